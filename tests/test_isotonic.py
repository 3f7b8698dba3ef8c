"""Isotonic steps in groups of any size against plain pooling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlab.operators import calibration, isotonic


def pooled(x, y):
    """(x, value) of every distinct score, by pooling in one list."""
    levels = [(a, a, float((x == a).sum()), float(y[x == a].sum())) for a in np.unique(x)]
    stack = []
    for lo, hi, w, s in levels:
        while stack and stack[-1][3] / stack[-1][2] > s / w:
            a, _, w0, s0 = stack.pop()
            lo, w, s = a, w + w0, s + s0
        stack.append((lo, hi, w, s))
    return {a: next(s / w for lo, hi, w, s in stack if lo <= a <= hi) for a in np.unique(x)}


def interpolated(table, at):
    xs = np.array(sorted(table))
    return np.interp(at, xs, [table[a] for a in xs])


def shapes(n=150):
    r = np.random.default_rng(1)
    x = np.round(r.uniform(0, 1, n), 2)
    yield "noise", x, r.normal(size=n)
    yield "falling", x, -x
    yield "rising", x, x * 2
    yield "steps that fall back", x, np.floor(x * 5) - 3 * (x > 0.9)
    yield "a valley", x, np.abs(x - 0.5)
    yield "a peak", x, -np.abs(x - 0.5)
    yield "one score", np.zeros(n), x


@pytest.mark.parametrize("group, first, last", [(2, 0, 2), (16, 1, 7), (1 << 17, 0, 1)])
def test_steps_do_not_depend_on_groups(spark, monkeypatch, group, first, last):
    monkeypatch.setattr(isotonic, "GROUP", group)
    for name, x, y in list(shapes())[first:last]:
        df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "pred double, odds_after_10 double")
        fitted = calibration.fit_calibrator(df)
        got = dict(calibration.calibrate(df, fitted).select("pred", "calibrated").distinct().collect())
        want = pooled(x, y)
        assert set(got) == set(want)
        for a in want:
            assert got[a] == pytest.approx(want[a], abs=1e-9), (name, a)


def test_both_ways_to_look_up(spark, monkeypatch, tmp_path):
    r = np.random.default_rng(3)
    x, y = np.round(r.uniform(0, 1, 300), 2), r.normal(size=300)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "pred double, odds_after_10 double")
    calibration.fit_calibrator(df).save(f"{tmp_path}/c")
    fitted = isotonic.Calibrator.load(f"{tmp_path}/c")
    at = [*np.linspace(-0.2, 1.2, 97).tolist(), *x[:20].tolist(), float("inf"), float("-inf")]
    asked = spark.createDataFrame([(i, a) for i, a in enumerate([*at, None, float("nan"), *[0.5] * 40])], "i int, pred double")
    sent = dict(fitted.apply(asked, "pred", "c").select("i", "c").collect())
    monkeypatch.setattr(isotonic, "SENT", 0)
    ranged = dict(fitted.apply(asked, "pred", "c").select("i", "c").collect())
    want = interpolated(pooled(x, y), at)
    for i in range(len(at)):
        assert sent[i] == pytest.approx(want[i], abs=1e-9) and ranged[i] == pytest.approx(want[i], abs=1e-9)
    assert all(t[len(at)] is None and t[len(at) + 1] is None for t in (sent, ranged))
    assert len(sent) == len(ranged) == asked.count()
    empty = calibration.fit_calibrator(df.limit(0))
    assert empty.apply(asked, "pred", "c").filter("c is not null").count() == 0


def test_rows_without_score_or_outcome_do_not_count(spark):
    rows = [(0.1, 1.0), (0.2, 0.0), (0.3, 2.0), (None, 9.0), (0.2, None), (float("nan"), 1.0), (0.3, float("inf"))]
    df = spark.createDataFrame(rows, "pred double, odds_after_10 double")
    steps = calibration.fit_calibrator(df, scale=2).steps.orderBy("position").collect()
    assert [(s.lo, s.hi, s.value) for s in steps] == [(0.1, 0.2, 0.5), (0.3, 0.3, 2.0)]


def test_no_task_of_the_fit_takes_all_levels(spark, monkeypatch):
    monkeypatch.setattr(isotonic, "GROUP", 50)
    x = np.arange(2000) / 2000
    df = spark.createDataFrame(list(zip(x.tolist(), (x + 0.01 * np.sin(90 * x)).tolist())), "pred double, odds_after_10 double")
    steps = isotonic.fit_steps(df, "odds_after_10", "pred")
    assert steps.count() > 500
    values = [r.value for r in steps.orderBy("position").collect()]
    assert values == sorted(values)
    assert steps.agg(F.max("position")).first()[0] == len(values) - 1
