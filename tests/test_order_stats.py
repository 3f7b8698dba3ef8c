"""Exact selection against plain Python on small and on very uneven data."""

import hashlib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlab.operators import order_stats as o


@pytest.fixture(scope="module")
def uneven():
    """A third of the rows share one key; values tie heavily."""
    r = random.Random(5)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 == 0 else r.choice("abc")
        value = 1.5 if i % 3 == 0 else round(r.gauss(0, 1), 2)
        rows.append((f"t{i:05d}", group, value, None if i % 50 == 0 else value))
    return rows


@pytest.fixture(scope="module")
def frame(spark, uneven):
    return spark.createDataFrame(uneven, "ticket_id string, g string, v double, w double").repartition(6)


def test_quantiles_match_numpy(frame, uneven):
    values = [w for *_, w in uneven if w is not None]
    p = [0, 0.1, 0.25, 0.5, 0.77, 0.999, 1]
    assert o.quantile_list(frame, "w", p) == pytest.approx(list(np.quantile(values, p)), abs=1e-12)


def test_grouped_median(frame, uneven):
    got = {r["g"]: r["median"] for r in o.median(frame, "w", ["g"]).collect()}
    for g in ("hot", "a", "b", "c"):
        assert got[g] == pytest.approx(statistics.median(w for _, x, _, w in uneven if x == g and w is not None))


def test_null_group_and_empty_input(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    got = {r["g"]: r["median"] for r in o.median(df, "x", ["g"]).collect()}
    assert got == {None: 2.0, "a": 5.0}
    assert o.median(df.filter("x > 99"), "x").collect()[0]["median"] is None
    assert o.quantile_list(df.filter("x > 99"), "x", [0.5]) == []


def test_running_total(frame, uneven):
    got = o.running_total(frame.select("ticket_id", "g", F.lit(2).alias("n")), ["ticket_id"], "n", ["g"])
    for r in got.collect():
        ahead = [t for t, g, *_ in uneven if g == r["g"] and t <= r["ticket_id"]]
        assert r["running"] == 2 * len(ahead)


def test_positions(frame, uneven):
    got = {r["ticket_id"]: r["position"] for r in o.with_position(frame.select("v", "ticket_id"), ["v", "ticket_id"]).collect()}
    ordered = sorted((v, t) for t, _, v, _ in uneven)
    assert got == {t: i for i, (_, t) in enumerate(ordered)}


def test_keys_at(frame, uneven):
    ordered = sorted((v, t) for t, _, v, _ in uneven)
    keys = o.keys_at(frame, ["v", "ticket_id"], [0, 1500, 2999, 3000])
    assert keys[3] is None
    for p, k in zip([0, 1500, 2999], keys):
        assert (k["v"], k["ticket_id"]) == ordered[p]


@pytest.mark.parametrize("direct,factor", [(1_000_000, 100), (50, 3), (0, 1)])
def test_smallest(frame, uneven, monkeypatch, direct, factor):
    monkeypatch.setattr(o, "DIRECT", direct)
    monkeypatch.setattr(o, "SAMPLE_FACTOR", factor)
    ordered = sorted((v, t) for t, _, v, _ in uneven)
    got = [(r["v"], r["ticket_id"]) for r in o.smallest(frame, ["v", "ticket_id"], 40).collect()]
    assert got == ordered[:40]
    assert o.smallest(frame, ["v", "ticket_id"], 10_000).count() == 3000
    assert o.smallest(frame.filter("v > 99"), ["v", "ticket_id"], 5).count() == 0


def test_smallest_puts_nulls_first(frame, uneven, monkeypatch):
    monkeypatch.setattr(o, "DIRECT", 100)
    monkeypatch.setattr(o, "SAMPLE_FACTOR", 10)
    nulls = sorted(t for t, _, _, w in uneven if w is None)
    got = [r["ticket_id"] for r in o.smallest(frame, ["w", "ticket_id"], 10).collect()]
    assert got == nulls[:10]


@pytest.mark.parametrize("n", [1, 37, 2999, 3000, 5000])
def test_hash_sample(frame, uneven, n):
    got = sorted(r["ticket_id"] for r in o.hash_sample(frame, n, 9).select("ticket_id").collect())
    ordered = sorted((hashlib.md5(f"{t}|9".encode()).hexdigest(), t) for t, *_ in uneven)
    assert got == sorted(t for _, t in ordered[:n])


def test_pin_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, name):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        o.shared_folder(Session())
