"""Leaf-wise trees against a plain search, whatever the partitioning."""

import heapq
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ticketlab.config import BoostParams
from ticketlab.operators import boosting, model, order_stats

PARAMS = BoostParams(
    rounds=3, learning_rate=0.5, max_leaves=7, min_leaf=3, feature_fraction=1.0, bagging_fraction=1.0, checkpoint_every=2
)


def made(seed, n=300):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.integers(0, 12, n), np.round(r.normal(size=n), 1), r.integers(0, 9, n)]).astype(float)
    y = 0.1 * x[:, 0] + np.sin(3 * x[:, 1]) + np.array([3, -2, 1, 0, 5, -4, 2, -1, 0.5])[x[:, 2].astype(int)] * 0.3
    return x, np.round(y + r.normal(size=n) * 0.1, 4)


def frame(spark, x, y, parts):
    rows = [(f"k{i}", Vectors.dense(*a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType().add("ticket_id", StringType()).add("features", VectorUDT()).add("_label", DoubleType())
    return order_stats.pin(spark.createDataFrame(rows, schema).repartition(parts))


def best_cut(x, g, rows, p, groups):
    best = (0.0,)
    for f in range(x.shape[1]):
        v = x[rows, f]
        if f in groups:
            keys = sorted(set(v), key=lambda c: (g[rows][v == c].mean(), c))
            sides = [np.isin(v, keys[: k + 1]) for k in range(len(keys) - 1)]
        else:
            sides = [v <= a for a in sorted(set(v))[:-1]]
        for left in sides:
            if min(left.sum(), (~left).sum()) < p.min_leaf:
                continue
            a, b = g[rows][left], g[rows][~left]
            gain = a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b) - g[rows].sum() ** 2 / len(rows)
            if gain > best[0] + 1e-9:
                best = (gain, rows[left], rows[~left])
    return best


def plain(x, y, p, groups=()):
    score = np.full(len(y), y.mean())
    for _ in range(p.rounds):
        g = np.clip(y - score, -p.huber_delta, p.huber_delta)
        leaves, heap, n = [], [], 0
        everything = np.arange(len(y))
        heapq.heappush(heap, (-best_cut(x, g, everything, p, groups)[0], n, everything))
        while heap and len(heap) + len(leaves) < p.max_leaves:
            gain, _, rows = heapq.heappop(heap)
            cut = best_cut(x, g, rows, p, groups)
            if not gain:
                leaves.append(rows)
                continue
            for side in cut[1:]:
                n += 1
                heapq.heappush(heap, (-best_cut(x, g, side, p, groups)[0], n, side))
        step = np.zeros(len(y))
        for rows in [*leaves, *(h[2] for h in heap)]:
            step[rows] = g[rows].mean()
        score = score + p.learning_rate * step
    return score


def scores(spark, df, p, groups=None):
    with order_stats.scratch(spark) as folder:
        booster, used, _ = boosting.boost(df, None, p, "ticket_id", 3, groups or {}, folder)
    assert used == p.rounds
    out = df.withColumn("s", booster.column(F.col("features"))).select("ticket_id", "s").collect()
    return booster, np.array([s for _, s in sorted((int(k[1:]), s) for k, s in out)])


# few: how many rows are finished on their rows; 0 asks for sums all the way down.
@pytest.mark.parametrize("seed, parts, few", [(1, 1, 0), (1, 4, 40), (2, 3, 0), (2, 3, 1000)])
def test_trees_are_those_of_a_plain_search(spark, monkeypatch, seed, parts, few):
    monkeypatch.setattr(boosting, "FEW", few)
    monkeypatch.setattr(boosting, "TASK_ROWS", 10)
    monkeypatch.setattr(boosting, "BLOCK", 64)
    x, y = made(seed)
    df = frame(spark, x, y, parts)
    booster, got = scores(spark, df, PARAMS)
    assert got == pytest.approx(plain(x, y, PARAMS), abs=1e-8)
    assert max(sum(f < 0 for f in t.feature) for t in booster.trees) == PARAMS.max_leaves
    _, shallow = scores(spark, df, replace(PARAMS, max_depth=1))
    assert shallow == pytest.approx(plain(x, y, replace(PARAMS, max_leaves=2)), abs=1e-8)


def test_categories_are_split_into_the_best_groups(spark):
    x, y = made(3)
    _, got = scores(spark, frame(spark, x, y, 2), PARAMS, {2: 10})
    assert got == pytest.approx(plain(x, y, PARAMS, {2}), abs=1e-8)


def test_a_feature_with_a_thousand_categories(spark):
    r = np.random.default_rng(4)
    effect = r.normal(size=1000)
    x = np.column_stack([r.integers(0, 1000, 6000), np.zeros(6000), np.zeros(6000)]).astype(float)
    y = np.round(effect[x[:, 0].astype(int)] * 0.3 + r.normal(size=6000) * 0.01, 4)
    p = replace(PARAMS, rounds=1, max_leaves=2)
    booster, got = scores(spark, frame(spark, x, y, 2), p, {0: 1001})
    assert len(booster.trees[0].group[0]) > 255
    assert got == pytest.approx(plain(x, y, p, {0}), abs=1e-8)


def test_the_same_trees_on_any_partitioning_and_after_reloading(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(boosting, "TASK_ROWS", 10)
    x, y = made(5, 800)
    p = replace(PARAMS, rounds=5, feature_fraction=0.7, bagging_fraction=0.6, bagging_every=2)
    found = []
    for parts in (1, 5, 20):
        booster, got = scores(spark, frame(spark, x, y, parts), p)
        found.append((booster.trees, got.tolist()))
    assert found[0] == found[1] == found[2]
    booster.save(f"{tmp_path}/b")
    assert boosting.Booster.load(f"{tmp_path}/b") == booster
    used = {f for t in booster.trees for f in t.feature if f >= 0}
    assert used <= {0, 1, 2} and all(len({f for f in t.feature if f >= 0}) <= 3 for t in booster.trees)


def test_bins_of_many_values_and_of_a_sample(spark, monkeypatch):
    r = np.random.default_rng(6)
    x = np.column_stack([r.normal(size=2000), r.integers(0, 5, 2000), np.zeros(2000)]).astype(float)
    df = frame(spark, x, x[:, 0], 3)
    edges = boosting.bin_edges(df, 3, "ticket_id", 16, {})
    assert [len(e) for e in edges] == [15, 4, 0] and edges[1].tolist() == [0.5, 1.5, 2.5, 3.5]
    shares = np.bincount(np.searchsorted(edges[0], x[:, 0])) / 2000
    assert shares == pytest.approx(np.full(16, 1 / 16), abs=0.002)
    monkeypatch.setattr(boosting, "BIN_ROWS", 500)
    shares = np.bincount(np.searchsorted(boosting.bin_edges(df, 3, "ticket_id", 16, {})[0], x[:, 0])) / 2000
    assert shares == pytest.approx(np.full(16, 1 / 16), abs=0.05)
    with pytest.raises(ValueError):
        boosting.bin_edges(df.limit(0), 3, "ticket_id", 16, {})


def test_declared_categories_of_a_model(spark):
    r = np.random.default_rng(7)
    kinds = [f"k{i:03d}" for i in range(400)]
    effect = dict(zip(kinds, r.normal(size=400)))
    rows = [(f"t{i}", k := kinds[i % 400], float(effect[k] + r.normal() * 0.01)) for i in range(4000)]
    df = spark.createDataFrame(rows, "ticket_id string, sport string, odds_after_10 double")
    p = replace(PARAMS, rounds=2, min_leaf=1)
    fitted, _ = model.train(df, ["sport"], p, categorical=["sport"])
    codes = dict(fitted.encode(df).select("sport", F.col("_cat_sport")).distinct().collect())
    assert len(set(codes.values())) == 400
    x = np.array([[codes[s]] for _, s, _ in rows])
    got = dict(fitted.score(df).select("ticket_id", "raw_score").collect())
    want = plain(x, np.array([y for *_, y in rows]), p, {0})
    assert [got[f"t{i}"] for i in range(4000)] == pytest.approx(want.tolist(), abs=1e-7)
    unseen = fitted.score(df.limit(1).withColumn("sport", F.lit("new"))).first()["raw_score"]
    assert np.isfinite(unseen)
