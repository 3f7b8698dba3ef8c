"""Joins, splits, policy, review, calibration and profile on small frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticketlab.config import SplitFractions
from ticketlab.operators import (
    analytics, calibration, enrich, features, filters, policy, profile, review, split,
)
from ticketlab.plans import jobs
from ticketlab.schema import ENRICH_COLUMNS
from ticketlab.sources import star
from ticketlab.sources.star import Aggregates


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- enrichment ----------------------------------------------------------------------------


def test_both_join_forms_agree_with_a_hot_key(spark, tickets):
    """One key holds over a third of the rows; some keys are null; some sides repeat keys."""
    hot = tickets.withColumn("hot", F.pmod(F.xxhash64("ticket_id"), F.lit(5)) < 2)
    t = hot.select(
        *[F.when(F.col("hot"), F.lit(v)).otherwise(F.col(k)).alias(k) for k, v in
          (("bettor_id", "77"), ("sport", "HOT"), ("market_name", "m"))],
        *[c for c in tickets.columns if c not in enrich.KEYS],
    ).withColumn("sport", F.when(F.col("pending_delay") == 4, None).otherwise(F.col("sport")))
    sides = star.aggregates(t, 4)
    twice = Aggregates(
        sides.bettor_stats.unionByName(sides.bettor_stats.filter("bettor_id = '12'")),
        sides.rejected, sides.risk_tier, sides.stake_size,
    )
    for s in (sides, twice):
        direct, keyed = enrich.enrich(t, s, 4, by_key=False), enrich.enrich(t, s, 4, by_key=True)
        assert direct.columns == keyed.columns == [*t.columns, *ENRICH_COLUMNS]
        plain = [c for c in direct.columns if not c.startswith("avg_rejected") and c != "risk_tier_avg_margin"]
        a, b = direct.select(*plain), keyed.select(*plain)
        assert a.count() == b.count()
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_small_sides_are_joined_directly(spark, tickets, tmp_path):
    files = {}
    for name, df in vars(star.aggregates(tickets, 4)).items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        files[name] = spark.read.parquet(f"{tmp_path}/{name}")
    plan = enrich.enrich(tickets, Aggregates(**files), 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_unique_check(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    enrich.check_unique(df, ["k", "v"])
    with pytest.raises(ValueError, match="duplicate key"):
        enrich.check_unique(df, ["k"])


def test_dominant_tier_ignores_nulls_and_breaks_ties_low(spark):
    df = spark.createDataFrame(
        [("a", 3, 5.0), ("a", 1, 5.0), ("a", None, 9.0), ("a", 4, None), ("b", None, 1.0)],
        "bettor_id string, ots_risk_tier_id bigint, volume double",
    ).withColumns({"pnl": F.lit(1.0), "margin": F.lit(0.5)})
    got = {r["bettor_id"]: r["dominant_risk_tier"] for r in enrich.risk_rollup(df).collect()}
    assert got == {"a": 1, "b": None}


# --- splits --------------------------------------------------------------------------------


def test_split_is_ordered_disjoint_and_complete(tickets):
    df = split.temporal_split(tickets, SplitFractions(0.6, 0.3))
    n = df.count()
    sizes = {r["split"]: r["n"] for r in split.split_counts(df).collect()}
    assert sizes["train"] == int(n * 0.6) and sizes["train"] + sizes["val"] == int(n * (0.6 + 0.3))
    key = F.struct("created_at", "ticket_id")
    edges = {r["split"]: r for r in df.groupBy("split").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
    assert edges["train"]["hi"] < edges["val"]["lo"] and edges["val"]["hi"] < edges["test"]["lo"]


def test_source_basis_can_empty_the_late_splits(tickets):
    kept = filters.apply_rules(tickets)
    df = split.temporal_split(kept, basis="source", source_rows=tickets.count())
    assert {r["split"] for r in split.split_counts(df).collect()} == {"train"}
    with pytest.raises(ValueError):
        split.temporal_split(kept, basis="source")
    with pytest.raises(ValueError):
        split.temporal_split(kept, basis="other")


def test_split_with_one_hot_time(spark):
    df = spark.createDataFrame(
        [("2020" if i % 2 else "2021", f"{i:04d}") for i in range(400)], "created_at string, ticket_id string"
    )
    sizes = {r["split"]: r["n"] for r in split.split_counts(split.temporal_split(df)).collect()}
    assert sizes == {"train": 280, "val": 60, "test": 60}


def test_cap_rows(tickets):
    ordered = [r[0] for r in tickets.orderBy("created_at", "ticket_id").limit(10).select("ticket_id").collect()]
    assert sorted(r[0] for r in split.cap_rows(tickets, 10).select("ticket_id").collect()) == sorted(ordered)
    assert split.cap_rows(tickets, 10**9).count() == tickets.count()


# --- policy --------------------------------------------------------------------------------


def test_policy_by_state_and_tier(spark):
    df = spark.createDataFrame(
        [("SKIP", "won", 10.0, 5.0), ("SKIP", "lost", 10.0, -1.0), ("SKIP", "rejected", 4.0, None),
         ("SKIP", "accepted", 7.0, float("nan")), ("PENDING", "rejected", 4.0, None), ("PENDING", "won", 1.0, 1.0),
         ("SKIP", None, 2.0, 3.0)],
        "model_tier string, ticket_state string, stake double, pnl double",
    )
    out = policy.policy(df)
    assert rows(out, "model_tier", "ticket_state", "factual_pnl", "counterfactual_pnl") == sorted(
        [("SKIP", "won", 5.0, 5.0), ("SKIP", "lost", -1.0, -1.0), ("SKIP", "rejected", 0.0, 4.0 * (4.0 / 20.0)),
         ("SKIP", "accepted", 0.0, 0.0), ("PENDING", "rejected", 0.0, 0.0), ("PENDING", "won", 1.0, 1.0),
         ("SKIP", None, 3.0, 3.0)], key=repr)
    s = policy.policy_summary(out).first()
    assert (s["n_total"], s["skip_count"], s["pending_count"], s["skip_rejected_count"]) == (7, 5, 2, 1)
    assert s["pnl_delta"] == pytest.approx(0.8) and s["pnl_delta_pct"] == pytest.approx(10.0)


def test_policy_without_settled_stake_or_profit(spark):
    df = spark.createDataFrame(
        [("SKIP", "rejected", 4.0, None), ("SKIP", "won", 0.0, 0.0)],
        "model_tier string, ticket_state string, stake double, pnl double",
    )
    assert policy.skip_yield(df).first()[0] == 0.0
    assert policy.policy_summary(policy.policy(df)).first()["pnl_delta_pct"] == 0.0
    shares = [tuple(r) for r in policy.tier_share(df).collect()]
    assert shares == [("SKIP", 2, 100.0), ("PENDING", 0, 0.0)]
    empty = policy.policy_summary(policy.policy(df.limit(0))).first()
    assert (empty["n_total"], empty["skip_rate"], empty["pnl_delta"]) == (0, 0.0, 0.0)


# --- review --------------------------------------------------------------------------------


def test_review_sample_holds_the_worst(tickets):
    df = policy.classify(jobs.proxy_score(tickets), "pred").withColumn("predicted_clv", F.col("pred"))
    sample = review.review_sample(df)
    assert sample.count() == 100 and sample.select("ticket_id").distinct().count() == 100
    worst = {r[0] for r in review.worst(df).select("ticket_id").collect()}
    assert worst <= {r[0] for r in sample.select("ticket_id").collect()}
    small = df.limit(60)
    assert review.review_sample(small).count() == small.filter("model_tier = 'PENDING'").count()


def test_review_tables(spark):
    df = spark.createDataFrame(
        [("1", "s", "won", -0.02, -0.1), ("2", "s", "rejected", None, -0.2), ("3", None, None, 0.5, -0.3)],
        "ticket_id string, sport string, ticket_state string, odds_after_10 double, predicted_clv double",
    )
    head = review.review_summary(df).first()
    assert (head["n"], head["n_sharp"], head["pct_sharp"], head["n_rejected"]) == (3, 1, 33.3, 1)
    assert [tuple(r) for r in review.review_by_sport(df).collect()] == [("s", 1, 50.0, -0.02)]
    assert rows(review.review_states(df), "state", "count") == [("rejected", 1), ("won", 1)]
    bins = review.histogram(features.with_sharp(df), n_bins=2)
    assert rows(bins, "bin", "sharp", "n") == [(0, "Sharp (< -0.01)", 1), (1, "Not sharp", 1)]
    assert [r["predicted_clv"] for r in review.review_detail(df).collect()] == [-0.3, -0.2, -0.1]
    with pytest.raises(ValueError):
        review.review_detail(df, "stake")


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(0.5, "x"), (0.5, "x")], "odds_after_10 double, sharp string")
    assert rows(review.histogram(df), "bin", "n") == [(0, 2)]


# --- calibration ---------------------------------------------------------------------------


def test_bins_match_qcut_with_ties(spark):
    pred = [1.0] * 30 + [2.0] * 5 + [3.0] * 40 + [float(i) / 7 for i in range(25)]
    pdf = pd.DataFrame({"pred": pred, "odds_after_10": [p * 2 for p in pred]})
    for q in (4, 10):
        expected = pdf.groupby(pd.qcut(pdf["pred"], q, duplicates="drop"), observed=True)["pred"].agg(["count", "mean"])
        got = calibration.calibration_report(spark.createDataFrame(pdf), n_bins=q).collect()
        assert [r["n"] for r in got] == list(expected["count"])
        assert [r["mean_predicted"] for r in got] == pytest.approx(list(expected["mean"]))


def test_bins_of_one_value_and_of_nothing(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.5, 2.0)], "pred double, odds_after_10 double")
    assert [(r["bin_lo"], r["n"]) for r in calibration.calibration_report(df).collect()] == [(0.5, 2)]
    assert calibration.calibration_report(df.limit(0)).count() == 0


def test_calibrator_is_monotone_clipped_and_no_worse(tickets):
    df = jobs.proxy_score(filters.valid_target(tickets))
    m = calibration.fit_calibrator(df)
    out = calibration.calibrate(df, m)
    ordered = [r["calibrated"] for r in out.orderBy("pred").select("calibrated").collect()]
    assert all(a <= b + 1e-12 for a, b in zip(ordered, ordered[1:]))
    e = out.agg(F.avg((F.col("pred") - F.col("odds_after_10")) ** 2), F.avg((F.col("calibrated") - F.col("odds_after_10")) ** 2)).first()
    assert e[1] <= e[0]
    far = calibration.calibrate(df.limit(1).withColumn("pred", F.lit(99.0)), m).first()["calibrated"]
    assert far == pytest.approx(ordered[-1])
    assert calibration.calibrate(df, None).filter("pred <> calibrated").count() == 0


def test_metrics_of_a_single_row(spark):
    df = spark.createDataFrame([(1.0, 3.0)], "odds_after_10 double, pred double")
    m = calibration.regression_metrics(df).first()
    assert (m["mae"], m["rmse"], m["median_ae"], m["std_pred"], m["correlation"]) == (2.0, 2.0, 2.0, 0.0, 0.0)


# --- profile -------------------------------------------------------------------------------


def test_correlations_match_pandas(spark):
    pdf = pd.DataFrame({
        "a": [1.0, 2.0, 3.0, 4.0, 5.0], "b": [2.0, 4.1, 6.0, 8.0, 10.0],
        "c": [5.0, None, 1.0, 0.0, 2.0], "k": [7.0] * 5, "odds_after_10": [0.1, -0.2, 0.3, 0.0, 0.5],
    })
    df = spark.createDataFrame(pdf)
    expected = pdf[["a", "b", "c", "k"]].corr()
    for r in profile.corr_matrix(df, ["a", "b", "c", "k"]).collect():
        want = expected.loc[r["feature_1"], r["feature_2"]]
        assert (r["correlation"] is None) if pd.isna(want) else r["correlation"] == pytest.approx(want)
    target = {r["feature"]: r["abs_correlation"] for r in profile.corr_with_target(df, ["a", "c", "k"]).collect()}
    assert target["a"] == pytest.approx(abs(pdf["a"].corr(pdf["odds_after_10"]))) and target["k"] is None
    assert [(r[0], r[1]) for r in profile.high_corr_pairs(df, ["a", "b", "c", "k"]).collect()] == [("a", "b")]
    assert profile.high_corr_pairs(df, ["a"]).count() == 0


def test_correlations_do_not_depend_on_how_states_meet(spark, tickets, monkeypatch):
    names = ["stake", "selection_odds", "odds_after_30", "odds_after_90", "oaf"]
    whole = rows(profile.corr_matrix(tickets, names), "feature_1", "feature_2")
    monkeypatch.setattr(profile, "GROUPS", 3)
    assert rows(profile.corr_matrix(tickets, names), "feature_1", "feature_2") == whole


# --- browsing ------------------------------------------------------------------------------


def test_browse(tickets):
    page = analytics.browse(tickets, ["ticket_id", "stake"], max_rows=5, order=("stake", "ticket_id"))
    first = [tuple(r) for r in tickets.orderBy("stake", "ticket_id").select("ticket_id", "stake").limit(5).collect()]
    assert [tuple(r) for r in page.collect()] == first
    assert analytics.browse(tickets, max_rows=7, order=None).count() == 7
    assert analytics.browse_count(tickets, state="won", min_stake=10.0).first()["n"] == tickets.filter(
        "ticket_state = 'won' AND stake >= 10").count()
    assert analytics.browse(tickets, sport="NOWHERE").count() == 0


def test_registered_view(spark, tickets):
    analytics.register(tickets, "tickets")
    assert spark.sql("SELECT count(*) FROM tickets").first()[0] == tickets.count()


def test_inspection(tickets):
    out = jobs.inspect(tickets, [("LOW", 0.0), ("HIGH", None)])
    assert set(out) == {"shape", "columns", "target_stats", "band_distribution", "state_counts", "rule_audit"}
    assert out["shape"].first()["n_columns"] == 31 and out["columns"].count() == 31


def test_split_with_missing_times(spark):
    """Rows without a time come first, ordered by ticket."""
    df = spark.createDataFrame(
        [(None if i < 150 else "2020", f"{i:04d}") for i in range(200)], "created_at string, ticket_id string"
    )
    got = split.temporal_split(df, SplitFractions(0.5, 0.4))
    names = {r["ticket_id"]: r["split"] for r in got.collect()}
    assert [names[f"{i:04d}"] for i in (0, 99, 100, 149, 150, 179, 180, 199)] == [
        "train", "train", "val", "val", "val", "val", "test", "test",
    ]


def test_correlations_of_33_columns_are_one_scan(spark, tmp_path):
    """Against numpy over the rows where both are present, with gaps, large means and flat columns."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(3000, 33)) + draw.normal(size=(3000, 1))
    x[:, 1] += 1e9
    x[:, 2] = x[:, 1] * 3 + 7
    x[:, 3] = 0.1
    x[draw.random(x.shape) < 0.1] = np.nan
    x[:, 5] = np.where(np.arange(3000) < 1, x[:, 5], np.nan)
    names = [f"c{i}" for i in range(33)]
    spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in names)).repartition(7).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    got = profile.corr_matrix(df, names)
    assert got._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("FileScan parquet") == 1
    rows = {(r.feature_1, r.feature_2): r.correlation for r in got.collect()}
    assert len(rows) == 33 * 33
    for (a, b), r in rows.items():
        i, j = names.index(a), names.index(b)
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        if {i, j} & {3, 5}:
            assert r is None
        else:
            u, v = (x[both, c] - x[both, c].mean() for c in (i, j))
            assert r == pytest.approx((u @ v) / np.sqrt((u @ u) * (v @ v)), abs=1e-7)
    nothing = profile.corr_with_target(df.limit(0), names[1:], "c0").collect()
    assert len(nothing) == 32 and {r.abs_correlation for r in nothing} == {None}
    odd = spark.createDataFrame([(1.0, float("inf")), (2.0, 3.0), (3.0, 1.0)], "a double, b double")
    found = {(r.feature_1, r.feature_2): r.correlation for r in profile.corr_matrix(odd, ["a", "b"]).collect()}
    assert found.pop(("a", "a")) == pytest.approx(1.0) and set(found.values()) == {None}
