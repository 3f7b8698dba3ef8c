"""Named queries over the star-schema tables; each takes the session and a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlab import functions as fn
from ticketlab.config import BoostParams, Rule, DEFAULT_RULES, Settings
from ticketlab.operators import (
    analytics,
    calibration,
    enrich,
    features,
    filters,
    model,
    order_stats,
    policy,
    profile,
    review,
    split,
)
from ticketlab.plans import jobs
from ticketlab.schema import AGGREGATES, DEFAULT_FEATURES, DELAY, DELAYED, DELAYED_COUNT, TARGET
from ticketlab.sources import files, star
from ticketlab.sources.star import MONEY

Query = Callable[[SparkSession, str], DataFrame]

BANDS = (("HIGHER", -0.02), ("STATIC", 0.0), ("LOWER", 0.02), ("SKIP", None))
AUDIT_RULES = (*DEFAULT_RULES, Rule("sport", "!=", "BUILDING"), Rule("absent", ">", 0))
PROFILE_NUMBERS = (
    "selection_odds", "stake", DELAY, "client_id", "market_type_id", "stake_ratio",
    "mean_stake_size", "odds_after_30", "odds_after_90",
)
ODDS = 4  # decimals of the price movements
# Ticket columns that the four aggregates are made of.
AGGREGATED = (
    *enrich.KEYS, "reject_reason", "ticket_state", "ots_risk_tier_id", "stake", "pnl",
    "odds_after_10", "odds_after_30", "odds_after_90",
)
# Ticket columns that training or its rules and engineered columns read, and those of ``star.base`` that these do not need.
TRAINED = (
    "ticket_id", "created_at", "bettor_id", TARGET, "bos", "selection_odds", "stake", DELAY, "market_selection", "sport",
    "client_id", "market_type_id",
)
UNTRAINED = ("l_shipdate", "rejected", "open", "o_orderpriority", "p_name", "market_name")
# A fit that SQL can repeat: one string feature, each of its values a leaf, all rows in each round.
EXACT = BoostParams(
    rounds=3, learning_rate=0.3, max_depth=6, min_leaf=1, feature_fraction=1.0, bagging_fraction=1.0, checkpoint_every=2
)
# One that it can repeat with two features, validation and an early end: each tree one split.
EARLY = BoostParams(
    rounds=12, learning_rate=0.7, patience=2, max_leaves=2, min_leaf=20, feature_fraction=1.0, bagging_fraction=1.0,
    checkpoint_every=5,
)
EARLY_FEATURES = ("sport", "selection_odds")
FULL = Settings().boost
QUICK = BoostParams(rounds=4, learning_rate=0.3, patience=2, max_depth=4, checkpoint_every=2)


def scratch(spark: SparkSession) -> str:
    """A new folder name beside the checkpoints, which all executors can reach."""
    return f"{order_stats.shared_folder(spark)}/run-{uuid.uuid4().hex[:12]}"


def once(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns written once, for operators that pass over them several times."""
    return order_stats.pin(df.select(*columns))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: fn.round_half_away(c, digits) for c in columns})


tickets = star.tickets


def sides(spark, sf):
    return star.aggregates(tickets(spark, sf), MONEY)


def whole(spark, sf, folder):
    """``tickets`` for work on all their columns: large star tables are joined by buckets, in ``folder``."""
    n = star.buckets(spark, sf)
    return star.derive(star.base_by_buckets(spark, sf, n, folder)) if n else tickets(spark, sf)


def by_bettor(spark, sf):
    """The stored rows of ``star.base``, each part with whether it is read by buckets of its bettors.

    That is one table, or where the star tables are too large for broadcasts those in
    buckets and, if there are any, the rows of bettors too large for a bucket.
    """
    n = star.buckets(spark, sf)
    if not n:
        return [(order_stats.pin(star.base(spark, sf)), False)]
    with order_stats.scratch(spark) as passing:
        return order_stats.in_parts(star.base_by_buckets(spark, sf, n, passing), "bettor_id", n)[0]


def merged(spark, sf, by_key=None):
    """The star tables are joined once; tickets are derived behind the enrichment, which is one for each part of the bettors."""
    parts = []
    for rows, bucketed in by_bettor(spark, sf):
        aggregates = star.aggregates(star.derive(rows), MONEY)
        direct = False if bucketed and by_key is None else by_key
        parts.append(star.derive(enrich.enrich(rows, aggregates, MONEY, direct, star.ROW)))
    return reduce(DataFrame.unionByName, parts)


def merged_sides(spark, sf):
    """The keys and the aggregate columns alone of the merged tickets, for reports on these."""
    rows = once(tickets(spark, sf), "ticket_id", *AGGREGATED)
    return enrich.enrich(rows, star.aggregates(rows, MONEY), MONEY)


def featured(spark, sf, by_key=None, names=None, without=()):
    """Kept tickets with the mean stake and the engineered columns.

    With ``names`` only these columns of a ticket, and none of ``star.base`` that is in ``without``.
    """
    rows = order_stats.pin(star.base(spark, sf).drop(*without))
    stake = star.stake_size(star.derive(rows, names), MONEY)
    return jobs.prepare(star.derive(enrich.with_stake_size(rows, stake, by_key, star.ROW), names))


def trainable(spark, sf):
    """What training reads of ``featured``; the other columns are not joined, stored or shuffled."""
    return featured(spark, sf, None, TRAINED, UNTRAINED)


def kept(spark, sf):
    return filters.apply_rules(filters.valid_target(tickets(spark, sf)))


def scored(spark, sf):
    return jobs.proxy_score(kept(spark, sf))


def tiered(spark, sf):
    return policy.classify(scored(spark, sf), "pred")


def delayed(spark, sf):
    """Tickets to delay as the review sees them."""
    rows = tiered(spark, sf).filter(F.col("model_tier") == DELAYED)
    return rows.withColumn("predicted_clv", F.col("pred"))


def _merged_rounded(df):
    """Averages of averages depend on the order of summation in their last digit."""
    averages = [f"avg_rejected_odds_after_{s}" for s in (10, 30, 90)]
    df = rounded(df, 11, *[c for c in averages if c in df.columns])
    return rounded(df, 6, *[c for c in ["risk_tier_avg_margin"] if c in df.columns])


# --- aggregates and joins ------------------------------------------------------------------


def rejected_rollup(spark, sf):
    return _merged_rounded(enrich.rejected_rollup(sides(spark, sf).rejected, MONEY))


def risk_rollup(spark, sf):
    return _merged_rounded(enrich.risk_rollup(sides(spark, sf).risk_tier, MONEY))


# --- reports -------------------------------------------------------------------------------


def overview(spark, sf):
    df = once(
        tickets(spark, sf), "bettor_id", "sport", "match_id", "ticket_state", TARGET, "stake", "pnl"
    )
    return rounded(analytics.overview(df, MONEY), 6, "avg_clv", "med_clv")


def target_stats(spark, sf):
    df = analytics.target_stats(once(tickets(spark, sf), TARGET), TARGET, MONEY)
    return rounded(df, 6, "mean_val", "std_val", "median_val")


def clv_by_state(spark, sf):
    df = once(tickets(spark, sf), "ticket_state", TARGET, "stake", "pnl")
    return analytics.clv_by_state(df, MONEY)


def browse(spark, sf):
    return analytics.browse(
        tickets(spark, sf),
        ["ticket_id", "sport", "ticket_state", "reject_reason", "stake", "odds_after_10"],
        max_rows=1000, state="rejected", min_stake=100.0,
    )


def browse_count(spark, sf):
    return analytics.browse_count(
        tickets(spark, sf), state="rejected", sport="MACHINERY", reason="1-URGENT", min_stake=100.0
    )


def distinct_values(spark, sf):
    return analytics.distinct_values(tickets(spark, sf), "market_name")


# --- rows and features ---------------------------------------------------------------------


def valid_target(spark, sf):
    return filters.valid_target(tickets(spark, sf)).select("ticket_id", TARGET)


def apply_rules(spark, sf):
    return kept(spark, sf).select("ticket_id", "bos", DELAY, TARGET)


def stake_ratio(spark, sf):
    return featured(spark, sf).select("ticket_id", "stake", "mean_stake_size", "stake_ratio")


def odds_bucket(closed):
    def run(spark, sf):
        df = features.with_odds_bucket(tickets(spark, sf), closed)
        return df.groupBy("odds_bucket").agg(
            F.count("*").alias("n"), F.min("selection_odds").alias("lowest"),
            F.max("selection_odds").alias("highest"),
        )

    return run


def sharp_flag(spark, sf):
    return features.with_sharp(tickets(spark, sf)).select("ticket_id", TARGET, "sharp")


def fill_categories(spark, sf):
    df = features.fill_categories(tickets(spark, sf), ["reject_reason", "sport"])
    return df.select("ticket_id", "reject_reason", "sport")


def clean_label(spark, sf):
    df = features.labels(tickets(spark, sf))
    return df.groupBy(TARGET).agg(F.count("*").alias("n"))


def resolve_features(spark, sf):
    df = featured(spark, sf)
    return df.select("ticket_id", *features.resolve_features(df, DEFAULT_FEATURES))


SPLIT = ("ticket_id", "created_at", TARGET)

# --- splits --------------------------------------------------------------------------------


def split_kept(spark, sf):
    return split.temporal_split(once(kept(spark, sf), *SPLIT)).select("ticket_id", "split")


def split_source(spark, sf):
    rows = tickets(spark, sf).count()
    df = split.temporal_split(once(kept(spark, sf), *SPLIT), basis="source", source_rows=rows)
    return split.split_counts(df)


def split_counts(spark, sf):
    return split.split_counts(split.temporal_split(once(kept(spark, sf), *SPLIT)))


def label_stats(spark, sf):
    df = split.label_stats(split.temporal_split(once(kept(spark, sf), *SPLIT)), TARGET, MONEY)
    return rounded(df, 6, "mean_label", "std_label")


def cap_rows(spark, sf):
    return split.cap_rows(once(kept(spark, sf), *SPLIT), 5000).select("ticket_id", "created_at")


# --- policy --------------------------------------------------------------------------------


def classify(spark, sf):
    return tiered(spark, sf).select("ticket_id", "pred", "model_tier")


def classify_bands(spark, sf):
    df = policy.classify_bands(scored(spark, sf), "pred", BANDS)
    return df.groupBy("model_tier").agg(F.count("*").alias("n"))


def policy_rows(spark, sf):
    return policy.policy(tiered(spark, sf), MONEY).select(
        "ticket_id", "ticket_state", "model_tier", "factual_pnl", "counterfactual_pnl"
    )


def policy_summary(spark, sf):
    df = policy.policy_summary(policy.policy(tiered(spark, sf), MONEY))
    df = rounded(df, 2, "factual_pnl", "counterfactual_pnl", "pnl_delta")
    return rounded(df, 4, "pnl_delta_pct")


# --- evaluation ----------------------------------------------------------------------------


def regression_metrics(spark, sf):
    df = calibration.regression_metrics(once(scored(spark, sf), TARGET, "pred"))
    return rounded(df, 6, *df.columns)


def calibration_report(spark, sf):
    df = calibration.calibration_report(once(scored(spark, sf), TARGET, "pred"))
    return rounded(rounded(df, 9, "bin_lo", "bin_hi"), 6, "mean_predicted", "mean_actual", "abs_error")


def calibration_bins(spark, sf):
    df = calibration.calibration_bins(once(scored(spark, sf), TARGET, "pred"))
    return rounded(rounded(df, 9, "bin_lo", "bin_hi"), 6, "mean_pred", "mean_actual", "std_actual")


def isotonic(spark, sf):
    """Calibrated value of each score."""
    df = once(scored(spark, sf), "pred", TARGET)
    calibrator = calibration.fit_calibrator(df, TARGET, "pred", ODDS)
    levels = df.groupBy(F.col("pred").alias("score")).agg(F.count("*").alias("n"))
    return rounded(calibration.calibrate(levels, calibrator, "score", "calibrated"), 6, "calibrated")


def isotonic_unseen(spark, sf):
    """Calibrated value of scores between, below and above those of the fit."""
    df = once(scored(spark, sf), "ticket_id", "pred", TARGET)
    calibrator = calibration.fit_calibrator(df.filter("pred > -0.05 and pred < 0.05"), TARGET, "pred", ODDS)
    moved = df.select("ticket_id", (F.col("pred") * 1.5 + 0.00007).alias("score"))
    return rounded(calibration.calibrate(moved, calibrator, "score", "calibrated"), 6, "calibrated").drop("score")


# --- review --------------------------------------------------------------------------------

REVIEW = ["ticket_id", "sport", "ticket_state", "stake", "predicted_clv", TARGET]


def worst_50(spark, sf):
    return review.worst(once(delayed(spark, sf), *REVIEW))


def review_sample(spark, sf):
    df = tiered(spark, sf).withColumn("predicted_clv", F.col("pred"))
    return review.review_sample(once(df, *REVIEW, "model_tier")).select(*REVIEW)


def review_points(spark, sf):
    return review.review_points(delayed(spark, sf), "predicted_clv")


def review_detail(spark, sf):
    return review.review_detail(delayed(spark, sf), "stake", ascending=False)


def review_summary(spark, sf):
    return rounded(review.review_summary(delayed(spark, sf)), 6, "avg_predicted_clv")


def review_by_sport(spark, sf):
    df = review.review_by_sport(delayed(spark, sf), MONEY)
    return rounded(df, 6, "pct_sharp", "mean_clv")


def review_states(spark, sf):
    return review.review_states(delayed(spark, sf))


def histogram(spark, sf):
    return rounded(review.histogram(features.with_sharp(once(delayed(spark, sf), TARGET))), 6, "bin_lo")


def scatter_points(spark, sf):
    return review.scatter_points(once(scored(spark, sf), "ticket_id", TARGET, "pred"))


def sample_n(spark, sf):
    return review.sample_n(once(kept(spark, sf), "ticket_id", TARGET), 2000, 7)


# --- profile -------------------------------------------------------------------------------


def feature_coverage(spark, sf):
    df = featured(spark, sf)
    out = profile.feature_coverage(df, ["mean_stake_size", "reject_reason", "accepted_at", *DEFAULT_FEATURES])
    return rounded(out, 6, "non_null_pct")


def profiled(spark, sf):
    return once(featured(spark, sf), *PROFILE_NUMBERS, TARGET)


def corr_with_target(spark, sf):
    df = profile.corr_with_target(profiled(spark, sf), PROFILE_NUMBERS)
    return rounded(df, 6, "abs_correlation")


def corr_matrix(spark, sf):
    df = profile.corr_matrix(profiled(spark, sf), PROFILE_NUMBERS)
    return rounded(df, 6, "correlation")


def high_corr_pairs(spark, sf):
    return profile.high_corr_pairs(profiled(spark, sf), PROFILE_NUMBERS, 0.4)


# --- model ---------------------------------------------------------------------------------


def _trained(spark, sf, boost=FULL):
    known = once(featured(spark, sf, None, TRAINED, UNTRAINED), "ticket_id", "created_at", TARGET, *DEFAULT_FEATURES)
    rows = split.temporal_split(known)
    train_rows, val_rows = (rows.filter(F.col("split") == s) for s in ("train", "val"))
    fitted, _ = model.train(train_rows, DEFAULT_FEATURES, boost, val_rows)
    return fitted, rows


def train_score(spark, sf, boost=FULL):
    fitted, rows = _trained(spark, sf, boost)
    return fitted.score(rows.filter(F.col("split") == "test")).select("ticket_id", TARGET, "raw_score")


def _trained_exact(spark, sf):
    rows = once(kept(spark, sf), "ticket_id", "sport", TARGET)
    return model.train(rows, ["sport"], EXACT)[0], rows


def train_exact(spark, sf):
    """Scores of a model whose rounds are plain means per sport."""
    fitted, rows = _trained_exact(spark, sf)
    return rounded(fitted.score(rows).select("ticket_id", "raw_score"), 9, "raw_score")


def reload_score(spark, sf):
    """The same after saving and loading the model."""
    fitted, rows = _trained_exact(spark, sf)
    path = f"{scratch(spark)}/model"
    fitted.save(path)
    again = model.TicketModel.load(path)
    return rounded(again.score(rows).select("ticket_id", "raw_score"), 9, "raw_score")


def importance_exact(spark, sf):
    """Gain and splits of that model."""
    fitted, _ = _trained_exact(spark, sf)
    return rounded(model.importance(fitted, spark), 4, "gain")


def permutation_exact(spark, sf):
    """Rise of its MAE when tickets take the sport of their partner."""
    fitted, rows = _trained_exact(spark, sf)
    return rounded(model.permutation_importance(fitted, rows), 9, "mae_increase")


def _trained_early(spark, sf):
    gaps = F.when(F.col("market_type_id") % 7 != 0, F.col("selection_odds"))
    known = once(kept(spark, sf).withColumn("selection_odds", gaps), "ticket_id", "created_at", TARGET, *EARLY_FEATURES)
    rows = order_stats.pin(split.temporal_split(known))
    train_rows, val_rows = (rows.filter(F.col("split") == s) for s in ("train", "val"))
    fitted, _ = model.train(train_rows, EARLY_FEATURES, EARLY, val_rows)
    return fitted, rows


def train_early(spark, sf):
    """Scores of a model of two features, one with gaps, that ends early, and after how many rounds."""
    fitted, rows = _trained_early(spark, sf)
    scored = fitted.score(rows).select("ticket_id", "split", "raw_score")
    return rounded(scored, 8, "raw_score").withColumn("best_iteration", F.lit(fitted.best_iteration))


def importance_early(spark, sf):
    """Gain and splits of that model, the leading ones first."""
    fitted, _ = _trained_early(spark, sf)
    return rounded(model.top_importance(model.importance(fitted, spark)), 6, "gain")


def metrics_early(spark, sf):
    """Validation record of that model."""
    fitted, rows = _trained_early(spark, sf)
    top = model.top_importance(model.importance(fitted, spark))
    n_train = rows.filter(F.col("split") == "train").count()
    record = model.train_metrics(fitted, n_train, rows.filter(F.col("split") == "val"), top)
    record = record.withColumn("leading", F.col("feature_importance_top20")[0]["feature"])
    return rounded(record.drop("features_used", "feature_importance_top20"), 8, "val_mae", "val_rmse")


def _stored_early(spark, sf):
    """Splits, model and training record of that model in a folder, as the training job leaves them."""
    fitted, parts = _trained_early(spark, sf)
    root = scratch(spark)
    rows = kept(spark, sf).join(parts.select("ticket_id", "split", F.col("selection_odds").alias("_gaps")), "ticket_id")
    files.ensure_splits(spark, f"{root}/splits", lambda: rows.withColumn("selection_odds", F.col("_gaps")).drop("_gaps"))
    fitted.save(f"{root}/model")
    n_train, val_rows = (files.read_split(spark, f"{root}/splits", x) for x in ("train", "val"))
    top = model.top_importance(model.importance(fitted, spark))
    files.write_metrics(model.train_metrics(fitted, n_train.count(), val_rows, top), f"{root}/metrics.json")
    return root


def calibrate_early(spark, sf):
    """Errors of that model before and after calibration."""
    return rounded(jobs.calibrate_job(spark, _stored_early(spark, sf), ODDS), 8, "mae_before", "mae_after")


def _evaluated_early(spark, sf):
    root = _stored_early(spark, sf)
    jobs.calibrate_job(spark, root, ODDS)
    return root, jobs.evaluate_job(spark, root, Settings(delay_below=0.0), scale=MONEY)


def evaluate_early(spark, sf):
    """Metrics and policy totals of that model, calibrated, with a delay below 0."""
    record = _evaluated_early(spark, sf)[1]
    record = record.select("mae", "rmse", "n_total", "skip_count", "skip_rejected_count", "factual_pnl", "counterfactual_pnl")
    return rounded(rounded(record, 6, "mae", "rmse"), 2, "factual_pnl", "counterfactual_pnl")


def results_early(spark, sf):
    """Results panel of that run."""
    root, _ = _evaluated_early(spark, sf)
    panel = jobs.results_job(spark, root)
    panel = panel.select("val_mae", "best_iteration", "n_train", "n_val", DELAYED_COUNT, "skip_count", "mae", "skip_rate")
    return rounded(panel, 6, "val_mae", "mae", "skip_rate")


def importance(spark, sf, boost=FULL):
    fitted, _ = _trained(spark, sf, boost)
    return model.top_importance(model.importance(fitted, spark))


def permutation_importance(spark, sf, boost=FULL):
    fitted, rows = _trained(spark, sf, boost)
    return model.permutation_importance(fitted, rows.filter(F.col("split") == "val"))


def permute(spark, sf):
    """Every ticket with the stake of another one and the sport of a third."""
    rows = once(kept(spark, sf), "ticket_id", "stake", "sport")
    swapped = model.permute(rows, ["stake", "sport"], seed=7)
    return swapped.select("ticket_id", F.col("_swap_stake").alias("stake"), F.col("_swap_sport").alias("sport"))


def encode(spark, sf):
    """Codes of a string feature."""
    rows = once(kept(spark, sf), "ticket_id", "sport")
    coded = model.fit_encoder(rows, ["sport"]).transform(rows)
    return coded.select("ticket_id", vector_to_array("features")[0].alias("code"))


def feature_analysis(spark, sf, boost=BoostParams(rounds=200)):
    known = once(featured(spark, sf), "ticket_id", TARGET, *DEFAULT_FEATURES)
    sample = order_stats.pin(review.sample_n(known, jobs.SAMPLE_ROWS, 42))
    _, gains = model.feature_analysis(sample, DEFAULT_FEATURES, boost)
    return gains


def cumulative_share(spark, sf):
    by_sport = tickets(spark, sf).groupBy("sport").agg(fn.total("stake", MONEY).alias("stake"))
    df = model.cumulative_share(by_sport, "sport", "stake")
    return rounded(df, 6, "stake_pct", "cumulative_stake_pct")


# --- sources and jobs ----------------------------------------------------------------------


def parquet_roundtrip(spark, sf):
    path = f"{scratch(spark)}/tickets"
    files.write_parquet(tickets(spark, sf), path)
    return files.read_tickets(spark, path)


def _written_csv(spark, sf, root):
    """The tickets as a CSV file under ``root``."""
    path = f"{root}/tickets.csv"
    with order_stats.scratch(spark) as passing:
        files.write_csv(whole(spark, sf, passing), path)
    return path


def csv_roundtrip(spark, sf):
    return files.read_tickets_csv(spark, _written_csv(spark, sf, scratch(spark)), blank_strings="null")


def csv_default(spark, sf):
    """Missing strings come back empty."""
    return files.read_tickets_csv(spark, _written_csv(spark, sf, scratch(spark)))


def _digests(df, names, read):
    """Id and digest of each row, and whether it was read. Only rows of one id are compared by it."""
    # Nulls do not change a hash, so which columns are null goes in as well.
    row = F.xxhash64(*names, *[F.col(c).isNull() for c in names])
    return df.select("ticket_id", row.alias("row"), F.lit(read).alias("read"))


def csv_head(spark, sf):
    """The first half of a ticket file by bytes: every row as it was, none twice, about half of them."""
    path, n_buckets = f"{scratch(spark)}/tickets.csv", star.buckets(spark, sf)
    # Joining by buckets again shuffles and stores nothing, so the joined rows are not stored.
    rows = star.derive(
        star.base_by_buckets(spark, sf, n_buckets) if n_buckets else order_stats.pin(star.base(spark, sf))
    )
    files.write_csv(rows, path)
    head = files.read_tickets_csv(spark, path, blank_strings="null", limit_bytes=files.path_bytes(spark, path) // 2)
    # Rows travel as their id and a digest, in one shuffle or write by the id.
    both = _digests(head, rows.columns, 1).unionByName(_digests(rows.filter("ticket_id is not null"), rows.columns, 0))
    both = order_stats.pin_by(both, "ticket_id", n_buckets)[0] if n_buckets else both.repartition("ticket_id")
    alike = both.groupBy("ticket_id", "row").agg(
        F.sum("read").alias("read"), F.sum(1 - F.col("read")).alias("known")
    )
    # Each row read meets all written under its id, or nothing.
    seen = alike.groupBy("ticket_id").agg(
        F.sum("read").alias("read"), F.sum("known").alias("known"), F.sum(F.col("read") * F.col("known")).alias("right")
    ).filter("read > 0")
    times = F.col("read") * F.greatest("known", F.lit(1))
    seen = seen.select("ticket_id", times.alias("times"), (times - F.col("right")).alias("wrong"))
    n = rows.agg(F.count("*").alias("n"))
    return seen.agg(
        F.coalesce(F.sum("wrong"), F.lit(0)).alias("n_wrong"), F.count_if(F.col("times") > 1).alias("n_twice"),
        F.sum("times").alias("times"),
    ).join(F.broadcast(n)).select("n_wrong", "n_twice", (F.abs(F.col("times") / F.col("n") - 0.5) < 0.05).alias("half"))


def convert(spark, sf):
    root = scratch(spark)
    return jobs.convert(spark, _written_csv(spark, sf, root), f"{root}/tickets").select("n_rows")


def splits_roundtrip(spark, sf):
    path = f"{scratch(spark)}/splits"
    df = split.temporal_split(once(kept(spark, sf), *SPLIT)).select("ticket_id", TARGET, "split")
    files.ensure_splits(spark, path, lambda: df)
    return files.read_split(spark, path, "val")


def publish(spark, sf):
    path = f"{scratch(spark)}/published"
    files.publish(kept(spark, sf), path)
    return files.read_tickets(spark, path).select("ticket_id", "stake")


def publish_again(spark, sf):
    """A table published over another one, with the files that are not as its manifest says."""
    path = f"{scratch(spark)}/published"
    files.publish(kept(spark, sf).limit(10), path)
    files.publish(kept(spark, sf), path)
    wrong = files.changed_files(spark, path).agg(F.count("*").alias("n_changed"))
    return files.manifest(spark, path).agg(F.sum("n_rows").alias("n_rows")).join(F.broadcast(wrong))


def report_roundtrip(spark, sf):
    path = f"{scratch(spark)}/calibration.csv"
    files.write_report(calibration_report(spark, sf), path)
    return files.read_report(spark, path).withColumn("n", F.col("n").cast("bigint"))


def metrics_roundtrip(spark, sf):
    path = f"{scratch(spark)}/metrics.json"
    files.write_metrics(regression_metrics(spark, sf), path)
    return files.read_metrics(spark, path)


def _ingested(spark, sf, root):
    with order_stats.scratch(spark) as passing:
        files.write_parquet(whole(spark, sf, passing), f"{root}/tickets")
    paths, n = {}, star.buckets(spark, sf)
    stored = files.read_tickets(spark, f"{root}/tickets")
    with order_stats.scratch(spark) as passing:
        parts = [(stored, False)]
        if n:
            parts = order_stats.in_parts(stored.select(*AGGREGATED), "bettor_id", n, passing)[0]
        made = [vars(star.aggregates(rows, MONEY)) for rows, _ in parts]
        for kind in AGGREGATES:
            paths[kind] = f"{root}/{kind}.csv"
            files.write_csv(reduce(DataFrame.unionByName, [tables[kind] for tables in made]), paths[kind])
    return jobs.enrich_job(spark, f"{root}/tickets", paths, f"{root}/merged", scale=MONEY)


def enrich_job(spark, sf):
    return _merged_rounded(_ingested(spark, sf, scratch(spark)))


def _ran(spark, sf, boost=FULL):
    root = scratch(spark)
    files.write_parquet(merged(spark, sf), f"{root}/merged")
    jobs.train_job(spark, f"{root}/merged", f"{root}/model", Settings(boost=boost))
    return f"{root}/model"


def calibrate_job(spark, sf, boost=FULL):
    return jobs.calibrate_job(spark, _ran(spark, sf, boost))


def evaluate_job(spark, sf, boost=FULL):
    root = _ran(spark, sf, boost)
    jobs.calibrate_job(spark, root)
    return jobs.evaluate_job(spark, root, scale=MONEY)


def results_summary(spark, sf, boost=FULL):
    root = _ran(spark, sf, boost)
    jobs.evaluate_job(spark, root, scale=MONEY)
    return jobs.results_job(spark, root)


def on_tickets(operator, *args) -> Query:
    return lambda spark, sf: operator(tickets(spark, sf), *args)


QUERIES: dict[str, Query] = {
    "tickets": tickets,
    "by_sport": on_tickets(analytics.by_sport, MONEY),
    "bettor_stats": lambda spark, sf: sides(spark, sf).bettor_stats,
    "rejected_by_reason": lambda spark, sf: sides(spark, sf).rejected,
    "risk_tier": lambda spark, sf: sides(spark, sf).risk_tier,
    "stake_size": lambda spark, sf: sides(spark, sf).stake_size,
    "rejected_rollup": rejected_rollup,
    "risk_rollup": risk_rollup,
    "enrich": lambda spark, sf: _merged_rounded(merged(spark, sf)),
    "enrich_by_key": lambda spark, sf: _merged_rounded(merged(spark, sf, True)),
    "overview": overview,
    "shape": on_tickets(analytics.shape),
    "target_stats": target_stats,
    "tier_summary": on_tickets(analytics.tier_summary, -0.02, MONEY),
    "state_counts": on_tickets(analytics.state_counts),
    "state_distribution": on_tickets(analytics.state_distribution),
    "reject_reasons": on_tickets(analytics.reject_reasons),
    "clv_by_state": clv_by_state,
    "distinct_values": distinct_values,
    "browse": browse,
    "browse_count": browse_count,
    "valid_target": valid_target,
    "apply_rules": apply_rules,
    "rule_audit": on_tickets(filters.rule_audit, AUDIT_RULES),
    "band_distribution": on_tickets(analytics.band_distribution, BANDS),
    "null_counts": lambda spark, sf: analytics.null_counts(merged_sides(spark, sf)),
    "coverage": lambda spark, sf: analytics.coverage(merged_sides(spark, sf)),
    "stake_ratio": stake_ratio,
    "odds_bucket_left": odds_bucket("left"),
    "odds_bucket_right": odds_bucket("right"),
    "sharp_flag": sharp_flag,
    "fill_categories": fill_categories,
    "clean_label": clean_label,
    "resolve_features": resolve_features,
    "split_kept": split_kept,
    "split_source": split_source,
    "split_counts": split_counts,
    "label_stats": label_stats,
    "cap_rows": cap_rows,
    "classify": classify,
    "classify_bands": classify_bands,
    "skip_yield": lambda spark, sf: policy.skip_yield(tiered(spark, sf), MONEY),
    "policy": policy_rows,
    "policy_summary": policy_summary,
    "tier_share": lambda spark, sf: policy.tier_share(tiered(spark, sf)),
    "regression_metrics": regression_metrics,
    "calibration_report": calibration_report,
    "calibration_bins": calibration_bins,
    "isotonic": isotonic,
    "isotonic_unseen": isotonic_unseen,
    "worst_50": worst_50,
    "review_sample": review_sample,
    "review_points": review_points,
    "review_detail": review_detail,
    "review_summary": review_summary,
    "review_by_sport": review_by_sport,
    "review_states": review_states,
    "histogram": histogram,
    "scatter_points": scatter_points,
    "sample_n": sample_n,
    "feature_coverage": feature_coverage,
    "corr_with_target": corr_with_target,
    "corr_matrix": corr_matrix,
    "high_corr_pairs": high_corr_pairs,
    "cumulative_share": cumulative_share,
    "train_score": train_score,
    "importance": importance,
    "permute": permute,
    "encode": encode,
    "train_exact": train_exact,
    "reload_score": reload_score,
    "csv_default": csv_default,
    "importance_exact": importance_exact,
    "train_early": train_early,
    "importance_early": importance_early,
    "metrics_early": metrics_early,
    "calibrate_early": calibrate_early,
    "evaluate_early": evaluate_early,
    "results_early": results_early,
    "permutation_exact": permutation_exact,
    "permutation_importance": permutation_importance,
    "feature_analysis": feature_analysis,
    "results_summary": results_summary,
    "csv_roundtrip": csv_roundtrip,
    "parquet_roundtrip": parquet_roundtrip,
    "csv_head": csv_head,
    "convert": convert,
    "splits_roundtrip": splits_roundtrip,
    "publish": publish,
    "publish_again": publish_again,
    "report_roundtrip": report_roundtrip,
    "metrics_roundtrip": metrics_roundtrip,
    "enrich_job": enrich_job,
    "calibrate_job": calibrate_job,
    "evaluate_job": evaluate_job,
}

# The same queries with a model of 4 rounds of depth 4.
TRAINING = (
    "train_score", "importance", "permutation_importance", "feature_analysis", "calibrate_job", "evaluate_job",
    "results_summary",
)
QUERIES |= {f"{name}_4_rounds": partial(QUERIES[name], boost=QUICK) for name in TRAINING}
