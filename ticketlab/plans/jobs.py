"""End-to-end jobs for spark-submit: ingest, train, calibrate, evaluate, inspect."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlab import functions as fn
from ticketlab.config import Settings
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
from ticketlab.schema import AGGREGATES, DEFAULT_FEATURES, TARGET, inspect_columns
from ticketlab.sources import files
from ticketlab.sources.star import Aggregates

SAMPLE_ROWS = 200_000  # tickets of the feature analysis


def convert(
    spark: SparkSession, source: str, target: str, limit_rows: int | None = None, limit_bytes: int | None = None
) -> DataFrame:
    """Ticket CSV to Parquet; one row with the rows written and the size ratio.

    With ``limit_bytes`` only the whole lines within so many bytes count, as read and as size.
    """
    with order_stats.scratch(spark) as folder:
        rows = files.read_tickets_csv(spark, source, limit_rows, limit_bytes=limit_bytes, folder=folder)
        files.write_parquet(rows, target)
    before, after = files.path_bytes(spark, source), files.path_bytes(spark, target)
    if limit_bytes is not None:
        before = min(before, limit_bytes)
    return spark.read.parquet(target).agg(
        F.count("*").alias("n_rows"),
        F.lit(before).cast("bigint").alias("csv_bytes"),
        F.lit(after).cast("bigint").alias("parquet_bytes"),
        F.lit(before / after).alias("ratio"),
    )


def read_aggregates(spark: SparkSession, paths: Mapping[str, str]) -> Aggregates:
    missing = [k for k in AGGREGATES if k not in paths]
    if missing:
        raise FileNotFoundError(f"no path given for the aggregates {missing}")
    return Aggregates(**{k: files.read_aggregate_csv(spark, paths[k], k) for k in AGGREGATES})


def enrich_job(
    spark: SparkSession,
    tickets_path: str,
    aggregate_paths: Mapping[str, str],
    target: str,
    check_keys: bool = True,
    scale: int | None = None,
) -> DataFrame:
    """Join the ticket table with the four aggregate files and write the merged table.

    ``check_keys`` refuses aggregates whose keys repeat, which would repeat tickets.
    """
    if not files.path_exists(spark, tickets_path):
        raise FileNotFoundError(f"no ticket table at {tickets_path}; run convert first")
    sides = read_aggregates(spark, aggregate_paths)
    tickets = files.read_tickets(spark, tickets_path)
    small = all(order_stats.can_broadcast(side) for side in vars(sides).values())
    buckets = 0 if small else order_stats.bucket_count(tickets)
    with order_stats.scratch(spark) as folder:
        if buckets:
            sides = enrich.by_buckets(sides, buckets, folder)
        if check_keys:
            enrich.check_unique(sides.bettor_stats, ["bettor_id", "sport", "market_type"])
            enrich.check_unique(sides.stake_size, ["bettor_id"])
        if buckets:
            merged = enrich.enrich_by_buckets(tickets, sides, scale, buckets, folder)
        else:
            merged = enrich.enrich(tickets, sides, scale)
        files.write_parquet(merged, target)
    return files.read_tickets(spark, target)


def ingest_job(
    spark: SparkSession,
    csv_path: str,
    aggregate_paths: Mapping[str, str],
    work_dir: str,
    target: str,
    limit_rows: int | None = None,
    limit_bytes: int | None = None,
) -> int:
    """CSV to published merged table; returns the verified row count."""
    raw = f"{work_dir.rstrip('/')}/tickets_raw"
    convert(spark, csv_path, raw, limit_rows, limit_bytes)
    merged = f"{work_dir.rstrip('/')}/tickets"
    return files.publish(enrich_job(spark, raw, aggregate_paths, merged), target)


def prepare(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows with a usable target that pass the rules, with the engineered columns."""
    return features.engineer(filters.apply_rules(filters.valid_target(df), settings.rules))


def split_job(
    spark: SparkSession,
    data_path: str,
    model_dir: str,
    settings: Settings = Settings(),
    overwrite: bool = False,
    basis: str = "kept",
) -> DataFrame:
    """Splits under ``model_dir``, built from the merged table unless they exist."""

    def build() -> DataFrame:
        merged = files.read_tickets(spark, data_path)
        source_rows = merged.count() if basis == "source" else None
        return split.temporal_split(
            prepare(merged, settings), settings.split, basis=basis, source_rows=source_rows
        )

    return files.ensure_splits(spark, f"{model_dir.rstrip('/')}/splits", build, overwrite)


def train_job(
    spark: SparkSession, data_path: str, model_dir: str, settings: Settings = Settings()
) -> DataFrame:
    """Split, train with early stopping, and save model and metrics. Returns the metrics."""
    root = model_dir.rstrip("/")
    splits = split_job(spark, data_path, root, settings)
    names = features.resolve_features(splits, settings.features or DEFAULT_FEATURES)
    train_rows, val_rows = (splits.filter(F.col("split") == s) for s in ("train", "val"))
    if settings.max_train_rows is not None:
        train_rows = split.cap_rows(train_rows, settings.max_train_rows)
    fitted, _ = model.train(train_rows, names, settings.boost, val_rows)
    fitted.save(f"{root}/model")
    top = model.top_importance(model.importance(fitted, spark))
    record = model.train_metrics(fitted, train_rows.count(), val_rows, top)
    files.write_metrics(record, f"{root}/metrics.json")
    return files.read_metrics(spark, f"{root}/metrics.json")


def _scored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One split with ``raw_score``."""
    if not files.path_exists(spark, f"{root}/splits/_SUCCESS"):
        raise FileNotFoundError(f"no splits under {root}; run train_job first")
    rows = files.read_split(spark, f"{root}/splits", name)
    return model.TicketModel.load(f"{root}/model").score(rows)


def calibrate_job(spark: SparkSession, model_dir: str, decimals: int | None = None) -> DataFrame:
    """Fit and save the calibrator on the validation split; reports before and after.

    ``decimals`` of the outcomes, if given, make the fit exact. Returns the MAE before and
    after, one row.
    """
    root = model_dir.rstrip("/")
    with order_stats.scratch(spark) as folder:
        scored = order_stats.pin(_scored(spark, root, "val").select(TARGET, "raw_score"), folder)
        calibrator = calibration.fit_calibrator(scored, TARGET, "raw_score", decimals)
        calibrator.save(f"{root}/calibrator")
        both = calibration.calibrate(scored, calibrator, "raw_score", "calibrated")
        for column, name in (("raw_score", "calibration_pre"), ("calibrated", "calibration_post")):
            report = calibration.calibration_report(both, TARGET, column)
            files.write_report(report, f"{root}/{name}.csv")
        label = F.col(TARGET)
        errors = both.agg(
            F.avg(F.abs(F.col("raw_score") - label)).alias("mae_before"),
            F.avg(F.abs(F.col("calibrated") - label)).alias("mae_after"),
        )
        files.write_metrics(errors, f"{root}/calibration.json")
    return files.read_metrics(spark, f"{root}/calibration.json")


def evaluate_job(
    spark: SparkSession,
    model_dir: str,
    settings: Settings = Settings(),
    scale: int | None = None,
) -> DataFrame:
    """Score the test split, simulate the policy, draw the review sample, save everything.

    Beside the metrics that is the simulated tickets, the sample, calibration bins, thinned
    scatter points and importance. Returns the metrics and the policy totals in one row.
    """
    root = model_dir.rstrip("/")
    with order_stats.scratch(spark) as folder:
        scored, calibrator = _scored(spark, root, "test"), None
        if files.path_exists(spark, f"{root}/calibrator"):
            calibrator = calibration.Calibrator.load(f"{root}/calibrator")
            if not calibrator.is_sent():
                scored = order_stats.pin(scored, folder)  # read for the scores and for the rows
        predicted = calibration.calibrate(scored, calibrator, "raw_score", "predicted_clv")
        tiered = policy.classify(predicted, "predicted_clv", settings.delay_below)
        files.write_parquet(policy.policy(tiered, scale).drop("raw_score"), f"{root}/ope/simulation")
    simulated = spark.read.parquet(f"{root}/ope/simulation")
    files.write_parquet(review.review_sample(simulated), f"{root}/ope/review_sample")
    files.write_report(calibration.calibration_bins(simulated, TARGET, "predicted_clv"), f"{root}/ope/calibration_bins.csv")
    files.write_parquet(review.scatter_points(simulated, TARGET, "predicted_clv"), f"{root}/ope/scatter")
    gains = model.importance(model.TicketModel.load(f"{root}/model"), spark)
    files.write_report(gains, f"{root}/ope/importance.csv")
    measures = calibration.regression_metrics(simulated, TARGET, "predicted_clv")
    totals = policy.policy_summary(simulated)
    record = measures.withColumn("_one", F.lit(1)).join(totals.withColumn("_one", F.lit(1)), "_one")
    files.write_metrics(record.drop("_one"), f"{root}/ope/metrics.json")
    return files.read_metrics(spark, f"{root}/ope/metrics.json")


def review_job(spark: SparkSession, model_dir: str, scale: int | None = None) -> dict[str, DataFrame]:
    """The review tables over the sample that ``evaluate_job`` has stored."""
    sample = files.read_tickets(spark, f"{model_dir.rstrip('/')}/ope/review_sample")
    return {
        "summary": review.review_summary(sample),
        "by_sport": review.review_by_sport(sample, scale),
        "states": review.review_states(sample),
        "points": review.review_points(sample, "predicted_clv"),
        "detail": review.review_detail(sample, "stake", ascending=False),
        "histogram": review.histogram(features.with_sharp(sample)),
    }


def results_job(spark: SparkSession, model_dir: str) -> DataFrame:
    root = model_dir.rstrip("/")
    return model.results_summary(
        files.read_metrics(spark, f"{root}/metrics.json"),
        files.read_metrics(spark, f"{root}/ope/metrics.json"),
    )


def inspect(df: DataFrame, bands, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """The data-inspection tables by name, lazily."""
    out = {"shape": analytics.shape(df), "columns": features.describe_columns(df)}
    if TARGET in df.columns:
        out["target_stats"] = analytics.target_stats(df)
        out["band_distribution"] = analytics.band_distribution(df, bands)
    if "ticket_state" in df.columns:
        out["state_counts"] = analytics.state_counts(df)
    if settings.rules:
        out["rule_audit"] = filters.rule_audit(df, settings.rules)
    if inspect_columns(df.columns):
        out["null_counts"] = analytics.null_counts(df)
    return out


def feature_report(
    df: DataFrame,
    names,
    sample_size: int = SAMPLE_ROWS,
    seed: int = 42,
    settings: Settings = Settings(),
) -> dict[str, DataFrame]:
    """The feature-analysis tables over an exact-size sample of the kept rows.

    ``names`` are taken in the order of the feature groups, those that exist.
    """
    kept = filters.apply_rules(filters.valid_target(df, finite=False), settings.rules)
    sample = order_stats.pin(features.engineer(review.sample_n(kept, sample_size, seed), "right"))
    names = features.resolve_features(sample, features.chosen(names))
    numbers = features.numeric_features(sample, names)
    fitted, gains = model.feature_analysis(sample, names, settings.boost)
    return {
        "coverage": profile.feature_coverage(sample, names),
        "importance": gains,
        "corr_with_target": profile.corr_with_target(sample, numbers),
        "corr_matrix": profile.corr_matrix(sample, numbers),
        "high_corr_pairs": profile.high_corr_pairs(sample, numbers),
        "permutation_importance": model.permutation_importance(fitted, sample),
    }


def proxy_score(df: DataFrame) -> DataFrame:
    """Closed-form score, half the later price movement, for runs without a trained model."""
    later = fn.nan_to_null("odds_after_30")
    return df.filter(later.isNotNull()).withColumn("pred", later / 2)
