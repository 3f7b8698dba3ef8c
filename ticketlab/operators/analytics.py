"""Descriptive reports over a ticket table and the ticket browser.

``scale`` has the meaning given in :func:`ticketlab.functions.total`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlab import functions as fn
from ticketlab.config import DELAY_THRESHOLD
from ticketlab.operators import order_stats
from ticketlab.operators.filters import valid_target
from ticketlab.schema import DELAYED, TARGET, enrich_columns, inspect_columns


def _state(name: str) -> Column:
    return F.count_if(F.col("ticket_state") == name)


def _unpivot(df: DataFrame, measures: dict[str, Column], key: str, value: str) -> DataFrame:
    """One aggregate per name, turned into rows."""
    rows = [F.struct(F.lit(k).alias(key), v.alias(value)) for k, v in measures.items()]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def register(df: DataFrame, name: str = "tickets") -> None:
    """Make the table available to ``spark.sql``."""
    df.createOrReplaceTempView(name)


def with_share(
    grouped: DataFrame, count: str = "n", name: str = "pct", few: bool = False
) -> DataFrame:
    """Percentage of the total of ``count``, to one decimal.

    ``few`` says that the groups are a fixed handful, so that one task can see them all;
    otherwise the total is a subquery over the grouped rows.
    """
    if few:
        whole = F.sum(count).over(Window.partitionBy(F.lit(0)))
    else:
        whole = grouped.agg(F.sum(count)).scalar()
    return grouped.withColumn(name, fn.percent(F.col(count), whole))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns")
    )


def _n_distinct(df: DataFrame, column: str) -> Column:
    """Distinct non-null values, as a subquery that reads this column alone.

    Several distinct counts in one aggregation would repeat every row once per count.
    """
    return df.select(column).filter(F.col(column).isNotNull()).distinct().agg(F.count("*")).scalar()


def overview(df: DataFrame, scale: int | None = None) -> DataFrame:
    """Headline numbers, one row."""
    return df.agg(
        F.count("*").alias("n"),
        _state("won").alias("n_won"),
        _state("lost").alias("n_lost"),
        _state("rejected").alias("n_rejected"),
        fn.mean(TARGET, scale).alias("avg_clv"),
        F.count(TARGET).alias("n_clv_nonnull"),
        fn.total("stake", scale).alias("total_stake"),
        fn.total("pnl", scale).alias("total_pnl"),
    ).select(
        "n",
        _n_distinct(df, "bettor_id").alias("n_bettors"),
        _n_distinct(df, "sport").alias("n_sports"),
        _n_distinct(df, "match_id").alias("n_matches"),
        "n_won",
        "n_lost",
        "n_rejected",
        "avg_clv",
        order_stats.median(df, TARGET).scalar().alias("med_clv"),
        "n_clv_nonnull",
        "total_stake",
        "total_pnl",
    )


def target_stats(df: DataFrame, column: str = TARGET, scale: int | None = None) -> DataFrame:
    """Distribution of the finite target values, one row."""
    ok = fn.is_finite(column)
    value = F.when(ok, F.col(column))
    return df.agg(
        F.count("*").alias("n_total"),
        F.count(value).alias("n_valid"),
        fn.percent(F.count(value), F.count("*")).alias("pct_valid"),
        fn.mean(value, scale).alias("mean_val"),
        F.stddev_samp(value).alias("std_val"),
        F.min(value).alias("min_val"),
        F.max(value).alias("max_val"),
    ).withColumn("median_val", order_stats.median(valid_target(df, column), column).scalar())


def tier_summary(
    df: DataFrame, below: float = DELAY_THRESHOLD, scale: int | None = None
) -> DataFrame:
    """Tickets with a target by the tier their target would put them in."""
    label = F.when(F.col(TARGET) < below, F.lit(f"1. {DELAYED}")).otherwise(F.lit("2. SKIP"))
    grouped = (
        df.filter(F.col(TARGET).isNotNull())
        .groupBy(label.alias("tier"))
        .agg(
            F.count("*").alias("n"),
            fn.round_half_away(fn.mean(TARGET, scale), 5).alias("avg_clv"),
            fn.round_half_away(fn.mean("stake", scale), 2).alias("avg_stake"),
            fn.round_half_away(fn.total("pnl", scale), 2).alias("total_pnl"),
        )
    )
    return with_share(grouped, few=True).orderBy("tier")


def band_distribution(
    df: DataFrame, bands: Sequence[tuple[str, float | None]], column: str = TARGET
) -> DataFrame:
    """Count of target values per threshold band and its share of the finite values."""
    label = fn.band(column, bands)
    n_valid = F.count_if(fn.is_finite(column))
    rows = [
        F.struct(
            F.lit(name).alias("band"),
            F.count_if(label == name).alias("n"),
            fn.percent(F.count_if(label == name), n_valid).alias("pct"),
        )
        for name, _ in bands
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def state_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("ticket_state").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticket_state")


def state_distribution(df: DataFrame) -> DataFrame:
    grouped = df.groupBy("ticket_state").agg(F.count("*").alias("n"))
    return with_share(grouped).orderBy(F.desc("n"), "ticket_state")


def reject_reasons(df: DataFrame) -> DataFrame:
    grouped = (
        df.filter((F.col("ticket_state") == "rejected") & F.col("reject_reason").isNotNull())
        .groupBy("reject_reason")
        .agg(F.count("*").alias("n"))
    )
    return with_share(grouped).orderBy(F.desc("n"), "reject_reason")


def clv_by_state(df: DataFrame, scale: int | None = None) -> DataFrame:
    """Target, stake and profit by ticket state, over tickets with a target."""
    known = df.filter(F.col(TARGET).isNotNull())
    grouped = known.groupBy("ticket_state").agg(
        F.count(TARGET).alias("n"),
        fn.round_half_away(fn.mean(TARGET, scale), 5).alias("avg_clv"),
        fn.round_half_away(fn.mean("stake", scale), 2).alias("avg_stake"),
        fn.round_half_away(fn.total("pnl", scale), 2).alias("total_pnl"),
    )
    medians = order_stats.median(known, TARGET, ["ticket_state"], "_median").withColumnRenamed(
        "ticket_state", "_state"
    )
    return (
        grouped.join(medians, F.col("ticket_state").eqNullSafe(F.col("_state")), "left")
        .select(
            "ticket_state",
            "n",
            "avg_clv",
            fn.round_half_away("_median", 5).alias("med_clv"),
            "avg_stake",
            "total_pnl",
        )
        .orderBy(F.desc("n"), "ticket_state")
    )


def by_sport(df: DataFrame, scale: int | None = None) -> DataFrame:
    stake, pnl = fn.total("stake", scale), fn.total("pnl", scale)
    return (
        df.groupBy("sport")
        .agg(
            F.count("*").alias("n"),
            F.countDistinct("bettor_id").alias("n_bettors"),
            fn.round_half_away(fn.mean(TARGET, scale), 5).alias("avg_clv"),
            fn.round_half_away(stake, 2).alias("total_stake"),
            fn.round_half_away(pnl, 2).alias("total_pnl"),
            fn.round_half_away(fn.ratio(pnl, stake) * 100, 2).alias("margin_pct"),
        )
        .orderBy(F.desc("n"), "sport")
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = inspect_columns(df.columns) if columns is None else columns
    return _unpivot(df, {c: F.count_if(F.col(c).isNull()) for c in columns}, "feature", "n_null")


def coverage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = enrich_columns(df.columns) if columns is None else columns
    return _unpivot(
        df, {c: fn.percent(F.count(c), F.count("*")) for c in columns}, "feature", "coverage_pct"
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def _browse_filter(
    df: DataFrame,
    state: str | None = None,
    sport: str | None = None,
    reason: str | None = None,
    min_stake: float = 0.0,
) -> DataFrame:
    for column, wanted in (("ticket_state", state), ("sport", sport), ("reject_reason", reason)):
        if wanted is not None:
            df = df.filter(F.col(column) == wanted)
    return df.filter(F.col("stake") >= min_stake) if min_stake > 0 else df


def browse(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_rows: int = 5000,
    order: Sequence[str] | None = ("ticket_id",),
    **filters,
) -> DataFrame:
    """Filtered tickets up to a row limit.

    The first rows by ``order`` make the page repeatable; ``order=None`` takes whichever
    rows are read first.
    """
    matching = _browse_filter(df, **filters)
    shown = list(columns) if columns else df.columns
    if order is None:
        return matching.select(*shown).limit(max_rows)
    needed = [c for c in order if c not in shown]
    return order_stats.smallest(matching.select(*shown, *needed), order, max_rows).select(*shown)


def browse_count(df: DataFrame, **filters) -> DataFrame:
    return _browse_filter(df, **filters).agg(F.count("*").alias("n"))
