"""The review sample of tickets to delay and the tables behind its charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlab import functions as fn
from ticketlab.operators import order_stats
from ticketlab.schema import DELAYED, REVIEW_COLUMNS, TARGET


def worst(df: DataFrame, n: int = 50, score: str = "predicted_clv") -> DataFrame:
    """The ``n`` smallest scores, ties by ticket."""
    return order_stats.smallest(df, [score, "ticket_id"], n)


def sample_n(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` tickets, chosen by salted hash of the ticket id."""
    return order_stats.hash_sample(df, n, seed)


def scatter_points(
    df: DataFrame, actual: str = TARGET, predicted: str = "pred", n: int = 10_000, seed: int = 42
) -> DataFrame:
    """Points of the predicted-against-actual chart, thinned to ``n``."""
    return sample_n(df.select("ticket_id", actual, predicted), n, seed)


def review_sample(
    df: DataFrame, score: str = "predicted_clv", size: int = 100, seed: int = 42
) -> DataFrame:
    """All tickets to delay if at most ``size``; else the worst half and a random half."""
    delayed = df.filter(F.col("model_tier") == DELAYED)
    if delayed.limit(size + 1).count() <= size:
        return delayed
    half = size // 2
    order = [score, "ticket_id"]
    last = order_stats.last_of_smallest(delayed, order, half)
    lowest = order_stats.key_before(delayed, order, last, inclusive=True)
    return delayed.filter(lowest).unionByName(sample_n(delayed.filter(~lowest), half, seed))


def review_summary(df: DataFrame, score: str = "predicted_clv") -> DataFrame:
    n = F.count("*")
    sharp = F.count_if(fn.is_sharp(TARGET))
    rejected = F.count_if(F.col("ticket_state") == "rejected")
    return df.agg(
        n.alias("n"),
        sharp.alias("n_sharp"),
        fn.percent(sharp, n).alias("pct_sharp"),
        rejected.alias("n_rejected"),
        fn.percent(rejected, n).alias("pct_rejected"),
        F.avg(score).alias("avg_predicted_clv"),
    )


def review_by_sport(df: DataFrame, scale: int | None = None) -> DataFrame:
    """Known outcomes, share of sharp tickets and mean outcome per sport."""
    return (
        df.filter(F.col("sport").isNotNull())
        .groupBy("sport")
        .agg(
            F.count(TARGET).alias("count"),
            fn.percent(F.count_if(fn.is_sharp(TARGET)), F.count("*"), None).alias("pct_sharp"),
            fn.mean(TARGET, scale).alias("mean_clv"),
        )
        .orderBy(F.desc("count"), "sport")
    )


def review_states(df: DataFrame) -> DataFrame:
    known = df.filter(F.col("ticket_state").isNotNull())
    return known.groupBy(F.col("ticket_state").alias("state")).agg(F.count("*").alias("count"))


def histogram(df: DataFrame, column: str = TARGET, by: str = "sharp", n_bins: int = 25) -> DataFrame:
    """Equal-width counts between minimum and maximum, per value of ``by``."""
    known = df.filter(fn.is_finite(column))
    span = known.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    lo, hi = span.getField("lo"), span.getField("hi")
    width = (hi - lo) / n_bins
    # Without spread the quotient is null and every value is in the first bin.
    place = F.coalesce(F.floor(fn.ratio(F.col(column) - lo, width)), F.lit(0))
    return (
        known.select(F.col(by), F.least(place, F.lit(n_bins - 1)).cast("bigint").alias("bin"))
        .groupBy("bin", by)
        .agg(F.count("*").alias("n"))
        .select("bin", by, (lo + F.col("bin") * width).alias("bin_lo"), "n")
    )


def review_points(
    df: DataFrame,
    x: str,
    y: str = TARGET,
    extra: Sequence[str] = ("sport", "market_name", "stake", "ticket_state"),
) -> DataFrame:
    """Point columns of a review chart with the sharp flag."""
    return df.select(
        "ticket_id", x, *[c for c in (y, *extra) if c != x], fn.sharp_flag(y).alias("sharp")
    )


def review_detail(
    df: DataFrame, sort_by: str = "predicted_clv", ascending: bool = True
) -> DataFrame:
    """The detail columns that exist, sorted by any of them."""
    available = [c for c in REVIEW_COLUMNS if c in df.columns]
    if sort_by not in available:
        raise ValueError(f"cannot sort by {sort_by!r}; shown columns are {available}")
    c = F.col(sort_by)
    return df.select(*available).orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last())
