"""Delay tiers and the counterfactual profit of skipping the delay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlab import functions as fn
from ticketlab.config import DELAY_THRESHOLD
from ticketlab.schema import DELAYED, DELAYED_COUNT, DELAYED_RATE


def classify(df: DataFrame, score: str, below: float = DELAY_THRESHOLD) -> DataFrame:
    return df.withColumn("model_tier", fn.tier(score, below))


def classify_bands(df: DataFrame, score: str, bands) -> DataFrame:
    return df.withColumn("model_tier", fn.band(score, bands))


def tier_share(df: DataFrame) -> DataFrame:
    """Count and percentage of both tiers, also of one without tickets."""
    counts = {t: F.count_if(F.col("model_tier") == t) for t in ("SKIP", DELAYED)}
    both = counts["SKIP"] + counts[DELAYED]
    rows = [
        F.struct(F.lit(t).alias("model_tier"), n.alias("n"), fn.percent(n, both).alias("pct"))
        for t, n in counts.items()
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _factual() -> Column:
    return F.coalesce(fn.nan_to_null("pnl"), F.lit(0.0))


def _skip_rejected() -> Column:
    return (F.col("model_tier") == "SKIP") & F.coalesce(
        F.col("ticket_state") == "rejected", F.lit(False)
    )


def skip_yield(df: DataFrame, scale: int | None = None) -> DataFrame:
    """Profit per unit staked of settled SKIP tickets, one row; 0 without any stake."""
    settled = (F.col("model_tier") == "SKIP") & F.col("ticket_state").isin("won", "lost")
    profit = fn.total(F.when(settled, _factual()), scale)
    stake = fn.total(F.when(settled, F.col("stake")), scale)
    return df.agg(F.coalesce(fn.ratio(profit, stake), F.lit(0.0)).alias("skip_yield"))


def policy(df: DataFrame, scale: int | None = None) -> DataFrame:
    """Add ``factual_pnl`` and ``counterfactual_pnl`` to tickets with a ``model_tier``.

    Rejected SKIP tickets would have gone through; they earn the yield of settled SKIP
    tickets on their stake. Everything else keeps its profit.
    """
    rate = skip_yield(df, scale).scalar()
    return df.withColumn("factual_pnl", _factual()).withColumn(
        "counterfactual_pnl",
        F.when(_skip_rejected(), F.col("stake") * rate).otherwise(F.col("factual_pnl")),
    )


def policy_summary(df: DataFrame) -> DataFrame:
    """Totals of a policy table, one row; rates are 0 where the denominator is."""
    skip, delayed = (F.count_if(F.col("model_tier") == t) for t in ("SKIP", DELAYED))
    n = F.count("*")
    totals = df.agg(
        n.alias("n_total"),
        skip.alias("skip_count"),
        delayed.alias(DELAYED_COUNT),
        F.count_if(_skip_rejected()).alias("skip_rejected_count"),
        F.coalesce(F.sum("factual_pnl"), F.lit(0.0)).alias("factual_pnl"),
        F.coalesce(F.sum("counterfactual_pnl"), F.lit(0.0)).alias("counterfactual_pnl"),
    )
    zero = F.lit(0.0)
    delta = F.col("counterfactual_pnl") - F.col("factual_pnl")

    def share(c: str) -> Column:
        return F.coalesce(fn.ratio(F.col(c), F.col("n_total")), zero)

    return totals.select(
        "n_total",
        "skip_count",
        share("skip_count").alias("skip_rate"),
        DELAYED_COUNT,
        share(DELAYED_COUNT).alias(DELAYED_RATE),
        "skip_rejected_count",
        "factual_pnl",
        "counterfactual_pnl",
        delta.alias("pnl_delta"),
        F.coalesce(fn.ratio(delta, F.abs("factual_pnl")) * 100, zero).alias("pnl_delta_pct"),
    )
