"""Tickets and bettor aggregates derived from the star-schema test tables.

``tickets`` maps lineitem, orders, customer and part to the ticket schema. The four
aggregate builders are ordinary group-by jobs over any ticket table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlab import functions as fn
from ticketlab.operators import order_stats
from ticketlab.schema import DELAY, TICKETS

MONEY = 4  # decimals of stakes, profits and price movements in the derived tickets
PRODUCT = 6  # decimals of a stake multiplied by a price movement
ROW = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents")  # what a ticket id is made of
# Columns of ``base`` that are not columns of a ticket.
BASE = (
    *ROW, "l_quantity", "l_shipdate", "d", "t", "rejected", "open", "o_orderdate", "o_orderpriority", "c_nationkey",
    "p_name", "p_size", "p_brand",
)


@dataclass(frozen=True)
class Aggregates:
    """The four per-bettor side tables."""

    bettor_stats: DataFrame
    rejected: DataFrame
    risk_tier: DataFrame
    stake_size: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: Column | str) -> Column:
    return fn.col(c).cast("string")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with the columns that tickets are derived from, and the keys of the aggregates.

    ``derive`` makes tickets of them. Rows in this form are half as wide as tickets, so
    they are the ones to store or shuffle.
    """
    items, placed, parts = _joined_tables(spark, sf_dir)
    joined = items.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )
    return _based(joined, items.columns)


def _joined_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = table(spark, sf_dir, "lineitem").select(
        *[f"l_{c}" for c in ("orderkey", "partkey", "suppkey", "linenumber", "quantity", "shipdate")],
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("d"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("t"),
        (F.col("l_returnflag") == "N").alias("rejected"),
        (F.col("l_linestatus") == "O").alias("open"),
    )
    # Orders are few beside line items: they meet their customers before any line item moves.
    placed = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return items, placed, table(spark, sf_dir, "part")


def _based(joined: DataFrame, items: Sequence[str]) -> DataFrame:
    return joined.select(
        *items, "o_orderdate", "o_orderpriority", "c_nationkey", "p_name", "p_size", "p_brand",
        _text("o_custkey").alias("bettor_id"),
        F.col("c_mktsegment").alias("sport"),
        F.col("p_type").alias("market_name"),
    )


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """Buckets to join the tables by, or 0 where ``base`` is better: if all that line items meet can be broadcast."""
    met = [table(spark, sf_dir, name) for name in ("orders", "customer", "part")]
    if all(order_stats.can_broadcast(df) for df in met):
        return 0
    return order_stats.bucket_count(table(spark, sf_dir, "lineitem"))


def _met(left: DataFrame, right: DataFrame, key: str, other: str, n: int, folder: str | None) -> DataFrame:
    """Inner join over tables in buckets; rows of heavy keys are joined by shuffle, in which skew is split."""
    rows, any_rows = order_stats.pin_by(left.filter(F.col(key).isNotNull()), key, n, folder)
    side, any_side = order_stats.pin_by(right.filter(F.col(other).isNotNull()), other, n, folder)
    hot = order_stats.heavy(any_rows, key, n)
    if not hot:
        return rows.join(side, F.col(key) == F.col(other))
    heavy, met = F.col(key).isin(hot), F.col(other).isin(hot)
    return rows.filter(~heavy).join(side.filter(~met), F.col(key) == F.col(other)).unionByName(
        any_rows.filter(heavy).join(any_side.filter(met), F.col(key) == F.col(other))
    )


def base_by_buckets(spark: SparkSession, sf_dir: str, n: int, folder: str | None = None) -> DataFrame:
    """``base`` by way of tables in ``n`` buckets, which take a fraction of the bytes that a shuffle does.

    The tables are written now, with all columns, so this is for work that needs all of
    them. What the result reads stays in ``folder``.
    """
    items, placed, parts = _joined_tables(spark, sf_dir)
    placed = placed.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "c_nationkey", "c_mktsegment")
    parts = parts.select("p_partkey", "p_name", "p_size", "p_brand", "p_type")
    with order_stats.scratch(spark) as passing:
        ordered = _met(items, placed, "l_orderkey", "o_orderkey", n, passing).drop("o_orderkey")
        return _based(_met(ordered, parts, "l_partkey", "p_partkey", n, folder), items.columns)


def derive(rows: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Tickets from rows of ``base``; columns that were joined to these stay behind them.

    With ``names`` only these columns of a ticket are made, and ``rows`` may lack what the others need.
    """
    cents, d, t = F.col("cents"), F.col("d"), F.col("t")
    rejected, open_ = F.col("rejected"), F.col("open")
    known = F.col("l_suppkey") % 10 != 0

    def movement(factor: int, prime: int) -> Column:
        raw = (t - d) * factor + F.col("l_partkey") % prime
        return F.when(known, raw.cast("double") / 10000)

    columns = {
        "ticket_id": F.concat_ws(
            "-", *[_text(c) for c in ROW]
        ),
        "created_at": _text("o_orderdate"),
        "accepted_at": F.when(~rejected, _text("l_shipdate")),
        "rejected_at": F.when(rejected, _text("l_shipdate")),
        "bettor_id": F.col("bettor_id"),
        DELAY: F.col("l_linenumber") * 2 - 2,
        "client_id": F.col("c_nationkey"),
        "cashout_stake": F.when(F.col("l_linenumber") == 7, cents.cast("double") / 200).otherwise(0.0),
        "reject_reason": F.when(rejected, F.col("o_orderpriority")),
        "ticket_state": F.when(rejected, "rejected").when(open_, "accepted")
        .when(d < 5, "lost").otherwise("won"),
        "match_id": F.col("l_partkey"),
        "home_team": F.col("p_name"),
        "away_team": F.concat(F.lit("team-"), _text("l_suppkey")),
        "stake": cents.cast("double") / 100,
        "pnl": F.when(rejected, F.lit(None)).when(open_, F.lit(0.0))
        .otherwise((cents * (5 - d)).cast("double") / 10000),
        "selection_odds": (10 + F.col("l_quantity")) / 10,
        "market_name": F.col("market_name"),
        "market_type_id": F.col("p_size"),
        "market_params": F.concat(F.lit("size="), _text("p_size")),
        "market_selection": F.col("p_brand"),
        "client_name": F.concat(F.lit("client-"), _text("c_nationkey")),
        "bos": t.cast("double") / 2,
        "oaf": d.cast("double") / 10,
        "ots_risk_tier_id": F.col("l_suppkey") % 5,
        "sport_id": F.ascii("sport"),
        "sport": F.col("sport"),
        "tournament_id": F.col("l_partkey") % 50,
        "tournament": F.concat(F.lit("cup-"), _text(F.col("l_partkey") % 50)),
        "odds_after_10": movement(100, 97),
        "odds_after_30": movement(150, 89),
        "odds_after_90": movement(200, 83),
    }
    joined = [c for c in rows.columns if c not in BASE and c not in columns]
    fields = [f for f in TICKETS if names is None or f.name in names]
    return rows.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in fields], *joined)


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticket per line item, in the ticket schema."""
    return derive(base(spark, sf_dir))


def bettor_stats(df: DataFrame, scale: int | None = None) -> DataFrame:
    """History per bettor, sport and market."""
    rejected = F.col("ticket_state") == "rejected"
    product = None if scale is None else PRODUCT
    return df.groupBy("bettor_id", "sport", F.col("market_name").alias("market_type")).agg(
        fn.total("pnl", scale).alias("pnl"),
        fn.ratio(
            fn.total("pnl", scale), fn.total(F.when(~rejected, F.col("stake")), scale)
        ).alias("margin"),
        fn.total("stake", scale).alias("stake"),
        *[fn.mean(f"odds_after_{s}", scale).alias(f"avg_odds_after_{s}") for s in (10, 30, 90)],
        fn.total(F.when(rejected, F.col("stake")).otherwise(0.0), scale).alias("rejected_stake"),
        fn.total(
            F.when(rejected, F.col("stake") * F.col("odds_after_10")).otherwise(0.0), product
        ).alias("rejected_pnl"),
    )


def rejected_by_reason(df: DataFrame, scale: int | None = None) -> DataFrame:
    """Rejected tickets per bettor, sport, market and reason."""
    product = None if scale is None else PRODUCT
    market = F.col("market_name").alias("market_type")
    return (
        df.filter(F.col("ticket_state") == "rejected")
        .groupBy("bettor_id", "sport", market, "reject_reason")
        .agg(
            fn.total("stake", scale).alias("rejected_stake"),
            fn.total(F.col("stake") * F.col("odds_after_10"), product).alias("rejected_pnl"),
            *[
                fn.mean(f"odds_after_{s}", scale).alias(f"avg_rejected_odds_after_{s}")
                for s in (10, 30, 90)
            ],
        )
    )


def risk_tier(df: DataFrame, scale: int | None = None) -> DataFrame:
    """Profit and volume per bettor and risk tier."""
    return df.groupBy("bettor_id", "ots_risk_tier_id").agg(
        fn.total("pnl", scale).alias("pnl"),
        fn.total("stake", scale).alias("volume"),
        fn.ratio(fn.total("pnl", scale), fn.total("stake", scale)).alias("margin"),
    )


def stake_size(df: DataFrame, scale: int | None = None) -> DataFrame:
    """Mean stake per bettor."""
    return df.groupBy("bettor_id").agg(fn.mean("stake", scale).alias("mean_stake_size"))


def aggregates(df: DataFrame, scale: int | None = None) -> Aggregates:
    """All four side tables of a ticket table, with every bettor in it."""
    return Aggregates(
        bettor_stats(df, scale),
        rejected_by_reason(df, scale),
        risk_tier(df, scale),
        stake_size(df, scale),
    )
