"""Left joins of tickets with the per-bettor aggregates.

If Catalyst can broadcast all four sides, the joins are written one after the other and
no ticket is shuffled. Otherwise the sides are first joined to the distinct ticket keys,
which are few beside the tickets, and the wide ticket rows are shuffled once, for one join.
Keys with a large share of the rows are cut into slices for that join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlab import functions as fn
from ticketlab.operators.order_stats import can_broadcast, in_parts, pin_by
from ticketlab.sources.star import Aggregates

KEYS = ("bettor_id", "sport", "market_name")
# A key with more than 1/SLICES of all rows is split, so fewer than SLICES keys can be.
SLICES = 2000


def rejected_rollup(rejected: DataFrame, scale: int | None = None) -> DataFrame:
    """Rejected history per bettor, sport and market; averages are unweighted over reasons."""
    return rejected.groupBy("bettor_id", "sport", "market_type").agg(
        fn.total("rejected_stake", scale).alias("total_rejected_stake"),
        fn.total("rejected_pnl", scale and scale + 2).alias("total_rejected_pnl"),
        F.countDistinct("reject_reason").alias("n_reject_reasons"),
        *[
            F.avg(f"avg_rejected_odds_after_{s}").alias(f"avg_rejected_odds_after_{s}")
            for s in (10, 30, 90)
        ],
    )


def risk_rollup(risk_tier: DataFrame, scale: int | None = None) -> DataFrame:
    """Risk profile per bettor; the dominant tier has the largest volume, then the lowest id."""
    tier, volume = F.col("ots_risk_tier_id"), F.col("volume")
    usable = tier.isNotNull() & volume.isNotNull() & ~F.isnan(volume)
    return risk_tier.groupBy("bettor_id").agg(
        F.max_by(F.when(usable, tier), F.when(usable, F.struct(volume, -tier))).alias(
            "dominant_risk_tier"
        ),
        fn.total("pnl", scale).alias("risk_tier_total_pnl"),
        fn.total("volume", scale).alias("risk_tier_total_volume"),
        F.avg("margin").alias("risk_tier_avg_margin"),
    )


def check_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise if a key occurs twice; a duplicate on the right of a left join adds rows."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key {[twice[0][k] for k in keys]} in {list(keys)}")


def _sides(aggregates: Aggregates, scale: int | None) -> list[tuple[DataFrame, dict[str, str]]]:
    """Each side with its join columns: side column -> ticket column."""
    bs = aggregates.bettor_stats
    stats = bs.select(
        F.col("bettor_id").alias("_bs_bettor"),
        F.col("sport").alias("_bs_sport"),
        F.col("market_type").alias("_bs_market"),
        *[
            F.col(c).alias(f"bs_{c}")
            for c in (
                "pnl", "margin", "stake", "avg_odds_after_10", "avg_odds_after_30",
                "avg_odds_after_90", "rejected_stake", "rejected_pnl",
            )
        ],
    )
    rejected = rejected_rollup(aggregates.rejected, scale).withColumnsRenamed(
        {"bettor_id": "_rej_bettor", "sport": "_rej_sport", "market_type": "_rej_market"}
    )
    risk = risk_rollup(aggregates.risk_tier, scale).withColumnRenamed("bettor_id", "_rt_bettor")
    return [
        (stats, dict(zip(("_bs_bettor", "_bs_sport", "_bs_market"), KEYS))),
        (rejected, dict(zip(("_rej_bettor", "_rej_sport", "_rej_market"), KEYS))),
        (risk, {"_rt_bettor": "bettor_id"}),
        _stake_side(aggregates.stake_size),
    ]


def _stake_side(stake_size: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    stake = stake_size.select(F.col("bettor_id").alias("_ss_bettor"), "mean_stake_size")
    return stake, {"_ss_bettor": "bettor_id"}


def _attach(left: DataFrame, sides) -> DataFrame:
    for side, keys in sides:
        condition = [F.col(ours) == F.col(theirs) for theirs, ours in keys.items()]
        left = left.join(side, condition, "left").drop(*keys)
    return left


def _by_key(tickets: DataFrame, sides, row: Sequence[str]) -> DataFrame:
    """Joins by the KEYS that some side needs, so that no ticket carries or is counted by another one."""
    needed = {ours for _, on in sides for ours in on.values()}
    keys = [k for k in KEYS if k in needed]
    counted = tickets.groupBy(*keys).agg(F.count("*").alias("_rows"))
    everything = tickets.agg(F.count("*")).scalar()
    sliced = counted.select(
        *keys,
        F.greatest(F.lit(1), F.ceil(F.col("_rows") * F.lit(float(SLICES)) / everything)).alias("_slices"),
    )
    hot = sliced.filter("_slices > 1").select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys], "_slices"
    )
    # Fewer than SLICES rows, since each holds more than 1/SLICES of all tickets.
    left = tickets.join(
        F.broadcast(hot), [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys], "left"
    ).withColumn(
        "_slice",
        F.when(F.col("_slices").isNull(), F.lit(0).cast("bigint")).otherwise(
            F.pmod(F.xxhash64(*row), F.col("_slices"))
        ),
    ).drop("_slices", *[f"_hot_{k}" for k in keys])
    right = (
        _attach(sliced, sides)
        .withColumn("_side_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_slices") - 1)))
        .drop("_slices")
        .withColumnsRenamed({k: f"_side_{k}" for k in keys})
    )
    on = [F.col(k).eqNullSafe(F.col(f"_side_{k}")) for k in keys]
    on.append(F.col("_slice") == F.col("_side_slice"))
    return left.join(right, on, "left").drop("_slice", "_side_slice", *[f"_side_{k}" for k in keys])


def _join(tickets: DataFrame, sides, by_key: bool | None, row: Sequence[str]) -> DataFrame:
    if by_key is None:
        by_key = not all(can_broadcast(side) for side, _ in sides)
    return _by_key(tickets, sides, row) if by_key else _attach(tickets, sides)


def with_stake_size(
    tickets: DataFrame, stake_size: DataFrame, by_key: bool | None = None, row: Sequence[str] = ("ticket_id",)
) -> DataFrame:
    """Tickets with the bettor's mean stake, joined as in ``enrich``."""
    return _join(tickets, [_stake_side(stake_size)], by_key, row)


def enrich(
    tickets: DataFrame,
    aggregates: Aggregates,
    scale: int | None = None,
    by_key: bool | None = None,
    row: Sequence[str] = ("ticket_id",),
) -> DataFrame:
    """Tickets with the 19 aggregate columns.

    ``by_key`` forces the one-shuffle form (True) or the direct joins (False); by default
    the sides' sizes decide. ``tickets`` may be any rows with the KEYS; ``row`` names the
    columns that tell rows of one key apart.
    """
    return _join(tickets, _sides(aggregates, scale), by_key, row)


def by_buckets(aggregates: Aggregates, buckets: int, folder: str) -> Aggregates:
    """The four sides stored in buckets by their bettors, for ``enrich_by_buckets``."""
    return Aggregates(**{k: pin_by(side, "bettor_id", buckets, folder)[0] for k, side in vars(aggregates).items()})


def enrich_by_buckets(
    tickets: DataFrame, aggregates: Aggregates, scale: int | None, buckets: int, folder: str
) -> DataFrame:
    """``enrich`` with sides of ``by_buckets``: tickets are stored in buckets as well, so that none is shuffled.

    Tickets of a bettor with too many for a bucket, or of none, are joined by key.
    """
    parts, light = in_parts(tickets, "bettor_id", buckets, folder)
    joined = []
    for rows, bucketed in parts:
        ours = light if bucketed else ~light
        sides = Aggregates(**{k: side.filter(ours) for k, side in vars(aggregates).items()})
        joined.append(enrich(rows, sides, scale, not bucketed))
    return reduce(DataFrame.unionByName, joined)
