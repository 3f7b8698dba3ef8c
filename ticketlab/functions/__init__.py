"""Column expressions shared by the operators; all run inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlab.config import (
    MISSING_CATEGORY,
    ODDS_EDGES,
    ODDS_LABELS,
    DELAY_THRESHOLD,
    SHARP_THRESHOLD,
)
from ticketlab.schema import DELAYED

LOW_BITS = 24


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """True for a value that is neither null, NaN nor infinite; never null."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def nan_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column, so that both mean a missing value."""
    floating = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floating})


def round_half_away(c: Column | str, digits: int) -> Column:
    """Round a double half away from zero by scaling in binary."""
    c, p = col(c), F.lit(float(10**digits))
    return F.when(c >= 0, F.floor(c * p + 0.5) / p).otherwise(F.ceil(c * p - 0.5) / p)


def _units(c: Column, scale: int) -> Column:
    # Half away from zero, as a long. Values a double cannot carry at this scale would lose
    # digits silently, so they raise.
    scaled = c * F.lit(float(10**scale))
    fits = F.abs(scaled) < F.lit(float(2**53))
    return F.when(
        fits, F.when(c >= 0, F.floor(scaled + 0.5)).otherwise(F.ceil(scaled - 0.5))
    ).when(
        c.isNotNull(),
        F.raise_error(F.lit(f"value does not fit an exact sum at scale {scale}")).cast("bigint"),
    )


def total(c: Column | str, scale: int | None = None) -> Column:
    """Sum of a double column.

    ``scale`` states that the values carry at most that many decimals. The sum is then
    taken in whole units of ``10**-scale``: exact, the same for every partitioning and
    task retry, for up to 5 * 10**11 rows. Without it this is an ordinary double sum.
    """
    c = col(c)
    if scale is None:
        return F.sum(c)
    units = _units(c, scale)
    # Summed as two longs, since one would overflow at some 10**10 rows of money, and put
    # together as a decimal once per group.
    high = F.sum(F.shiftright(units, LOW_BITS)).cast("decimal(20,0)")
    low = F.sum(units.bitwiseAND(F.lit((1 << LOW_BITS) - 1))).cast("decimal(20,0)")
    whole = high * F.lit(1 << LOW_BITS).cast("decimal(10,0)") + low
    return whole.cast("double") / F.lit(float(10**scale))


def mean(c: Column | str, scale: int | None = None) -> Column:
    """Average of a double column, from an exact sum when ``scale`` is given."""
    c = col(c)
    if scale is None:
        return F.avg(c)
    return ratio(total(c, scale), F.count(c))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is null for a zero or null denominator, in every ANSI mode."""
    return F.when(denominator != 0, numerator / denominator)


def percent(part: Column, whole: Column, digits: int | None = 1) -> Column:
    p = ratio(part.cast("double") * 100.0, whole.cast("double"))
    return p if digits is None else round_half_away(p, digits)


def clean_label(c: Column | str) -> Column:
    """Label with non-finite values replaced by zero."""
    return F.when(is_finite(c), col(c)).otherwise(F.lit(0.0))


def fill_category(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(MISSING_CATEGORY))


def stake_ratio(stake: Column | str = "stake", typical: Column | str = "mean_stake_size") -> Column:
    """Stake over the bettor's mean stake; null unless the mean is positive."""
    m = col(typical)
    return F.when((m > 0) & ~F.isnan(m), col(stake) / m)


def odds_bucket(odds: Column | str = "selection_odds", closed: str = "left") -> Column:
    """Five odds bands.

    ``closed='left'`` is what the model is trained on; ``'right'`` is the interval form of
    the feature report, in which odds that are missing or not positive have no band.
    """
    o = col(odds)
    if closed == "left":
        out = F.when(o.isNull(), F.lit(None).cast("string"))
        for edge, label in zip(ODDS_EDGES, ODDS_LABELS):
            out = out.when(o < edge, F.lit(label))
    elif closed == "right":
        out = F.when(o.isNull() | F.isnan(o) | (o <= 0), F.lit(None).cast("string"))
        for edge, label in zip(ODDS_EDGES, ODDS_LABELS):
            out = out.when(o <= edge, F.lit(label))
    else:
        raise ValueError(f"closed must be 'left' or 'right', not {closed!r}")
    return out.otherwise(F.lit(ODDS_LABELS[-1]))


def tier(score: Column | str, below: float = DELAY_THRESHOLD) -> Column:
    """The delaying tier below the threshold, SKIP at or above it and for a missing score."""
    return F.when(col(score) < below, F.lit(DELAYED)).otherwise(F.lit("SKIP"))


def band(score: Column | str, bands: Sequence[tuple[str, float | None]]) -> Column:
    """First band whose upper bound exceeds the score; an upper bound of None is open."""
    s = col(score)
    out = F.when(s.isNull() | F.isnan(s), F.lit(None).cast("string"))
    for name, upper in bands:
        out = out.when(F.lit(True) if upper is None else s < upper, F.lit(name))
    return out


def is_sharp(c: Column | str, threshold: float = SHARP_THRESHOLD) -> Column:
    """True where the price moved for the bettor; a missing movement is not sharp."""
    return F.coalesce(col(c) < threshold, F.lit(False))


def sharp_flag(c: Column | str, threshold: float = SHARP_THRESHOLD) -> Column:
    return F.when(is_sharp(c, threshold), F.lit(f"Sharp (< {threshold})")).otherwise(F.lit("Not sharp"))
