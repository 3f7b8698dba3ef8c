"""Coverage and correlation of candidate features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ticketlab import functions as fn
from ticketlab.config import HIGH_CORRELATION
from ticketlab.schema import TARGET

GROUPS = 16  # tasks in which the states of all others meet first


def feature_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of present values and type per feature, best covered first."""
    kinds = dict(df.dtypes)
    rows = []
    for c in columns:
        value = fn.nan_to_null(c) if kinds[c] in ("double", "float") else F.col(c)
        rows.append(
            F.struct(
                F.lit(c).alias("feature"),
                fn.percent(F.count(value), F.count("*"), None).alias("non_null_pct"),
                F.lit(kinds[c]).alias("dtype"),
            )
        )
    return (
        df.agg(F.array(*rows).alias("rows"))
        .select(F.inline("rows"))
        .orderBy(F.desc("non_null_pct"), "feature")
    )


def _state(x: np.ndarray) -> np.ndarray:
    """Counts, means, squares and products of all pairs of columns of ``x``, gaps as NaN.

    Entry (i, j) is over the rows where both columns have a value: how many, the mean of
    i, the centred squares of i, the centred products of i and j. Columns are shifted
    close to their means first, so a large mean does not cancel the digits; a constant
    column has squares of exactly 0.
    """
    there = ~np.isnan(x)
    some = there.any(axis=0)
    first = np.where(some, x[there.argmax(axis=0), np.arange(x.shape[1])], 0.0)
    near = np.where(there, x - first, 0.0)
    shift = near.sum(axis=0) / np.maximum(there.sum(axis=0), 1)
    z, m = np.where(there, near - shift, 0.0), there.astype(float)
    n = m.T @ m
    rest = (z.T @ m) / np.maximum(n, 1)
    squares = np.maximum((z * z).T @ m - n * rest * rest, 0.0)
    mean = np.where(n > 0, (first + shift)[:, None] + rest, 0.0)
    return np.stack([n, mean, squares, z.T @ z - n * rest * rest.T])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of the rows of two states; equal means stay exactly as they are."""
    n = a[0] + b[0]
    part = b[0] / np.maximum(n, 1)
    apart, weight = b[1] - a[1], a[0] * part
    return np.stack([n, a[1] + apart * part, a[2] + b[2] + apart**2 * weight, a[3] + b[3] + apart * apart.T * weight])


def _one(states: Iterator[np.ndarray], kind: StructType) -> Iterator[pa.RecordBatch]:
    """All states of a task as one row; none if there are none."""
    whole = None
    with np.errstate(invalid="ignore", over="ignore"):
        for state in states:
            whole = state if whole is None else _merged(whole, state)
    if whole is not None:
        yield pa.RecordBatch.from_arrays([pa.array([whole.ravel()], pa.list_(pa.float64()))], kind.names)


def _comoments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """At most one row with the merged state of all rows: one pass over them.

    Each task sends one state of 4 k^2 numbers for k columns; these meet in GROUPS tasks,
    and the states of those in one.
    """
    k, kind = len(columns), StructType.fromDDL("state array<double>")
    values = df.select(*[fn.nan_to_null(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)])

    def of_rows(batches):
        def read():
            for batch in batches:
                if batch.num_rows:
                    filled = [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns]
                    with np.errstate(invalid="ignore", over="ignore"):
                        yield _state(np.column_stack(filled))

        return _one(read(), kind)

    def of_states(batches):
        return _one((np.array(row).reshape(4, k, k) for b in batches for row in b.column(0).to_pylist()), kind)

    grouped = values.mapInArrow(of_rows, kind).repartition(GROUPS).mapInArrow(of_states, kind)
    return grouped.repartition(1).mapInArrow(of_states, kind)


def _pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], mirrored: bool) -> DataFrame:
    """Long table of correlations over the rows where both values are present.

    Null if there are none, a column does not vary over them, or an infinite value is
    among them. The pairs are as many as their columns say, whatever the rows.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    index, k = {c: i for i, c in enumerate(columns)}, len(columns)
    rows = [
        (left, right, index[left] * k + index[right], index[right] * k + index[left])
        for a, b in pairs
        for left, right in ([(a, b), (b, a)] if mirrored and a != b else [(a, b)])
    ]
    wanted = df.sparkSession.createDataFrame(rows, "feature_1 string, feature_2 string, at int, back int")
    entry = lambda part, at: F.element_at("state", F.lit(part * k * k + 1) + F.col(at))
    left, right, product = entry(2, "at"), entry(2, "back"), entry(3, "at")
    r = product / (F.sqrt(left) * F.sqrt(right))
    sound = (left > 0) & (right > 0) & ~F.isnan(r) & fn.is_finite(left) & fn.is_finite(right)
    bounded = F.when(sound, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    # One row of states beside a row for each pair; without rows there is no state.
    held = _comoments(df, columns).agg(F.first("state").alias("state"))
    return wanted.crossJoin(F.broadcast(held)).select("feature_1", "feature_2", bounded.alias("correlation"))


def corr_with_target(df: DataFrame, columns: Sequence[str], target: str = TARGET) -> DataFrame:
    """Absolute correlation of each numeric feature with the target, largest first."""
    return (
        _pairs(df, [(c, target) for c in columns], mirrored=False)
        .select(F.col("feature_1").alias("feature"), F.abs("correlation").alias("abs_correlation"))
        .orderBy(F.desc_nulls_last("abs_correlation"), "feature")
    )


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All ordered pairs of features with their correlation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return _pairs(df, pairs, mirrored=True)


def high_corr_pairs(
    df: DataFrame, columns: Sequence[str], threshold: float = HIGH_CORRELATION
) -> DataFrame:
    """Pairs beyond the threshold in either direction, strongest first."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame(
            [], "feature_1 string, feature_2 string, correlation double"
        )
    return (
        _pairs(df, pairs, mirrored=False)
        .filter(F.abs("correlation") > threshold)
        .withColumn("correlation", fn.round_half_away("correlation", 3))
        .orderBy(F.desc(F.abs("correlation")), "feature_1", "feature_2")
    )
