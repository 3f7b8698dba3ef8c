"""Train, validation and test splits by position in time order.

Only the keys at the two cut-offs are looked up; the tickets themselves are labelled by
comparing their key with those two, without a sort or shuffle of the wide rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlab import functions as fn
from ticketlab.config import SplitFractions
from ticketlab.operators import order_stats
from ticketlab.schema import TARGET

TIME_ORDER = ("created_at", "ticket_id")


def temporal_split(
    df: DataFrame,
    fractions: SplitFractions = SplitFractions(),
    order: Sequence[str] = TIME_ORDER,
    basis: str = "kept",
    source_rows: int | None = None,
) -> DataFrame:
    """Add ``split``. ``order`` must be unique.

    ``basis='kept'`` takes the fractions of the rows given; ``'source'`` takes them of
    ``source_rows``, the row count before filtering, so late splits shrink or vanish.
    """
    if basis == "kept":
        n = df.count()
    elif basis == "source":
        if source_rows is None:
            raise ValueError("basis 'source' needs source_rows")
        n = source_rows
    else:
        raise ValueError(f"basis must be 'kept' or 'source', not {basis!r}")
    train_end, val_end = int(n * fractions.train), int(n * (fractions.train + fractions.val))
    first_val, first_test = order_stats.keys_at(df, order, [train_end, val_end])

    def before(key):
        return F.lit(True) if key is None else order_stats.key_before(df, order, key)

    return df.withColumn(
        "split",
        F.when(before(first_val), "train").when(before(first_test), "val").otherwise("test"),
    )


def cap_rows(df: DataFrame, n: int, order: Sequence[str] = TIME_ORDER) -> DataFrame:
    """The first ``n`` rows in time order."""
    key = order_stats.keys_at(df, order, [n])[0]
    return df if key is None else df.filter(order_stats.key_before(df, order, key))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))


def label_stats(df: DataFrame, column: str = TARGET, scale: int | None = None) -> DataFrame:
    """Rows, mean and population deviation of the label per split."""
    label = fn.clean_label(column)
    return df.groupBy("split").agg(
        F.count("*").alias("n"),
        fn.mean(label, scale).alias("mean_label"),
        F.stddev_pop(label).alias("std_label"),
    )
