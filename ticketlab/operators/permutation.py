"""Columns dealt anew by keyed bijections of row positions.

Rows are numbered once. A bijection is an expression over the position, so each group of
columns gets one of its own without another sort, and all of them go through one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlab.operators import order_stats

ROUNDS = 6
DIGITS = 12  # hexadecimal digits of a draw


def _draw(key: str, turn: int, line: str) -> Column:
    text = F.concat(F.col(key), F.lit(f"|{turn}|"), F.col(line).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("bigint")


def deal(df: DataFrame, n: int, position: str = "position", key: str = "key", name: str = "to") -> DataFrame:
    """Add ``name``, the place that ``position`` gets among 0 to ``n`` - 1 by the text in ``key``.

    The places are written line by line into a grid nearly as wide as high, whose last
    line may be shorter. Each line is turned by a draw from the key and its number, then
    each column likewise, in turns. A turn moves places within a line or column of
    known length, so that every round is a bijection of exactly the ``n`` places.
    """
    width = math.isqrt(max(n - 1, 0)) + 1
    last, end = divmod(max(n - 1, 0), width)
    in_line = F.when(F.col("_line") < last, width).otherwise(end + 1)
    in_column = F.when(F.col("_column") <= end, last + 1).otherwise(last)
    at = df.withColumns({"_line": F.expr(f"`{position}` div {width}"), "_column": F.col(position) % width})
    for turn in range(ROUNDS):
        if turn % 2 == 0:
            at = at.withColumn("_column", (F.col("_column") + _draw(key, turn, "_line")) % in_line)
        else:
            at = at.withColumn("_line", (F.col("_line") + _draw(key, turn, "_column")) % in_column)
    return at.withColumn(name, F.col("_line") * width + F.col("_column")).drop("_line", "_column")


def permute(
    df: DataFrame, groups: Sequence[str | Sequence[str]], seed: int, key: str = "ticket_id"
) -> DataFrame:
    """Give every row, for each group, the columns of another row, as ``_swap_<column>``.

    A group is a column or several that stay together; each has a bijection of its own,
    named by the seed and its first column. ``key`` is unique and orders the rows. Values
    travel in narrow rows, one shuffle for each type of column; a row collects as many as
    there are columns. An empty table stays empty.
    """
    groups = [[g] if isinstance(g, str) else list(g) for g in groups]
    rows = order_stats.with_position(df, [key]).withColumnRenamed("position", "_position")
    n = rows.count()
    sent: dict[str, list[tuple[str, str]]] = {}
    kinds = dict(df.dtypes)
    for group in groups:
        for column in group:
            sent.setdefault(kinds[column], []).append((column, f"{seed}|{group[0]}"))
    out = rows
    for i, columns in enumerate(sent.values()):
        values = [
            F.struct(F.lit(k).alias("slot"), F.lit(by).alias("key"), F.col(c).alias("value"))
            for k, (c, by) in enumerate(columns)
        ]
        dealt = (
            deal(rows.select("_position", F.inline(F.array(*values))), n, "_position")
            .groupBy(F.col("to").alias("_to"))
            .agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias(f"_dealt{i}"))
        )
        out = out.join(dealt, F.col("_position") == F.col("_to")).drop("_to")
        out = out.withColumns({f"_swap_{c}": F.col(f"_dealt{i}")[F.lit(k)] for k, (c, _) in enumerate(columns)})
        out = out.drop(f"_dealt{i}")
    return out.drop("_position")
