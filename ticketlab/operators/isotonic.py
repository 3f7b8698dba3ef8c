"""Isotonic regression as a table of steps, fitted and applied without a driver or a single task.

Adjacent violators are pooled inside groups of neighbouring levels. A pooled level is one
level with the sum and weight of its members, so pooling may go on from any grouping and
ends at the same steps. Groups are moved by half their size until no two neighbours of
any border are in the wrong order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlab import functions as fn
from ticketlab.operators import order_stats

# Functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUP = 1 << 17  # levels pooled together
SENT = 1 << 20  # steps that are sent to every task, 40 bytes each; more are looked up by ranges
ROWS = 50_000  # rows of a batch that a task hands on

_LEVEL = "lo double, hi double, weight double, total double"


def _pooled(batches: Iterator[pa.RecordBatch]):
    """Levels of each group, ascending, with neighbours in the wrong order pooled."""
    group, stack, out = None, [], []

    def batch_of():
        made = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), *[pa.float64()] * 4])],
            ["slot", "lo", "hi", "weight", "total"],
        )
        out.clear()
        return made

    def close():
        out.extend((group, *level) for level in stack)
        stack.clear()

    for batch in batches:
        for g, lo, hi, weight, total in zip(*(c.to_pylist() for c in batch.columns)):
            if g != group:
                close()
                group = g
                if len(out) >= ROWS:
                    yield batch_of()
            while stack and stack[-1][3] * weight > total * stack[-1][2]:
                before = stack.pop()
                lo, weight, total = before[0], before[2] + weight, before[3] + total
            stack.append((lo, hi, weight, total))
    close()
    if out:
        yield batch_of()


def _numbered(levels: DataFrame) -> DataFrame:
    return order_stats.with_position(levels, ["lo"])


def _wrong_borders(levels: DataFrame) -> bool:
    """Whether the last level of a group is above the first one of the next; a row per group."""
    mean = F.col("total") / F.col("weight")
    ends = levels.groupBy("slot").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))
    after = F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("slot"))
    return not ends.select((F.col("last") > after).alias("wrong")).filter("wrong").isEmpty()


def fit_steps(df: DataFrame, actual: str, predicted: str, scale: int | None = None) -> DataFrame:
    """Steps (position, lo, hi, value) of the least-squares ascending fit of ``actual`` on ``predicted``.

    Rows without a finite score or outcome do not count. Equal scores are one level with
    the sum of their outcomes, combined before the shuffle. Tasks hold GROUP levels; a
    round that pools nothing across a border is the last one, and each other round leaves
    fewer levels: what is pooled over a border has swallowed half a group by then, or
    ends inside the next group. ``scale`` states the decimals of the outcomes: sums are then
    of whole numbers and do not depend on partitioning.
    """
    unit = 10.0 ** (scale or 0)
    label = F.col("label") if scale is None else F.round(F.col("label") * unit)
    levels = (
        df.select(F.col(predicted).cast("double").alias("lo"), F.col(actual).cast("double").alias("label"))
        .filter(fn.is_finite("lo") & fn.is_finite("label"))
        .groupBy("lo")
        .agg(F.count("*").cast("double").alias("weight"), F.sum(label).alias("total"))
        .select("lo", F.col("lo").alias("hi"), "weight", "total")
    )
    with order_stats.scratch(df.sparkSession) as place:
        shift = 0
        while True:
            numbered = _numbered(levels).withColumn("slot", F.floor((F.col("position") + shift) / GROUP))
            levels = order_stats.pin(
                numbered.repartition("slot")
                .sortWithinPartitions("slot", "lo")
                .select("slot", "lo", "hi", "weight", "total")
                .mapInArrow(_pooled, f"slot bigint, {_LEVEL}"),
                place,
            )
            if not _wrong_borders(levels):
                break
            levels = levels.drop("slot")
            shift = GROUP // 2 - shift
        value = F.col("total") / (F.col("weight") * unit)
        return order_stats.pin(_numbered(levels.drop("slot")).select("position", "lo", "hi", value.alias("value")))


def _between(x: np.ndarray, lo, hi, value) -> np.ndarray:
    """Value of the step around x, on the line between two steps, or of the nearest end."""
    known = np.isfinite(x) | np.isinf(x)
    out = np.full(len(x), np.nan)
    k = np.clip(np.searchsorted(lo, x[known], "right") - 1, 0, len(lo) - 1)
    following = np.minimum(k + 1, len(lo) - 1)
    gap = lo[following] - hi[k]
    with np.errstate(invalid="ignore", divide="ignore"):
        part = np.where(gap > 0, np.clip((x[known] - hi[k]) / gap, 0, 1), 0.0)
    # Both ends exactly, without a rounding in between.
    line = value[k] + np.where(part > 0, part * (value[following] - value[k]), 0.0)
    out[known] = np.where(part == 1, value[following], line)
    return out


@dataclass
class Calibrator:
    """Stored steps of an ascending fit."""

    steps: DataFrame

    def save(self, path: str) -> None:
        self.steps.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> Calibrator:
        return cls(SparkSession.active().read.parquet(path))

    def is_sent(self) -> bool:
        """Whether the steps go to the tasks, which reads the rows once."""
        return self.steps.count() <= SENT

    def apply(self, df: DataFrame, predicted: str, name: str) -> DataFrame:
        """``df`` with the calibrated score in ``name``; null where there is no score.

        Between steps the value is on the line from one to the next, outside all of them
        that of the nearest. Up to SENT steps go to the tasks; more are looked up by
        ranges of the distinct scores, which are then joined to the rows.
        """
        if self.is_sent():
            return df.withColumn(name, self._sent(F.col(predicted).cast("double")))
        return self._by_ranges(df, predicted, name)

    def _sent(self, x: Column) -> Column:
        table = self.steps.orderBy("position").select("lo", "hi", "value").toArrow()
        if not table.num_rows:
            return F.lit(None).cast("double")
        arrays = [table[c].to_numpy() for c in ("lo", "hi", "value")]
        sent = self.steps.sparkSession.sparkContext.broadcast(arrays)

        @F.arrow_udf("double")
        def value(x: pa.Array) -> pa.Array:
            numbers = x.fill_null(float("nan")).to_numpy(zero_copy_only=False)
            return pa.array(_between(numbers, *sent.value), pa.float64(), from_pandas=True)

        return value(x)

    def _by_ranges(self, df: DataFrame, predicted: str, name: str) -> DataFrame:
        x = F.col(predicted).cast("double")
        after = self.steps.select((F.col("position") - 1).alias("position"), F.col("lo").alias("next_lo"), F.col("value").alias("next"))
        step = F.struct("lo", "hi", "value", "next_lo", "next")
        marks = self.steps.join(after, "position", "left").select(F.col("lo").alias("x"), F.lit(0).alias("kind"), step.alias("step"))
        none = F.lit(None).cast(marks.schema["step"].dataType)
        asked = df.select(x.alias("x")).filter("x is not null and not isnan(x)").distinct()
        asked = asked.select("x", F.lit(1).alias("kind"), none.alias("step"))
        placed = order_stats.pin(
            marks.union(asked)
            .repartitionByRange("x")
            .sortWithinPartitions("x", "kind")
            .select("*", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("at"))
        )
        # One row per block: the last step before it.
        ends = placed.groupBy("block").agg(F.max_by("step", F.when(F.col("step").isNotNull(), F.col("at"))).alias("end"))
        ahead = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(F.col("block").alias("b"), F.last("end", ignorenulls=True).over(ahead).alias("carried"))
        inside = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        first = self.steps.orderBy("position").limit(1).select(F.col("value").alias("first"))
        found = (
            placed.withColumn("own", F.last("step", ignorenulls=True).over(inside))
            .filter("kind = 1")
            .join(F.broadcast(carried), F.col("block") == F.col("b"))
            .withColumn("s", F.coalesce("own", "carried"))
            .crossJoin(F.broadcast(first))  # one row
        )
        part = F.least((F.col("x") - F.col("s.hi")) / (F.col("s.next_lo") - F.col("s.hi")), F.lit(1.0))
        line = F.col("s.value") + part * (F.col("s.next") - F.col("s.value"))
        value = (
            F.when(F.col("s").isNull(), F.col("first"))
            .when(F.col("s.next_lo").isNull() | (F.col("x") <= F.col("s.hi")), F.col("s.value"))
            .otherwise(line)
        )
        table = order_stats.pin(found.select(F.col("x").alias("_x"), value.alias(name)))
        return df.join(table, x == F.col("_x"), "left").drop("_x")
