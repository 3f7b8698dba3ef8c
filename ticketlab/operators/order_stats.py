"""Exact order statistics without a global sort in one task.

Rows are first counted per distinct key (combined map-side, so repeated values cost
nothing), the distinct keys are range-partitioned into blocks, and each block gets the
number of rows ahead of it. Only blocks that hold a wanted rank are then looked into.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

DIRECT = 1_000_000  # rows that may be ordered without a bound
SAMPLE_FACTOR = 100  # rows sampled per wanted row when looking for a bound
BUCKET_BYTES = 32 << 20  # of a table for each of its buckets
DIRECT_BUCKETS, MOST_BUCKETS = 512, 2048
DIGITS = 3  # hexadecimal digits per step of the hash sample: 4096 counters


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: the one named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="ticketlab-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder beside the checkpoints that is removed afterwards."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pin(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and return it read back.

    Range boundaries come from sampling, so a frame that is used twice after a range
    partitioning must be fixed first. A table survives the loss of executors, cuts the
    lineage, and lets later steps read only the columns they need.
    """
    path = f"{folder or shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin_by(
    df: DataFrame, key: str, buckets: int, folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``pin`` in buckets by the hash of ``key``; returned read by bucket, and read like any table.

    Groupings and joins by the key, alone or with more columns, shuffle nothing of what is
    read by bucket; the setting that this needs stays for the session, since plans are made
    later. A task writes a file for each bucket, so beyond ``DIRECT_BUCKETS`` the rows are
    shuffled to their buckets first. One value of the key is in one bucket: see ``heavy``.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{folder or shared_folder(spark)}/{name}"
    rows = df.coalesce(buckets) if buckets <= DIRECT_BUCKETS else df.repartition(buckets, key)
    writer = rows.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(buckets, key).saveAsTable(name)
    by_bucket = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone; its files stay
    return by_bucket, spark.read.schema(df.schema).parquet(path)


def bucket_count(df: DataFrame) -> int:
    """Buckets for a stored table by its size, or 0 beyond ``MOST_BUCKETS``."""
    found = max(df.sparkSession.sparkContext.defaultParallelism, -(-estimated_bytes(df) // BUCKET_BYTES))
    return found if found <= MOST_BUCKETS else 0


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def can_broadcast(df: DataFrame) -> bool:
    """Whether that is within the session's broadcast threshold."""
    return estimated_bytes(df) <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def heavy(df: DataFrame, key: str, buckets: int) -> list:
    """Values of ``key`` that hold more than a quarter of an even bucket, at most 4 * ``buckets``."""
    share = 4 * buckets
    # All values above the share are among the frequent items, with others that the count excludes.
    found = df.filter(F.col(key).isNotNull()).stat.freqItems([key], 1 / share).first()[0]
    counted = df.filter(F.col(key).isin(found)).groupBy(key).agg(F.count("*").alias("n"))
    return [row[0] for row in counted.filter(F.col("n") * share > df.count()).collect()]


def in_parts(
    df: DataFrame, key: str, buckets: int, folder: str | None = None
) -> tuple[list[tuple[DataFrame, bool]], Column]:
    """``pin_by`` in at most two parts, each with whether it is read by bucket, and the condition of the first.

    The other has the rows with a ``heavy`` value or none, which would be in one bucket. No
    value is in both.
    """
    rows, any_rows = pin_by(df, key, buckets, folder)
    hot = heavy(any_rows, key, buckets)
    light = ~F.col(key).isin(hot) if hot else F.col(key).isNotNull()
    rest = any_rows.filter(~F.coalesce(light, F.lit(False)))
    return [(rows.filter(light), True)] + ([] if rest.isEmpty() else [(rest, False)]), light


def _blocks(
    counts: DataFrame, by: Sequence[str], order: Sequence[str], weight: str, folder: str | None
):
    """Range blocks of ``counts`` and, per block, the weight in it, ahead of it and overall."""
    blocks = pin(
        counts.repartitionByRange(*by, *order).withColumn("_block", F.spark_partition_id()), folder
    )
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ahead = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per block and group: at most the number of shuffle partitions per group.
    totals = (
        blocks.groupBy(*by, "_block")
        .agg(F.sum(weight).alias("_inside"))
        .select(
            *by,
            "_block",
            "_inside",
            F.coalesce(F.sum("_inside").over(ahead), F.lit(0)).alias("_before"),
            F.sum("_inside").over(group).alias("_total"),
        )
    )
    return blocks, totals


def _attach(blocks: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    right = totals.select(
        F.col("_block").alias("_b"),
        "_before",
        "_total",
        *[F.col(c).alias(f"_by_{c}") for c in by],
    )
    if not by:
        # At most one row per block, whatever the number of rows.
        right = F.broadcast(right)
    condition = blocks["_block"] == right["_b"]
    for c in by:
        condition = condition & blocks[c].eqNullSafe(right[f"_by_{c}"])
    return blocks.join(right, condition).drop("_b", *[f"_by_{c}" for c in by])


def running_total(
    df: DataFrame,
    order: Sequence[str],
    weight: str,
    by: Sequence[str] = (),
    folder: str | None = None,
) -> DataFrame:
    """Add ``running`` (up to and including the row) and ``overall``, in ascending ``order``.

    ``order`` must be unique within ``by``.
    """
    blocks, totals = _blocks(df, by, order, weight, folder)
    inside = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return _attach(blocks, totals, by).select(
        *df.columns,
        (F.col("_before") + F.sum(weight).over(inside)).alias("running"),
        F.col("_total").alias("overall"),
    )


def with_position(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``position``, the zero-based row number in ascending ``order``."""
    sorted_ = pin(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "*",
            F.spark_partition_id().alias("_block"),
            # The low 33 bits number the rows of a partition.
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_local"),
        )
    )
    ahead = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sorted_.groupBy("_block")
        .count()
        .select(
            F.col("_block").alias("_b"),
            F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_before"),
        )
    )
    # One row per partition, so its size does not depend on the rows.
    return sorted_.join(F.broadcast(offsets), F.col("_block") == F.col("_b")).select(
        *df.columns, (F.col("_before") + F.col("_local")).alias("position")
    )


def quantiles(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    folder: str | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles, as an array column ``q`` per group.

    Null and NaN values do not count. Without groups the result is one row.
    """
    by = list(by)
    value = F.col(column).cast("double").alias("_value")
    counts = (
        df.select(*by, value)
        .filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
        .groupBy(*by, "_value")
        .agg(F.count("*").alias("_n"))
    )
    blocks, totals = _blocks(counts, by, ["_value"], "_n", folder)
    wanted = []
    for p in probabilities:
        place = (F.col("_total") - 1).cast("double") * F.lit(float(p))
        wanted.append((F.floor(place), F.ceil(place), place - F.floor(place)))
    ranks = [r for low, high, _ in wanted for r in (low, high)]
    hit = reduce(
        lambda a, b: a | b,
        [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_inside")) for r in ranks],
    )
    inside = Window.partitionBy(*by, "_block").orderBy("_value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rows = _attach(blocks, totals.filter(hit), by).withColumn(
        "_end", F.col("_before") + F.sum("_n").over(inside)
    )
    rows = rows.withColumn("_start", F.col("_end") - F.col("_n"))
    picks = []
    for i, (low, high, part) in enumerate(wanted):
        for name, rank in (("low", low), ("high", high)):
            at = (F.col("_start") <= rank) & (rank < F.col("_end"))
            picks.append(F.max(F.when(at, F.col("_value"))).alias(f"_{name}{i}"))
        picks.append(F.max(part).alias(f"_part{i}"))
    found = rows.groupBy(*by).agg(*picks)
    interpolated = [
        F.when(F.col(f"_low{i}") == F.col(f"_high{i}"), F.col(f"_low{i}")).otherwise(
            F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}")
        )
        for i in range(len(wanted))
    ]
    return found.select(*by, F.array(*interpolated).alias("q"))


def median(df: DataFrame, column: str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    return quantiles(df, column, [0.5], by).select(*by, F.col("q")[0].alias(name))


def quantile_list(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float]:
    """Exact quantiles as numbers, the counterpart of ``approxQuantile``."""
    with scratch(df.sparkSession) as folder:
        row = quantiles(df, column, probabilities, folder=folder).first()
    return [] if row is None or row["q"][0] is None else list(row["q"])


def keys_at(df: DataFrame, order: Sequence[str], positions: Sequence[int]) -> list[Row | None]:
    """Key of the row at each zero-based position in ascending ``order``.

    Works key column by key column: the first column is counted per distinct value, and
    only rows that share a boundary value are looked at for the next column.
    """
    first, rest = order[0], list(order[1:])
    if not positions:
        return []
    with scratch(df.sparkSession) as folder:
        counts = df.groupBy(first).agg(F.count("*").alias("_n"))
        ranked = running_total(counts, [first], "_n", folder=folder)
        start = F.col("running") - F.col("_n")
        hits = [(start <= p) & (F.lit(p) < F.col("running")) for p in positions]
        # At most one row per wanted position.
        bounds = ranked.filter(reduce(lambda a, b: a | b, hits)).select(
            first, start.alias("start"), F.col("running").alias("end")
        ).collect()
    found: list[Row | None] = []
    for p in positions:
        bound = next((b for b in bounds if b["start"] <= p < b["end"]), None)
        if bound is None or not rest:
            found.append(bound and Row(**{first: bound[first]}))
            continue
        tied = df.filter(F.col(first).eqNullSafe(F.lit(bound[first]))).select(*rest)
        inner_position = p - bound["start"]
        inner = keys_at(tied, rest, [inner_position])[0]
        found.append(Row(**{first: bound[first]}, **inner.asDict()))
    return found


def literal_key(df: DataFrame, order: Sequence[str], key: Row) -> Column:
    types = df.select(*order).schema
    return F.struct(*[F.lit(key[c]).cast(types[c].dataType).alias(c) for c in order])


def key_before(df: DataFrame, order: Sequence[str], key: Row, inclusive: bool = False) -> Column:
    """Whether a row's key sorts before ``key``, nulls first."""
    here, there = F.struct(*order), literal_key(df, order, key)
    before = here <= there if inclusive else here < there
    lead = key[order[0]]
    if lead is None:
        return before
    # Repeats the leading column as a plain comparison, which the scan can push down.
    return before & (F.col(order[0]).isNull() | (F.col(order[0]) <= F.lit(lead)))


def _bounded(df: DataFrame, order: list[str], n: int) -> tuple[Row | None, DataFrame, int]:
    """A key with at least ``n`` rows up to it, the keys up to it, and how many these are.

    The ``n``-th smallest key of any part of the rows has at least ``n`` rows up to it, so
    a random part yields a filter that is always valid and leaves about ``n / part`` of
    the rows. This repeats until few enough are left to order.
    """
    keys = df.select(*order)
    bound, left = None, keys.count()
    while left > max(DIRECT, 2 * SAMPLE_FACTOR * n):
        part = keys.sample(SAMPLE_FACTOR * n / left, seed=left % 1_000_003)
        top = _last_of(part, order, n)
        if top["n"] < n:
            break
        bound = top["key"]
        keys = df.filter(key_before(df, order, bound, inclusive=True)).select(*order)
        before, left = left, keys.count()
        if left > before // 2:
            break
    return bound, keys, left


def smallest(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The ``n`` rows with the smallest keys; ``order`` must be unique.

    A plain ordered limit hands ``n`` rows per input partition to one task; here a bound
    comes first.
    """
    order = list(order)
    bound, keys, left = _bounded(df, order, n)
    if left > DIRECT:
        # The bound is narrowed to the answer on the keys alone, before wide rows are read.
        bound = _last_of(keys, order, n)["key"]
    if bound is not None:
        df = df.filter(key_before(df, order, bound, inclusive=True))
    return df.orderBy(*order).limit(n)


def last_of_smallest(df: DataFrame, order: Sequence[str], n: int) -> Row:
    """Key of the last of the ``n`` rows with the smallest keys."""
    return _last_of(_bounded(df, list(order), n)[1], order, n)["key"]


def _last_of(keys: DataFrame, order: Sequence[str], n: int) -> Row:
    """Count and largest key of the first ``n`` keys."""
    first = keys.orderBy(*order).limit(n)
    return first.agg(F.max(F.struct(*order)).alias("key"), F.count("*").alias("n")).first()


def hash_sample(df: DataFrame, n: int, seed: int, key: str = "ticket_id") -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer) with the smallest salted hash of the unique ``key``.

    The hash is narrowed three digits at a time by counting at most 4096 prefixes, so
    neither the rows nor their hashes are sorted beyond the few that can be chosen.
    """
    hashed = F.md5(F.concat(F.coalesce(F.col(key), F.lit("")), F.lit(f"|{seed}")))
    prefix, need = "", n
    while len(prefix) < 30:
        width = len(prefix) + DIGITS
        rows = df.select(F.substring(hashed, 1, width).alias("digits"))
        if prefix:
            rows = rows.filter(F.col("digits").startswith(prefix))
        counts = sorted((r["digits"], r["count"]) for r in rows.groupBy("digits").count().collect())
        if not prefix and sum(c for _, c in counts) <= n:
            return df
        for digits, count in counts:
            if count >= need:
                prefix = digits
                break
            need -= count
        if count <= need + n:
            break
    near = df.withColumn("_hash", hashed).filter(F.substring("_hash", 1, len(prefix)) <= prefix)
    order = ["_hash", key]
    last = _last_of(near.select(*order), order, n)["key"]
    # A filter, unlike a limit, leaves the sample spread over the tasks that read it.
    return near.filter(key_before(near, order, last, inclusive=True)).drop("_hash")
