"""Readers and writers: ticket and aggregate CSV, Parquet, splits, metrics, reports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructType

from ticketlab import functions as fn
from ticketlab.operators import order_stats
from ticketlab.schema import AGGREGATES, TICKETS

# --- fixed values: unquoted texts that mean a missing number ------------------------------
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)
# -----------------------------------------------------------------------------------------

PROBE = 1 << 16  # bytes looked at in one step for the end of a line


def _number(name: str, kind: DataType) -> Column:
    """Text to number: null tokens are null, infinities are kept, other text must parse.

    The cast comes first, since nearly all texts are numbers. The tokens are looked through
    by ``exists``, which Spark evaluates outside whole-stage code: with them, the code for
    all columns of a ticket is one method too long to be compiled.
    """
    raw = F.trim(F.col(name))
    parsed = raw.try_cast(kind)
    if kind.typeName() == "double":
        parsed = fn.nan_to_null(parsed)  # reads infinities in all their spellings
    missing = F.exists(F.lit(list(NULL_TOKENS)), lambda token: token == raw)
    error = F.raise_error(
        F.concat(F.lit(f"column {name}: not a {kind.simpleString()}: "), raw)
    ).cast(kind)
    return F.coalesce(parsed, F.when(raw.isNotNull() & ~missing, error))


def read_csv(
    spark: SparkSession, path: str | list[str], schema: StructType, blank_strings: str = "empty"
) -> DataFrame:
    """Strictly typed CSV; columns are found by their names in the header.

    Blank text is an empty string (``blank_strings='empty'``) or null (``'null'``). Numbers
    accept the usual null tokens; anything else that does not parse raises.
    """
    if blank_strings not in ("empty", "null"):
        raise ValueError(f"blank_strings must be 'empty' or 'null', not {blank_strings!r}")
    raw = (
        spark.read.option("header", True)
        .option("mode", "FAILFAST")
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path}: columns {missing} are missing")
    columns = []
    for f in schema:
        if f.dataType != StringType():
            c = _number(f.name, f.dataType)
        elif blank_strings == "empty":
            c = F.coalesce(F.col(f.name), F.lit(""))
        else:
            c = F.when(F.col(f.name) != "", F.col(f.name))
        columns.append(c.alias(f.name))
    return raw.select(*columns)


def _whole_lines(spark: SparkSession, path: str, limit: int) -> int:
    """Bytes of the whole lines within the first ``limit`` bytes of a file; looks at its end only."""
    with _opened(spark, path) as stream:
        end = limit
        while end > 0:
            start = max(0, end - PROBE)
            stream.seek(start)
            block = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, end - start))
            if b"\n" in block:
                return start + block.rfind(b"\n") + 1
            end = start
    return 0


@contextmanager
def _opened(spark: SparkSession, path: str, create: bool = False):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.create(hadoop) if create else system.open(hadoop)
    try:
        yield stream
    finally:
        stream.close()


def head_paths(spark: SparkSession, path: str, limit_bytes: int, folder: str | None = None) -> list[str]:
    """Files that hold the whole lines within the first ``limit_bytes`` bytes of a file or folder.

    Files count in the order of their names. Those within the bound are taken as they are;
    of the one that crosses it, only the bytes up to the last line end before the bound are
    read and copied, as a stream, to ``folder`` (beside the checkpoints by default), where
    they can be split among tasks. Lines end at a newline, also within quotes.
    """
    if limit_bytes < 1:
        raise ValueError(f"limit_bytes must be positive, not {limit_bytes}")
    listed = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path")
    found, left = [], limit_bytes
    for file in listed.toLocalIterator():
        if file["length"] <= left:
            found.append(file["path"])
            left -= file["length"]
            continue
        size = _whole_lines(spark, file["path"], left)
        if size:
            copy = f"{folder or order_stats.shared_folder(spark)}/head-{uuid.uuid4().hex}.csv"
            with _opened(spark, file["path"]) as source, _opened(spark, copy, create=True) as target:
                spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, target, 0, size)
            found.append(copy)
        break
    if not found:
        raise ValueError(f"{path}: no whole line in the first {limit_bytes} bytes")
    return found


def read_tickets_csv(
    spark: SparkSession,
    path: str,
    limit_rows: int | None = None,
    blank_strings: str = "empty",
    limit_bytes: int | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Ticket CSV in the fixed 31-column schema, optionally only a part for a trial run.

    ``limit_bytes`` reads no more than the first so many bytes, in as many tasks as they
    are worth; ``limit_rows`` hands its rows to one task.
    """
    paths = path if limit_bytes is None else head_paths(spark, path, limit_bytes, folder)
    df = read_csv(spark, paths, TICKETS, blank_strings)
    return df if limit_rows is None else df.limit(limit_rows)


def read_aggregate_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One of the four aggregate CSV files; keys are always read as strings."""
    return read_csv(spark, path, AGGREGATES[kind], blank_strings="null")


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    """A ticket table; NaN is read as null, both mean a missing value."""
    return fn.clean_numbers(spark.read.parquet(path))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the file system its URI names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def path_bytes(spark: SparkSession, path: str) -> int:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()


def _mark(columns: Sequence[str]) -> Column:
    """Order-independent fingerprint of rows: a wide sum of their 64-bit hashes, so equal rows count twice."""
    return F.coalesce(F.sum(F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")), F.lit(0)).cast("string")


def manifest(spark: SparkSession, uri: str) -> DataFrame:
    """Rows and fingerprint of each file of a Parquet table, as they are now."""
    df = spark.read.parquet(uri)
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return df.groupBy(file.alias("file")).agg(F.count("*").alias("n_rows"), _mark(df.columns).alias("mark"))


def changed_files(spark: SparkSession, uri: str) -> DataFrame:
    """Files of a published table that are not as the manifest says: changed, missing or added."""
    said = spark.read.schema("file string, n_rows bigint, mark string").json(f"{uri.rstrip('/')}/_manifest")
    now = manifest(spark, uri).select("file", F.col("n_rows").alias("n_now"), F.col("mark").alias("mark_now"))
    same = F.col("n_rows").eqNullSafe(F.col("n_now")) & F.col("mark").eqNullSafe(F.col("mark_now"))
    return said.join(now, "file", "full").filter(~same).select("file", "n_rows", "n_now")


def _move(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not path(source).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(source), path(target)):
        raise RuntimeError(f"{source} could not be moved to {target}")


def publish(df: DataFrame, uri: str) -> int:
    """Write to any Hadoop URI, verify what was written, then put it in place of what is there.

    The table is written beside the target, with a manifest of its files. Rows and
    fingerprint read back have to be those that went into the write, else the new table is
    removed and an error raised; the old table is not touched before. The switch is two
    renames, the first of which is undone if the second one fails.
    """
    spark, target = df.sparkSession, uri.rstrip("/")
    staging, old = (f"{target}-{name}-{uuid.uuid4().hex[:12]}" for name in ("staging", "old"))
    written = Observation()
    marked = df.observe(written, F.count(F.lit(1)).alias("n"), _mark(df.columns).alias("mark"))
    try:
        write_parquet(marked, staging)
        manifest(spark, staging).coalesce(1).write.json(f"{staging}/_manifest")
        said = spark.read.schema("file string, n_rows bigint, mark decimal(38,0)").json(f"{staging}/_manifest")
        found = said.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"), F.coalesce(F.sum("mark"), F.lit(0)).alias("mark")).first()
        expected = written.get
        if (found["n"], int(found["mark"])) != (expected["n"], int(expected["mark"])):
            raise RuntimeError(f"{uri}: read back {found['n']} rows that are not the {expected['n']} rows written")
        there = path_exists(spark, target)
        if there:
            _move(spark, target, old)
        try:
            _move(spark, staging, target)
        except Exception:
            if there:
                _move(spark, old, target)
            raise
    finally:
        remove(spark, staging)
    remove(spark, old)
    return expected["n"]


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per split, so that reading one split touches only its files."""
    df.write.mode(mode).option("compression", "zstd").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("split") == split)


def ensure_splits(spark: SparkSession, path: str, build, overwrite: bool = False) -> DataFrame:
    """Splits at ``path``; ``build()`` is called and written only if they are not complete.

    A finished write leaves a ``_SUCCESS`` file, which an interrupted one lacks.
    """
    if overwrite or not path_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        write_splits(build(), path)
    return spark.read.parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """One-row table of measures as JSON."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def write_report(df: DataFrame, path: str) -> None:
    """Small report as CSV with a header."""
    write_csv(df, path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)
