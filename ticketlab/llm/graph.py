"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlab.operators.order_stats import delete, pin, shared_folder


def discard(*tables: DataFrame) -> None:
    """Remove tables written by ``pin`` that nothing reads any more."""
    for df in tables:
        shared = shared_folder(df.sparkSession).rpartition(":")[2]
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/table-" in folder and folder.rpartition(":")[2].lstrip("/").startswith(shared.lstrip("/")):
                delete(df.sparkSession, folder)


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v.

    The least neighbours are written before they are joined back, so that both sides of
    the join are plain exchanges and Spark splits the partition of a hub by itself.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pin(both.groupBy("u").agg(F.min("v").alias("m")))
    large = pin(
        both.filter("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .filter("u > v")
        .distinct()
    )
    discard(least)
    least = pin(large.groupBy("u").agg(F.min("v").alias("m")))
    joined = large.join(least, "u")
    small = pin(
        joined.filter("v > m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .distinct()
    )
    discard(least)
    discard(large)
    return small


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of a link with the smallest node it reaches.

    Large-star and small-star steps alternate until the edges stay the same, which takes
    a number of rounds logarithmic in the longest path. Each round is written to the
    checkpoint folder. Null ends and self links are ignored; a node without a link has
    no row.
    """
    edges = pin(
        links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )

    def mark(df: DataFrame):
        return df.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()

    last = mark(edges)
    while last[0]:
        after = _round(edges)
        discard(edges)
        edges, before, last = after, last, mark(after)
        if before == last:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
