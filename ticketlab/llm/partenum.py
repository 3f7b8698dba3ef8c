"""Set-similarity self join of documents on word shingles by PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlab.llm.graph import components, discard
from ticketlab.llm.words import SPACED, Words, carrying, mix, runs, shingles
from ticketlab.operators.order_stats import pin

SHINGLE = 5
SIMILARITY = 80  # per cent
FIRST_BAND = 4  # smallest size of the first band; each band is twice as wide as the one before
LEAST_PARTS = 16
BLOCK = 192  # documents of one side of a comparison in a task
ELEMENTS = 4_000_000  # shingles of one side
COLUMNS = 4096  # shingles compared at a time
FILTER_BITS = 27  # 16 MB, sent to every task, say which texts to read again

_ONE = np.uint64(1)


def distance_bound(n: int, percent: int) -> int:
    """Most elements by which a set of n differs from any set that is similar enough.

    Similar sets of sizes a and b share at least s(a+b)/(1+s) elements and b <= a/s, so
    the symmetric difference is at most (a+b)(1-s)/(1+s).
    """
    largest = n * 100 // percent
    return (n + largest) * (100 - percent) // (100 + percent)


def signatures(elements: np.ndarray, percent: int = SIMILARITY) -> np.ndarray:
    """PartEnum signatures of a sorted set of 64-bit numbers.

    The sizes are cut into bands [B, 2B). A set belongs to its own band and, if a set
    similar to it can lie in the next one, to that one too, so two similar sets share a
    band. Within a band the domain is cut into P ranges. Two similar sets differ in at
    most k elements, hence in at most k ranges; of any k+1 ranges at least one is the
    same in both. The enumerated subsets are single ranges, named by their content.

    Only ranges holding two elements or more are used when there are k+1 of them, and
    then the first k+1 are enough: one of those is untouched, and the other set, which
    has the same content there, lists it as well, because it goes on at least until its
    own k+1 are complete. Sets with fewer such ranges list every range with an element,
    and sets with too few of these list the empty ones besides, of which k+1 of P must
    agree. In all three cases no similar pair is missed.
    """
    n = len(elements)
    k = distance_bound(n, percent)
    if not n or not k:  # only equal sets are similar, and those are one node
        return np.zeros(0, np.uint64)
    band = max(0, (n // FIRST_BAND).bit_length() - 1)
    found = []
    for j in (band, band + 1):
        low = FIRST_BAND << j
        if j > band and n * 100 // percent < low:
            break
        parts = max(LEAST_PARTS, 2 * low // 3)
        part = ((elements >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1))
        counts = np.diff(np.append(starts, n))
        with np.errstate(over="ignore"):
            content = np.add.reduceat(mix(elements), starts)
            place = mix(part[starts] * np.uint64(64) + np.uint64(j + 1))
            names = mix(content + place)
            full = np.flatnonzero(counts > 1)
            if len(full) > k:
                names = names[full[: k + 1]]
            elif len(names) <= k:
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[starts])
                names = np.concatenate((names, mix(mix(empty * np.uint64(64) + np.uint64(j + 1)) ^ _ONE)))
        found.append(names)
    return np.concatenate(found)


def _sets(size: int, percent: int, batches: Iterator[pa.RecordBatch], full: bool):
    words, seen = Words(SPACED), set()
    for batch in batches:
        for first, rows, data, offsets in runs(batch.column(1)):
            hashes, bounds = words.of(data, offsets)
            sizes, nodes, lists = [], [], []
            for i in range(rows):
                s = shingles(hashes[bounds[i] : bounds[i + 1]], size)
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None)
                    lists.append(None)
                    continue
                with np.errstate(over="ignore"):
                    total = np.add.reduce(mix(s + _ONE), keepdims=True) + np.uint64(len(s))
                    node = int(mix(total).view(np.int64)[0])
                nodes.append(node)
                if full:
                    lists.append(s.view(np.int64))
                elif node in seen:
                    lists.append(None)
                else:
                    seen.add(node)
                    lists.append(signatures(s, percent).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, rows),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(lists, pa.list_(pa.int64())),
                ],
                ["id", "n", "node", "items"],
            )


def _read(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, full: bool):
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        lambda batches: _sets(size, percent, batches, full),
        carrying(docs, id_col, "n bigint, node bigint, items array<bigint>"),
    )


def _key(id_col: str):
    return F.pmod(F.xxhash64(id_col), F.lit(1 << FILTER_BITS))


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of an ``id`` (null is one as well), made by Spark in pieces of 4 KB."""
    at = _key("id") + 1
    pieces = ids.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    found = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in pieces.collect():  # at most 2**FILTER_BITS bits
        begin = (row["piece"] - 1) * len(row["bits"])
        found[begin : begin + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return found


def perhaps_in(ids: DataFrame, id_col: str) -> Column:
    """Whether a row's ``id_col`` is among the ``id`` of a table: true for all that are and a few others.

    Only the hash goes through the filter of 2**FILTER_BITS bits, in the scan.
    """
    sent = ids.sparkSession.sparkContext.broadcast(_filter_of(ids))

    @F.arrow_udf("boolean")
    def found(key: pa.Array) -> pa.Array:
        at = key.to_numpy(zero_copy_only=False)
        return pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return found(_key(id_col))


def _chosen(sent, batches: Iterator[pa.RecordBatch]):
    """The rows (key, id, text) whose key has its bit set, without the key."""
    for batch in batches:
        key = batch.column(0).to_numpy()
        keep = sent.value[key >> 3] >> (key & 7).astype(np.uint8) & 1
        rows = batch.filter(pa.array(keep.astype(bool)))
        yield pa.RecordBatch.from_arrays(rows.columns[1:], rows.schema.names[1:])


def _forest(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of one unit, reduced to one star for each group that they connect."""
    pdf = pdf.drop_duplicates("node").reset_index(drop=True)
    sets = [np.asarray(x, np.int64) for x in pdf["items"]]
    n, sizes = len(sets), pdf["n"].to_numpy()
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, uses = np.unique(flat, return_inverse=True, return_counts=True)
    shared = uses[column] > 1
    row, column = row[shared], column[shared]
    if len(column):
        _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        present = np.zeros((n, COLUMNS), np.float32)
        present[row[lo:hi], column[lo:hi] - at] = 1
        common += present @ present.T
    common = common.astype(np.int64)  # below 2**24, so the sums are exact
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    label = np.arange(n)
    while True:
        after = np.where(linked, label[None, :], n).min(axis=1)
        after = np.minimum(after, label)
        if (after == label).all():
            break
        label = after
    nodes = pdf["node"].to_numpy()
    return pd.DataFrame({"a": nodes[label], "b": nodes})[label != np.arange(n)]


def _pieces(size, block: int):
    return F.ceil(size / F.lit(block)).cast("bigint")


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = SIMILARITY,
    block: int = BLOCK,
) -> DataFrame:
    """Per document: its id, ``n_shingles`` and ``component_id``.

    Words are what stands between ASCII white space, A-Z lower-cased; a set is the
    distinct shingles of ``shingle`` words, or the whole sequence if it is shorter.
    Two documents link when 100 * common >= percent * union, which is checked on the
    whole sets. ``component_id`` is the smallest id reachable by links, itself included.

    1. One pass makes the sets. Equal sets are one node, named by 64 bits of the set, and
       a task lists the signatures of a node once.
    2. Nodes under one signature are chained to the smallest of them, which keeps
       candidates linear in the number of signatures; the chains' components are the
       candidate groups.
    3. Each candidate group is compared by blocks inside tasks, either as a whole or
       signature by signature, whichever means fewer comparisons; both cover all pairs
       that share a signature. A task holds two blocks of about ``block`` sets, fewer if
       they have over ELEMENTS shingles, and emits a forest of the links it found, so a
       large group of near copies never becomes rows of pairs.

    4. The texts of candidates are read again; a filter of 2**FILTER_BITS bits over hashes of
    their ids picks them in the scan. Where there are far more candidates than bits, more
    sets than needed are made and shuffled; the result is the same.

    Null or empty texts have no shingles and stay alone. Null ids are kept, link like
    others and count for ``component_id`` only where a group has no other; rows that
    repeat an id are judged by their own text. Other columns are ignored. An empty table
    gives an empty result.
    """
    made = pin(_read(docs, id_col, text_col, shingle, percent, False))
    same = Window.partitionBy("sig")
    members = pin(
        made.filter(F.size("items") > 0)
        .select("node", F.explode("items").alias("sig"))
        .withColumns({"lo": F.min("node").over(same), "hi": F.max("node").over(same)})
        .filter("lo < hi")
        .select("sig", "node", "lo")
        .distinct()
    )
    chained = components(members.select(F.col("lo").alias("a"), F.col("node").alias("b")))
    candidates = pin(chained)
    discard(chained)

    # Signatures with the same members are one group.
    groups = (
        members.groupBy("sig", "lo")
        .agg(F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("mark"))
        .groupBy("lo", "size", "mark")
        .agg(F.min("sig").alias("sig"))
        .join(candidates.withColumnRenamed("node", "lo"), "lo")
        .select("sig", "component", "size")
    )
    cost = groups.groupBy("component").agg(F.sum(F.col("size") * F.col("size")).alias("apart"))
    # The document whose text gives each node that takes part.
    wanted = pin(
        made.filter(F.size("items") > 0)
        .select("id", "node", "n")
        .join(candidates, "node")
        .groupBy("node", "component")
        .agg(F.min("id").alias("id"), F.max("n").alias("n"))
    )
    whole = wanted.groupBy("component").agg(
        F.count("*").alias("size"), F.sum("n").alias("elements"), F.max("n").alias("largest")
    )
    plan = pin(
        whole.join(cost, "component").withColumn(
            "together", F.col("size") * F.col("size") <= 4 * F.col("apart")
        ).drop("apart")
    )
    units = wanted.join(plan.filter("together"), "component").select(
        F.lit(0).alias("kind"), F.col("component").alias("unit"), "size", "elements", "node"
    ).union(
        groups.join(plan.filter("not together").select("component", "largest"), "component")
        .join(members.select("sig", "node"), "sig")
        .select(F.lit(1).alias("kind"), F.col("sig").alias("unit"), "size", F.col("size") * F.col("largest"), "node")
    )
    by_size = F.greatest(_pieces(F.col("size"), block), _pieces(F.col("elements"), ELEMENTS))
    pieces = units.withColumn("pieces", by_size).withColumn(
        "own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("pieces"))
    )
    dealt = pieces.select(
        "kind", "unit", "node", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("other")
    ).select(
        "kind", "unit", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    # The sets are made again from the texts of those documents (and a few whose hash is
    # the same); a filter tells them in the scan, so that no text is shuffled to be chosen.
    sent = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted))
    texts = docs.select(_key(id_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.mapInArrow(lambda b: _chosen(sent, b), carrying(docs, id_col, "text string"))
    sets = (
        _read(texts, "id", "text", shingle, percent, True)
        .join(wanted.select("node"), "node", "left_semi")
        .dropDuplicates(["node"])
        .select("node", "n", "items")
    )
    links = pin(
        dealt.join(sets, "node")
        .groupBy("kind", "unit", "i", "j")
        .applyInPandas(lambda pdf: _forest(pdf, percent), "a bigint, b bigint")
    )
    discard(members, candidates, wanted, plan)
    groups_of = components(links)
    discard(links)
    placed = made.select("id", "n", "node").join(groups_of, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    # Written first, so that Spark can split the rows of a large group in the join.
    least = pin(placed.filter("component is not null").groupBy("component").agg(F.min("id").alias("least")))
    return placed.join(least, "component", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
    )
