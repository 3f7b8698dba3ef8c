"""Trie of conversation prefixes, its subtree totals by time-forward processing."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlab.operators.order_stats import pin

BLOCK = 4096  # turns of a conversation that are handled together
TOP = 16  # nodes with more than 1/2**TOP of all turns are above the shards
HELD = 200_000  # messages a task holds before it spills them
ROWS = 10_000  # rows of a batch that a task hands on
CHUNK = 4096  # conversation ids that are joined to one string
PREFIX = 64  # characters of a text that choose its range of rows; inside a range all count

NODE = ["a", "b"]  # the 128 bits that name a node
PARENT = ["pa", "pb"]
SHARD = ["ra", "rb"]


# --- conversations as turns in order, without their texts ---------------------------------


def _number(batches: Iterator[pa.RecordBatch]):
    """Place of each row within its conversation and range of rows."""
    block, nothing = TaskContext.get().partitionId(), object()
    conv, at = nothing, 0
    for batch in batches:
        places = []
        for c in batch.column(0).to_pylist():
            conv, at = c, (at + 1 if c == conv else 0)
            places.append(at)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([block] * len(places), pa.int32()), pa.array(places, pa.int64())],
            [*batch.schema.names, "block", "local"],
        )


def ordered_turns(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): (conv, depth, x, y, bytes) from depth 1, and (conv, length).

    Turns come in the order of (turn, role, text), nulls first; null roles and texts are
    empty. x and y are 64-bit hashes of role and text, ``bytes`` the text's size. Rows are
    numbered in ranges, so that a conversation of any size spreads over tasks; the first
    conversation of a range is the only one that can have begun before it. Rows without a
    conversation id belong to none and are left out.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    made = rows.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")
    )
    hashed = (
        made.repartitionByRange("conv", "turn", F.substring("role", 1, PREFIX), F.substring("text", 1, PREFIX))
        .sortWithinPartitions("conv", "turn", "role", "text")
        .select(
            "conv",
            F.xxhash64(F.lit(1), "role", F.lit(2), "text").alias("x"),
            F.xxhash64(F.lit(3), "text", F.lit(4), "role").alias("y"),
            F.octet_length("text").cast("bigint").alias("bytes"),
        )
    )
    local = pin(hashed.mapInArrow(_number, "conv bigint, x bigint, y bigint, bytes bigint, block int, local bigint"))
    held = pin(local.groupBy("block", "conv").agg((F.max("local") + 1).alias("n")))
    ahead = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per range, whatever the number of rows.
    before = (
        held.withColumn("before", F.sum("n").over(ahead))
        .filter("before is not null")
        .select(F.col("block").alias("in_block"), F.col("conv").alias("of"), "before")
    )
    turns = local.join(
        F.broadcast(before), (F.col("block") == F.col("in_block")) & (F.col("conv") == F.col("of")), "left"
    ).select("conv", (F.coalesce("before", F.lit(0)) + F.col("local") + 1).alias("depth"), "x", "y", "bytes")
    return pin(turns), pin(held.groupBy("conv").agg(F.sum("n").alias("length")))


SHARED = 8  # turns at most that a conversation takes from another
EVERY = 5


def rebuild(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths after each conversation c took its first h turns from c - c % 5.

    h is the CRC-32 of the decimal id modulo 9. A conversation that is its own source
    stays; one whose source is shorter or absent takes what there is.
    """

    def h(conv: str) -> Column:
        return F.crc32(F.col(conv).cast("string").cast("binary")) % (SHARED + 1)

    source = convs.select(F.col("conv").alias("source"), F.col("length").alias("there"))
    plan = pin(
        convs.withColumn("source", F.col("conv") - F.col("conv") % EVERY)
        .join(source, "source", "left")
        .select(
            "conv", "source", h("conv").alias("h"), F.least(h("conv"), F.coalesce("there", F.lit(0))).alias("taken"), "length"
        )
        .withColumn("rebuilt", F.col("taken") + F.greatest(F.lit(0), F.col("length") - F.col("h")))
        .withColumn("rebuilt", F.when(F.col("conv") == F.col("source"), F.col("length")).otherwise(F.col("rebuilt")))
    )
    own = (
        turns.join(plan, "conv")
        .filter((F.col("conv") == F.col("source")) | (F.col("depth") > F.col("h")))
        .select(
            "conv",
            F.when(F.col("conv") == F.col("source"), F.col("depth"))
            .otherwise(F.col("depth") - F.col("h") + F.col("taken"))
            .alias("depth"),
            "x", "y", "bytes",
        )
    )
    first = turns.filter((F.col("conv") % EVERY == 0) & (F.col("depth") <= SHARED)).withColumnRenamed("conv", "source")
    lent = (
        first.join(plan.filter("conv != source"), "source")
        .filter(F.col("depth") <= F.col("h"))
        .select("conv", "depth", "x", "y", "bytes")
    )
    return pin(own.union(lent)), plan.select("conv", F.col("rebuilt").alias("length"))


# --- time-forward processing ---------------------------------------------------------------


class Messages:
    """A priority queue of tuples that keeps at most ``held`` in memory, the rest in sorted runs.

    A run is an unnamed temporary file of this task alone, as Spark's own spills are.
    """

    def __init__(self, held: int):
        self.held, self.heap, self.runs, self.number = held, [], [], 0

    def push(self, message: tuple) -> None:
        heappush(self.heap, message)
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        file = tempfile.TemporaryFile()
        for at in range(0, len(self.heap), 1000):
            pickle.dump(self.heap[at : at + 1000], file)
        file.seek(0)
        self.heap = []
        self.number += 1
        self._next(self.number, self._read(file))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def _next(self, number: int, run: Iterator[tuple]) -> None:
        head = next(run, None)
        if head is not None:
            heappush(self.runs, (head, number, run))

    def first(self) -> tuple | None:
        heads = ([self.heap[0]] if self.heap else []) + ([self.runs[0][0]] if self.runs else [])
        return min(heads, default=None)

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            head, number, run = heappop(self.runs)
            self._next(number, run)
            return head
        return heappop(self.heap)


_TOTALS = "a bigint, b bigint, depth bigint, leaves bigint, saved bigint, from_a bigint, from_b bigint"


def _forward(held: int, batches: Iterator[pa.RecordBatch]):
    """Subtree totals of the nodes of a shard, which come by falling depth, then by name.

    Each node takes the messages sent to it, which are the first in the queue by then,
    and sends its total to its parent at depth ``up``. What a shard's root sends leaves
    the shard: rows with a sender are what a node elsewhere is to get.
    """
    queue, names = Messages(held), [f.split()[0] for f in _TOTALS.split(", ")]
    out: list[tuple] = []

    def batch_of():
        made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
        out.clear()
        return made

    for batch in batches:
        for a, b, depth, to_a, to_b, up, leaves, saved, is_root in zip(*(c.to_pylist() for c in batch.columns)):
            while (m := queue.first()) is not None and m[:3] == (-depth, a, b):
                queue.pop()
                leaves, saved = leaves + m[3], saved + m[4]
            out.append((a, b, depth, leaves, saved, None, None))
            if is_root:
                out.append((to_a, to_b, up, leaves, saved, a, b))
            elif to_a is not None:
                queue.push((-up, to_a, to_b, leaves, saved))
        if len(out) >= ROWS:
            yield batch_of()
    if out:
        yield batch_of()


def _totals(dealt: DataFrame) -> DataFrame:
    """Totals of nodes that lie with their whole shard in one partition."""
    held = HELD
    return (
        dealt.select(*NODE, "depth", *PARENT, "up", "leaves", "saved", "is_root")
        .sortWithinPartitions(F.desc("depth"), *NODE)
        .mapInArrow(lambda b: _forward(held, b), _TOTALS)
    )


# --- ids of the conversations that end at a node -----------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]):
    """Ids that end at a node, joined by commas, in chunks; a node that is one chunk is finished."""
    block, nothing = TaskContext.get().partitionId(), object()
    node, ids, begun, number, out = nothing, [], False, 0, []

    def flush(ended: bool):
        nonlocal number, begun
        text, whole = ",".join(map(str, ids)), ended and not begun
        sha = hashlib.sha256(text.encode()).hexdigest() if whole else None
        out.append((*node, block, number, None if whole else text, sha))
        ids.clear()
        number, begun = number + 1, True

    def batch_of():
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
        made = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        out.clear()
        return pa.RecordBatch.from_arrays(made, ["a", "b", "block", "number", "ids", "sha"])

    for batch in batches:
        for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (a, b) != node:
                if ids:
                    flush(True)
                begun, node = node is nothing, (a, b)
            elif len(ids) >= CHUNK:
                flush(False)
            ids.append(conv)
        if len(out) >= ROWS:
            yield batch_of()
    if ids:
        flush(False)
    if out:
        yield batch_of()


def _running(batches: Iterator[pa.RecordBatch]):
    """SHA-256 of the chunks of each node in order."""
    node, sha, out = None, None, []

    def batch_of():
        made = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.string()])]
        out.clear()
        return pa.RecordBatch.from_arrays(made, ["a", "b", "sha"])

    for batch in batches:
        for a, b, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (a, b) != node:
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (a, b), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if len(out) >= ROWS:
            yield batch_of()
    if node:
        out.append((*node, sha.hexdigest()))
    if out:
        yield batch_of()


def _ends(ends: DataFrame) -> DataFrame:
    """(a, b, sha) of (a, b, conv): digests of the ids at each node, ascending."""
    cut = pin(
        ends.repartitionByRange(*NODE, "conv")
        .sortWithinPartitions(*NODE, "conv")
        .mapInArrow(_chunks, "a bigint, b bigint, block int, number bigint, ids string, sha string")
    )
    rest = (
        cut.filter("sha is null")
        .repartition(*NODE)
        .sortWithinPartitions(*NODE, "block", "number")
        .select(*NODE, "ids")
        .mapInArrow(_running, "a bigint, b bigint, sha string")
    )
    return cut.filter("sha is not null").select(*NODE, "sha").union(rest)


# --- the trie -------------------------------------------------------------------------------


def _named(turns: DataFrame) -> DataFrame:
    """Turns with the names of the node they lead to and of its parent.

    A node's name are two sums (exclusive or) of hashes of the turns up to it with their
    depths, so that the parent's name is the node's without the last turn's. They are
    summed in blocks of BLOCK turns, to which those of the blocks before are added.
    """
    placed = turns.select(
        "conv",
        "depth",
        "bytes",
        F.floor((F.col("depth") - 1) / BLOCK).alias("block"),
        F.xxhash64("depth", "x").alias("x"),
        F.xxhash64("y", "depth").alias("y"),
    )
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = pin(placed.withColumn("a", F.bit_xor("x").over(inside)).withColumn("b", F.bit_xor("y").over(inside)))
    over = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = summed.filter(F.col("depth") % BLOCK == 0).select(
        "conv",
        (F.col("block") + 1).alias("block"),
        F.bit_xor("a").over(over).alias("a0"),
        F.bit_xor("b").over(over).alias("b0"),
    )
    return summed.join(before, ["conv", "block"], "left").select(
        "conv",
        "depth",
        "bytes",
        "block",
        F.col("a").bitwiseXOR(F.coalesce("a0", F.lit(0))).alias("a"),
        F.col("b").bitwiseXOR(F.coalesce("b0", F.lit(0))).alias("b"),
        "x",
        "y",
    ).withColumn("pa", F.col("a").bitwiseXOR(F.col("x"))).withColumn("pb", F.col("b").bitwiseXOR(F.col("y"))).drop("x", "y")


def _rows_and_nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their node and whether they are the last, and the nodes with their shard."""
    named = pin(_named(turns))
    members = max(1, named.count() >> TOP)
    above = named.groupBy(*NODE).count().filter(F.col("count") > members)
    above = pin(above.select(*NODE, F.lit(True).alias("above")))
    light = F.when(F.col("above").isNull(), F.struct(*NODE))
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pin(
        named.join(F.broadcast(above), NODE, "left")
        .withColumn("root", F.first(light, ignorenulls=True).over(inside))
        .join(convs, "conv")
        .select(
            "conv", "depth", "bytes", *NODE, *PARENT, "above", F.col("root.a").alias("ra"), F.col("root.b").alias("rb"),
            (F.col("depth") == F.col("length")).cast("bigint").alias("ends"),
        )
    )
    zero, nothing = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    grouped = rows.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.count("*").alias("n_convs"),
        F.sum("ends").alias("ends"),
        F.min("bytes").alias("bytes"),
        *[F.min(c).alias(c) for c in (*PARENT, *SHARD)],
        F.coalesce(F.max("above"), F.lit(False)).alias("above"),
    )
    root = (
        convs.agg(
            F.min("conv").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.sum((F.col("length") == 0).cast("bigint")).alias("ends"),
        )
        .filter("n_convs > 0")
        .select(
            *[zero.alias(c) for c in (*NODE, "depth", "bytes")], "conv_id", "n_convs", "ends",
            *[nothing.alias(c) for c in (*PARENT, *SHARD)], F.lit(True).alias("above"),
        )
    )
    nodes = pin(
        grouped.unionByName(root)
        .withColumn("up", F.col("depth") - 1)
        .withColumn("leaves", (F.col("ends") == F.col("n_convs")).cast("bigint"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
        .withColumn("is_root", F.coalesce((F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")), F.lit(False)))
    )
    return rows, nodes


def _as(df: DataFrame, **names: str) -> DataFrame:
    """Columns under new names, the new one given first."""
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def _subtree_totals(nodes: DataFrame) -> DataFrame:
    """(a, b, leaves, saved) of all nodes, summed over their subtrees."""
    below, above = nodes.filter("not above"), nodes.filter("above")
    first = pin(_totals(below.repartition(*SHARD)))
    sent = first.filter("from_a is not null")
    parts = [first.filter("from_a is null").select(*NODE, "leaves", "saved")]

    # Only the first turn of a later block is the root of a shard that hangs below another.
    late = sent.filter((F.col("depth") > 0) & (F.col("depth") % BLOCK == 0))
    over = below.select(*NODE, F.col("ra").alias("qa"), F.col("rb").alias("qb"))
    inner = pin(late.join(over, NODE).select("from_a", "from_b", *NODE, "qa", "qb"))
    hangs = not inner.isEmpty()
    if hangs:
        upper = inner.select(F.col("qa").alias("a"), F.col("qb").alias("b")).distinct().join(below, NODE)
        upper = pin(upper.select(*NODE, "depth"))
        placed = sent.join(inner.select("from_a", "from_b", "qa", "qb"), ["from_a", "from_b"], "left")
        at = _as(upper, qa="a", qb="b", q_depth="depth")
        placed = placed.join(at, ["qa", "qb"], "left")
        own = _as(upper, from_a="a", from_b="b", own_depth="depth")
        placed = pin(placed.join(own, ["from_a", "from_b"], "left"))
        among = placed.filter("qa is not null or own_depth is not null")
        sent = placed.filter("qa is null and own_depth is null")
    got = sent.groupBy(*NODE).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
    tree = above.join(got, NODE, "left").select(
        *NODE, "depth", *PARENT, "up",
        (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        "is_root",
    )
    if hangs:
        # A shard's root in the tree of roots: its parent there is the root over it, or the node above.
        tree = tree.unionByName(
            among.select(
                F.col("from_a").alias("a"), F.col("from_b").alias("b"), (F.col("depth") + 1).alias("depth"),
                F.coalesce("qa", "a").alias("pa"), F.coalesce("qb", "b").alias("pb"),
                F.coalesce("q_depth", "depth").alias("up"), "leaves", "saved", F.lit(False).alias("is_root"),
            )
        )
    roots = pin(_totals(tree.coalesce(1)))
    parts.append(above.select(*NODE).join(roots, NODE).select(*NODE, "leaves", "saved"))
    if hangs:
        come = inner.join(_as(roots, from_a="a", from_b="b", leaves="leaves", saved="saved"), ["from_a", "from_b"])
        come = come.groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        again = (
            below.drop("leaves", "saved")
            .join(_as(upper, ra="a", rb="b"), SHARD)
            .join(come, NODE, "left")
            .fillna(0, ["leaves", "saved"])
        )
        parts.append(_totals(again.repartition(*SHARD)).filter("from_a is null").select(*NODE, "leaves", "saved"))
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.union(part)
    return sums


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns, with totals of the subtree below it.

    ``turns`` (conv, depth, x, y, bytes) and ``convs`` (conv, length) are as
    ``ordered_turns`` gives them. Result: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (the parent's smallest member; null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (bytes that members share, summed over
    the subtree) and ``ends_sha256`` (of the ids that end there). The text of a node is
    turn ``depth`` of conversation ``conv_id``.

    Nodes are one aggregate over the turns. Those with more than 1/2**TOP of all turns as
    members are above the shards: fewer than 2**(TOP + 1), since each turn is at one node.
    Below them each node belongs to the shard of its first ancestor that is not such a
    node, or that begins a block of BLOCK turns, so neither a turn that many conversations
    share nor a long conversation makes a large shard. Shards are hashed to tasks, sorted
    by falling depth by Spark, and totals go to the parents through a queue that spills
    (``Messages``). What shard roots send to a node above is summed per recipient, and one
    such queue takes it up through the nodes above the shards. Where a shard hangs below
    another (conversations of more than BLOCK turns), their roots are in that queue too,
    at most two per block of a conversation, and what arrives inside a shard then goes
    to the nodes up to its root by a second pass over these shards.

    SHA-256 needs its input in sequence: ids that end at one node are joined to strings
    in parallel, and only these go through one task per node.

    An empty table gives an empty result. Equal rows are turns of their own.
    """
    rows, nodes = _rows_and_nodes(turns, convs)
    children = nodes.filter("depth > 0").groupBy(*PARENT).agg(F.count("*").alias("children"))
    totals = (
        _subtree_totals(nodes)
        .withColumn("children", F.lit(0).cast("bigint"))
        .union(children.select(*PARENT, *[F.lit(0).cast("bigint").alias(c) for c in ("leaves", "saved")], "children"))
        .groupBy(*NODE)
        .agg(*[F.sum(c).alias(c) for c in ("leaves", "saved", "children")])
    )
    zero = F.lit(0).cast("bigint")
    ends = rows.filter("ends = 1").select(*NODE, "conv")
    ends = ends.union(convs.filter("length = 0").select(zero.alias("a"), zero.alias("b"), "conv"))
    # Parents above the shards, fewer than 2**(TOP + 1), are sent along; others have few children each.
    above = _as(nodes.filter("above"), pa="a", pb="b", parent_above="conv_id")
    placed = nodes.select(*NODE, *PARENT, "conv_id", "depth", "n_convs").join(F.broadcast(above), PARENT, "left")
    known = placed.filter("parent_above is not null or depth = 0").withColumnRenamed("parent_above", "parent_conv_id")
    others = placed.filter("parent_above is null and depth > 0").drop("parent_above")
    others = others.join(_as(nodes.filter("not above"), pa="a", pb="b", parent_conv_id="conv_id"), PARENT)
    return (
        known.unionByName(others)
        .join(totals.select(*NODE, "leaves", "saved", "children"), NODE)
        .join(_ends(ends), NODE, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
