"""Huber boosting of leaf-wise trees over stored bin codes.

Features are binned once and stored as blocks of codes. A round needs one aggregate per
step of its tree: sums of gradients and counts per (node, feature, bin), for the smaller
one of two children; the other one is its parent less that. Nodes of few rows are finished
on their rows. Sums are integers, so the trees do not depend on how the rows are
partitioned.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce
from heapq import heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlab.config import BoostParams
from ticketlab.operators import order_stats

# Functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1 << 16  # rows of a stored block
TASK_ROWS = 50_000  # rows that are worth a task of their own
BIN_ROWS = 200_000  # rows, chosen by hash, whose values place the bins
FEW = 1 << 13  # rows of a node that are looked at in one place
FAN_IN = 16  # partial sums that are added up in one place, and tasks that put nodes together
FINEST = 36  # bits behind the binary point of a gradient: a block's sums stay below 2**53
ERROR_BITS = 30  # the same for absolute errors of the validation rows


@dataclass
class Tree:
    """Nodes in arrays; node 0 is the root, a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    code: list[int] = field(default_factory=list)  # left if the row's code is not above it
    threshold: list[float] = field(default_factory=list)  # the same on the feature's values
    group: list[tuple[int, ...] | None] = field(default_factory=list)  # or left if its category is one of these
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)

    def add(self, value: float, rows: int) -> int:
        for column, x in zip(vars(self).values(), (-1, 0, 0.0, None, -1, -1, value, 0.0, rows)):
            column.append(x)
        return len(self.feature) - 1

    def goes_left(self, node: int, x: np.ndarray, codes: bool) -> np.ndarray:
        if self.group[node] is not None:
            return np.isin(x, self.group[node])
        return x <= (self.code[node] if codes else self.threshold[node])

    def walk(self, columns, codes: bool) -> np.ndarray:
        """Leaf of each row; ``columns`` are codes or values by feature."""
        at = np.zeros(len(columns[0]), np.int64)
        for node, rows in self.rows_at(columns, np.arange(len(at)), codes):
            at[rows] = node
        return at

    def rows_at(self, columns, rows: np.ndarray, codes: bool, wanted: set[int] | None = None):
        """(node, its rows among ``rows``) of the wanted nodes, or of all leaves; other subtrees are left out."""
        above = None
        if wanted is not None:
            up = {child: k for k in range(len(self.feature)) for child in (self.left[k], self.right[k]) if child >= 0}
            above = set(wanted)
            for node in wanted:
                while node in up:
                    node = up[node]
                    above.add(node)
        todo = [(0, rows)]
        while todo:
            node, rows = todo.pop()
            if above is not None and node not in above:
                continue
            if node in wanted if wanted is not None else self.feature[node] < 0:
                yield node, rows
                continue
            here = self.goes_left(node, columns[self.feature[node]][rows], codes)
            todo += [(self.left[node], rows[here]), (self.right[node], rows[~here])]


# --- bins --------------------------------------------------------------------------------


def _edges_of(slots: int, max_bins: int, categories: dict[int, int], batches: Iterator[pa.RecordBatch]):
    """Upper bounds of all bins but the last, one row per slot."""
    x = np.concatenate([b.column(0).flatten().to_numpy(zero_copy_only=False) for b in batches] or [np.zeros(0)])
    x = x.reshape(-1, slots)
    edges = []
    for s in range(slots):
        if s in categories:
            edges.append(np.arange(categories[s], dtype=np.float64) + 0.5)
            continue
        values = np.unique(x[:, s])
        if len(values) > max_bins:
            edges.append(np.unique(np.quantile(x[:, s], np.arange(1, max_bins) / max_bins, method="lower")))
        else:
            edges.append(values[:-1] / 2 + values[1:] / 2)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(slots), pa.int32()), pa.array([e.tolist() for e in edges], pa.list_(pa.float64()))],
        ["slot", "edges"],
    )


def bin_edges(rows: DataFrame, slots: int, key: str, max_bins: int, categories: dict[int, int]) -> list[np.ndarray]:
    """Upper bounds of all bins but the last, per slot of the vector ``features``.

    A slot with no more than ``max_bins`` distinct values has a bin for each, bounded half
    way to the next; else the bins are even shares of the rows. Values are looked up, in
    one task, on about BIN_ROWS rows at most, those with the smallest hashes of ``key``
    (all rows, if there are no more): which bounds the bins have is all that depends on
    them, and every row is then put into its bin. Slots in ``categories`` have one bin for
    each of that many codes.
    """
    n = rows.count()
    if not n:
        raise ValueError("there are no rows to train on")
    if n > BIN_ROWS:
        limit = int(2**63 * (2 * BIN_ROWS / n - 1))
        rows = rows.filter(F.xxhash64(F.col(key)) < limit)
    chosen = rows.select(vector_to_array("features").alias("x")).repartition(1)
    found = chosen.mapInArrow(
        lambda b: _edges_of(slots, max_bins, categories, b), "slot int, edges array<double>"
    )
    return [np.array(r["edges"], np.float64) for r in sorted(found.collect())]


def _coded(edges: list[np.ndarray], batches: Iterator[pa.RecordBatch]):
    """Blocks of BLOCK rows: codes by feature, hashes of the key, labels."""
    kind = np.uint8 if max(map(len, edges), default=0) < 256 else np.uint16
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            codes = [np.searchsorted(e, x[:, s]).astype(kind).tobytes() for s, e in enumerate(edges)]
            hashes, labels = (part.column(k).to_numpy(zero_copy_only=False).tobytes() for k in (0, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], pa.binary()) for x in (b"".join(codes), hashes, labels)], ["codes", "hashes", "labels"]
            )


def _block(row, slots: int, kind, base: float):
    labels = np.frombuffer(row[2], np.float64)
    codes = np.frombuffer(row[0], kind).reshape(slots, len(labels))
    return codes, np.frombuffer(row[1], np.uint64), labels, np.full(len(labels), base)


def _stored(rows: DataFrame, edges: list[np.ndarray], key: Column, base: float, folder: str) -> RDD:
    """(codes, hashes, labels, scores) per block, from a stored table."""
    table = order_stats.pin(
        rows.select(F.xxhash64(key).alias("hash"), vector_to_array("features").alias("x"), "_label").mapInArrow(
            lambda b: _coded(edges, b), "codes binary, hashes binary, labels binary"
        ),
        folder,
    )
    kind = np.uint8 if max(map(len, edges), default=0) < 256 else np.uint16
    n = rows.count()
    blocks = table.rdd.map(tuple).map(partial(_block, slots=len(edges), kind=kind, base=base))
    return blocks.coalesce(max(1, min(blocks.getNumPartitions(), n // TASK_ROWS)))


# --- sums ---------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _in_bag(hashes: np.ndarray, bag: int, fraction: float) -> np.ndarray:
    if fraction >= 1:
        return np.ones(len(hashes), bool)
    with np.errstate(over="ignore"):
        mixed = _mixed(hashes + np.uint64(bag * 0x9E3779B97F4A7C15 % 2**64))
    return (mixed >> np.uint64(11)).astype(np.float64) < fraction * 2.0**53


def _gradients(labels, scores, delta: float, bits: int) -> np.ndarray:
    """Clipped residuals as whole multiples of 2**-bits."""
    return np.rint(np.clip(labels - scores, -delta, delta) * 2.0**bits)


def _histogram(codes, g: np.ndarray, features: Sequence[int], bins: list[int]) -> np.ndarray:
    """Gradient sums and counts per feature and bin; ``codes`` are those of ``features``."""
    parts = [
        np.stack((np.bincount(c, g, bins[f]), np.bincount(c, minlength=bins[f]))) for c, f in zip(codes, features)
    ]
    # Whole numbers below 2**53: the double sums are exact.
    return np.concatenate(parts, axis=1).astype(np.int64)


def _joined(one: tuple[dict, dict], other: tuple[dict, dict]) -> tuple[dict, dict]:
    """Sums of the large nodes added up, rows of the small ones put together."""
    return tuple({k: a[k] + b[k] for k in a} for a, b in zip(one, other))


def _by_node(part: tuple[dict, dict]) -> list:
    return [((i, node), found) for i, nodes in enumerate(part) for node, found in nodes.items()]


def _gathered(parts: RDD) -> tuple[dict, dict]:
    """What the parts have of each node, put together before it comes to the driver, unless they are few."""
    if parts.getNumPartitions() <= FAN_IN:
        return reduce(_joined, parts.collect())
    out = {}, {}
    for (i, node), found in parts.flatMap(_by_node).reduceByKey(add, FAN_IN).collect():
        out[i][node] = found
    return out


def _measured(blocks, tree: Tree, large: list[int], small: list[int], features, bins, bag: int, p: BoostParams, bits: int):
    width = sum(bins[f] for f in features)
    sums, found = {k: np.zeros((2, width), np.int64) for k in large}, {k: [] for k in small}
    for codes, hashes, labels, scores in blocks:
        rows = np.flatnonzero(_in_bag(hashes, bag, p.bagging_fraction))
        for node, rows in tree.rows_at(codes, rows, True, {*large, *small}):
            g = _gradients(labels[rows], scores[rows], p.huber_delta, bits)
            mine = [codes[f][rows] for f in features]
            if node in sums:
                sums[node] += _histogram(mine, g, features, bins)
            elif len(g):
                found[node].append((np.stack(mine), g))
    yield sums, found


def _added(parts: RDD):
    """Sum of the parts, added up in steps so that no place adds many."""
    n = parts.getNumPartitions()
    if n <= FAN_IN:
        return reduce(add, parts.collect())
    return parts.treeReduce(add, math.ceil(math.log(n) / math.log(FAN_IN)))


# --- trees --------------------------------------------------------------------------------


@dataclass
class _Open:
    """What is known of a node: sums per feature and bin, its rows if they are few, its best split."""

    sums: np.ndarray
    depth: int
    rows: tuple[np.ndarray, np.ndarray] | None = None
    gain: float = 0.0
    feature: int = -1
    code: int = 0
    group: tuple[int, ...] | None = None
    left: tuple[int, int] = (0, 0)  # gradient sum and rows of the left child


def _best_split(sums: np.ndarray, depth: int, features, bins, categories, p: BoostParams, bits: int) -> _Open:
    node, begin, scale = _Open(sums, depth), 0, 2.0**-bits
    if p.max_depth is not None and depth >= p.max_depth:
        return node
    for f in features:
        g, n = sums[:, begin : begin + bins[f]]
        begin += bins[f]
        order = None
        if f in categories:
            # Categories by their mean gradient: the best two groups are a beginning and the rest.
            held = np.flatnonzero(n)
            order = held[np.lexsort((held, g[held] / n[held]))]
            g, n = g[order], n[order]
        if not len(n):
            continue
        left_g, left_n = np.cumsum(g), np.cumsum(n)
        all_g, all_n = int(left_g[-1]), int(left_n[-1])
        right_g, right_n = all_g - left_g, all_n - left_n
        fits = (left_n >= p.min_leaf) & (right_n >= p.min_leaf)
        if not fits.any():
            continue
        a, b = left_g * scale, right_g * scale
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = a * a / left_n + b * b / right_n - (all_g * scale) ** 2 / all_n
        gain = np.where(fits, gain, -np.inf)
        best = int(np.argmax(gain))
        if gain[best] > max(node.gain, 1e-12 * all_n):
            node.gain, node.feature, node.code = float(gain[best]), f, best
            node.group = None if order is None else tuple(sorted(order[: best + 1].tolist()))
            node.left = int(left_g[best]), int(left_n[best])
    return node


def _grown(measure, features, edges, bins, categories, p: BoostParams, bits: int) -> Tree:
    """The tree that always splits the leaf of the greatest gain, up to ``max_leaves``.

    ``measure(tree, large, small)`` gives the sums of some nodes and the rows of others. Each
    call asks for children of all leaves that may be split with what is left of
    ``max_leaves``, so a tree takes about as many calls as it is deep; splits that turn out
    not to be among the best are dropped. A node of at most FEW rows is asked for its rows,
    and what is below it needs no further call.
    """
    scale = 2.0**-bits
    tree = Tree()
    tree.add(0.0, 0)
    split = partial(_best_split, features=features, bins=bins, categories=categories, p=p, bits=bits)
    place = {f: k for k, f in enumerate(features)}
    first = measure(tree, [0], [])[0][0]
    whole = first[:, : bins[features[0]]].sum(axis=1)
    tree.value[0], tree.rows[0] = int(whole[0]) * scale / max(1, int(whole[1])), int(whole[1])
    known = {0: split(first, 0)}
    while True:
        queue, used, leaves, missing = [(-known[0].gain, 0)], [], 1, []
        while queue and leaves < p.max_leaves:
            gain, node = heappop(queue)
            if not gain:
                break
            leaves += 1
            if tree.feature[node] < 0:
                missing.append(node)
                continue
            used.append(node)
            for child in (tree.left[node], tree.right[node]):
                heappush(queue, (-known[child].gain, child))
        if not missing:
            return _only(tree, set(used))
        asked, few = {}, []
        for node in missing:
            best = known[node]
            whole = best.sums[:, : bins[features[0]]].sum(axis=1)
            left = best.left
            right = int(whole[0]) - left[0], int(whole[1]) - left[1]
            tree.feature[node], tree.code[node], tree.group[node] = best.feature, best.code, best.group
            if best.group is None:
                tree.threshold[node] = float(edges[best.feature][best.code])
            tree.gain[node] = best.gain
            tree.left[node] = tree.add(left[0] * scale / left[1], left[1])
            tree.right[node] = tree.add(right[0] * scale / right[1], right[1])
            children = tree.left[node], tree.right[node]
            if best.rows is None:
                smaller = min(children, key=lambda c: tree.rows[c])
                few += [c for c in children if tree.rows[c] <= FEW]
                asked[node] = smaller
        # A small child's rows give its sums as well.
        large = [c for c in asked.values() if c not in few]
        got, rows = measure(tree, large, few) if asked else ({}, {})
        for node in missing:
            best, depth = known[node], known[node].depth + 1
            found = {}
            for child in (tree.left[node], tree.right[node]):
                if best.rows is not None:
                    codes, g = best.rows
                    here = tree.goes_left(node, codes[place[best.feature]], True)
                    here = here if child == tree.left[node] else ~here
                    found[child] = codes[:, here], g[here]
                elif child in rows:
                    found[child] = tuple(np.concatenate(x, axis=-1) for x in zip(*rows[child]))
            sums = {c: _histogram(*r, features, bins) for c, r in found.items()}
            sums |= {c: got[c] for c in (tree.left[node], tree.right[node]) if c in got}
            for child, other in ((tree.left[node], tree.right[node]), (tree.right[node], tree.left[node])):
                mine = sums[child] if child in sums else best.sums - sums[other]
                known[child] = split(mine, depth)
                known[child].rows = found.get(child)
            best.rows = best.sums = None


def _only(tree: Tree, used: set[int]) -> Tree:
    """The part of ``tree`` whose splits are ``used``."""
    out = Tree()

    def copy(node: int) -> int:
        new = out.add(tree.value[node], tree.rows[node])
        if node in used:
            for name in ("feature", "code", "threshold", "group", "gain"):
                getattr(out, name)[new] = getattr(tree, name)[node]
            out.left[new], out.right[new] = copy(tree.left[node]), copy(tree.right[node])
        return new

    copy(0)
    return out


# --- boosting -----------------------------------------------------------------------------


def _moved(block, tree: Tree, rate: float):
    codes, hashes, labels, scores = block
    return codes, hashes, labels, scores + rate * np.array(tree.value)[tree.walk(codes, True)]


def _errors(blocks, trees: Sequence[Tree], rate: float):
    """Sums of absolute errors after each tree as whole multiples of 2**-ERROR_BITS, and the rows."""
    total = np.array([0] * (len(trees) + 1), object)
    for block in blocks:
        for i, tree in enumerate(trees):
            block = _moved(block, tree, rate)
            total[i] += sum(map(int, np.rint(np.abs(block[2] - block[3]) * 2.0**ERROR_BITS)))
        total[-1] += len(block[2])
    yield total


def best_round(history: Sequence[float], patience: int) -> tuple[int, int]:
    """Best round, and the round at which training ends or has come to.

    Walks the errors in order and ends ``patience`` rounds after the last improvement, so
    the result does not depend on how many rounds are looked at together.
    """
    best = 0
    for number, error in enumerate(history, 1):
        if not best or error < history[best - 1]:
            best = number
        elif number - best >= patience:
            return best, number
    return best, len(history)


@dataclass
class Booster:
    """A mean and trees whose steps are added to it."""

    base: float
    rate: float
    slots: int
    trees: list[Tree]

    def predict(self, columns: np.ndarray) -> np.ndarray:
        """Scores of rows whose slots' values are given by slot."""
        scores = np.full(columns.shape[1], self.base)
        for tree in self.trees:
            scores += self.rate * np.array(tree.value)[tree.walk(columns, False)]
        return scores

    def column(self, vector: Column) -> Column:
        """Score as a column over the encoded vector, computed from Arrow batches.

        The trees go to the tasks: at most ``rounds`` times ``max_leaves`` leaves.
        """
        spark = SparkSession.active()
        sent, slots = spark.sparkContext.broadcast(self), self.slots

        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), slots)
            return pa.array(sent.value.predict(np.ascontiguousarray(values.T)), pa.float64())

        return score(vector_to_array(vector))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per node: round, node, feature slot (-1 for leaves), its split, gain, rows and value."""
        rows = [
            (i, k, *(x[k] if name != "group" else x[k] and list(x[k]) for name, x in vars(tree).items()))
            for i, tree in enumerate(self.trees)
            for k in range(len(tree.feature))
        ]
        return spark.createDataFrame(
            rows,
            "round int, node int, slot int, code int, threshold double, `group` array<int>, `left` int, `right` int, "
            "value double, gain double, `rows` bigint",
        )

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        head = spark.createDataFrame(
            [(self.base, self.rate, self.slots, len(self.trees))], "base double, rate double, slots int, rounds int"
        )
        head.coalesce(1).write.mode("overwrite").parquet(f"{path}/head")

    @classmethod
    def load(cls, path: str) -> Booster:
        spark = SparkSession.active()
        head = spark.read.parquet(f"{path}/head").first()
        trees = [Tree() for _ in range(head["rounds"])]
        for row in spark.read.parquet(f"{path}/nodes").orderBy("round", "node").collect():
            values = list(row)[2:]
            values[3] = None if values[3] is None else tuple(values[3])
            for column, x in zip(vars(trees[row["round"]]).values(), values):
                column.append(x)
        return cls(head["base"], head["rate"], head["slots"], trees)


def boost(
    train: DataFrame,
    val: DataFrame | None,
    params: BoostParams,
    row_key: str,
    slots: int,
    categories: dict[int, int],
    folder: str,
) -> tuple[Booster, int, list[float]]:
    """Gradient boosting with Huber loss over columns ``features`` and ``_label``.

    Starts from the mean label. Each round grows one tree (``_grown``) on the residuals
    clipped at ``huber_delta``, over a share of the features drawn per round, on a hashed
    share of the rows that changes every ``bagging_every`` rounds. Stops when the
    validation MAE has not improved for ``patience`` rounds, and keeps the trees up to the
    best round. ``categories`` are slots split into groups of their codes, with how many
    codes they have.

    Codes are stored under ``folder``; scores move with them, in memory or on the disks of
    the executors, from round to round, and every ``checkpoint_every`` rounds to the
    checkpoint folder. A lost executor costs what is done again since then. What comes to
    the driver is sums per node, feature and bin, whose size does not depend on the rows.
    """
    spark = train.sparkSession
    order_stats.shared_folder(spark)
    mean = train.agg(F.avg("_label")).first()[0]
    edges = bin_edges(train, slots, row_key, params.max_bins, categories)
    bins = [len(e) + 1 for e in edges]
    base = float(f"{mean:.12e}")  # the last bits of a mean depend on the order of its sum
    state = _stored(train, edges, F.col(row_key), base, folder).persist(StorageLevel.MEMORY_AND_DISK)
    val_state = None
    if val is not None:
        val_state = _stored(val, edges, F.monotonically_increasing_id(), base, folder).persist(StorageLevel.MEMORY_AND_DISK)
    n = state.map(lambda b: len(b[2])).sum()
    # Sums of n gradients stay below 2**62.
    room = 62 - max(0, math.ceil(math.log2(n * max(params.huber_delta, 1e-9))))
    bits = min(FINEST - max(0, math.ceil(math.log2(max(params.huber_delta, 1e-9)))), room)
    take = max(1, math.ceil(params.feature_fraction * slots - 1e-9))
    trees, history, best, done, old, kept = [], [], 0, False, None, {}
    for number in range(params.rounds):
        draw = np.random.default_rng([params.seed, number])
        features = sorted(draw.choice(slots, take, replace=False).tolist())
        bag = params.seed + number // params.bagging_every

        task = partial(_measured, features=features, bins=bins, bag=bag, p=params, bits=bits)

        def measure(tree, large, small, state=state, task=task):
            return _gathered(state.mapPartitions(partial(task, tree=tree, large=large, small=small)))

        trees.append(_grown(measure, features, edges, bins, categories, params, bits))
        if old is not None:
            old.unpersist()
        last = number + 1 == params.rounds
        if (number + 1) % params.checkpoint_every == 0 or last:
            recent = trees[len(history) :]
            if val_state is not None:
                sums = _added(val_state.mapPartitions(partial(_errors, trees=recent, rate=params.learning_rate)))
                history += [int(s) / 2.0**ERROR_BITS / max(1, sums[-1]) for s in sums[:-1]]
                best, stop = best_round(history, params.patience)
                done = stop < len(history) or stop - best >= params.patience
                history = history[:stop]
            if done or last:
                break
            if val_state is not None:
                after = val_state.map(partial(_all_moved, trees=recent, rate=params.learning_rate))
                val_state = _fixed(after, val_state, kept, "val")
        old, state = state, state.map(partial(_moved, tree=trees[-1], rate=params.learning_rate))
        state.persist(StorageLevel.MEMORY_AND_DISK)
        if (number + 1) % params.checkpoint_every == 0:
            state = _fixed(state, old, kept, "train")
            old = None
    state.unpersist()
    if val_state is not None:
        val_state.unpersist()
    for path in kept.values():
        order_stats.delete(spark, path)
    used = best if history else len(trees)
    return Booster(base, params.learning_rate, slots, trees[:used]), used, history


def _all_moved(block, trees: Sequence[Tree], rate: float):
    for tree in trees:
        block = _moved(block, tree, rate)
    return block


def _fixed(after: RDD, before: RDD, kept: dict[str, str], name: str) -> RDD:
    """``after`` written to the checkpoint folder; ``before`` and the last checkpoint are given up."""
    after.persist(StorageLevel.MEMORY_AND_DISK).checkpoint()
    after.count()
    before.unpersist()
    if name in kept:
        order_stats.delete(SparkSession.active(), kept[name])
    kept[name] = after.getCheckpointFile()
    return after
