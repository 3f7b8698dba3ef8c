"""Near-duplicate vectors by lattice hashing: projections decoded to E8 points."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlab.llm.graph import components, discard
from ticketlab.llm.words import mix
from ticketlab.operators.order_stats import pin

COSINE = 0.95
TABLES = 10
LATTICES = 2  # E8 points whose coordinates make up one cell of a table
WIDTH = 2.0  # of a lattice, in units of a projected coordinate of a unit vector
PROBES = 4  # neighbouring cells looked into
SEED = 8
SIDE = 512  # vectors of one side of a comparison in a task


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of 1, or all of 1/2 with an even number negative."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [v for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.concatenate((np.array(whole), np.array(half)))


def _even(z: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates and an even sum: round, and where the sum is
    odd, round the coordinate that is farthest off the other way.
    """
    near = np.rint(z)
    off = z - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def nearest(z: np.ndarray) -> np.ndarray:
    """Nearest E8 points: of the even points and of those shifted by 1/2."""
    a, b = _even(z), _even(z - 0.5) + 0.5
    closer = ((z - a) ** 2).sum(axis=1) <= ((z - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


class Hash:
    """Cells of vectors of one dimension, the same in every task."""

    def __init__(self, dim: int):
        draw = np.random.default_rng([SEED, dim])
        self.project = draw.normal(size=(dim, TABLES * LATTICES * 8)) / WIDTH
        self.moves = neighbours()
        with np.errstate(over="ignore"):
            number = np.arange(TABLES * LATTICES * 8, dtype=np.uint64)
            self.factor = (mix((number + np.uint64(1)) * np.uint64(dim * 2 + 1)) | np.uint64(1)).reshape(TABLES, LATTICES, 8)
            steps = np.rint(2 * self.moves).astype(np.int64).astype(np.uint64)
            self.step = (self.factor[:, :, None, :] * steps).sum(axis=3, dtype=np.uint64)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cell, and the PROBES nearest neighbouring cells, of each vector and table."""
        n = len(unit)
        z = (unit @ self.project).reshape(-1, 8)
        point = nearest(z)
        gain = ((z - point) @ self.moves.T).reshape(n, TABLES, -1)
        best = np.argpartition(-gain, PROBES, axis=2)[:, :, :PROBES]
        with np.errstate(over="ignore"):
            coordinates = np.rint(2 * point).astype(np.int64).astype(np.uint64).reshape(n, TABLES, LATTICES, 8)
            home = (coordinates * self.factor).sum(axis=(2, 3), dtype=np.uint64)
            moved = home[:, :, None] + self.step.reshape(TABLES, -1)[np.arange(TABLES)[None, :, None], best]
            table = mix(np.arange(1, TABLES + 1, dtype=np.uint64))
            return mix(home ^ table), mix(moved ^ table[:, None])


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the lists of a column, for each length that occurs."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        x = flat[starts[at][:, None] + np.arange(dim)].astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
        yield at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(batches: Iterator[pa.RecordBatch]):
    made: dict[int, Hash] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            node = part.column(0).to_numpy()
            for at, unit in _rows(part.column(1)):
                dim = unit.shape[1]
                if dim not in made:
                    made[dim] = Hash(dim)
                home, near = made[dim].cells(unit)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((home.ravel(), near.ravel())).view(np.int64)),
                        pa.array(np.concatenate((np.repeat(node[at], TABLES), np.repeat(node[at], TABLES * PROBES)))),
                        pa.array(np.arange(home.size + near.size) < home.size),
                    ],
                    ["cell", "node", "home"],
                )


def _units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of equal leading columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.zeros(batch.num_rows + 1, bool)
        for k in range(keys):
            column = batch.column(k).to_numpy()
            marks[1:-1] |= column[1:] != column[:-1]
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        cuts = np.concatenate(([0], np.flatnonzero(marks), [batch.num_rows]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _unit_vectors(table: pa.Table, name: str):
    return _rows(table.column(name).combine_chunks())


def _forest(node: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the groups that the symmetric matrix connects."""
    label = np.arange(len(node))
    while True:
        after = np.minimum(label, np.where(linked, label[None, :], len(node)).min(axis=1))
        if (after == label).all():
            break
        label = after
    other = label != np.arange(len(node))
    return node[label[other]], node[other]


def _link(cosine: float, batches: Iterator[pa.RecordBatch]):
    """Links between the vectors at home in a cell and those that probe it or share it."""
    for table in _units(batches, 3):
        node, home = table.column("node").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
        if len(node) < 2 or not home.any():
            continue
        for at, unit in _unit_vectors(table, "vec"):
            mine, own = node[at], home[at]
            close = (unit[own] @ unit.T) >= cosine
            linked = np.zeros((len(at), len(at)), bool)
            linked[own] = close
            linked |= linked.T
            np.fill_diagonal(linked, False)
            if linked.any():
                a, b = _forest(mine, linked)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _count(cosine: float, batches: Iterator[pa.RecordBatch]):
    """Links of each vector of a unit to those of the other block, or of its own one."""
    for table in _units(batches, 3):
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        node, own, rows = (table.column(c).to_numpy() for c in ("node", "own", "rows"))
        for at, unit in _unit_vectors(table, "vec"):
            close = (unit @ unit.T) >= cosine
            np.fill_diagonal(close, False)
            if i != j:
                close &= own[at][:, None] != own[at][None, :]
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(close @ rows[at])], ["node", "links"])


def usable(vec: Column) -> Column:
    """Vectors without null or non-finite components that are not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def _pieces(size: Column, side: int) -> Column:
    return F.ceil(size / F.lit(side)).cast("bigint")


def _upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, side: int = SIDE
) -> DataFrame:
    """Per vector: its id, ``n_links``, ``component_id`` and ``kept``.

    Equal vectors are one node. Each of TABLES tables projects a vector at random to
    LATTICES times 8 coordinates, decodes them to E8 points and so names a cell; a vector
    lies in its own cell and looks into the PROBES nearest neighbouring ones. Vectors that
    meet in a cell are compared by cosine in double precision, in blocks of ``side``
    inside tasks, which emit a forest of the links. The links within the components
    are then counted the same way over all pairs of a component, so ``n_links`` also
    has the links between its members that no cell has shown.

    At a cosine of 0.95 a table finds a pair of 64-component vectors with a chance of
    0.57, all ten miss it with 0.0002; closer pairs are missed less. Vectors that are null,
    empty, zero, or have a null or non-finite component have no links; vectors of
    different length do not link. Rows that repeat an id are vectors of their own, null
    ids are kept; other columns are ignored; an empty table gives an empty result.
    """
    given = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    named = given.withColumn("node", F.when(usable(F.col("vec")), F.xxhash64("vec")))
    nodes = pin(
        named.filter("node is not null").groupBy("node", "vec").agg(F.count("*").alias("rows"), F.min("id").alias("least"))
    )
    cells = pin(nodes.select("node", "vec").mapInArrow(_cells, "cell bigint, node bigint, home boolean"))
    home = F.col("home").cast("int")
    busy = pin(
        cells.groupBy("cell")
        .agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.sum(home).alias("homes"), F.sum(1 - home).alias("probes"))
        .filter("lo < hi and homes > 0")
        .select("cell", _pieces(F.col("homes"), side).alias("across"), F.greatest(F.lit(1), _pieces(F.col("probes"), side)).alias("down"))
    )
    # A cell's vectors are compared with those at home in it: blocks of one against blocks of both.
    met = cells.join(busy, "cell").withColumn("h", F.xxhash64("node", F.lit(3)))
    at_home = met.filter("home")
    blocks = at_home.select("cell", "node", "home", F.pmod("h", "across").alias("i"), _upto(F.col("down")).alias("j")).union(
        met.filter("not home").select("cell", "node", "home", _upto(F.col("across")).alias("i"), F.pmod("h", "down").alias("j"))
    )
    among = at_home.filter("across > 1").select(
        "cell", "node", "home", F.pmod("h", "across").alias("own"), _upto(F.col("across")).alias("other")
    ).filter("own != other").select(
        "cell", "node", "home", F.least("own", "other").alias("i"), (-1 - F.greatest("own", "other")).alias("j")
    )
    vectors = nodes.select("node", "vec")
    links = pin(
        blocks.union(among)
        .join(vectors, "node")
        .select("cell", "i", "j", "node", "home", "vec")
        .repartition("cell", "i", "j")
        .sortWithinPartitions("cell", "i", "j")
        .mapInArrow(lambda b: _link(cosine, b), "a bigint, b bigint")
    )
    joined = components(links)
    placed = pin(joined)
    discard(cells, busy, links, joined)

    sizes = placed.groupBy("component").agg(_pieces(F.count("*"), side).alias("pieces"))
    dealt = (
        placed.join(sizes, "component")
        .withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("pieces")))
        .select("component", "node", "own", _upto(F.col("pieces")).alias("other"))
        .select("component", "node", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    counts = (
        dealt.join(nodes.select("node", "vec", "rows"), "node")
        .select("component", "i", "j", "node", "own", "rows", "vec")
        .repartition("component", "i", "j")
        .sortWithinPartitions("component", "i", "j")
        .mapInArrow(lambda b: _count(cosine, b), "node bigint, links bigint")
        .groupBy("node")
        .agg(F.sum("links").alias("links"))
    )
    together = nodes.select("node", "rows", "least").join(placed, "node", "left").join(counts, "node", "left")
    together = together.withColumn("component", F.coalesce("component", "node"))
    least = together.groupBy("component").agg(F.min("least").alias("component_id"))
    # Written, so that Spark can split the rows of a vector that is repeated very often.
    result = pin(
        together.join(least, "component").select(
            "node", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
        )
    )
    discard(nodes, placed)
    joined = named.select("id", "node").join(result, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
