"""Order-preserving packing of tokenised documents into windows, by dynamic programming."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlab.llm.pieces import Pieces
from ticketlab.llm.words import carrying, runs

WINDOW = 4096
END_ID = 2
SENTENCE = 8  # tokens of padding that a cut at a sentence end is worth
INSIDE = 24  # and one inside a sentence
CHUNK = 1 << 20  # ids held before windows are cut
GRID = 64  # within sentences a cut is possible every so many ids of a document


def padded(rest: int, window: int) -> float:
    """Cost of a last window of ``rest`` ids that is filled up."""
    return window - rest if rest else 0


def split_up(rest: int, window: int) -> float:
    """Cost of the cheaper way to end: one padded window, or windows of powers of two."""
    return min(padded(rest, window), max(0, rest.bit_count() - 1) * INSIDE)


def left_open(rest: int, window: int) -> float:
    """Cost of what is not cut yet."""
    return 0


def choose_cuts(
    at: np.ndarray,
    penalty: np.ndarray,
    window: int = WINDOW,
    end: Callable[[int, int], float] = padded,
) -> list[int]:
    """Positions of the cuts that minimise padding plus penalties, without one at the end.

    ``at`` are the possible cuts in order, none more than ``window`` after the one before
    (or after 0), the last one being the end; ``penalty`` is what a cut there costs and
    ``end`` what the ids after the last cut do. best(k) is the penalty of k plus the
    least best(i) + window - (at[k] - at[i]) over the i within one window, so only
    best(i) + at[i] has to be compared: a queue of candidates with growing values gives
    the least one, and each enters and leaves it once. Of equal ones the earliest is
    taken, which fills windows as far as possible.
    """
    place, cost = [0, *at.tolist()], [0.0, *penalty.tolist()]
    best, back = [0.0] * len(place), [0] * len(place)
    queue = deque([(0.0, 0)])
    for k in range(1, len(place)):
        here = place[k]
        while place[queue[0][1]] < here - window:
            queue.popleft()
        value, i = queue[0]
        best[k], back[k] = value - here + window + cost[k], i
        value = best[k] + here
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, k))
    total = place[-1]
    last = range(bisect_left(place, total - window), len(place))
    k = min(last, key=lambda k: best[k] + end(total - place[k], window))
    cuts = []
    while k:
        cuts.append(place[k])
        k = back[k]
    return cuts[::-1]


def _tail(rest: int, window: int) -> list[int]:
    """Sizes of the windows that ``split_up`` stands for."""
    if not rest:
        return []
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return powers if (len(powers) - 1) * INSIDE < window - rest else [rest]


class _Packer:
    """Windows of the documents of one task, in the order in which they come."""

    def __init__(self, task: int, window: int):
        self.window, self.next = window, task << 32
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # id, tokens, tokens already given out
        self.cuts: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.held = 0

    def add(self, doc, ids: np.ndarray, sentence: np.ndarray) -> None:
        """``ids`` of a whole document with its end mark; ``sentence`` marks sentence ends."""
        possible = np.zeros(len(ids) + 1, bool)
        possible[1:-1] = sentence[ids[:-1]]
        whole = possible.copy()
        step = min(GRID, self.window)
        possible[step::step] = possible[-1] = True
        ends = np.flatnonzero(possible)
        cost = np.where(whole[ends], float(SENTENCE), float(INSIDE))
        cost[-1] = 0
        self.cuts.append(ends + self.held)
        self.costs.append(cost)
        self.ids.append(ids)
        self.docs.append((doc, len(ids), 0))
        self.held += len(ids)

    def cut(self, last: bool) -> Iterator[tuple]:
        """Pieces of all windows; unless this is the last call, what follows them stays."""
        if not self.held:
            return
        at, cost = np.concatenate(self.cuts), np.concatenate(self.costs)
        # The end of what is held is no real end before the last call: it waits for more.
        cuts = choose_cuts(at, cost, self.window, split_up if last else left_open)
        if last:
            begin = cuts[-1] if cuts else 0
            cuts += (begin + np.cumsum(_tail(self.held - begin, self.window), dtype=np.int64)).tolist()
        done = cuts[-1] if cuts else 0
        ids = np.concatenate(self.ids)
        doc, begin = 0, 0  # current document and where its remaining ids begin
        at_id = 0
        for end in cuts:
            offset = 0
            while at_id < end:
                name, tokens, given = self.docs[doc]
                stop = min(end, begin + tokens - given)
                length = stop - at_id
                first = given + at_id - begin
                yield name, first, length, zlib.crc32(ids[at_id:stop].tobytes()), tokens, self.next, offset
                offset += length
                at_id = stop
                if stop == begin + tokens - given:
                    doc, begin = doc + 1, stop
            self.next += 1
        rest = self.docs[doc:]
        if rest and done > begin:
            name, tokens, given = rest[0]
            rest[0] = (name, tokens, given + done - begin)
        left = at > done
        self.docs, self.ids, self.held = rest, [ids[done:]], len(ids) - done
        self.cuts, self.costs = [at[left] - done], [cost[left]]


_FIELDS = ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _pack(path: str, end_id: int, window: int, batches: Iterator[pa.RecordBatch]):
    pieces = Pieces(path)
    packer = _Packer(TaskContext.get().partitionId(), window)
    end, schema = np.array([end_id], np.uint32), None

    def batch(rows):
        names = pa.array([r[0] for r in rows], schema)
        rest = [pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 7)]
        return pa.RecordBatch.from_arrays([names, *rest], list(_FIELDS))

    for b in batches:
        schema = b.schema.field(0).type
        names = b.column(0).to_pylist()
        for first, rows, data, offsets in runs(b.column(1)):
            ids, bounds = pieces.encode(data, offsets)
            for i in range(rows):
                packer.add(names[first + i], np.concatenate((ids[bounds[i] : bounds[i + 1]], end)), pieces.sentence)
            if packer.held >= CHUNK and (out := list(packer.cut(False))):
                yield batch(out)
    if out := list(packer.cut(True)):
        yield batch(out)


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    window: int = WINDOW,
) -> DataFrame:
    """One row per piece: where a stretch of a document's ids lies in which sequence.

    ``path`` names a tokenizer file with word ends. Documents are taken in stored order;
    each input partition is packed by itself, in chunks whose open end is carried on, so
    a task holds CHUNK ids and one document. Windows end at document ends for free, at
    sentence ends for SENTENCE and elsewhere for INSIDE tokens of padding; the last
    windows of a partition are powers of two. ``sequence_id`` is the partition's number
    times 2**32 plus a running number. The input must be stored (a scan), so that a task
    that runs again sees the same rows in the same order.

    A null or empty text is a document of its end mark alone. Rows that repeat an id, or
    have none, are documents of their own. Other columns are ignored; an empty table
    gives an empty result.
    """
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(
            lambda batches: _pack(path, end_id, window, batches),
            carrying(docs, id_col, ", ".join(f"{name} bigint" for name in _FIELDS[1:])),
        )
        .withColumnRenamed("id", id_col)
    )
