"""Packing of tokenised documents into few sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlab.llm.pieces import Pieces
from ticketlab.llm.words import carrying, runs
from ticketlab.operators.order_stats import pin

WINDOW = 4096
END_ID = 1
PART_BYTES = 1 << 20  # a longer text is encoded in parts that end before a space
ROWS = 20_000  # pieces of a batch that a task hands on
_RANK_BITS = 50


def _with(sums: int, length: int, times: int, mask: int) -> int:
    """Bitset of what ``sums`` reaches with up to ``times`` pieces of ``length`` more."""
    step = 1
    while times > 0:
        sums |= (sums << (length * min(step, times))) & mask
        times, step = times - step, 2 * step
    return sums


class _Reach:
    """Subset sums of the available lengths, kept for every prefix of the ascending lengths."""

    def __init__(self, counts: Mapping[int, int], window: int):
        self.window, self.mask = window, (1 << (window + 1)) - 1
        self.lengths = sorted(n for n, c in counts.items() if c > 0)
        self.count = [counts[n] for n in self.lengths]
        self.sums = [1]  # sums[i]: reached by lengths[:i], so one more than there are lengths
        for n, c in zip(self.lengths, self.count):
            self.sums.append(_with(self.sums[-1], n, min(c, window // n), self.mask))

    def fullest(self) -> list[tuple[int, int]]:
        """(place of a length, how often) of the fullest bin that holds a longest piece.

        Of equally full ones it is the one with the longest pieces.
        """
        i = len(self.lengths) - 1
        n = self.lengths[i]
        mask = (1 << (self.window - n + 1)) - 1
        rest = _with(self.sums[i] & mask, n, min(self.count[i] - 1, self.window // n), mask).bit_length() - 1
        chosen, spare = [], self.count[i] - 1
        times = min(spare, rest // n)
        while not self.sums[i] >> (rest - times * n) & 1:
            times -= 1
        chosen.append((i, times + 1))
        rest -= times * n
        while rest:
            i = min(i, bisect_right(self.lengths, rest)) - 1
            n = self.lengths[i]
            times = min(self.count[i], rest // n)
            while not self.sums[i] >> (rest - times * n) & 1:
                times -= 1
            if times:
                chosen.append((i, times))
                rest -= times * n
        return chosen

    def remove(self, taken: list[tuple[int, int]]) -> None:
        """Take away (place, pieces); sums that do not change are not made again."""
        changed, gone = [], []
        for i, pieces in taken:
            fits = self.window // self.lengths[i]
            before, self.count[i] = self.count[i], self.count[i] - pieces
            if min(before, fits) != min(self.count[i], fits):
                changed.append(i)
            if not self.count[i]:
                gone.append(i)
        changed.sort()
        for k, i in enumerate(changed):
            stop = changed[k + 1] if k + 1 < len(changed) else len(self.lengths)
            while i < stop:
                n = self.lengths[i]
                after = _with(self.sums[i], n, min(self.count[i], self.window // n), self.mask)
                same = after == self.sums[i + 1]
                self.sums[i + 1] = after
                if same:
                    break
                i += 1
        for i in sorted(gone, reverse=True):
            del self.lengths[i], self.count[i], self.sums[i + 1]


def fill_bins(counts: Mapping[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, pieces a bin)]) so that every piece is in one bin.

    ``counts`` says how many pieces there are of each length of 1 to ``window``. Each bin
    holds a longest piece left and the fullest combination with it, found as the largest
    subset sum not above ``window``; of equally full ones it is the one with the longest
    pieces, so that short ones are left to fit others. (Without the longest piece, long
    ones stay until nothing fits them: with lengths spread evenly, 2.9 % of the sequences
    were above the bound of total / window, with it 0.3 %.) The same combination is taken
    as often as its pieces last, which leaves at least one of its lengths with fewer
    pieces than it uses and with less than half of what it had. After the first time that
    is below window / length, so there are at most window + sum(log2(window / length))
    different combinations, about 2.5 * window, whatever the number of pieces.
    """
    reach, found = _Reach(counts, window), []
    while reach.lengths:
        bin_ = reach.fullest()
        bins = min(reach.count[i] // times for i, times in bin_)
        found.append((bins, [(reach.lengths[i], times) for i, times in bin_]))
        reach.remove([(i, times * bins) for i, times in bin_])
    return found


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in parts of about PART_BYTES; each later part begins with a space before an ASCII letter or digit."""
    at = 0
    while len(data) - at > PART_BYTES:
        tail = data[at + PART_BYTES :]
        one, two = tail[:-1], tail[1:] | 0x20
        good = np.flatnonzero((one == 0x20) & ((two >= 0x61) & (two <= 0x7A)))
        if not len(good):
            break
        stop = at + PART_BYTES + int(good[0])
        yield data[at:stop]
        at = stop
    yield data[at:]


_FIELDS = ("id", "piece", "start", "length", "ids_crc32", "block", "nth")


def _cut(path: str, end_id: int, window: int, batches: Iterator[pa.RecordBatch]):
    """Pieces of the documents of a task, each with its place among those of its length."""
    pieces, block = Pieces(path), TaskContext.get().partitionId()
    end, schema, nth, rows = np.array([end_id], np.uint32), None, {}, []

    def out():
        names = pa.array([r[0] for r in rows], schema)
        rest = [
            pa.array([r[k] for r in rows], pa.int32() if name in ("piece", "block") else pa.int64())
            for k, name in enumerate(_FIELDS)
            if k
        ]
        made = pa.RecordBatch.from_arrays([names, *rest], list(_FIELDS))
        rows.clear()
        return made

    def give(doc, ids, start):
        n = len(ids)
        rows.append((doc, start // window, start, n, zlib.crc32(ids.tobytes()), block, nth.get(n, 0)))
        nth[n] = nth.get(n, 0) + 1

    def document(doc, stretches):
        """Full pieces are given out as soon as more follows, so a long text is not held as ids."""
        held, start = np.zeros(0, np.uint32), 0
        for ids in stretches:
            held = np.concatenate((held, ids))
            while len(held) > window:
                give(doc, held[:window], start)
                held, start = held[window:], start + window
        give(doc, held, start)

    def long_text(data):
        for part in _parts(data):
            yield pieces.encode(part, np.array([0, len(part)]))[0]
        yield end

    for b in batches:
        schema = b.schema.field(0).type
        names = b.column(0).to_pylist()
        for first, n, data, offsets in runs(b.column(1)):
            if n == 1 and len(data) > PART_BYTES:
                document(names[first], long_text(data))
            else:
                ids, bounds = pieces.encode(data, offsets)
                for i in range(n):
                    document(names[first + i], (ids[bounds[i] : bounds[i + 1]], end))
            if len(rows) >= ROWS:
                yield out()
    if rows:
        yield out()


class _Slots:
    """Where the r-th piece of a length goes: runs of equal combinations, sorted by (length, first rank)."""

    def __init__(self, bins: list[tuple[int, list[tuple[int, int]]]]):
        ranks, rows, base = {}, [], 0
        for copies, parts in bins:
            offset = 0
            for n, times in parts:
                rows.append((n << _RANK_BITS | ranks.get(n, 0), base, times, offset))
                ranks[n] = ranks.get(n, 0) + copies * times
                offset += n * times
            base += copies
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.key, self.base, self.times, self.offset = table.T

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length << _RANK_BITS | rank
        run = np.searchsorted(self.key, key, "right") - 1
        copy, slot = np.divmod(key - self.key[run], self.times[run])
        return self.base[run] + copy, self.offset[run] + slot * length


def _place(sent, batches: Iterator[pa.RecordBatch]):
    for b in batches:
        length, rank = (b.column(name).to_numpy(zero_copy_only=False) for name in ("length", "rank"))
        sequence, offset = sent.value.place(length, rank)
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:-1], pa.array(sequence), pa.array(offset)],
            [*b.schema.names[:-1], "sequence_id", "offset"],
        )


def pack_full(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    window: int = WINDOW,
) -> DataFrame:
    """One row per piece: which stretch of a document's ids lies where in which sequence.

    ``path`` names a tokenizer file with word ends. A document is its ids and ``end_id``;
    only one longer than ``window`` is cut, into pieces of ``window`` and a last one. The
    texts are read once and become a stored table of pieces. What is packed is then the
    number of pieces of each length, at most ``window`` numbers, which is all that goes
    through the driver (``fill_bins``); its combinations, whose number is bounded by the
    window as well, go to the tasks. The pieces of one length are numbered by adding up
    the counts of the blocks (input partitions) before, and the r-th goes where the r-th
    place for its length is. So one length may have any share of all pieces.

    A null or empty text is a document of its end mark alone. Rows that repeat an id, or
    have none, are documents of their own. Pieces of equal length may change places when
    the input is read in another order; the number of sequences does not. A text above
    PART_BYTES is encoded in parts that end at spaces, and its full pieces are given out
    as they come (a stretch without spaces before a letter is one part). Other columns
    are ignored; an empty table gives an empty result.
    """
    cut = pin(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
            lambda batches: _cut(path, end_id, window, batches),
            carrying(docs, id_col, "piece int, start bigint, length bigint, ids_crc32 bigint, block int, nth bigint"),
        )
    )
    # One row per block and length.
    held = cut.groupBy("block", "length").agg((F.max("nth") + 1).alias("n"))
    ahead = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = pin(
        held.select("block", "length", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    )
    counts = {r.length: r.n for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(_Slots(fill_bins(counts, window)))
    ranked = cut.join(before.drop("n").hint("merge"), ["block", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(
        lambda batches: _place(sent, batches),
        carrying(
            docs, id_col, "piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
        ),
    ).withColumnRenamed("id", id_col)
