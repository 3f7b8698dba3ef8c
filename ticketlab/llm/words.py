"""Words and word shingles as 64-bit numbers, made from whole Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

RUN_BYTES = 1 << 18  # texts handled together; a longer text is a run of its own

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)
_STEP = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Words:
    """Splits UTF-8 text at separator bytes and hashes the words, A-Z lower-cased.

    With ``latin`` the other capital letters of Latin-1 are lower-cased too. A word's
    hash is a polynomial over 64-bit values of its bytes; two different words of a corpus
    share one with a chance of about 2**-60 a pair.
    """

    def __init__(self, separators: bytes, latin: bool = False):
        self.latin = latin
        self.separator = np.zeros(256, bool)
        self.separator[list(separators)] = True
        byte = np.arange(256)
        byte[65:91] += 32
        with np.errstate(over="ignore"):
            self.value = mix(mix((byte + 1).astype(np.uint64) * _A))
            self.value[self.separator] = 0
            self.low = np.concatenate(([1], np.cumprod(np.full(_STEP, _B)))).astype(np.uint64)
            self.high_step = self.low[_STEP]

    def power(self, exponent: np.ndarray) -> np.ndarray:
        if not len(exponent) or exponent.max() < _STEP:
            return self.low[exponent]
        high = np.cumprod(np.full(int(exponent.max()) // _STEP, self.high_step))
        high = np.concatenate(([1], high)).astype(np.uint64)
        return self.low[exponent % _STEP] * high[exponent // _STEP]

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of the texts data[offsets[i]:offsets[i+1]], and where each text's begin."""
        if self.latin:  # À to Þ without × are 0xC3 and a byte that is 0x20 below the small letter's
            capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
            data = data.copy()
            data[1:][capital] += 0x20
        word = ~self.separator[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inside = offsets[:-1][offsets[:-1] < len(data)]
        first[inside] = word[inside]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        with np.errstate(over="ignore"):
            at = np.arange(starts[0], len(data))
            at -= np.repeat(starts, np.diff(np.append(starts, len(data))))
            terms = self.value[data[starts[0] :]] * self.power(at)
            hashes = mix(np.add.reduceat(terms, starts - starts[0]))
        return hashes, np.searchsorted(starts, offsets)

    def hash(self, word: str) -> int:
        """Hash of one string taken as a single word, whatever its bytes."""
        data = np.frombuffer(word.encode(), np.uint8)
        with np.errstate(over="ignore"):
            total = np.add.reduce(self.value[data] * self.power(np.arange(len(data))), keepdims=True)
            return int(mix(total)[0])


SPACED = bytes([0x20, *range(0x09, 0x0E)])
LETTERS_AND_DIGITS = bytes(
    [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
)


def runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets into them) of runs of texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + RUN_BYTES, "right")) - 1)
        yield at, stop - at, data[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at]
        at = stop


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words count as one run."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    with np.errstate(over="ignore"):
        h = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            h = h * _A + hashes[k : n - size + 1 + k]
        return np.unique(mix(h + np.uint64(size)))


def carrying(docs: DataFrame, id_col: str, rest: str) -> StructType:
    """Schema of a result that begins with ``id``, of any type, and goes on with ``rest``."""
    made = StructType().add("id", docs.schema[id_col].dataType)
    return StructType(made.fields + StructType.fromDDL(rest).fields)
