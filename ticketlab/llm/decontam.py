"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ticketlab.llm.words import LETTERS_AND_DIGITS, Words, carrying, mix, runs

GRAM = 3
MANY = 8  # different items that may use an n-gram which is rare
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5  # of the score of an unchanged copy
BLOCK_WORDS = 1_000_000  # words of test items that are sent to the tasks at a time
_SIEVE = 1 << 20
_PLACE = 1 << 32


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the n-gram that begins at each word; none for the last size - 1 words."""
    n = max(0, len(hashes) - size + 1)
    with np.errstate(over="ignore"):
        if size > GRAM:  # GRAM, doubled so many times: made of its halves
            half = _grams(hashes, size // 2)
            return mix(half[:n] * np.uint64(3) + half[size // 2 :][:n] + np.uint64(size))
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = mix(h + hashes[k : k + n] + np.uint64(size))
    return h


def _seeds(words: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """(n-gram, item, place, size) of the seeds of the items ``words[begin[k]:end[k]]``.

    At each place the n-gram is lengthened, by doubling, until at most MANY items use it;
    one that reaches beyond its item before is no seed. An item left without any keeps
    those of its longest n-grams that the fewest items use.
    """
    n = len(begin)
    seeds, spare = [], []
    for size in range(1, GRAM):  # shorter items are their own seed
        mine = np.flatnonzero(end - begin == size)
        seeds.append((_grams(words, size)[begin[mine]], mine, np.zeros_like(mine), np.full_like(mine, size)))
    owner = np.repeat(np.arange(n), end - begin)
    at, size = np.arange(len(words)), GRAM
    while True:
        at = at[at + size <= end[owner[at]]]
        if not len(at):
            break
        gram, item = _grams(words, size)[at], owner[at]
        names, which = np.unique(gram, return_inverse=True)
        users = np.bincount(np.unique(which * n + item) // n, minlength=len(names))[which]
        rows = (gram, item, at - begin[item], np.full_like(at, size))
        rare = users <= MANY
        seeds.append(tuple(x[rare] for x in rows))
        spare.append((*(x[~rare] for x in rows), users[~rare]))
        at, size = at[~rare], 2 * size
    if spare:
        gram, item, place, size, users = map(np.concatenate, zip(*spare))
        seeded = np.zeros(n, bool)
        seeded[np.concatenate([x[1] for x in seeds])] = True
        best = np.full(n, 1 << 62)
        order = users - size * (len(words) + 1)  # the longest, then those of the fewest users
        np.minimum.at(best, item, order)
        kept = ~seeded[item] & (order == best[item])
        seeds.append(tuple(x[kept] for x in (gram, item, place, size)))
    return tuple(map(np.concatenate, zip(*seeds)))


@dataclass
class Items:
    """Test items as word hashes, with their seeds in one sorted list."""

    ids: list
    words: list[np.ndarray]
    gram: np.ndarray  # hash of each seed
    item: np.ndarray  # its item
    at: np.ndarray  # its place in the item
    size: np.ndarray  # its words

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> Items:
        split = Words(LETTERS_AND_DIGITS, latin=True)
        words = []
        for text in texts:
            data = np.frombuffer((text or "").encode(), np.uint8)
            words.append(split.of(data, np.array([0, len(data)]))[0])
        alike: dict[bytes, list[int]] = {}  # items of the same words count once and share their seeds
        for k, w in enumerate(words):
            alike.setdefault(w.tobytes(), []).append(k)
        groups = [np.array(g) for g in alike.values()]
        end = np.cumsum([len(words[g[0]]) for g in groups], dtype=np.int64)
        begin = np.concatenate((np.zeros(1, np.int64), end[:-1]))[: len(end)]
        joined = np.concatenate([words[g[0]] for g in groups] or [np.zeros(0, np.uint64)])
        gram, group, at, size = _seeds(joined, begin, end)
        many = np.array([len(g) for g in groups], np.int64)[group] if len(group) else group
        item = np.concatenate([groups[g] for g in group] or [np.zeros(0, np.int64)])
        gram, at, size = (np.repeat(x, many) for x in (gram, at, size))
        order = np.argsort(gram, kind="stable")
        return cls(ids, words, gram[order], item[order], at[order], size[order])

    def parts(self) -> tuple:
        return self.ids, self.words, self.gram, self.item, self.at, self.size


class _Finder:
    """Places of listed n-grams in runs of texts."""

    def __init__(self, items: Items):
        self.split = Words(LETTERS_AND_DIGITS, latin=True)
        self.by_size = {}
        for size in np.unique(items.size):
            mine = items.size == size
            grams = np.unique(items.gram[mine])
            sieve = np.zeros(_SIEVE, bool)
            sieve[(grams >> np.uint64(44)).astype(np.int64)] = True
            self.by_size[int(size)] = (grams, sieve)

    def find(self, data: np.ndarray, offsets: np.ndarray):
        """Word hashes, where each text's begin, and (places, n-grams) of what was found."""
        hashes, bounds = self.split.of(data, offsets)
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for size, (grams, sieve) in self.by_size.items():
            g = _grams(hashes, size)
            at = np.flatnonzero(sieve[(g >> np.uint64(44)).astype(np.int64)])
            at = at[grams[np.minimum(np.searchsorted(grams, g[at]), len(grams) - 1)] == g[at]]
            end = bounds[np.searchsorted(bounds, at, "right")]  # no n-gram crosses texts
            at = at[at + size <= end]
            places.append(at)
            found.append(g[at])
        return hashes, bounds, np.concatenate(places), np.concatenate(found)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and the first and last word of the text in it.

    Smith-Waterman by rows. A cell holds score and start of its alignment in one number;
    gaps within a row are a running maximum of score plus distance.
    """
    n = len(text)
    column = np.arange(n + 1)
    fresh = column.astype(np.int64)
    slope = -GAP * column * _PLACE
    row, best, end = fresh.copy(), 0, 0
    for word in item:
        gain = np.where(text == word, MATCH, MISMATCH) * _PLACE
        cell = np.maximum(row + GAP * _PLACE, fresh)
        cell[1:] = np.maximum(cell[1:], row[:-1] + gain)
        cell = np.maximum.accumulate(cell + slope) - slope
        row = np.maximum(cell, fresh)
        top = int((row // _PLACE).argmax())
        if row[top] // _PLACE > best // _PLACE:
            best, end = int(row[top]), top
    return best // _PLACE, best % _PLACE, end - 1


def _found(items: Items, finder: _Finder, threshold: float, data: np.ndarray, offsets: np.ndarray):
    """{(text, item): (score, first word, last word)} of a run of texts."""
    hashes, bounds, at, found = finder.find(data, offsets)
    lo, hi = np.searchsorted(items.gram, found), np.searchsorted(items.gram, found, "right")
    many = hi - lo
    entry = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
    place = np.repeat(at, many)
    doc = np.searchsorted(bounds, place, "right") - 1
    order = np.lexsort((place - items.at[entry], items.item[entry], doc))
    entry, place, doc = entry[order], place[order], doc[order]
    item, shift = items.item[entry], (place - items.at[entry])
    out: dict[tuple[int, int], tuple] = {}
    k = 0
    while k < len(entry):  # seeds of one item that lie close together are aligned once
        size = len(items.words[item[k]])
        end = k + 1
        while (
            end < len(entry)
            and (doc[end], item[end]) == (doc[k], item[k])
            and shift[end] - shift[end - 1] <= size // 2
        ):
            end += 1
        a = max(bounds[doc[k]], shift[k] - size // 2)
        b = min(bounds[doc[k] + 1], shift[end - 1] + size + size // 2)
        words, text = items.words[item[k]], hashes[a:b]
        # No alignment can match more words than the two have in common.
        if np.isin(words, text).sum() >= threshold * size:
            score, left, right = align(words, text)
            score /= MATCH * size
            key = (int(doc[k]), int(item[k]))
            if score >= threshold and score > out.get(key, (0,))[0]:
                base = a - bounds[doc[k]]
                out[key] = (float(score), int(base + left), int(base + right))
        k = end
    return out


def _hits(sent, threshold: float, batches: Iterator[pa.RecordBatch]):
    items = Items(*sent.value)
    finder = _Finder(items)
    for batch in batches:
        for first, rows, data, offsets in runs(batch.column(1)):
            out = _found(items, finder, threshold, data, offsets)
            if out:
                keys = sorted(out)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, rows).take(pa.array([d for d, _ in keys])),
                        pa.array([k for _, k in keys], pa.int64()),
                        pa.array([out[k][0] for k in keys], pa.float64()),
                        pa.array([out[k][1] for k in keys], pa.int64()),
                        pa.array([out[k][2] for k in keys], pa.int64()),
                    ],
                    ["id", "item", "score", "first_word", "last_word"],
                )


def _without(sent, threshold: float, batches: Iterator[pa.RecordBatch]):
    items = Items(*sent.value)
    finder = _Finder(items)
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for first, _, data, offsets in runs(batch.column(1)):
            for doc, _ in _found(items, finder, threshold, data, offsets):
                keep[first + doc] = False
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep))], ["id"])


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, item, score, first_word, last_word) of test items found in documents.

    Words are runs of letters, digits and bytes above ASCII, ASCII and Latin-1 letters
    lower-cased. The seeds of an item are its rare n-grams: GRAM words, or where more
    than MANY different items use those, twice as many and so on. So a copy is looked at
    wherever it leaves GRAM neighbouring words as they are that few items share; one that
    leaves fewer everywhere, or only words that many items begin or end with, is not
    found, whatever its score. Each n-gram of a text leads to MANY different items at
    most, but for items made of n-grams that many others hold throughout, whose longest
    ones are their seeds. One pass over the documents finds the seeds and aligns
    the item with the words around them; ``score`` is the alignment's part of what an
    unchanged copy would get, from ``threshold`` to 1, and the best place in a document
    is given. Items go to the tasks in blocks of BLOCK_WORDS words, documents are never
    shuffled, so it does not matter how many of them hold the same item.

    Null or empty documents and items hold nothing. Items shorter than GRAM words are
    their own seed. Rows that repeat an id are judged one by one, items that repeat an
    id are items of their own; other columns are ignored, empty tables give an empty
    result.
    """
    spark = docs.sparkSession
    item_kind = benchmark.schema[item_col].dataType
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = carrying(text, "id", "item bigint, score double, first_word bigint, last_word bigint")
    found = spark.createDataFrame([], schema).withColumn("name", F.lit(None).cast(item_kind))
    for ids, texts in _blocks(benchmark.select(F.col(item_col).alias("id"), F.col("text"))):
        seeds = spark.sparkContext.broadcast(Items.of(ids, texts).parts())
        names = spark.createDataFrame(
            list(enumerate(ids)), StructType().add("item", "long").add("name", item_kind)
        )
        part = text.mapInArrow(lambda b, seeds=seeds: _hits(seeds, threshold, b), schema)
        found = found.unionByName(part.join(F.broadcast(names), "item"))  # a block of items
    return found.select(
        F.col("id").alias(id_col), F.col("name").alias(item_col), "score", "first_word", "last_word"
    )


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows in which ``leaks`` finds no item, with all their columns."""
    kept = docs.select(F.struct("*").alias("id"), F.col(text_col).alias("text"))
    for ids, texts in _blocks(benchmark.select(F.lit(None).alias("id"), F.col("text"))):
        seeds = docs.sparkSession.sparkContext.broadcast(Items.of(ids, texts).parts())
        kept = kept.mapInArrow(
            lambda b, seeds=seeds: _without(seeds, threshold, b), StructType().add("id", kept.schema["id"].dataType)
        ).select("id", F.col("id").getField(text_col).alias("text"))
    return kept.select("id.*")


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """The items in blocks of about BLOCK_WORDS words; one block at a time is in memory."""
    ids, texts, size = [], [], 0
    for row in benchmark.filter("length(text) > 0").toLocalIterator():
        ids.append(row["id"])
        texts.append(row["text"])
        size += len(row["text"]) // 5 + 1
        if size >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
