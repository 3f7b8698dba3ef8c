"""Packing by minimum bin slack against plain bins, and its pieces against the library's ids."""

import random
import zlib
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest

from ticketlab.llm import bin_slack
from ticketlab.llm.pieces import load

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_bins(counts, window):
    """One bin after the other, each by trying all combinations beside a longest piece."""
    left = [n for n, c in counts.items() for _ in range(c)]
    bins = []
    while left:
        longest = max(left)
        rest = sorted(left, reverse=True)
        rest.remove(longest)
        best = (longest, (longest,))
        for size in range(1, len(rest) + 1):
            for some in set(combinations_with_replacement(sorted(set(rest), reverse=True), size)):
                if all(some.count(n) <= rest.count(n) for n in some) and longest + sum(some) <= window:
                    best = max(best, (longest + sum(some), (longest, *some)))
        for n in best[1]:
            left.remove(n)
        bins.append(best[1])
    return bins


@pytest.mark.parametrize("seed", range(40))
def test_bins_are_the_fullest_ones(seed):
    r = random.Random(seed)
    window = r.randint(5, 20)
    counts = {}
    for _ in range(r.randint(0, 8)):
        n = r.randint(1, window)
        counts[n] = counts.get(n, 0) + 1
    got = []
    for copies, parts in bin_slack.fill_bins(counts, window):
        got += [tuple(sorted((n for n, t in parts for _ in range(t)), reverse=True))] * copies
    assert got == plain_bins(counts, window)


def test_the_number_of_combinations_does_not_grow_with_the_pieces():
    r = random.Random(7)
    few = {n: r.randint(1, 100) for n in range(1, 257)}
    many = {n: c * 10**7 + r.randint(0, 99) for n, c in few.items()}
    for counts in (few, many):
        bins = bin_slack.fill_bins(counts, 256)
        assert len(bins) <= 2.5 * 256
        used = {}
        for copies, parts in bins:
            assert sum(n * t for n, t in parts) <= 256 and len({n for n, _ in parts}) == len(parts)
            for n, t in parts:
                used[n] = used.get(n, 0) + copies * t
        assert used == counts


def pieces_of(ids, window, end):
    ids = [*ids, end]
    return [ids[k : k + window] for k in range(0, len(ids), window)]


def check(spark, rows, window=bin_slack.WINDOW, **more):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, sequence_id int, id int")
    got = bin_slack.pack_full(docs.repartition(3), PATH, window=window, **more).collect()
    tokenizer = load(PATH)
    want = []
    for i, t in rows:
        start = 0
        for k, part in enumerate(pieces_of(tokenizer.encode(t or "", add_special_tokens=False).ids, window, 1)):
            want.append((i, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
            start += len(part)
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    counts = {}
    for *_, n, _ in want:
        counts[n] = counts.get(n, 0) + 1
    assert len(sequences) == sum(c for c, _ in bin_slack.fill_bins(counts, window))
    return sequences


def test_pieces_places_and_odd_rows(spark, monkeypatch):
    r = random.Random(3)
    words = ["the", "house", "Étude", "don't", "x1y22", "naïve", "…", "日本", "!?", "antidisestablishmentarianism"]
    rows = [(k, " ".join(r.choices(words, k=r.randint(0, 40)))) for k in range(120)]
    rows += [(None, "no id"), (None, None), (5, "again"), (7, ""), (7, ""), (8, "\n\t "), (9, "<|endoftext|> a")]
    rows += [(1000 + k, "same words here") for k in range(100)]
    check(spark, rows, window=32)
    # a long text in parts gives the same pieces as whole
    monkeypatch.setattr(bin_slack, "PART_BYTES", 300)
    rows += [(2000, " ".join(r.choices(words, k=3000))), (2001, "x" * 2000), (2002, " " * 1000 + "a " * 500)]
    check(spark, rows, window=32)
    check(spark, [(1, "one two three four five")], window=1)


def test_exact_window_and_empty_table(spark):
    assert len(check(spark, [(1, "one two three"), (2, "one two three four")], window=4)) == 3
    docs = spark.createDataFrame([], "doc_id long, text string")
    got = bin_slack.pack_full(docs, PATH)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.collect() == []
