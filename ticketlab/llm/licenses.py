"""License notices by a positional index of their rarest words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlab.llm.words import LETTERS_AND_DIGITS, Words, carrying, runs

# Phrases that always count, with their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Notices as their publishers word them, each with its label and with the
# phrases of which one must stand in a match word for word.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file"
        " except in compliance with the License. You may obtain a copy of the License at",
        ("apache license",),
    ),
    ("mit", "Released under the MIT License", ("mit license",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction",
        ("permission is hereby granted", "free of charge"),
    ),
    (
        "gpl-notice",
        "This work is licensed under the GNU General Public License, version 3",
        ("gnu general public license",),
    ),
    (
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation",
        ("gnu general public license",),
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4",)),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met",
        ("redistribution and use",),
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("mozilla public license",),
    ),
)

ANCHORS = 4  # rarest words of a notice that are looked up
VOTES = 2  # different anchors that must agree on a place
SLACK = 3  # words by which their places may differ
COVERAGE = 0.5  # of a notice's words that must stand where the notice has them
_SIEVE = 1 << 20


def _split(split: Words, text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return split.of(data, np.array([0, len(data)]))[0]


def _slots(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(44)).astype(np.int64)


def _listed(names: np.ndarray, sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the words that are among the sorted ``names``."""
    at = np.flatnonzero(sieve[_slots(hashes)])
    return at[names[np.minimum(np.searchsorted(names, hashes[at]), len(names) - 1)] == hashes[at]]


def _sieve(names: np.ndarray) -> np.ndarray:
    sieve = np.zeros(_SIEVE, bool)
    sieve[_slots(names)] = True
    return sieve


def _document_counts(names: np.ndarray, batches: Iterator[pa.RecordBatch]):
    split, sieve = Words(LETTERS_AND_DIGITS), _sieve(names)
    total = np.zeros(len(names), np.int64)
    for batch in batches:
        for _, _, data, offsets in runs(batch.column(0)):
            hashes, bounds = split.of(data, offsets)
            at = _listed(names, sieve, hashes)
            word, doc = np.searchsorted(names, hashes[at]), np.searchsorted(bounds, at, "right")
            pairs = np.unique(doc * len(names) + word)
            total += np.bincount(pairs % len(names), minlength=len(names))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names))), pa.array(total)], ["word", "n"])


def _consecutive(hashes: np.ndarray, bounds: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Words at which the phrase begins within one text."""
    size = len(phrase)
    at = np.flatnonzero(hashes == phrase[0])
    at = at[at + size <= bounds[np.searchsorted(bounds, at, "right")]] if len(at) else at
    for k in range(1, size):
        at = at[hashes[at + k] == phrase[k]]
    return at


def _scan(phrases, notices, postings, batches: Iterator[pa.RecordBatch]):
    split = Words(LETTERS_AND_DIGITS)
    base = [(_split(split, p), label) for p, label in phrases]
    words = [_split(split, text) for _, text, _ in notices]
    keys = [[_split(split, p) for p in ps] for _, _, ps in notices]
    gram, notice, place = postings
    names = np.unique(gram)
    sieve = _sieve(names)
    need = [min(VOTES, len(np.unique(gram[notice == k]))) for k in range(len(notices))]
    for batch in batches:
        for first, rows, data, offsets in runs(batch.column(1)):
            hashes, bounds = split.of(data, offsets)
            n_base = np.zeros(rows, np.int64)
            low = np.full(rows, np.iinfo(np.int64).max)
            high = np.full(rows, -1)
            base_labels = [set() for _ in range(rows)]
            labels = [set() for _ in range(rows)]
            score = np.zeros(rows)
            for phrase, label in base:
                at = _consecutive(hashes, bounds, phrase)
                doc = np.searchsorted(bounds, at, "right") - 1
                np.add.at(n_base, doc, 1)
                np.minimum.at(low, doc, at - bounds[doc])
                np.maximum.at(high, doc, at - bounds[doc])
                for d in set(doc.tolist()):
                    base_labels[d].add(label)
                    score[d] = 1.0

            at = _listed(names, sieve, hashes)
            lo, hi = np.searchsorted(gram, hashes[at]), np.searchsorted(gram, hashes[at], "right")
            many = hi - lo
            entry = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
            spot = np.repeat(at, many)
            doc, which, shift = np.searchsorted(bounds, spot, "right") - 1, notice[entry], spot - place[entry]
            order = np.lexsort((shift, which, doc))
            doc, which, shift, word = doc[order], which[order], shift[order], gram[entry][order]
            new = np.ones(len(doc) + 1, bool)
            new[1:-1] = (doc[1:] != doc[:-1]) | (which[1:] != which[:-1]) | (np.diff(shift) > SLACK)
            cuts = np.flatnonzero(new)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                k, d = int(which[a]), int(doc[a])
                if b - a < need[k] or len(np.unique(word[a:b])) < need[k]:
                    continue
                size = len(words[k])
                left = max(bounds[d], shift[a] - SLACK)
                right = min(bounds[d + 1], shift[b - 1] + size + SLACK)
                span = hashes[left:right]
                edges = np.array([0, len(span)])
                if not any(len(_consecutive(span, edges, p)) for p in keys[k]):
                    continue
                covered = 0
                for s in set(shift[a:b].tolist()):
                    i, j = max(bounds[d], s), min(bounds[d + 1], s + size)
                    covered = max(covered, int((hashes[i:j] == words[k][i - s : j - s]).sum()))
                if covered >= COVERAGE * size:
                    labels[d].add(notices[k][0])
                    score[d] = max(score[d], covered / size)
            some = n_base > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, rows),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array(n_base),
                    pa.array(low, mask=~some),
                    pa.array(high.astype(np.int64), mask=~some),
                    pa.array([",".join(sorted(x)) for x in base_labels], pa.string()),
                    pa.array([",".join(sorted(x | y)) for x, y in zip(base_labels, labels)], pa.string()),
                    pa.array(score),
                ],
                ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    notices: Sequence[tuple[str, str, Sequence[str]]] = NOTICES,
) -> DataFrame:
    """Per document: its words, the places of the phrases, and the labels of all notices.

    Words are runs of letters, digits and bytes above ASCII, A-Z lower-cased. One pass
    counts in how many documents each word of the notices occurs. The ANCHORS words of a
    notice with the highest inverse document frequency are indexed with their positions.
    A second pass looks up the words of each file in this index, brings the postings to
    the place where the notice would begin, and keeps places on which VOTES different
    anchors agree within SLACK words. A place counts if one of the notice's key phrases
    stands there word for word and COVERAGE of its words are where they should be.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` are about ``phrases``
    alone; ``labels`` are those of both. ``score`` is the largest part of a notice that
    was found, 1 for a phrase. Texts that are null or empty have no words and empty
    labels. Rows that repeat an id are judged one by one, other columns are ignored, an
    empty table gives an empty result. What is sent to the tasks depends on the notices
    alone.
    """
    split = Words(LETTERS_AND_DIGITS)
    words = [_split(split, text) for _, text, _ in notices]
    names = np.unique(np.concatenate(words))
    counts = (
        docs.select(F.col(text_col).alias("text"))
        .mapInArrow(lambda b: _document_counts(names, b), "word bigint, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .collect()  # one row for each word of the notices at most
    )
    n = np.zeros(len(names), np.int64)
    for row in counts:
        n[row["word"]] = row["n"]
    entries = []
    for k, w in enumerate(words):
        own, at = np.unique(w, return_index=True)
        rank = np.lexsort((at, n[np.searchsorted(names, own)]))  # rarest first
        for anchor in own[rank[:ANCHORS]]:
            entries += [(anchor, k, p) for p in np.flatnonzero(w == anchor)]
    gram = np.array([e[0] for e in entries], np.uint64)
    order = np.argsort(gram, kind="stable")
    notice, place = (np.array([e[i] for e in entries], np.int64)[order] for i in (1, 2))
    postings = gram[order], notice, place
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return text.mapInArrow(
        lambda b: _scan(phrases, notices, postings, b),
        carrying(
            text, "id",
            "n_words bigint, n_base bigint, first_word bigint, last_word bigint,"
            " base_labels string, labels string, score double",
        ),
    ).withColumnRenamed("id", id_col)
