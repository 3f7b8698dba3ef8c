"""Tokens, packing, languages, licenses and decontamination against plain versions."""

import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from ticketlab.llm import decontam, language, licenses, packing, pieces, queries, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "it's I'll we've they're 'tis ''s .'s 'S 'LL x'rest", "<|endoftext|>a<|startoftext|>", "a<|endoftext|>'s b",
    "İ ß ÀÉ × ÷ ² ½ ª\x1c\x85\xa0 中文a ǅ é", "<|", "12 3x_y", "", " ", None,
]


@pytest.fixture(scope="module")
def tokenizer():
    return pieces.load(PATH)


def encoded(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    draw = random.Random(1)
    letters = "abst 'rvemldESTÉçß×÷.,!?-_012  \n\t<|>éñ²½ªºµİΣς\x1c\x85\xa0 中文ａǅ́é"
    return ODD + ["".join(draw.choice(letters) for _ in range(draw.randrange(40))) for _ in range(400)]


@pytest.mark.parametrize("frequent", [token_counts.FREQUENT, 1])
def test_token_counts_are_the_librarys(spark, tokenizer, monkeypatch, frequent):
    monkeypatch.setattr(token_counts, "FREQUENT", frequent)
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "a", 1), (3, "b c", 1)], "doc_id long, text string, known int")
    got = token_counts.count_tokens(df, PATH, limit=7).collect()
    want = [(i, t) for i, t in enumerate(texts)] + [(None, "a"), (3, "b c")]
    key = lambda r: (str(r[0]), *r[1:])
    want = [(i, len((t or "").encode()), len(encoded(tokenizer, t)), len(encoded(tokenizer, t)) > 7) for i, t in want]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(df.limit(0), PATH).collect() == []


def check_pieces(rows: pd.DataFrame, ids: dict, window: int):
    for doc, own in rows.groupby("doc_id"):
        own = own.sort_values("start")
        assert own["start"].tolist() == [0, *own["length"].cumsum()[:-1]]
        assert own["length"].sum() == len(ids[doc]) and set(own["doc_tokens"]) == {len(ids[doc])}
        for r in own.itertuples():
            assert zlib.crc32(np.array(ids[doc][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]] and own["length"].sum() <= window
    assert set(rows["doc_id"]) == set(ids)


@pytest.mark.parametrize("window, chunk", [(4096, 1 << 20), (64, 300), (8, 1)])
def test_packing_is_a_partition(spark, folder, tokenizer, monkeypatch, tmp_path, window, chunk):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    texts = odd_texts() + [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").limit(30).collect()]
    spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3).write.parquet(f"{tmp_path}/docs")
    got = packing.pack(spark.read.parquet(f"{tmp_path}/docs"), PATH, window=window).toPandas()
    check_pieces(got, {i: [*encoded(tokenizer, t), packing.END_ID] for i, t in enumerate(texts)}, window)
    sizes = got.groupby("sequence_id")["length"].sum()
    padding = sizes.map(lambda n: 0 if n & (n - 1) == 0 else window - n).sum()
    assert window < 4096 or padding < 0.05 * sizes.sum()


def test_packing_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none")
    assert packing.pack(spark.read.parquet(f"{tmp_path}/none"), PATH).collect() == []


def test_cuts_are_the_best():
    draw = random.Random(2)
    for _ in range(200):
        window, at = 10, []
        while len(at) < 9:
            at.append((at[-1] if at else 0) + draw.randint(1, window))
        cost = [draw.choice([0, 1, 3]) for _ in at]

        for end in (packing.padded, packing.split_up, packing.left_open):

            def total(cuts):
                padding = sum(window - (b - a) + cost[at.index(b)] for a, b in zip([0, *cuts], cuts))
                return padding + end(at[-1] - (cuts[-1] if cuts else 0), window)

            options = []
            for mask in range(1 << 9):
                cuts = [at[k] for k in range(9) if mask >> k & 1]
                if all(b - a <= window for a, b in zip([0, *cuts], [*cuts, at[-1]])):
                    options.append(total(cuts))
            assert total(packing.choose_cuts(np.array(at), np.array(cost, float), window, end)) == min(options)


def test_language_of_held_out_documents(spark):
    got = queries.QUERIES["op5_language"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs)
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (both["lang_pred"] == both["lang"])[both["held_out"]].mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_mixture_finds_both_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.learn(docs)
    rows = {r["lang"]: r["text"] for r in docs.filter("length(text) between 800 and 3000").collect()}
    half = rows["en"][:800] + " " + rows["de"][:800]
    df = spark.createDataFrame([(1, half, "fr"), (2, None, "fr"), (3, "12 !?", "en"), (4, "", ""), (None, rows["fr"], "")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    shares = dict(x.split(":") for x in got[1].mixture.split(","))
    assert set(shares) == {"en", "de"} and abs(float(shares["en"]) - 0.5) < 0.15
    assert [(got[k].lang_pred, got[k].score) for k in (2, 3, 4)] == [("und", 0.0)] * 3
    assert got[None].lang_pred == "fr"
    assert language.identify(df.limit(0), model).collect() == []
    nothing = language.learn(docs.limit(0))
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}


def test_best_mixture_by_search():
    chance = np.array([[0.7, 0.1], [0.2, 0.2], [0.1, 0.7]])
    cells = np.array([0] * 300 + [1] * 100 + [2] * 100)
    shares, _ = language.mixture(chance, np.log(chance), cells)
    grid = np.linspace(0, 1, 1001)
    likely = [np.log(chance[cells] @ np.array([p, 1 - p])).sum() for p in grid]
    assert abs(shares[0] - grid[int(np.argmax(likely))]) < 0.02


WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def license_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    w, places, labels = license_words(text), [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_phrases_and_notices(spark, folder):
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    texts += [
        None, "", "CC by", "all rights. reserved; CC-BY cc by", "general public", "license é all rights reserved",
        "x Released under the MIT License. y", "mit and license", "Licensed under the Apache License, Version 1.1",
        "Permission is hereby granted, free of charge, to anybody obtaining one copy of this software and its"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    n = len(texts)
    assert [got[n - k].labels for k in (4, 3, 2, 1)] == ["mit", "", "apache-2.0", "mit"]
    assert licenses.scan(df.limit(0)).collect() == []


def plain_alignment(item, text):
    best, row = 0, [0] * (len(text) + 1)
    for a in item:
        after = [0]
        for j, b in enumerate(text):
            same = decontam.MATCH if a == b else decontam.MISMATCH
            after.append(max(0, row[j] + same, row[j + 1] + decontam.GAP, after[j] + decontam.GAP))
        row = after
        best = max(best, max(row))
    return best


def test_alignment_is_smith_waterman():
    draw = np.random.default_rng(6)
    for _ in range(200):
        item, text = (draw.integers(0, 4, n).astype(np.uint64) for n in draw.integers(1, 20, 2))
        score, first, last = decontam.align(item, text)
        assert score == plain_alignment(item.tolist(), text.tolist())
        if score:
            assert score == plain_alignment(item.tolist(), text[first : last + 1].tolist())


def test_leaks_and_clean_documents(spark):
    draw = random.Random(8)
    vocabulary = [f"v{i}" for i in range(400)] + ["the", "of", "and"] * 60
    write = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [write(n) for n in (15, 20, 30, 40, 60, 2)] + [[]]
    docs, want = [], {}
    for i in range(150):
        text = write(draw.choice([30, 100, 400]))
        if i % 3 == 0:
            k = i % 6
            copy = list(items[k])
            for at in range(len(copy)):
                if k < 5 and draw.random() < (0.12 if i % 2 else 0):
                    copy[at] = "other"
            spot = draw.randrange(len(text))
            text[spot:spot] = copy
        docs.append((i, " ".join(text)))
    for i, text in docs:
        for k, item in enumerate(items):
            # An item of two words needs both as its seed, so one of them is no hit.
            score = plain_alignment(item, text.split()) / (2 * len(item)) if item else 0
            if score >= decontam.THRESHOLD and (len(item) > 2 or score == 1):
                want[i, k] = score
    df = spark.createDataFrame([(i, t, "s") for i, t in docs] + [(900, None, ""), (901, "", ""), (None, " ".join(items[3]), "")], "doc_id long, text string, item string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(77, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(df, bench).collect()}
    assert got.pop((None, 3)) == 1.0
    assert got == pytest.approx(want) and len(want) > 40
    kept = decontam.without_leaks(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs if not any(d == i for d, _ in want)} | {900, 901}
    assert decontam.leaks(df.limit(0), bench).collect() == decontam.leaks(df, bench.limit(0)).collect() == []


def test_capital_copies_are_found(spark):
    text = "été à Noël où ça naît du goût près d'ici, mêlé de thé"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    df = spark.createDataFrame([(1, "x " + text.upper() + " y"), (2, "× ÷ ß")], "doc_id long, text string")
    assert [(r.doc_id, r.score) for r in decontam.leaks(df, bench).collect()] == [(1, 1.0)]


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 3)
    bench = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k} e{k}") for k in range(4)], "item_id long, text string")
    df = spark.createDataFrame([(1, "x a1 b1 c1 d1 e1 y a3 b3 c3 d3 e3"), (2, "q")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.score) for r in decontam.leaks(df, bench).collect()) == [(1, 1, 1.0), (1, 3, 1.0)]
    assert [r.doc_id for r in decontam.without_leaks(df, bench).collect()] == [2]


@pytest.mark.parametrize("every", [4, 5, 6])
def test_copies_that_occur_only_edited_are_found(spark, every):
    item = [f"w{k}" for k in range(38)]
    edited = [f"other{k}" if k % every == every - 1 else w for k, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    df = spark.createDataFrame([(1, "before " + " ".join(edited) + " after"), (2, "w0 w1 w2")], "doc_id long, text string")
    want = plain_alignment(item, edited) / (2 * len(item))
    assert want >= decontam.THRESHOLD
    assert [(r.doc_id, r.score) for r in decontam.leaks(df, bench).collect()] == [(1, pytest.approx(want))]
    assert [r.doc_id for r in decontam.without_leaks(df, bench).collect()] == [2]


def test_a_phrase_that_many_items_share_leads_to_none(spark):
    phrase = "which of the following statements is true about"
    own = [" ".join(f"k{i}x{j}" for j in range(10)) for i in range(3000)]
    texts = [f"{phrase} {o}" for o in own] + [phrase, "which of the", "of the", own[7], f"{phrase} {own[8]}"]
    items = decontam.Items.of(list(range(len(texts))), texts)
    # Items of the same words are as one: number 8 and the last share all their seeds.
    assert np.unique(items.gram, return_counts=True)[1].max() <= 2 * decontam.MANY
    assert set(items.item.tolist()) == set(range(len(texts)))
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = [(1, " and ".join([phrase] * 50)), (2, f"x {phrase} {own[5]} y"), (3, "is true about " + own[5].replace("k5x4", "z")), (4, f"{phrase} {own[8]}")]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    short = {3000, 3001, 3002}
    assert {i for d, i in got if d == 1} == short
    assert {i for d, i in got if d == 2} == {5} | short
    assert {i for d, i in got if d == 3} == {5}
    assert {i for d, i in got if d == 4} == {8, 3004} | short


def test_items_of_shared_n_grams_keep_the_rarest():
    draw = random.Random(3)
    texts = [" ".join(draw.choices("ab", k=draw.randint(1, 12))) for _ in range(400)]
    items = decontam.Items.of(list(range(400)), texts)
    assert set(items.item.tolist()) == set(range(400))
    for g, k, at, size in zip(items.gram, items.item, items.at, items.size):
        part = decontam.Items.of([0], [" ".join(texts[k].split()[at : at + size])])
        assert at + size <= len(texts[k].split()) and g in decontam._grams(part.words[0], size)
