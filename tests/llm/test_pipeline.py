"""The pipeline's stages: what they keep, and that each works on what is left."""

import random

import public_tokenizers
import pytest
from test_words_and_pairs import shingle_set

import corpus_pipeline
from ticketlab.llm import packing, pieces


@pytest.fixture
def small(spark, tmp_path):
    """A folder with documents of known kinds and a benchmark."""
    draw = random.Random(12)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) between 500 and 2500").orderBy("doc_id").limit(80).collect()
    rows, bad = [], set()
    test = " ".join(f"item{draw.randrange(40)} word{k}" for k in range(20))
    for r in docs:
        rows.append((r.doc_id, r.text, r.lang, r.source, r.n_chars, "x"))
    base = docs[0].text
    shout = "".join(c.upper() if c.isascii() else c for c in base)
    for i, text in enumerate(["12 34 !!", "", None, base, shout, docs[1].text + " " + test]):
        rows.append((100_000 + i, text, "en", "s", 1, "x"))
        bad.add(100_000 + i)
    rows += [(200_000, "eins und zwei", "de", "s", 1, "x")] * 2
    rows += [(None, docs[2].text + " und noch viel mehr", None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, test), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return f"{tmp_path}", rows, bad


def test_stages_keep_clean_documents(spark, small):
    folder, rows, bad = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == columns
        kept[name] = sorted((tuple(r) for r in docs.collect()), key=str)
        assert set(kept[name]) <= set(rows)
    ids = {name: {r[0] for r in found} for name, found in kept.items()}
    assert {100_000, 100_001, 100_002}.isdisjoint(ids["languages"]) and {100_003, 100_004, 100_005} <= ids["languages"]
    assert {100_003, 100_004}.isdisjoint(ids["near_copies"])
    final = kept["decontaminated"]
    assert not bad & ids["decontaminated"] and sum(r[0] == 200_000 for r in final) == 1
    # No two that are left are near copies, and every one that went as a copy is like one of its group.
    sets = [shingle_set(r[1]) for r in final]
    for i, a in enumerate(sets):
        assert not any(100 * len(a & b) >= 80 * len(a | b) for b in sets[:i])
    gone = [r for r in kept["languages"] if r not in kept["near_copies"]]
    for r in gone:
        s = shingle_set(r[1])
        assert any(100 * len(s & shingle_set(o[1])) >= 80 * len(s | shingle_set(o[1])) for o in kept["languages"] if o[0] != r[0])


def test_run_packs_what_is_left(spark, small):
    folder, _, bad = small
    got = corpus_pipeline.run(spark, folder).filter("doc_id is not null").toPandas()
    tokenizer = pieces.load(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = {i: [*tokenizer.encode(texts[i], add_special_tokens=False).ids, packing.END_ID] for i in set(got["doc_id"])}
    assert not bad & set(ids) and len(ids) > 60
    for doc, own in got.groupby("doc_id"):
        assert own["length"].sum() == len(ids[doc])


def test_empty_tables(spark, small, tmp_path):
    folder, _, _ = small
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


