"""Word hashes, PartEnum join, lattice hashing and components against brute force."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ticketlab.llm import graph, lattice, partenum, words

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text):
    w = SPACED.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def smallest_reachable(ids, linked):
    label = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_hashes_follow_the_words():
    texts = ["A b  É c", None, "", " \t", "x" * 9000 + " y", "b A\nb"]
    split = words.Words(words.SPACED)
    seen, found = {}, []
    for first, rows, data, offsets in words.runs(pa.array(texts)):
        hashes, bounds = split.of(data, offsets)
        for i in range(rows):
            own = [w for w in SPACED.findall(lower(texts[first + i] or ""))]
            mine = hashes[bounds[i] : bounds[i + 1]].tolist()
            assert len(own) == len(mine)
            for w, h in zip(own, mine):
                assert seen.setdefault(w, h) == h == split.hash(w)
            found += mine
    assert len(set(seen.values())) == len(seen)


def test_runs_cover_slices():
    column = pa.array(["aa", "b", None, "cc" * words.RUN_BYTES, "d"]).slice(1)
    got = [data[o[i] : o[i + 1]].tobytes() for _, n, data, o in words.runs(column) for i in range(n)]
    assert got == [b"b", b"", b"cc" * words.RUN_BYTES, b"d"]


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 8, 11, 16, 30, 31, 64, 100, 257, 700])
def test_similar_sets_share_a_signature(size):
    draw = np.random.default_rng(size)
    for _ in range(60):
        a = np.unique(draw.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
        drop = draw.integers(0, len(a) // 5 + 1)
        kept = draw.permutation(a)[drop:]
        add = draw.integers(0, size // 4 + 1)
        b = np.unique(np.concatenate((kept, draw.integers(0, 2**63, add).astype(np.uint64))))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common) and len(a) != common:
            assert set(partenum.signatures(a).tolist()) & set(partenum.signatures(b).tolist())


def documents():
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, texts = [], []
    for _ in range(25):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 6, 20, 80, 300]))]
        texts.append(base)
        for _ in range(draw.randrange(5)):
            other = list(base)
            for _ in range(draw.randrange(1 + len(base) // 40 + 2)):
                other[draw.randrange(len(other))] = draw.choice(vocabulary)
            texts.append(other)
    passage = " ".join(draw.choice(vocabulary) for _ in range(60))
    texts = [" ".join(t) for t in texts] + [f"{passage} {draw.random()}" for _ in range(12)]
    texts += [None, "", "  ", "A b", "a  B", "one two three four five", texts[0].upper(), texts[0]]
    draw.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows


@pytest.mark.parametrize("block, elements", [(partenum.BLOCK, partenum.ELEMENTS), (3, 10**6), (partenum.BLOCK, 200)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, block, elements):
    monkeypatch.setattr(partenum, "ELEMENTS", elements)
    rows = documents()
    df = spark.createDataFrame([(i, t, 1, "x", 0) for i, t in rows], "doc_id long, text string, n int, node string, sig int")
    sets = {i: shingle_set(t) for i, t in rows}
    linked = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    label = smallest_reachable(list(sets), linked)
    got = partenum.similar_groups(df, block=block).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), label[i]) for i, s in sets.items()}
    assert len(got) == len(rows) and len(linked) > 20


def test_groups_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "c d"), (3, None), (7, "A B")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in partenum.similar_groups(df).collect()), key=str)
    assert got == [(3, 0, 3), (3, 1, 3), (3, 1, 3), (7, 1, 3), (None, 1, 3)]
    assert partenum.similar_groups(df.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    draw = random.Random(9)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(1, 1), (None, 2), (2, 3)]
    draw.shuffle(links)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 560)} | {2: 2, 3: 2}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_nearest_lattice_points():
    draw = np.random.default_rng(1)
    moves = lattice.neighbours()
    assert len(moves) == 240 and np.allclose((moves**2).sum(axis=1), 2)
    z = draw.normal(size=(500, 8)) * 3
    point = lattice.nearest(z)
    assert np.allclose((2 * point) % 2, ((2 * point) % 2)[:, :1]) and np.allclose(point.sum(axis=1) % 2, 0)
    away = ((z - point) ** 2).sum(axis=1)
    for v in moves:  # no neighbour is nearer
        assert (((z - point - v) ** 2).sum(axis=1) >= away - 1e-9).all()


@pytest.mark.parametrize("side", [lattice.SIDE, 4])
def test_vectors_link_as_in_all_pairs(spark, side):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(60, 64))
    x = [v for b in base for v in (b, *(b + draw.normal(size=(draw.integers(0, 6), 64)) * draw.choice([0.02, 0.1, 0.2])))]
    x += [base[0], base[0], base[1] * 3]
    rows = [(i, v.astype(float).tolist(), i % 3) for i, v in enumerate(x)]
    n = len(rows)
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    label = smallest_reachable(range(n), [tuple(p) for p in np.argwhere(close)])
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] + [1.0] * 63, [1.0, 2.0]]
    rows += [(n + k, v, 0) for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(df, side=side).collect()}
    want = {i: (int(close[i].sum()), label[i], label[i] == i) for i in range(n)}
    want |= {n + k: (0, n + k, True) for k in range(len(odd))}
    assert got == want and close.sum() > 100
    assert lattice.near_vectors(df.limit(0)).collect() == []


def test_lattice_recall():
    draw = np.random.default_rng(5)
    a = draw.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    g = draw.normal(size=a.shape)
    g -= (g * a).sum(axis=1)[:, None] * a
    g /= np.linalg.norm(g, axis=1)[:, None]
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * g
    cells = lattice.Hash(64)
    (home_a, near_a), (home_b, near_b) = cells.cells(a), cells.cells(b)
    met = home_a == home_b
    met |= (near_a == home_b[:, :, None]).any(axis=2) | (near_b == home_a[:, :, None]).any(axis=2)
    assert met.any(axis=1).mean() > 0.99


@pytest.mark.parametrize("bits", [partenum.FILTER_BITS, 16])
def test_texts_without_an_id_link_like_others(spark, monkeypatch, bits):
    monkeypatch.setattr(partenum, "FILTER_BITS", bits)  # the least bitmap has 2**15 bits
    words = [f"w{k}" for k in range(60)]
    one, two, three = " ".join(words), " ".join([*words[:-1], "x"]), " ".join([*words[:-1], "y"])
    rows = [(1, one), (None, two), (3, three), (None, "alone " + " ".join(reversed(words))), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in partenum.similar_groups(df).collect()), key=str)
    assert got == sorted([(1, 56, 1), (None, 56, 1), (3, 56, 1), (None, 57, None), (9, 0, 9)], key=str)
