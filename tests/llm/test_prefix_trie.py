"""Trie of conversation prefixes against one made of nested dictionaries."""

import hashlib
import random
import zlib

import pytest

from ticketlab.llm import prefix_trie


def rebuilt(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + mine[h:]
    return out


def plain(convs):
    """Per node (members, text bytes), then totals by walking all prefixes."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, who in members.items():
        under = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in who if len(convs[c]) == len(node))
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who),
            sum(len(n) == len(node) + 1 for n in under),
            sum(not any(m[:-1] == n and m for m in under) for n in under),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def make(seed, conversations=60, longest=7):
    r = random.Random(seed)
    rows = []
    for c in [None, *range(conversations)]:
        if c is not None and c % 5 == 0 and r.random() < 0.3:
            continue
        for t in range(r.randint(1, longest)):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None]), r.choice(["a", "é", "", None, "yes"])))
    return rows


def frame(spark, rows):
    made = [(*r, 7, "x", 1) for r in rows]
    return spark.createDataFrame(made, "conv_id long, turn int, role string, text string, depth int, a string, n_convs int").repartition(4)


def trie(df):
    turns, convs = prefix_trie.ordered_turns(df)
    return sorted(map(tuple, prefix_trie.prefix_trie(*prefix_trie.rebuild(turns, convs)).collect()), key=str)


# How many turns a block has, how rare members of shards are, and what a queue holds.
@pytest.mark.parametrize("block, top, held", [(4096, 16, 200_000), (2, 16, 3), (3, 3, 2), (1, 4, 1)])
def test_nodes_and_totals(spark, monkeypatch, block, top, held):
    for name, value in (("BLOCK", block), ("TOP", top), ("HELD", held), ("CHUNK", 3)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = make(block + top)
    assert trie(frame(spark, rows)) == plain(rebuilt(rows))


def test_hot_prefixes_and_copies_in_small_pieces(spark, monkeypatch):
    for name, value in (("BLOCK", 4), ("TOP", 5), ("HELD", 5), ("CHUNK", 7)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = [(c, t, "user" if t % 2 else "system", f"turn {t}") for c in range(0, 300, 5) for t in range(6)]
    rows += [(c, t, "user", "hello" if t == 0 else f"{c} {t}") for c in range(300, 360) for t in range(3)]
    rows += [(1000, t, "user", f"long {t}") for t in range(60)]
    rows += [(1001, t, "user", f"long {t}") for t in range(45)]
    assert trie(frame(spark, rows)) == plain(rebuilt(rows))


def test_turnless_conversations_and_empty_tables(spark):
    short = [c for c in range(1, 4000) if c % 5 and zlib.crc32(str(c).encode()) % 9][:3]
    rows = [(c, 0, "user", "x") for c in short]
    assert trie(frame(spark, rows)) == plain(rebuilt(rows))
    assert trie(frame(spark, rows).limit(0)) == []
    assert trie(frame(spark, [(None, 0, "user", "x")])) == []


def test_the_queue_gives_back_the_least_whatever_it_spilled():
    r = random.Random(2)
    for held in (1, 2, 7, 1000):
        queue, inside, got = prefix_trie.Messages(held), [], []
        for _ in range(800):
            if inside and r.random() < 0.4:
                assert queue.first() == min(inside)
                got.append(queue.pop())
                inside.remove(got[-1])
            else:
                inside.append((r.randint(0, 50), r.randint(0, 50)))
                queue.push(inside[-1])
            assert len(queue.heap) <= held
        while inside:
            assert queue.pop() == min(inside)
            inside.remove(min(inside))
        assert queue.first() is None
