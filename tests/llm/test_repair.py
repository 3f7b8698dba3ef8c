"""Lightest repairs of conversations against all edits tried."""

import hashlib
import random
import re
import zlib

import pytest

from ticketlab.llm import repair

GOOD = re.compile(r"(s?(ua)+)?\Z")
MADE = {"s": None, "u": "user", "a": "assistant"}


def edits(rows, most):
    """All (cost, audit, repaired rows) of up to ``most`` insertions, by trying them."""
    if most:
        for role in ("user", "assistant"):
            for cost, audit, rest in edits(rows, most - 1):
                yield cost + 5, "I" + audit, [(role, ""), *rest]
    if not rows:
        yield 0, "", []
        return
    (role, text, fault), later = rows[0], rows[1:]
    for cost, audit, rest in edits(later, most):
        yield cost + 2, "D" + audit, rest
        if fault in "kt":
            more = 5 if fault == "t" else 0
            yield cost + more, "K" + audit, [(role, text), *rest]
            for other in ("user", "assistant"):
                yield cost + more + 1, "R" + audit, [(other, text), *rest]


def plain(rows):
    best = None
    for cost, audit, out in edits(rows, 2):
        if GOOD.match("".join(r[:1] or "?" for r, _ in out)):
            best = min(best or (cost, audit, out), (cost, audit, out), key=lambda x: x[:2])
    return best


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = text.strip(repair.SPACES)
        fault = "b" if not said else "d" if (role, text) in seen else "k" if said[-1] in ".!?" else "t"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain_report(rows):
    """``rows`` are (turn, role, text) of one conversation."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    judged = plain_faults([(r, x) for _, r, x in rows])
    turns = [t for t, _, _ in rows if t is not None]
    faults = [f for *_, f in judged]
    cost, audit, out = plain(judged)
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        faults.count("b"), faults.count("d"), faults.count("t"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest(),
    )


@pytest.mark.parametrize("seed", range(60))
def test_agenda_finds_the_lightest_edits(seed):
    r = random.Random(seed)
    rows = [(r.choice(["system", "user", "assistant", "tool", ""]), str(k), r.choice("kkktbd")) for k in range(r.randint(0, 5))]
    initials, faults = [x[0][:1] for x in rows], [x[2] for x in rows]
    (state, (cost, audit)), = repair.derive(initials, faults).items()
    want = plain(rows)
    assert (cost, audit) == want[:2]
    roles, texts = repair.apply(audit, 0, [x[0] for x in rows], [x[1] for x in rows])
    assert list(zip(roles, texts)) == want[2]
    # cut anywhere, the segments join to the same
    cuts = sorted(r.randint(0, len(rows)) for _ in range(2))
    parts = [slice(0, cuts[0]), slice(cuts[0], cuts[1]), slice(cuts[1], None)]
    segments = [
        {(p, q): v for p in range(4) for q, v in repair.derive(initials[s], faults[s], p, False).items()} for s in parts
    ]
    way = repair.join_segments(segments)
    assert "".join(a for _, a in way) == audit
    joined = []
    for (start, letters), s in zip(way, parts):
        joined += zip(*repair.apply(letters, start, [x[0] for x in rows[s]], [x[1] for x in rows[s]]))
    assert joined == want[2]


def make(seed, conversations=40, longest=5):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "So what", "", "  \n", None, "Why? ", "é", "Yes. \x1c", "a.b"]
    rows = []
    for c in [None, *range(conversations)]:
        for _ in range(r.randint(1, longest)):
            rows.append((c, r.choice([None, 0, 1, 2, 3, 9]), r.choice(["system", "user", "assistant", None, "tool"]), r.choice(texts)))
    return rows


def frame(spark, rows, parts=3):
    made = [(*r, 7, "x") for r in rows]
    return spark.createDataFrame(made, "conv_id long, turn int, role string, text string, id int, fault string").repartition(parts)


@pytest.mark.parametrize("segment", [(1024, 1 << 22), (2, 1 << 22), (1024, 3)])
def test_reports_of_odd_rows_in_segments_of_any_size(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", segment[0])
    monkeypatch.setattr(repair, "SEGMENT_BYTES", segment[1])
    rows = make(5)
    found = repair.report(repair.repair(frame(spark, rows))).collect()
    want = {}
    for c, *row in rows:
        want.setdefault(c, []).append(row)
    assert {r.conv_id: tuple(r)[1:] for r in found} == {c: plain_report(x) for c, x in want.items()}
    assert len(found) == len(want)


def test_a_long_conversation_spreads_over_tasks(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(9000)]
    rows[4000] = (1, 4000, "user", "turn 3998.")
    rows[7001] = (1, 7001, "user", "cut off")
    rows += [(c, 0, "user", "Hello.") for c in range(2, 60)]
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")  # the table is small
    try:
        fixed = repair.repair(frame(spark, rows, 5).repartition(8))
        cut = [r for r in fixed.collect() if r.conv_id == 1]
        assert len({r.block for r in cut}) > 1 and max(len(r.audit) for r in cut) <= repair.SEGMENT_ROWS + 2
        one = {r.conv_id: r for r in repair.report(fixed).collect()}
    finally:
        spark.conf.unset(merging)
    assert one[1].audit == "K" * 3999 + "DD" + "K" * 2999 + "DD" + "K" * 1998
    assert (one[1].gaps, one[1].duplicate, one[1].truncated, one[1].illegal, one[1].cost) == (0, 1, 1, 2, 8)
    assert len(one) == 59 and one[2].audit == "D"


def test_damage_and_conversations_that_vanish(spark):
    rows = make(11, 60)
    df = frame(spark, rows)
    damaged = {}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            damaged.setdefault(c, []).extend([(t, role, text)] * (2 if kind == 3 else 1))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: plain_report(damaged[c]) if c in damaged else nothing for c in {r[0] for r in rows}}
    found = repair.with_all(repair.report(repair.repair(repair.damage(df))), df).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == want and len(found) == len(want)
    empty = df.limit(0)
    assert repair.with_all(repair.report(repair.repair(repair.damage(empty))), empty).collect() == []
