"""Structure repair of conversations by lightest derivations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ticketlab.operators.order_stats import pin

SEGMENT_ROWS = 1024  # rows of a conversation that are derived together
SEGMENT_BYTES = 1 << 22  # and bytes of their texts
PREFIX = 64  # characters of a text that choose its range of rows; inside a range all count
BATCH = 500  # segments handed on together

# What edits cost, and the space characters.
DELETE, REROLE, INSERT, LEFT_TRUNCATED = 2, 1, 5, 5
SPACES = " \t\n\x0b\x0c\r"

# States of s?(ua)+ or nothing: 0 before anything, 1 after s, 2 after u, 3 after a.
_ENDS = (0, 3)
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_MAKE = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
_LEGAL = ("su", "ua", "au")


def derive(initials: Sequence[str], faults: Sequence[str], start: int = 0, whole: bool = True):
    """State after all rows -> (cost, audit) of the lightest edits that lead there from ``start``.

    An item says that the first i rows are edited and the grammar is in state q. Each
    deduction takes one item to another and adds its cost and its letter, so its value is
    above what it came from: a string comes before its continuations. Two edits of equal
    rows and cost are never one the continuation of the other, since that would be by
    insertions alone, which cost; so a lesser value stays the lesser one whatever follows,
    and the first value an item is popped with is its lightest. With ``whole`` the first
    goal ends the agenda.
    """
    n, found, done = len(initials), {}, set()
    agenda = [(0, "", 0, start)]
    while agenda:
        cost, audit, i, q = heappop(agenda)
        if (i, q) in done:
            continue
        done.add((i, q))
        made, after = _MAKE[q]
        if i == n:
            found[q] = (cost, audit)
            if whole and q in _ENDS:
                return {q: found[q]}
        else:
            heappush(agenda, (cost + DELETE, audit + "D", i + 1, q))
            if faults[i] in "kt":
                here = cost + (LEFT_TRUNCATED if faults[i] == "t" else 0)
                kept = _KEEP.get((q, initials[i]))
                if kept is not None:
                    heappush(agenda, (here, audit + "K", i + 1, kept))
                if initials[i] != made[0]:
                    heappush(agenda, (here + REROLE, audit + "R", i + 1, after))
        heappush(agenda, (cost + INSERT, audit + "I", i, after))
    return found


def join_segments(segments: Sequence[dict]) -> list[tuple[int, str]]:
    """(start state, audit) of each segment on the lightest way through all of them.

    A segment is a dict (start, end) -> (cost, audit). Items are (segments passed, state),
    whose values grow by what ``derive`` found for one more segment.
    """
    agenda, done = [(0, "", 0, 0, ())], set()
    while agenda:
        cost, audit, k, q, path = heappop(agenda)
        if (k, q) in done:
            continue
        done.add((k, q))
        if k == len(segments):
            if q in _ENDS:
                break
            continue
        for (start, end), (more, letters) in segments[k].items():
            if start == q:
                heappush(agenda, (cost + more, audit + letters, k + 1, end, (path, start, letters)))
    way = []
    while path:
        path, start, letters = path
        way.append((start, letters))
    return way[::-1]


def apply(audit: str, start: int, roles: Sequence[str], texts: Sequence[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits of ``audit``, made from state ``start``."""
    out_roles, out_texts, i, q = [], [], 0, start
    for letter in audit:
        if letter in "IR":
            role, q = _MAKE[q]
            out_roles.append(role)
            out_texts.append("" if letter == "I" else texts[i])
        elif letter == "K":
            q = _KEEP[q, roles[i][:1]]
            out_roles.append(roles[i])
            out_texts.append(texts[i])
        i += letter != "I"
    return out_roles, out_texts


_STATS = (
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, "
    "first_turn bigint, last_turn bigint, turns bigint"
)
_ITEMS = "array<struct<start:int,end:int,cost:bigint,audit:string>>"
_SEGMENT = (
    f"block int, segment bigint, complete boolean, {_STATS}, items {_ITEMS}, roles array<string>, texts array<string>"
)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _with_id(df: DataFrame, rest: str) -> StructType:
    made = StructType().add("id", df.schema["id"].dataType)
    return StructType(made.fields + StructType.fromDDL(rest).fields)


def _segments(schema: pa.Schema, batches: Iterator[pa.RecordBatch]):
    """Segments of the conversations of a range of rows, with what can be derived from each.

    A conversation that begins and ends inside the range and is one segment is whole: its
    lightest repair is found here. Others are derived from every state to every state.
    """
    block, made, rows = TaskContext.get().partitionId(), [], []
    nothing = object()
    conv, number, size, begun = nothing, 0, 0, False  # begun: an earlier segment or range may hold rows of it

    def flush(ended: bool):
        nonlocal number, size, begun
        turns, roles, texts, faults = map(list, zip(*rows))
        initials = [r[:1] for r in roles]
        known = [t for t in turns if t is not None]
        complete = ended and not begun
        if complete:
            items = [(0, q, *v) for q, v in derive(initials, faults).items()]
        else:
            items = [(p, q, *v) for p in range(4) for q, v in derive(initials, faults, p, False).items()]
        made.append(
            {
                "id": conv,
                "block": block,
                "segment": number,
                "complete": complete,
                "blank": faults.count("b"),
                "duplicate": faults.count("d"),
                "truncated": faults.count("t"),
                "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
                "first_initial": initials[0],
                "last_initial": initials[-1],
                "first_turn": known[0] if known else None,
                "last_turn": known[-1] if known else None,
                "turns": len(set(known)),
                "items": [dict(zip(("start", "end", "cost", "audit"), x)) for x in items],
                "roles": roles,
                "texts": texts,
            }
        )
        rows.clear()
        number, size, begun = number + 1, 0, True

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != conv:
                if rows:
                    flush(True)
                begun = conv is nothing
                conv = row[0]
            elif len(rows) >= SEGMENT_ROWS or size >= SEGMENT_BYTES:
                flush(False)
            rows.append(row[1:])
            size += len(row[3])
        if len(made) >= BATCH:
            yield pa.RecordBatch.from_pylist(made, schema)
            made.clear()
    if rows:
        flush(False)
    if made:
        yield pa.RecordBatch.from_pylist(made, schema)


def _ways(batches: Iterator[pa.RecordBatch]):
    """Start state and audit of each segment of conversations that are several."""
    schema = pa.schema([("block", pa.int32()), ("segment", pa.int64()), ("start", pa.int32()), ("audit", pa.string())])
    nothing = object()
    conv, places, segments = nothing, [], []

    def way():
        found = [
            {"block": b, "segment": s, "start": start, "audit": audit}
            for (b, s), (start, audit) in zip(places, join_segments(segments))
        ]
        return pa.RecordBatch.from_pylist(found, schema)

    for batch in batches:
        for name, block, segment, items in zip(*(c.to_pylist() for c in batch.columns)):
            if name != conv and segments:
                yield way()
                places, segments = [], []
            conv = name
            places.append((block, segment))
            segments.append({(x["start"], x["end"]): (x["cost"], x["audit"]) for x in items})
    if segments:
        yield way()


def _mend(schema: pa.Schema, batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            row["roles"], row["texts"] = apply(row["audit"], row["start"], row["roles"], row["texts"])
        yield pa.RecordBatch.from_pylist(rows, schema)


def _faults(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows with an id of their own and their first fault: b, d or t, else k."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    said = F.rtrim(text, F.lit(SPACES))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    made = pin(
        rows.select(
            F.col(conv_col).alias("id"),
            F.col(turn_col).cast("bigint").alias("turn"),
            role.alias("role"),
            text.alias("text"),
            F.unhex(F.md5(named)).alias("said"),
            F.when(said == "", "b").when(F.right(said, F.lit(1)).isin(".", "!", "?"), "k").otherwise("t").alias("fault"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    place = F.struct("turn", "row")
    again = pin(
        made.groupBy("id", "said")
        .agg(F.count("*").alias("n"), F.min(place).alias("first"))
        .filter("n > 1")
        .select(F.col("id").alias("i"), F.col("said").alias("s"), "first")
    )
    # The few sayings that come again are stored, so that Spark can split a hot one's rows.
    joined = made.join(again, F.col("id").eqNullSafe(F.col("i")) & (F.col("said") == F.col("s")), "left")
    later = F.col("first").isNotNull() & (place != F.col("first")) & (F.col("fault") != "b")
    return joined.select("id", "turn", "role", "text", F.when(later, "d").otherwise(F.col("fault")).alias("fault"), "row")


def repair(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """The cheapest repair of every conversation to s?(ua)+ or nothing, as segments of rows.

    A row's first fault is blank (b), duplicate (d: role and text seen earlier in the
    conversation) or truncated (t: the last character that is no space is not one of
    ``.!?``). A row is kept for 0, given the role user or assistant for 1, or deleted for
    2, which blank rows and duplicates have to be; a truncated row that stays costs 5
    more, and a row of empty text and role user or assistant can be put in anywhere for 5.
    The cheapest edits are found by Knuth's agenda over weighted deductions (``derive``),
    of equally cheap ones those whose initials D, I, K, R come first in order.

    Rows are ordered by ranges of (conversation, turn, role, text), nulls first, so a
    conversation of any size spreads over tasks, and is cut into segments of SEGMENT_ROWS
    rows or SEGMENT_BYTES of text. Those of conversations that cross segments are derived
    between all 16 pairs of states and joined by a second agenda, which holds no texts: 16
    bytes a row of one conversation. Rows equal in conversation, turn, role and the first
    PREFIX characters of the text meet in one range, as a stream.

    Result: per segment the id, ``block`` and ``segment`` in order, ``complete`` (the
    conversation is this segment alone), counts of the faults and of ``illegal`` pairs of
    neighbouring initials (other than su, ua, au) inside it, what its ends are, ``cost``,
    ``audit`` (the initials of the edits) and the repaired ``roles`` and ``texts``.

    Null roles and texts are one space, null turns come first, rows without a conversation
    id are one conversation with a null id. Ties of turn come by role, then text; equal
    rows are duplicates. A role without characters fits no place of the grammar. A text of
    any length is one value. Other columns are ignored, an empty table gives an empty
    result.
    """
    order = ("id", "turn", "role", "text", "row")
    ranged = _faults(rows, conv_col, turn_col, role_col, text_col).repartitionByRange(
        "id", "turn", F.substring("role", 1, PREFIX), F.substring("text", 1, PREFIX)
    )
    schema = _with_id(ranged, _SEGMENT)
    arrow = _arrow(schema)
    cut = pin(
        ranged.sortWithinPartitions(*order)
        .select("id", "turn", "role", "text", "fault")
        .mapInArrow(lambda b: _segments(arrow, b), schema)
    )
    split = cut.filter("not complete")
    ways = (
        split.select("id", "block", "segment", "items")
        .repartition("id")
        .sortWithinPartitions("id", "block", "segment")
        .mapInArrow(_ways, "block int, segment bigint, start int, audit string")
    )
    found = (
        cut.filter("complete")
        .withColumn("start", F.lit(0))
        .withColumn("audit", F.col("items")[0]["audit"])
        .unionByName(split.join(ways, ["block", "segment"]))
        .withColumn("cost", _cost())
        .drop("items")
    )
    mended = found.schema
    target = _arrow(mended)
    return found.mapInArrow(lambda b: _mend(target, b), mended).withColumnRenamed("id", conv_col)


def _cost() -> Column:
    """Cost of the derivation whose start and audit were chosen."""
    chosen = F.filter("items", lambda x: (x["start"] == F.col("start")) & (x["audit"] == F.col("audit")))
    return chosen[0]["cost"]


_REPORT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)


def _digests(schema: pa.Schema, batches: Iterator[pa.RecordBatch]):
    """One row per conversation from its segments in order; texts go through a running SHA-256."""
    nothing = object()
    conv, out, now = nothing, [], {}

    def close():
        turns = now.pop("turns")
        low, high = now.pop("low"), now.pop("high")
        out.append(
            now
            | {
                "id": conv,
                "gaps": high - low + 1 - turns if turns else 0,
                "audit": "".join(now["audit"]),
                "repaired_sha256": now.pop("sha").hexdigest(),
            }
        )

    def batch_of():
        made = pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in out], schema)
        out.clear()
        return made

    for batch in batches:
        for row in batch.to_pylist():
            if row["id"] != conv:
                if conv is not nothing:
                    close()
                conv = row["id"]
                now = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0)
                now |= {"audit": [], "sha": hashlib.sha256(), "low": None, "high": None, "last": None, "any": False}
            for name in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                now[name] += row[name]
            if now["last"] is not None and now["last"] + row["first_initial"] not in _LEGAL:
                now["illegal"] += 1
            now["last"] = row["last_initial"]
            if row["turns"]:
                if now["high"] == row["first_turn"]:
                    now["turns"] -= 1
                now["low"] = row["first_turn"] if now["low"] is None else now["low"]
                now["high"] = row["last_turn"]
            now["audit"].append(row["audit"])
            for role, text in zip(row["roles"], row["texts"]):
                now["sha"].update(f"{chr(10) if now['any'] else ''}{role}:{text}".encode())
                now["any"] = True
        if len(out) >= BATCH:
            yield batch_of()
    if conv is not nothing:
        close()
    if out:
        yield batch_of()


def report(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation its counts of faults, cost, audit and the SHA-256 of its repaired rows.

    ``gaps`` are the turns missing between the least and the greatest one. A conversation
    of one segment is finished where it is; the others come together in order, as a
    stream: SHA-256 has to see its input in sequence, and the audit is one value, but
    texts are not held.
    """
    rows = repaired.withColumnRenamed(conv_col, "id")
    schema = _with_id(rows, _REPORT)
    arrow = _arrow(schema)
    cut = rows.filter("not complete").repartition("id").sortWithinPartitions("id", "block", "segment")
    parts = [df.mapInArrow(lambda b: _digests(arrow, b), schema) for df in (rows.filter("complete"), cut)]
    return parts[0].union(parts[1]).withColumnRenamed("id", conv_col)


def damage(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Rows with the faults that repair is for, chosen by the CRC-32 of ``conversation:turn``.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 removes all ``.!?`` of it,
    3 repeats it and 4 makes it the user's. Nulls are one space there, in roles and texts.
    """
    blank = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank)
    )
    role, text = F.coalesce(F.col(role_col), blank), F.coalesce(F.col(text_col), blank)
    kind = F.crc32(key.cast("binary")) % 20
    return (
        rows.select(
            F.col(conv_col),
            F.col(turn_col),
            F.when(kind == 4, "user").otherwise(role).alias(role_col),
            F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias(text_col),
            F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("_times"),
        )
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times"))))
        .drop("_times", "_copy")
    )


def with_all(report_: DataFrame, rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The report with a row of zeros for each conversation of ``rows`` that has none in it."""
    ids = rows.select(F.col(conv_col).alias("_id")).distinct()
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    named = StructType.fromDDL(_REPORT).names
    return ids.join(report_, F.col("_id").eqNullSafe(F.col(conv_col)), "left").select(
        F.col("_id").alias(conv_col), *[F.coalesce(c, F.lit(empty.get(c, 0))).alias(c) for c in named]
    )
