"""Token counts of documents from the piece counts of distinct pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlab.llm.pieces import Pieces, Splitter
from ticketlab.llm.words import carrying, runs
from ticketlab.operators.order_stats import pin

LIMIT = 2048
FREQUENT = 1 << 20  # a pre-token with more than this part of all is joined in memory
HELD = 200_000  # distinct pre-tokens a task holds before it hands them on
ROWS = 20_000  # rows of a batch that a task hands on


def _uses(path: str, batches: Iterator[pa.RecordBatch]):
    """(pre-token's hash, the pre-token, times) of a task, in portions of about HELD."""
    splitter, total, text = Splitter(path), {}, {}

    def out():
        names = list(total)
        for at in range(0, len(names), ROWS):
            part = names[at : at + ROWS]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(part, np.uint64).view(np.int64)),
                    pa.array([text[h] for h in part], pa.string()),
                    pa.array([total[h] for h in part], pa.int64()),
                ],
                ["token", "text", "uses"],
            )
        total.clear()
        text.clear()

    for batch in batches:
        for _, _, data, offsets in runs(batch.column(0)):
            hashes, _, word = splitter.split(data, offsets)
            names, where, uses = np.unique(hashes, return_index=True, return_counts=True)
            for h, at, n in zip(names.tolist(), where.tolist(), uses.tolist()):
                if h in total:
                    total[h] += n
                else:
                    total[h], text[h] = n, word(at)
            if len(total) > HELD:
                yield from out()
    yield from out()


def _piece_counts(path: str, batches: Iterator[pa.RecordBatch]):
    pieces = Pieces(path)
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(pieces.count(batch.column(1).to_pylist()))],
            ["token", "uses", "pieces"],
        )


def _frequencies(path: str, sent, batches: Iterator[pa.RecordBatch]):
    """Per document: bytes, tokens of the frequent pre-tokens, and how often the others occur."""
    splitter = Splitter(path)
    known, count = sent.value
    for batch in batches:
        for first, rows, data, offsets in runs(batch.column(1)):
            hashes, bounds, _ = splitter.split(data, offsets)
            place = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
            found = known[place] == hashes if len(known) else np.zeros(len(hashes), bool)
            pieces = np.zeros(len(hashes), np.int64)
            pieces[found] = count[place[found]]
            sums = np.concatenate(([0], np.cumsum(pieces)))
            tokens, uses = [], []
            for i in range(rows):
                mine = slice(bounds[i], bounds[i + 1])
                rare, n = np.unique(hashes[mine][~found[mine]], return_counts=True)
                tokens.append(rare.view(np.int64))
                uses.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, rows),
                    pa.array(np.diff(offsets)),
                    pa.array(sums[bounds[1:]] - sums[bounds[:-1]]),
                    pa.array(tokens, pa.list_(pa.int64())),
                    pa.array(uses, pa.list_(pa.int32())),
                ],
                ["id", "n_bytes", "known", "tokens", "uses"],
            )


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """Per document: its id, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``path`` names a tokenizer file whose pieces never cross pre-tokens. One pass counts
    the distinct pre-tokens of the corpus, whose pieces are then counted once each. A
    second pass counts each document's pre-tokens and joins the piece counts: those of
    pre-tokens that make up more than 1/FREQUENT of all, fewer than FREQUENT by
    arithmetic and 16 bytes each, in memory, so that no frequent one is a hot key; all
    others by a shuffle on the pre-token. No ids of a text are made. Pre-tokens are
    named by 64-bit hashes.

    Null and empty texts have 0 bytes and tokens. Rows that repeat an id are counted one
    by one, null ids are kept, other columns are ignored, an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    vocabulary = pin(
        text.select("text")
        .mapInArrow(lambda b: _uses(path, b), "token bigint, text string, uses bigint")
        .groupBy("token")
        .agg(F.min("text").alias("text"), F.sum("uses").alias("uses"))
        .mapInArrow(lambda b: _piece_counts(path, b), "token bigint, uses bigint, pieces bigint")
    )
    total = vocabulary.agg(F.sum("uses")).first()[0] or 0
    frequent = vocabulary.filter(F.col("uses") * FREQUENT > total)
    table = frequent.select("token", "pieces").toArrow()
    known = table["token"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    sent = spark.sparkContext.broadcast((known[order], table["pieces"].to_numpy()[order]))

    rows = text.withColumn("id", F.struct("id", F.monotonically_increasing_id().alias("row")))
    counted = pin(
        rows.mapInArrow(
            lambda b: _frequencies(path, sent, b),
            carrying(rows, "id", "n_bytes bigint, known bigint, tokens array<bigint>, uses array<int>"),
        )
    )
    rare = (
        counted.select(F.col("id.row").alias("row"), F.explode(F.arrays_zip("tokens", "uses")).alias("t"))
        .select("row", "t.tokens", "t.uses")
        .join(vocabulary.filter(F.col("uses") * FREQUENT <= total).drop("uses"), F.col("tokens") == F.col("token"))
        .groupBy("row")
        .agg(F.sum(F.col("uses") * F.col("pieces")).alias("others"))
    )
    n_tokens = F.col("known") + F.coalesce("others", F.lit(0))
    return (
        counted.select(F.col("id.row").alias("row"), F.col("id.id").alias(id_col), "n_bytes", "known")
        .join(rare, "row", "left")
        .select(id_col, "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
    )
