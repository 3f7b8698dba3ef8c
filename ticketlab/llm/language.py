"""Language mixtures of documents by expectation-maximisation over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlab.llm.words import carrying, mix, runs

BITS = 16  # pairs of bytes are exact, triples are hashed to as many cells
CELLS = 2 << BITS
SMOOTHING = 0.1
ROUNDS = 50
SETTLED = 1e-4
LANGUAGES_IN_TASK = 64  # a task hands on its counts when it has seen more labels than this
UNKNOWN = "und"
MAIN_SHARE = 0.5


@dataclass(frozen=True)
class Model:
    """Languages in alphabetical order and the probability of each cell under each."""

    languages: tuple[str, ...]
    chance: np.ndarray


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose crc32(id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _codes() -> np.ndarray:
    """Letters as lower-case bytes, bytes above ASCII as they are, all else as 0."""
    code = np.zeros(256, np.int64)
    code[97:123] = np.arange(97, 123)
    code[65:91] = code[97:123]
    code[128:] = np.arange(128, 256)
    return code


def _grams(code: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """Cells of the pairs and triples of all texts, and where each text's begin.

    Texts are taken with a gap before and after. Pairs of two gaps and triples around a
    gap say nothing and are left out.
    """
    n = len(offsets) - 1
    padded = np.zeros(len(data) + n + 1, np.int64)
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    padded[at] = code[data]
    starts = offsets + np.arange(n + 1)  # the gap before each text
    pair = padded[:-1] * 256 + padded[1:]
    keep2 = np.flatnonzero(pair)
    with np.errstate(over="ignore"):
        three = (pair[:-1] * 256 + padded[2:]).astype(np.uint64)
        triple = (mix(three) >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS)
    keep3 = np.flatnonzero(padded[1:-1])
    return (
        pair[keep2], np.searchsorted(keep2, starts),
        triple[keep3], np.searchsorted(keep3, starts),
    )


def _count(batches: Iterator[pa.RecordBatch]):
    code, sums = _codes(), {}

    def out():
        for lang, total in sums.items():
            cells = np.flatnonzero(total)
            for at in range(0, len(cells), 10_000):
                part = cells[at : at + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array(part), pa.array(total[part])],
                    ["lang", "cell", "n"],
                )
        sums.clear()

    for batch in batches:
        langs = batch.column(1).to_pylist()
        for first, rows, data, offsets in runs(batch.column(0)):
            pair, p, triple, t = _grams(code, data, offsets)
            own = np.array(langs[first : first + rows], object)
            of2, of3 = np.repeat(np.arange(rows), np.diff(p)), np.repeat(np.arange(rows), np.diff(t))
            for lang in set(own):
                mine = own == lang
                total = sums.setdefault(lang, np.zeros(CELLS, np.int64))
                total += np.bincount(pair[mine[of2]], minlength=CELLS)
                total += np.bincount(triple[mine[of3]], minlength=CELLS)
            if len(sums) > LANGUAGES_IN_TASK:
                yield from out()
    yield from out()


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Cell counts per label over all rows that have a text and a label.

    The counts are summed per task and then by Spark. What reaches the driver is bounded
    by the number of labels times CELLS, whatever the number of documents.
    """
    rows = (
        docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        .mapInArrow(_count, "lang string, cell bigint, n bigint")
        .groupBy("lang", "cell")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    labels = rows["lang"].to_numpy(zero_copy_only=False)
    languages = tuple(sorted(set(labels)))
    place = {x: k for k, x in enumerate(languages)}
    counts = np.full((CELLS, len(languages)), SMOOTHING)
    counts[rows["cell"].to_numpy(), [place[x] for x in labels]] += rows["n"].to_numpy()
    for order in (counts[: 1 << BITS], counts[1 << BITS :]):
        order /= order.sum(axis=0)
    return Model(languages, counts)


def mixture(chance: np.ndarray, log: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the languages in a text, and how sure the largest one is.

    Expectation-maximisation gives the shares of all languages; the sets of the 1, 2, ...
    largest are fitted again and the one with the best log-likelihood less log(n) per
    further language is taken. The log-likelihood is concave in the shares, so its slope
    at a single language bounds what any mixture can add; where that is below the
    penalty, no other set needs to be fitted.
    """
    n, width = len(cells), log.shape[1]
    alone = np.ones(n) @ log[cells]
    best = int(alone.argmax())
    posterior = np.exp(np.maximum(alone - alone[best], -700))
    sure = float(posterior[best] / posterior.sum())
    shares = np.zeros(width)
    shares[best] = 1.0
    penalty = np.log(n)
    likely = chance[cells]
    if width == 1 or ((1 / likely[:, best]) @ likely).max() - n <= penalty:
        return shares, sure
    likely /= likely[:, best : best + 1]
    cells, again, weight = np.unique(cells, return_index=True, return_counts=True)
    likely, weight = likely[again], weight.astype(float)

    def fit(p: np.ndarray):
        pi = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(ROUNDS):
            after = pi * ((weight / (p @ pi)) @ p) / n
            moved, pi = np.abs(after - pi).max(), after
            if moved < SETTLED:
                break
        return pi, float(weight @ np.log(p @ pi))

    order = np.argsort(-fit(likely)[0], kind="stable")
    top = 0.0  # log-likelihood of the best single language, relative to itself
    for size in range(2, width + 1):
        chosen = order[:size]
        pi, gain = fit(likely[:, chosen])
        if gain - (size - 1) * penalty > top:
            top = gain - (size - 1) * penalty
            shares = np.zeros(width)
            shares[chosen] = pi
    return shares, sure


def _has_letter(data: np.ndarray, code: np.ndarray) -> bool:
    letters = code[data]
    if ((letters > 0) & (letters < 128)).any():
        return True
    return bool((letters > 0).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace"))


def _judge(model, batches: Iterator[pa.RecordBatch]):
    code = _codes()
    languages, chance = model.value
    log = np.log(chance)
    for batch in batches:
        for first, rows, data, offsets in runs(batch.column(1)):
            pair, p, triple, t = _grams(code, data, offsets)
            names, scores, main, lists = [], [], [], []
            for i in range(rows):
                if not languages or not _has_letter(data[offsets[i] : offsets[i + 1]], code):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    main.append(0.0)
                    lists.append("")
                    continue
                cells = np.concatenate((pair[p[i] : p[i + 1]], triple[t[i] : t[i + 1]]))
                shares, sure = mixture(chance, log, cells)
                top = int(shares.argmax())
                names.append(languages[top])
                scores.append(float(min(1.0, shares[top] * sure)))
                main.append(float(shares[top]))
                lists.append(
                    ",".join(f"{languages[k]}:{shares[k]:.3f}" for k in np.argsort(-shares, kind="stable") if shares[k] > 0)
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, rows),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(main, pa.float64()),
                    pa.array(lists, pa.string()),
                ],
                ["id", "lang_pred", "score", "share", "mixture"],
            )


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: its id, ``lang_pred``, ``score``, ``share`` and ``mixture``.

    ``lang_pred`` is the largest language of the selected mixture, ``share`` its part of
    the text, ``score`` that part times its posterior among the single languages. The
    text alone is judged; ``id_col`` may be of any type, a struct of the whole row too. Of
    languages with equal shares the first in the model's order is taken. Null or empty
    texts, texts without a letter, and a model without languages give ``und`` with 0. Repeated rows are judged one by one, other columns
    are ignored, an empty table gives an empty result. The model goes to every task; its
    size is the number of labels times CELLS.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.chance))
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(
            lambda batches: _judge(sent, batches),
            carrying(docs, id_col, "lang_pred string, score double, share double, mixture string"),
        )
        .withColumnRenamed("id", id_col)
    )


def accepted(min_share: float = MAIN_SHARE) -> Column:
    """Documents with a language that makes up ``min_share`` of the text."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("share") >= min_share)
