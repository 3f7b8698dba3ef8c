"""URL filters: rules first, then trust and distrust carried along the links between hosts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlab.llm.graph import discard
from ticketlab.operators.order_stats import pin

ALLOW, BLOCK = "allow", "block"

# Host, path, verdict.
RULES = (
    ("org", "/", ALLOW),
    ("example.org", "/es/", BLOCK),
    ("example.org", "/en/1", BLOCK),
    ("com", "/fr/", ALLOW),
    ("com", "/de/", BLOCK),
)

DAMPING = 0.85
TOLERANCE = 1e-10  # scores are settled when a round changes none by more than this part of itself
LEAST = 1e-300  # score of a host that links reach, but so far off that it would vanish
DIRECT = 200_000  # links and seeds that are settled in the driver's memory
RATIO = 1.0  # distrust of a blocked host over its trust
MARGIN = 1e-9  # of itself, by which trust may exceed what equals it: sums of doubles depend on their order
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [
        F.when(
            ((host == F.lit(h)) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for h, p, verdict in ordered
    ]
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*fits, none)


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): in how many pages a host links to another one.

    Links are absolute and scheme-relative ``href`` values; others stay on their host. A
    host and the domain above it, down to two labels, count as one link each way.
    """
    own = host(F.col(url_col))
    found = F.transform(
        F.regexp_extract_all(html_col, F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)
    )
    links = pages.select(own.alias("src"), F.explode(F.array_distinct(found)).alias("dst"))
    linked = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    known = pages.select(own.alias("host")).union(links.select("dst")).distinct()
    labels = F.split("host", r"\.")
    above = F.transform(
        F.sequence(F.lit(0), F.size(labels) - 3),
        lambda k: F.struct(
            F.array_join(F.slice(labels, k + 1, F.size(labels)), ".").alias("low"),
            F.array_join(F.slice(labels, k + 2, F.size(labels)), ".").alias("high"),
        ),
    )
    family = (
        known.filter(F.size(labels) > 2).select(F.explode(above).alias("p")).select("p.low", "p.high").distinct()
    )
    kin = family.select(F.col("low").alias("src"), F.col("high").alias("dst")).union(family.select("high", "low"))
    return (
        linked.union(kin.withColumn("weight", F.lit(1.0)))
        .filter("src != '' and dst != '' and src != dst")
        .groupBy("src", "dst")
        .agg(F.sum("weight").alias("weight"))
    )


def _direct(seeds: pa.Table, links: pa.Table, damping: float) -> pa.Table:
    """``propagate`` in memory, by the same rounds and the same end."""
    column = lambda table, name: table[name].to_numpy(zero_copy_only=False)
    n = [seeds.num_rows, seeds.num_rows + links.num_rows]
    hosts = np.concatenate([column(seeds, "host"), column(links, "src"), column(links, "dst")])
    hosts, place = np.unique(hosts.astype(object), return_inverse=True)
    seed, src, dst = np.split(place, n)
    weight = column(links, "weight")
    scores = []
    for part, a, b in (("trusted", src, dst), ("blocked", dst, src)):
        base = np.bincount(seed, column(seeds, part), len(hosts))
        base = base / (base.sum() or 1.0)
        each = weight / np.bincount(a, weight, len(hosts))[a]
        state = base
        while True:
            before, state = state, (1 - damping) * base + damping * np.bincount(b, state[a] * each, len(hosts))
            state = np.where(state > 0, np.maximum(state, LEAST), 0.0)
            if not (np.abs(state - before) > TOLERANCE * state).any():
                break
        scores.append(state)
    return pa.table({"host": pa.array(hosts, pa.string()), "trust": scores[0], "distrust": scores[1]})


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of all hosts that a seed or a link names.

    ``seeds`` has host and the non-negative weights trusted and blocked. Trust is the
    personalised PageRank from the trusted ones along the links; distrust the same from
    the blocked ones against them: who links to a blocked host shares its distrust. Both
    go through one join a round. A host without links on the way hands nothing on.
    Rounds go on until no host's trust or distrust changes by more than TOLERANCE of
    itself, so they also reach every host that has any, which takes a round for each
    link on the way. A host that is reached has at least LEAST, so its score does not
    vanish after thousands of links. Each round is written to the checkpoint folder, so no plan grows
    and a lost executor costs one round; the parts of a hub's rows are split by Spark.
    Up to DIRECT seeds and links are settled in the driver, by the same rule.
    """
    if seeds.count() + links.count() <= DIRECT:
        parts = seeds.select("host", "trusted", "blocked").toArrow(), links.select("src", "dst", "weight").toArrow()
        found = _direct(*parts, damping)
        return pin(seeds.sparkSession.createDataFrame(found, "host string, trust double, distrust double"))
    totals = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    known = seeds.select("host").union(links.select("src")).union(links.select("dst")).distinct()
    start = pin(
        known.join(seeds, "host", "left")
        .crossJoin(F.broadcast(totals))  # one row
        .select("host", F.coalesce(share("trusted", "t"), F.lit(0.0)).alias("trust"), F.coalesce(share("blocked", "b"), F.lit(0.0)).alias("distrust"))
    )
    out = links.groupBy("src").agg(F.sum("weight").alias("all_out"))
    into = links.groupBy("dst").agg(F.sum("weight").alias("all_in"))
    forward = links.join(out, "src").select(
        F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("weight") / F.col("all_out")).alias("t"), F.lit(0.0).alias("d")
    )
    backward = links.join(into, "dst").select(
        F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("weight") / F.col("all_in")).alias("d")
    )
    ways = pin(forward.union(backward))
    scores = ("trust", "distrust")
    state = start
    while True:
        given = ways.join(state.withColumnRenamed("host", "from"), "from").select(
            F.col("to").alias("host"), (damping * F.col("trust") * F.col("t")).alias("trust"), (damping * F.col("distrust") * F.col("d")).alias("distrust"),
            F.lit(0.0).alias("old_trust"), F.lit(0.0).alias("old_distrust"),
        )
        anew = start.select("host", *[(1 - damping) * F.col(c) for c in scores], F.lit(0.0), F.lit(0.0))
        old = state.select("host", F.lit(0.0), F.lit(0.0), *scores)
        sums = [F.sum(c).alias(c) for c in (*scores, "old_trust", "old_distrust")]
        summed = given.union(anew).union(old).groupBy("host").agg(*sums)
        reached = {c: F.when(F.col(c) > 0, F.greatest(c, F.lit(LEAST))).otherwise(0.0) for c in scores}
        before, after = state, pin(summed.withColumns(reached))
        state = after.select("host", *scores)
        if before is not start:
            discard(before)
        moved = [F.abs(F.col(c) - F.col(f"old_{c}")) > TOLERANCE * F.col(c) for c in scores]
        if after.filter(moved[0] | moved[1]).isEmpty():
            break
    discard(ways, start)
    return state


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    ratio: float = RATIO,
) -> DataFrame:
    """Per page: its id, host, path, rule, verdict and its host's trust and distrust.

    The longest fitting rule decides. Hosts are seeds by how many of their pages a rule
    allows and blocks. A page without a rule is blocked if its host's distrust is above
    zero and at least ``ratio`` times its trust, else allowed; so it is where nothing is
    known. Both are shares of all seed pages, so only their ratio is looked at, however
    small they are; a ratio short of ``ratio`` by MARGIN counts as equal, and so do two
    scores of LEAST. Scores are given with 12 significant digits.

    A null url, or one without ``://``, has an empty host and path and is allowed. Null
    html has no links. Repeated rows are judged one by one and each count as a page;
    other columns are ignored; an empty table gives an empty result.
    """
    named = pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    ruled = named.withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    count = lambda v: F.count(F.when(F.col("by.verdict") == v, 1)).cast("double")
    seeds = ruled.filter("host != ''").groupBy("host").agg(count(ALLOW).alias("trusted"), count(BLOCK).alias("blocked"))
    links = pin(host_links(pages, url_col, html_col))
    counted = pin(seeds)
    scores = propagate(counted, links)
    discard(counted, links)
    trust, distrust = F.col("trust"), F.col("distrust")
    blocked = F.coalesce((distrust > 0) & (distrust >= trust * (ratio * (1 - MARGIN))), F.lit(False))
    digits = lambda x: F.when(x.isNotNull(), F.format_string("%.11e", x)).cast("double")
    return ruled.join(scores, "host", "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("by.rule").alias("rule"),
        F.coalesce(F.col("by.verdict"), F.when(blocked, BLOCK).otherwise(ALLOW)).alias("verdict"),
        digits(trust).alias("trust"),
        digits(distrust).alias("distrust"),
    )
