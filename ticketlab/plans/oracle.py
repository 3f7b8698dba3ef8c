"""DuckDB SQL equivalents of the catalog, over the raw star-schema tables.

Written against the tables alone, independently of the DataFrame code.
"""

from __future__ import annotations

from ticketlab.config import MISSING_CATEGORY
from ticketlab.operators import permutation
from ticketlab.plans.catalog import AUDIT_RULES, BANDS, EARLY, EXACT, PROFILE_NUMBERS
from ticketlab.schema import DEFAULT_FEATURES, DELAYED_COUNT, ENRICH_COLUMNS, REVIEW_COLUMNS, enrich_columns, inspect_columns

TICKETS = """
SELECT
  concat(CAST(l_orderkey AS STRING),'-',CAST(l_linenumber AS STRING),'-',CAST(l_partkey AS STRING),'-',CAST(l_suppkey AS STRING),'-',CAST(stake_cents AS STRING)) AS ticket_id,
  CAST(o_orderdate AS STRING) AS created_at,
  CASE WHEN l_returnflag <> 'N' THEN CAST(l_shipdate AS STRING) END AS accepted_at,
  CASE WHEN l_returnflag = 'N' THEN CAST(l_shipdate AS STRING) END AS rejected_at,
  CAST(o_custkey AS STRING) AS bettor_id,
  CAST(l_linenumber * 2 - 2 AS INT) AS pending_delay,
  c_nationkey AS client_id,
  CASE WHEN l_linenumber = 7 THEN CAST(stake_cents AS DOUBLE) / 200 ELSE CAST(0 AS DOUBLE) END AS cashout_stake,
  CASE WHEN l_returnflag = 'N' THEN o_orderpriority END AS reject_reason,
  CASE WHEN l_returnflag = 'N' THEN 'rejected' WHEN l_linestatus = 'O' THEN 'accepted'
       WHEN d < 5 THEN 'lost' ELSE 'won' END AS ticket_state,
  CAST(l_partkey AS INT) AS match_id,
  p_name AS home_team,
  concat('team-', CAST(l_suppkey AS STRING)) AS away_team,
  CAST(stake_cents AS DOUBLE) / 100 AS stake,
  CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_linestatus = 'O' THEN CAST(0 AS DOUBLE)
       ELSE CAST(stake_cents * (5 - d) AS DOUBLE) / 10000 END AS pnl,
  CAST(10 + l_quantity AS DOUBLE) / 10 AS selection_odds,
  p_type AS market_name,
  p_size AS market_type_id,
  concat('size=', CAST(p_size AS STRING)) AS market_params,
  p_brand AS market_selection,
  concat('client-', CAST(c_nationkey AS STRING)) AS client_name,
  CAST(t AS DOUBLE) / 2 AS bos,
  CAST(d AS DOUBLE) / 10 AS oaf,
  l_suppkey % 5 AS ots_risk_tier_id,
  CAST(ascii(c_mktsegment) AS BIGINT) AS sport_id,
  c_mktsegment AS sport,
  l_partkey % 50 AS tournament_id,
  concat('cup-', CAST(l_partkey % 50 AS STRING)) AS tournament,
  CASE WHEN l_suppkey % 10 <> 0 THEN CAST((t - d) * 100 + l_partkey % 97 AS DOUBLE) / 10000 END AS odds_after_10,
  CASE WHEN l_suppkey % 10 <> 0 THEN CAST((t - d) * 150 + l_partkey % 89 AS DOUBLE) / 10000 END AS odds_after_30,
  CASE WHEN l_suppkey % 10 <> 0 THEN CAST((t - d) * 200 + l_partkey % 83 AS DOUBLE) / 10000 END AS odds_after_90
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS stake_cents,
             CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t
      FROM lineitem) li
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN part ON l_partkey = p_partkey
"""

BETTOR_STATS = """
SELECT bettor_id, sport, market_name AS market_type, CAST(sum(CAST(pnl AS DECIMAL(18,4))) AS DOUBLE) AS pnl,
  CAST(sum(CAST(pnl AS DECIMAL(18,4))) AS DOUBLE) / nullif(CAST(sum(CAST(CASE WHEN ticket_state <> 'rejected' THEN stake END AS DECIMAL(18,4))) AS DOUBLE), 0) AS margin, CAST(sum(CAST(stake AS DECIMAL(18,4))) AS DOUBLE) AS stake,
  CAST(sum(CAST(odds_after_10 AS DECIMAL(18,4))) AS DOUBLE) / nullif(count(odds_after_10), 0) AS avg_odds_after_10, CAST(sum(CAST(odds_after_30 AS DECIMAL(18,4))) AS DOUBLE) / nullif(count(odds_after_30), 0) AS avg_odds_after_30, CAST(sum(CAST(odds_after_90 AS DECIMAL(18,4))) AS DOUBLE) / nullif(count(odds_after_90), 0) AS avg_odds_after_90,
  CAST(sum(CAST(CASE WHEN ticket_state = 'rejected' THEN stake ELSE 0 END AS DECIMAL(18,4))) AS DOUBLE) AS rejected_stake, CAST(sum(CAST(CASE WHEN ticket_state = 'rejected' THEN stake * odds_after_10 ELSE 0 END AS DECIMAL(18,6))) AS DOUBLE) AS rejected_pnl
FROM tickets GROUP BY bettor_id, sport, market_name
"""

REJECTED = """
SELECT bettor_id, sport, market_name AS market_type, reject_reason, CAST(sum(CAST(stake AS DECIMAL(18,4))) AS DOUBLE) AS rejected_stake, CAST(sum(CAST(CASE WHEN ticket_state = 'rejected' THEN stake * odds_after_10 ELSE 0 END AS DECIMAL(18,6))) AS DOUBLE) AS rejected_pnl,
  CAST(sum(CAST(odds_after_10 AS DECIMAL(18,4))) AS DOUBLE) / nullif(count(odds_after_10), 0) AS avg_rejected_odds_after_10, CAST(sum(CAST(odds_after_30 AS DECIMAL(18,4))) AS DOUBLE) / nullif(count(odds_after_30), 0) AS avg_rejected_odds_after_30, CAST(sum(CAST(odds_after_90 AS DECIMAL(18,4))) AS DOUBLE) / nullif(count(odds_after_90), 0) AS avg_rejected_odds_after_90
FROM tickets WHERE ticket_state = 'rejected' GROUP BY bettor_id, sport, market_name, reject_reason
"""

RISK_TIER = """
SELECT bettor_id, ots_risk_tier_id, CAST(sum(CAST(pnl AS DECIMAL(18,4))) AS DOUBLE) AS pnl, CAST(sum(CAST(stake AS DECIMAL(18,4))) AS DOUBLE) AS volume, CAST(sum(CAST(pnl AS DECIMAL(18,4))) AS DOUBLE) / nullif(CAST(sum(CAST(stake AS DECIMAL(18,4))) AS DOUBLE), 0) AS margin
FROM tickets GROUP BY bettor_id, ots_risk_tier_id
"""

STAKE_SIZE = """
SELECT bettor_id, CAST(sum(CAST(stake AS DECIMAL(18,4))) AS DOUBLE) / nullif(count(stake), 0) AS mean_stake_size FROM tickets GROUP BY bettor_id
"""

CTES = {
    "tickets": TICKETS,
    "bettor_stats": BETTOR_STATS,
    "rejected": REJECTED,
    "risk_tier": RISK_TIER,
    "stake_size": STAKE_SIZE,
}


def rnd(x: str, digits: int) -> str:
    """Half away from zero, scaled in binary."""
    p = f"CAST(1{'0' * digits} AS DOUBLE)"
    up = f"CAST(floor(({x}) * {p} + 0.5) AS BIGINT)"
    down = f"CAST(ceil(({x}) * {p} - 0.5) AS BIGINT)"
    return f"(CASE WHEN ({x}) >= 0 THEN {up} / {p} ELSE {down} / {p} END)"


def total(x: str, scale: int = 4) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE)"


def mean(x: str) -> str:
    return f"({total(x)} / nullif(count({x}), 0))"


def pct(part: str, whole: str) -> str:
    return f"(CAST({part} AS DOUBLE) * 100 / nullif(CAST({whole} AS DOUBLE), 0))"


CTES["rejected_rollup"] = f"""
SELECT bettor_id, sport, market_type, {total('rejected_stake')} AS total_rejected_stake,
  {total('rejected_pnl', 6)} AS total_rejected_pnl,
  count(DISTINCT reject_reason) AS n_reject_reasons,
  {rnd('avg(avg_rejected_odds_after_10)', 11)} AS avg_rejected_odds_after_10,
  {rnd('avg(avg_rejected_odds_after_30)', 11)} AS avg_rejected_odds_after_30,
  {rnd('avg(avg_rejected_odds_after_90)', 11)} AS avg_rejected_odds_after_90
FROM rejected GROUP BY bettor_id, sport, market_type
"""
CTES["risk_rollup"] = f"""
SELECT r.bettor_id, min(d.ots_risk_tier_id) AS dominant_risk_tier,
  {total('r.pnl')} AS risk_tier_total_pnl, {total('r.volume')} AS risk_tier_total_volume,
  {rnd('avg(r.margin)', 6)} AS risk_tier_avg_margin
FROM risk_tier r LEFT JOIN (
  SELECT bettor_id, min(ots_risk_tier_id) AS ots_risk_tier_id FROM (
    SELECT *, max(volume) OVER (PARTITION BY bettor_id) AS top FROM risk_tier
    WHERE ots_risk_tier_id IS NOT NULL AND volume IS NOT NULL) WHERE volume = top
  GROUP BY bettor_id) d ON r.bettor_id = d.bettor_id
GROUP BY r.bettor_id
"""
_KEY = "t.bettor_id = {0}.bettor_id AND t.sport = {0}.sport AND t.market_name = {0}.market_type"


def _from_side(side: str, *keys: str) -> str:
    return f"{side}.* EXCLUDE ({', '.join(keys)})"


CTES["history"] = f"""
SELECT bettor_id, sport, market_type,
  {", ".join(f"{c[3:]} AS {c}" for c in ENRICH_COLUMNS if c.startswith("bs_"))}
FROM bettor_stats
"""
CTES["merged"] = f"""
SELECT t.*, {_from_side("history", "bettor_id", "sport", "market_type")},
  {_from_side("rejected_rollup", "bettor_id", "sport", "market_type")},
  {_from_side("risk_rollup", "bettor_id")}, stake_size.mean_stake_size
FROM tickets t
LEFT JOIN stake_size USING (bettor_id)
LEFT JOIN risk_rollup USING (bettor_id)
LEFT JOIN history ON {_KEY.format("history")}
LEFT JOIN rejected_rollup ON {_KEY.format("rejected_rollup")}
"""
CTES["kept"] = """
SELECT * FROM tickets WHERE odds_after_10 IS NOT NULL AND isfinite(odds_after_10)
  AND bos >= 1.0 AND pending_delay > 0 AND pending_delay <= 9
"""


def bucket(op: str) -> str:
    o = "selection_odds"
    first = "WHEN selection_odds <= 0 THEN NULL " if op == "<=" else ""
    return (
        f"(CASE WHEN {o} IS NULL THEN NULL {first}WHEN {o} {op} 1.3 THEN 'heavy_fav' "
        f"WHEN {o} {op} 1.7 THEN 'slight_fav' WHEN {o} {op} 2.2 THEN 'even' "
        f"WHEN {o} {op} 3.5 THEN 'underdog' ELSE 'longshot' END)"
    )


def edge(op: str) -> str:
    # The bounds as doubles, since a bare 1.3 is a decimal.
    text = bucket(op)
    for bound in ("1.3", "1.7", "2.2", "3.5"):
        text = text.replace(f"{op} {bound}", f"{op} CAST('{bound}' AS DOUBLE)")
    return text


CTES["featured"] = f"""
SELECT k.*, ss.mean_stake_size,
  CASE WHEN ss.mean_stake_size > 0 THEN k.stake / ss.mean_stake_size END AS stake_ratio,
  {edge('<')} AS odds_bucket
FROM kept k LEFT JOIN stake_size ss ON k.bettor_id = ss.bettor_id
"""
CTES["positioned"] = """
SELECT *, row_number() OVER (ORDER BY created_at, ticket_id) - 1 AS pos, count(*) OVER () AS n FROM kept
"""


def split(n: str) -> str:
    cut = f"floor({n} * CAST('0.7' AS DOUBLE))", f"floor({n} * (CAST('0.7' AS DOUBLE) + CAST('0.15' AS DOUBLE)))"
    return f"CASE WHEN pos < {cut[0]} THEN 'train' WHEN pos < {cut[1]} THEN 'val' ELSE 'test' END"


CTES["split_kept"] = f"SELECT *, {split('n')} AS split FROM positioned"
CTES["split_source"] = f"SELECT *, {split('(SELECT count(*) FROM tickets)')} AS split FROM positioned"
CTES["scored"] = "SELECT *, odds_after_30 / 2 AS pred FROM kept WHERE odds_after_30 IS NOT NULL"
CTES["tiered"] = (
    "SELECT *, CASE WHEN pred < CAST('-0.02' AS DOUBLE) THEN 'PENDING' ELSE 'SKIP' END AS model_tier FROM scored"
)
CTES["delayed"] = "SELECT *, pred AS predicted_clv FROM tiered WHERE model_tier = 'PENDING'"
CTES["skip_yield"] = f"""
SELECT coalesce({total('CASE WHEN settled THEN coalesce(pnl, 0) END')}
  / nullif({total('CASE WHEN settled THEN stake END')}, 0), 0) AS skip_yield
FROM (SELECT *, model_tier = 'SKIP' AND ticket_state IN ('won', 'lost') AS settled FROM tiered)
"""
CTES["policy"] = """
SELECT tiered.*, coalesce(pnl, 0) AS factual_pnl,
  CASE WHEN model_tier = 'SKIP' AND ticket_state = 'rejected' THEN stake * skip_yield
       ELSE coalesce(pnl, 0) END AS counterfactual_pnl
FROM tiered, skip_yield
"""

DEPENDS = {
    "tickets": (),
    "bettor_stats": ("tickets",), "rejected": ("tickets",), "risk_tier": ("tickets",),
    "stake_size": ("tickets",), "rejected_rollup": ("rejected",), "risk_rollup": ("risk_tier",),
    "history": ("bettor_stats",),
    "merged": ("history", "rejected_rollup", "risk_rollup", "stake_size"),
    "kept": ("tickets",), "featured": ("kept", "stake_size"), "positioned": ("kept",),
    "split_kept": ("positioned",), "split_source": ("positioned",), "scored": ("kept",),
    "tiered": ("scored",), "delayed": ("tiered",), "skip_yield": ("tiered",),
    "policy": ("tiered", "skip_yield"),
}


def over(*needed: str, select: str, extra: dict[str, str] | None = None) -> str:
    """A statement with the common tables it needs, in order of dependence."""
    order: list[str] = []

    def visit(name: str) -> None:
        for d in DEPENDS[name]:
            visit(d)
        if name not in order:
            order.append(name)

    for name in needed:
        visit(name)
    tables = [f"{n} AS ({CTES[n].strip()})" for n in order]
    tables += [f"{n} AS ({text})" for n, text in (extra or {}).items()]
    return "WITH " + ",\n".join(tables) + "\n" + select


def share(grouped: str) -> str:
    return rnd(pct(grouped, f"sum({grouped}) OVER ()"), 1)


def states(table: str, column: str, where: str = "true", name: str = "n") -> str:
    return f"SELECT {column}, count(*) AS {name} FROM {table} WHERE {where} GROUP BY {column}"


def audit() -> str:
    parts = []
    negated = {">=": "<", ">": "<=", "<=": ">", "<": ">=", "==": "<>", "!=": "="}
    for rule in AUDIT_RULES:
        value = f"'{rule.value}'" if isinstance(rule.value, str) else repr(rule.value)
        head = f"SELECT '{rule.column}' AS \"column\", '{rule.op}' AS op, '{rule.value}' AS value"
        if rule.column == "absent":
            parts.append(
                f"{head}, 'missing column' AS status, CAST(NULL AS BIGINT) AS n_drop, CAST(NULL AS DOUBLE) AS pct_drop"
            )
            continue
        n = f"count(*) FILTER ({rule.column} {negated[rule.op]} {value} OR {rule.column} IS NULL)"
        parts.append(
            f"{head}, 'applied' AS status, {n} AS n_drop, {rnd(pct(n, 'count(*)'), 1)} AS pct_drop FROM tickets"
        )
    return " UNION ALL ".join(parts)


def bands() -> str:
    parts, lower = [], None
    n_valid = "count(*) FILTER (odds_after_10 IS NOT NULL AND isfinite(odds_after_10))"
    for name, upper in BANDS:
        tests = ["odds_after_10 IS NOT NULL"]
        tests += [] if lower is None else [f"odds_after_10 >= CAST('{lower}' AS DOUBLE)"]
        tests += [] if upper is None else [f"odds_after_10 < CAST('{upper}' AS DOUBLE)"]
        n = f"count(*) FILTER ({' AND '.join(tests)})"
        parts.append(f"SELECT '{name}' AS band, {n} AS n, {rnd(pct(n, n_valid), 1)} AS pct FROM tickets")
        lower = upper
    return " UNION ALL ".join(parts)


def banded(column: str) -> str:
    text = f"CASE WHEN {column} IS NULL THEN NULL"
    for name, upper in BANDS:
        text += f" ELSE '{name}'" if upper is None else f" WHEN {column} < CAST('{upper}' AS DOUBLE) THEN '{name}'"
    return text + " END"


def per_column(columns, template: str, table: str) -> str:
    return " UNION ALL ".join(template.format(c=c) + f" FROM {table}" for c in columns)


FEATURE_TYPES = {
    "mean_stake_size": "double", "reject_reason": "string", "accepted_at": "string",
    "selection_odds": "double", "stake": "double", "pending_delay": "int",
    "market_selection": "string", "sport": "string", "client_id": "int", "market_type_id": "int",
    "stake_ratio": "double", "odds_bucket": "string",
}


def coverage_of_features() -> str:
    p = rnd(pct("count({c})", "count(*)"), 6).replace("{c}", "{{c}}")
    parts = []
    for c in ("mean_stake_size", "reject_reason", "accepted_at", *DEFAULT_FEATURES):
        parts.append(
            f"SELECT '{c}' AS feature, {p.replace('{{c}}', c)} AS non_null_pct, "
            f"'{FEATURE_TYPES[c]}' AS dtype FROM featured"
        )
    return " UNION ALL ".join(parts)


def correlations(pairs, value: str, mirrored: bool) -> str:
    parts = []
    for a, b in pairs:
        ends = [(a, b), (b, a)] if mirrored and a != b else [(a, b)]
        parts += [
            f"SELECT '{x}' AS feature_1, '{y}' AS feature_2, {value.format(a=a, b=b)} AS correlation FROM featured"
            for x, y in ends
        ]
    return " UNION ALL ".join(parts)


ALL_PAIRS = [(a, b) for i, a in enumerate(PROFILE_NUMBERS) for b in PROFILE_NUMBERS[i:]]


def binned(n: int, names: tuple[str, str], spread: bool) -> str:
    probabilities = ", ".join(f"CAST({i} AS DOUBLE) / {n}" for i in range(n + 1))
    extra = {
        "edges": "SELECT DISTINCT round(q, 9) AS edge FROM "
        f"(SELECT unnest(quantile_cont(pred, [{probabilities}])) AS q FROM scored)",
        "bins": """SELECT edge AS lo, lead(edge) OVER (ORDER BY edge) AS hi,
  lag(edge) OVER (ORDER BY edge) IS NULL AS first, lead(edge, 2) OVER (ORDER BY edge) IS NULL AS last FROM edges""",
        "placed": """SELECT pred, odds_after_10, lo, hi FROM scored JOIN bins
  ON hi IS NOT NULL AND (first OR pred > lo) AND (last OR pred <= hi)""",
    }
    if spread:
        last = f"{rnd('stddev_samp(odds_after_10)', 6)} AS std_actual"
    else:
        last = f"{rnd('abs(avg(pred) - avg(odds_after_10))', 6)} AS abs_error"
    select = f"""SELECT lo AS bin_lo, hi AS bin_hi, count(odds_after_10) AS n,
  {rnd('avg(pred)', 6)} AS {names[0]}, {rnd('avg(odds_after_10)', 6)} AS {names[1]}, {last}
FROM placed GROUP BY lo, hi"""
    return over("scored", select=select, extra=extra)


BETWEEN = """CASE WHEN lo IS NULL THEN high WHEN hi IS NULL OR hi = lo THEN low
  ELSE low + ({x} - lo) / (hi - lo) * (high - low) END"""


def fitted(source: str) -> dict[str, str]:
    """Isotonic values: over all beginnings up to a level, the greatest of the least means up to any end from it."""
    return {
        "levels": f"""SELECT pred AS score, count(*) AS n, sum(CAST(round(odds_after_10 * 10000) AS BIGINT)) AS s FROM {source}
  WHERE odds_after_10 IS NOT NULL GROUP BY 1""",
        "ranked": """SELECT *, row_number() OVER w AS i, sum(s) OVER w AS up_s, sum(n) OVER w AS up_n
  FROM levels WINDOW w AS (ORDER BY score)""",
        "starts": """SELECT i + 1 AS lo, up_s AS s0, up_n AS n0 FROM ranked UNION ALL SELECT 1, 0, 0""",
        "floors": """SELECT i, lo, min(CAST(up_s - s0 AS DOUBLE) / CAST((up_n - n0) * 10000 AS DOUBLE)) OVER (PARTITION BY lo ORDER BY i DESC) AS m
  FROM starts JOIN ranked ON lo <= i""",
        "fitted": "SELECT i, max(m) AS value FROM floors GROUP BY i",
    }


def md5_order(seed: int) -> str:
    return f"ORDER BY md5(concat(ticket_id, '|{seed}')), ticket_id"


SHARP = "coalesce(odds_after_10 < CAST('-0.01' AS DOUBLE), false)"
FLAG = f"CASE WHEN {SHARP} THEN 'Sharp (< -0.01)' ELSE 'Not sharp' END"
REVIEW = "ticket_id, sport, ticket_state, stake, predicted_clv, odds_after_10"
ERROR = "(pred - odds_after_10)"
METRICS = f"""SELECT {rnd(f'avg(abs{ERROR})', 6)} AS mae, {rnd(f'sqrt(avg({ERROR} * {ERROR}))', 6)} AS rmse,
  {rnd(f'median(abs{ERROR})', 6)} AS median_ae, {rnd('avg(pred)', 6)} AS mean_pred,
  {rnd('avg(odds_after_10)', 6)} AS mean_actual, {rnd('stddev_pop(pred)', 6)} AS std_pred,
  {rnd('stddev_pop(odds_after_10)', 6)} AS std_actual, {rnd('corr(odds_after_10, pred)', 6)} AS correlation
FROM scored"""
MERGED_NAMES = enrich_columns(ENRICH_COLUMNS)
REPORT = binned(10, ("mean_predicted", "mean_actual"), spread=False)

def dealt(source: str, key: str, k: int) -> dict[str, str]:
    """The places that rows in order of their id get by a key, as ``place`` of the last table, ``dealt_<k>``."""
    turns = {f"dealt_{k}_0": f"""SELECT *, p // w AS l, p % w AS c, (n - 1) // w AS last, (n - 1) % w + 1 AS rest FROM (
  SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS w FROM (
    SELECT *, row_number() OVER (ORDER BY ticket_id) - 1 AS p, count(*) OVER () AS n FROM {source}))"""}
    for turn in range(permutation.ROUNDS):
        moved, by, length = ("l", "c", "CASE WHEN c < rest THEN last + 1 ELSE last END") if turn % 2 else (
            "c", "l", "CASE WHEN l < last THEN w ELSE rest END")
        draw = f"CAST('0x' || substr(md5('{key}|{turn}|' || {by}), 1, {permutation.DIGITS}) AS BIGINT)"
        turns[f"dealt_{k}_{turn + 1}"] = f"SELECT * REPLACE (({moved} + {draw}) % {length} AS {moved}) FROM dealt_{k}_{turn}"
    return turns | {f"dealt_{k}": f"SELECT *, l * w + c AS place FROM dealt_{k}_{permutation.ROUNDS}"}


def boosted(select: str, more: dict[str, str] | None = None) -> str:
    """Rounds of clipped mean steps per sport, from the mean label, as tables s0, s1, ..."""
    extra = {"s0": "SELECT ticket_id, sport, odds_after_10 AS y, avg(odds_after_10) OVER () AS s FROM kept"}
    delta, rate = (f"CAST({x} AS DOUBLE)" for x in (EXACT.huber_delta, EXACT.learning_rate))
    for k in range(EXACT.rounds):
        step = f"avg(greatest(least(y - s, {delta}), -{delta})) OVER (PARTITION BY sport)"
        extra[f"s{k + 1}"] = f"SELECT ticket_id, sport, y, s + {rate} * {step} AS s FROM s{k}"
    return over("kept", extra=extra | (more or {}), select=select)


def early(select: str, more: dict[str, str] | None = None) -> str:
    """Rounds of the best single split of two features, as tables e0, e1, ..., and the best round.

    A split is after a text or half way between neighbouring numbers of the training rows;
    a missing number is below all others.
    """
    delta, rate = (f"CAST({x} AS DOUBLE)" for x in (EARLY.huber_delta, EARLY.learning_rate))
    extra = {
        "e0": f"""SELECT ticket_id, split, coalesce(sport, '{MISSING_CATEGORY}') AS t,
  CASE WHEN market_type_id % 7 <> 0 THEN selection_odds ELSE CAST('-1e30' AS DOUBLE) END AS x, odds_after_10 AS y, (SELECT avg(odds_after_10) FROM split_kept WHERE split = 'train') AS s FROM split_kept""",
    }
    for k in range(1, EARLY.rounds + 1):
        before = f"e{k - 1}"
        extra[f"g{k}"] = f"""SELECT t, x, greatest(least(y - s, {delta}), -{delta}) AS g FROM {before} WHERE split = 'train'"""
        extra[f"c{k}"] = f"""SELECT 0 AS f, t AS cut_t, NULL::DOUBLE AS cut_x, sum(sum(g)) OVER w AS l, sum(count(*)) OVER w AS n
  FROM g{k} GROUP BY t WINDOW w AS (ORDER BY t)
UNION ALL SELECT 1, NULL, x / 2 + lead(x) OVER (ORDER BY x) / 2, sum(sum(g)) OVER w, sum(count(*)) OVER w
  FROM g{k} GROUP BY x WINDOW w AS (ORDER BY x)"""
        extra[f"b{k}"] = f"""SELECT f, cut_t, cut_x, l / c.n AS left_mean, (a.g - l) / (a.n - c.n) AS right_mean,
    l * l / c.n + (a.g - l) * (a.g - l) / (a.n - c.n) - a.g * a.g / a.n AS gain
  FROM c{k} c, (SELECT sum(g) AS g, count(*) AS n FROM g{k}) a
  WHERE c.n >= {EARLY.min_leaf} AND a.n - c.n >= {EARLY.min_leaf} ORDER BY gain DESC, f, cut_t, cut_x LIMIT 1"""
        extra[f"e{k}"] = f"""SELECT ticket_id, split, t, x, y, s + {rate} * CASE
    WHEN f = 0 AND t <= cut_t OR f = 1 AND x <= cut_x THEN left_mean ELSE right_mean END AS s FROM {before}, b{k}"""
    rounds = range(1, EARLY.rounds + 1)
    extra["errors"] = " UNION ALL ".join(
        f"SELECT {k} AS k, avg(abs(s - y)) AS mae, sqrt(avg((s - y) * (s - y))) AS rmse, count(*) AS n FROM e{k} WHERE split = 'val'"
        for k in rounds
    )
    extra["so_far"] = "SELECT a.k, (SELECT arg_min(b.k, (b.mae, b.k)) FROM errors b WHERE b.k <= a.k) AS best FROM errors a"
    extra["ended"] = f"""SELECT coalesce(min(k) FILTER (k - best >= {EARLY.patience}), {EARLY.rounds}) AS stop FROM so_far"""
    extra["best"] = "SELECT best FROM so_far, ended WHERE k = stop"
    extra["splits"] = " UNION ALL ".join(f"SELECT {k} AS k, f, gain FROM b{k}" for k in rounds)
    extra["gained"] = """SELECT v.feature, coalesce(sum(gain), 0) AS gain, count(gain) AS split_count
  FROM (VALUES (0, 'sport'), (1, 'selection_odds')) v(f, feature)
  LEFT JOIN (SELECT * FROM splits, best WHERE k <= best) u ON u.f = v.f GROUP BY v.feature"""
    scores = " UNION ALL ".join(f"SELECT {k} AS k, ticket_id, split, y, s FROM e{k}" for k in rounds)
    extra["final"] = f"SELECT * FROM ({scores}), best WHERE k = best"
    return over("split_kept", extra=extra | (more or {}), select=select)


def calibrated_early() -> dict[str, str]:
    """Calibrated scores of the test split, and the policy that delays below 0, as tables."""
    scored = CTES["tiered"].replace("-0.02", "0.0").replace("FROM scored", "FROM judged")
    return fitted("(SELECT s AS pred, y AS odds_after_10 FROM final WHERE split = 'val')") | {
        "points": "SELECT score, value FROM ranked r JOIN fitted f ON f.i = r.i",
        "below": """SELECT a.ticket_id, a.s, p.score AS lo, p.value AS low FROM (SELECT * FROM final WHERE split = 'test') a
  ASOF LEFT JOIN points p ON a.s >= p.score""",
        "around": "SELECT b.*, p.score AS hi, p.value AS high FROM below b ASOF LEFT JOIN points p ON b.s <= p.score",
        "judged": f"""SELECT t.*, {BETWEEN.format(x='s')} AS pred FROM split_kept t JOIN around USING (ticket_id)""",
        "early_tiered": scored,
        "early_yield": CTES["skip_yield"].replace("FROM tiered", "FROM early_tiered"),
        "early_policy": CTES["policy"].replace("tiered", "early_tiered").replace(", skip_yield", ", early_yield"),
        "judgement": """SELECT avg(abs(pred - odds_after_10)) AS mae, sqrt(avg((pred - odds_after_10) * (pred - odds_after_10))) AS rmse,
  count(*) AS n_total, count(*) FILTER (model_tier = 'SKIP') AS skip_count,
  count(*) FILTER (model_tier = 'SKIP' AND ticket_state = 'rejected') AS skip_rejected_count,
  sum(factual_pnl) AS factual_pnl, sum(counterfactual_pnl) AS counterfactual_pnl FROM early_policy""",
    }


def gains() -> str:
    """Squared error that the trees take away: between the sports' mean steps and the mean of all."""
    delta = f"CAST({EXACT.huber_delta} AS DOUBLE)"
    parts = " UNION ALL ".join(
        f"SELECT sport, greatest(least(y - s, {delta}), -{delta}) AS r, {k} AS k FROM s{k}" for k in range(EXACT.rounds)
    )
    return boosted(
        f"""SELECT 'sport' AS feature, {rnd('sum(n * (m - a) * (m - a))', 4)} AS gain,
  CAST(count(*) - {EXACT.rounds} AS BIGINT) AS split_count
FROM (SELECT k, sport, count(*) AS n, avg(r) AS m, sum(sum(r)) OVER (PARTITION BY k) / sum(count(*)) OVER (PARTITION BY k) AS a
      FROM steps GROUP BY k, sport)""",
        {"steps": parts},
    )


ORACLE: dict[str, str] = {
    "tickets": over("tickets", select="SELECT * FROM tickets"),
    "by_sport": over("tickets", select=f"""SELECT sport, count(*) AS n, count(DISTINCT bettor_id) AS n_bettors,
  {rnd(mean('odds_after_10'), 5)} AS avg_clv, {rnd(total('stake'), 2)} AS total_stake,
  {rnd(total('pnl'), 2)} AS total_pnl,
  {rnd(f"{total('pnl')} / nullif({total('stake')}, 0) * 100", 2)} AS margin_pct
FROM tickets GROUP BY sport"""),
    "bettor_stats": over("bettor_stats", select="SELECT * FROM bettor_stats"),
    "rejected_by_reason": over("rejected", select="SELECT * FROM rejected"),
    "risk_tier": over("risk_tier", select="SELECT * FROM risk_tier"),
    "stake_size": over("stake_size", select="SELECT * FROM stake_size"),
    "rejected_rollup": over("rejected_rollup", select="SELECT * FROM rejected_rollup"),
    "risk_rollup": over("risk_rollup", select="SELECT * FROM risk_rollup"),
    "enrich": over("merged", select="SELECT * FROM merged"),
    "enrich_by_key": over("merged", select="SELECT * FROM merged"),
    "overview": over("tickets", select=f"""SELECT count(*) AS n, count(DISTINCT bettor_id) AS n_bettors,
  count(DISTINCT sport) AS n_sports, count(DISTINCT match_id) AS n_matches,
  count(*) FILTER (ticket_state = 'won') AS n_won, count(*) FILTER (ticket_state = 'lost') AS n_lost,
  count(*) FILTER (ticket_state = 'rejected') AS n_rejected, {rnd(mean('odds_after_10'), 6)} AS avg_clv,
  count(odds_after_10) AS n_clv_nonnull, {total('stake')} AS total_stake, {total('pnl')} AS total_pnl,
  {rnd('median(odds_after_10)', 6)} AS med_clv FROM tickets"""),
    "shape": over("tickets", select="SELECT count(*) AS n_rows, CAST(31 AS BIGINT) AS n_columns FROM tickets"),
    "target_stats": over("tickets", select=f"""SELECT (SELECT count(*) FROM tickets) AS n_total,
  count(*) AS n_valid, {rnd(pct('count(*)', '(SELECT count(*) FROM tickets)'), 1)} AS pct_valid,
  {rnd(mean('odds_after_10'), 6)} AS mean_val, {rnd('stddev_samp(odds_after_10)', 6)} AS std_val,
  min(odds_after_10) AS min_val, max(odds_after_10) AS max_val, {rnd('median(odds_after_10)', 6)} AS median_val
FROM tickets WHERE odds_after_10 IS NOT NULL AND isfinite(odds_after_10)"""),
    "tier_summary": over("tickets", select=f"""SELECT tier, n, {share('n')} AS pct, avg_clv, avg_stake, total_pnl FROM (
  SELECT CASE WHEN odds_after_10 < CAST('-0.02' AS DOUBLE) THEN '1. PENDING' ELSE '2. SKIP' END AS tier,
    count(*) AS n, {rnd(mean('odds_after_10'), 5)} AS avg_clv, {rnd(mean('stake'), 2)} AS avg_stake,
    {rnd(total('pnl'), 2)} AS total_pnl
  FROM tickets WHERE odds_after_10 IS NOT NULL GROUP BY 1)"""),
    "state_counts": over("tickets", select=states("tickets", "ticket_state")),
    "state_distribution": over("tickets", select=f"""SELECT *, {share('n')} AS pct FROM (
  {states('tickets', 'ticket_state')})"""),
    "reject_reasons": over("tickets", select=f"""SELECT *, {share('n')} AS pct FROM (
  {states('tickets', 'reject_reason', "ticket_state = 'rejected' AND reject_reason IS NOT NULL")})"""),
    "clv_by_state": over("tickets", select=f"""SELECT ticket_state, count(odds_after_10) AS n,
  {rnd(mean('odds_after_10'), 5)} AS avg_clv, {rnd('median(odds_after_10)', 5)} AS med_clv,
  {rnd(mean('stake'), 2)} AS avg_stake, {rnd(total('pnl'), 2)} AS total_pnl
FROM tickets WHERE odds_after_10 IS NOT NULL GROUP BY ticket_state"""),
    "distinct_values": over("tickets", select="SELECT DISTINCT market_name FROM tickets WHERE market_name IS NOT NULL"),
    "browse": over("tickets", select="""SELECT ticket_id, sport, ticket_state, reject_reason, stake, odds_after_10
FROM tickets WHERE ticket_state = 'rejected' AND stake >= 100 ORDER BY ticket_id LIMIT 1000"""),
    "browse_count": over("tickets", select="""SELECT count(*) AS n FROM tickets WHERE ticket_state = 'rejected'
  AND sport = 'MACHINERY' AND reject_reason = '1-URGENT' AND stake >= 100"""),
    "valid_target": over("tickets", select="""SELECT ticket_id, odds_after_10 FROM tickets
WHERE odds_after_10 IS NOT NULL AND isfinite(odds_after_10)"""),
    "apply_rules": over("kept", select="SELECT ticket_id, bos, pending_delay, odds_after_10 FROM kept"),
    "rule_audit": over("tickets", select=audit()),
    "band_distribution": over("tickets", select=bands()),
    "null_counts": over("merged", select=per_column(
        inspect_columns(ENRICH_COLUMNS), "SELECT '{c}' AS feature, count(*) - count({c}) AS n_null", "merged")),
    "coverage": over("merged", select=" UNION ALL ".join(
        f"SELECT '{c}' AS feature, {rnd(pct(f'count({c})', 'count(*)'), 1)} AS coverage_pct FROM merged"
        for c in MERGED_NAMES)),
    "stake_ratio": over("featured", select="SELECT ticket_id, stake, mean_stake_size, stake_ratio FROM featured"),
    **{
        f"odds_bucket_{side}": over("tickets", select=f"""SELECT {edge(op)} AS odds_bucket, count(*) AS n,
  min(selection_odds) AS lowest, max(selection_odds) AS highest FROM tickets GROUP BY 1""")
        for side, op in (("left", "<"), ("right", "<="))
    },
    "sharp_flag": over("tickets", select=f"SELECT ticket_id, odds_after_10, {FLAG} AS sharp FROM tickets"),
    "fill_categories": over("tickets", select="""SELECT ticket_id, coalesce(reject_reason, '__missing__') AS reject_reason,
  coalesce(sport, '__missing__') AS sport FROM tickets"""),
    "clean_label": over("tickets", select="""SELECT coalesce(odds_after_10, 0) AS odds_after_10, count(*) AS n
FROM tickets GROUP BY 1"""),
    "resolve_features": over("featured", select=f"SELECT ticket_id, {', '.join(DEFAULT_FEATURES)} FROM featured"),
    "split_kept": over("split_kept", select="SELECT ticket_id, split FROM split_kept"),
    "split_source": over("split_source", select=states("split_source", "split")),
    "split_counts": over("split_kept", select=states("split_kept", "split")),
    "label_stats": over("split_kept", select=f"""SELECT split, count(*) AS n, {rnd(mean('odds_after_10'), 6)} AS mean_label,
  {rnd('stddev_pop(odds_after_10)', 6)} AS std_label FROM split_kept GROUP BY split"""),
    "cap_rows": over("positioned", select="SELECT ticket_id, created_at FROM positioned WHERE pos < 5000"),
    "classify": over("tiered", select="SELECT ticket_id, pred, model_tier FROM tiered"),
    "classify_bands": over("scored", select=f"SELECT {banded('pred')} AS model_tier, count(*) AS n FROM scored GROUP BY 1"),
    "skip_yield": over("skip_yield", select="SELECT * FROM skip_yield"),
    "policy": over("policy", select="SELECT ticket_id, ticket_state, model_tier, factual_pnl, counterfactual_pnl FROM policy"),
    "policy_summary": over("policy", select=f"""SELECT n_total, skip_count, skip_count / n_total AS skip_rate,
  pending_count, pending_count / n_total AS pending_rate, skip_rejected_count, {rnd('f', 2)} AS factual_pnl,
  {rnd('c', 2)} AS counterfactual_pnl, {rnd('c - f', 2)} AS pnl_delta,
  {rnd('coalesce((c - f) / nullif(abs(f), 0) * 100, 0)', 4)} AS pnl_delta_pct FROM (
  SELECT count(*) AS n_total, count(*) FILTER (model_tier = 'SKIP') AS skip_count,
    count(*) FILTER (model_tier = 'PENDING') AS pending_count,
    count(*) FILTER (model_tier = 'SKIP' AND ticket_state = 'rejected') AS skip_rejected_count,
    sum(factual_pnl) AS f, sum(counterfactual_pnl) AS c FROM policy)"""),
    "tier_share": over("tiered", select=f"SELECT *, {share('n')} AS pct FROM ({states('tiered', 'model_tier')})"),
    "regression_metrics": over("scored", select=METRICS),
    "calibration_report": REPORT,
    "calibration_bins": binned(20, ("mean_pred", "mean_actual"), spread=True),
    "isotonic": over("scored", extra=fitted("scored"), select=f"""SELECT r.score, r.n, {rnd('value', 6)} AS calibrated
FROM ranked r JOIN fitted f ON f.i = r.i"""),
    "isotonic_unseen": over("scored", extra=fitted("(SELECT * FROM scored WHERE pred > -0.05 AND pred < 0.05)") | {
        "points": "SELECT score, value FROM ranked r JOIN fitted f ON f.i = r.i",
        "asked": "SELECT ticket_id, pred * CAST(1.5 AS DOUBLE) + CAST('0.00007' AS DOUBLE) AS score FROM scored",
        "below": """SELECT a.ticket_id, a.score, p.score AS lo, p.value AS low FROM asked a ASOF LEFT JOIN points p
  ON a.score >= p.score""",
        "around": """SELECT b.*, p.score AS hi, p.value AS high FROM below b ASOF LEFT JOIN points p ON b.score <= p.score""",
    }, select=f"""SELECT ticket_id, {rnd(BETWEEN.format(x='score'), 6)} AS calibrated FROM around"""),
    "worst_50": over("delayed", select=f"SELECT {REVIEW} FROM delayed ORDER BY predicted_clv, ticket_id LIMIT 50"),
    "review_sample": over("delayed", extra={
        "worst": f"SELECT {REVIEW} FROM delayed ORDER BY predicted_clv, ticket_id LIMIT 50",
        "other": f"""SELECT {REVIEW} FROM delayed WHERE ticket_id NOT IN (SELECT ticket_id FROM worst)
  {md5_order(42)} LIMIT 50""",
    }, select="SELECT * FROM worst UNION ALL SELECT * FROM other"),
    "review_points": over("delayed", select=f"""SELECT ticket_id, predicted_clv, odds_after_10, sport, market_name,
  stake, ticket_state, {FLAG} AS sharp FROM delayed"""),
    "review_detail": over("delayed", select=f"""SELECT {', '.join(c for c in REVIEW_COLUMNS if not c.startswith('bs_'))}
FROM delayed"""),
    "review_summary": over("delayed", select=f"""SELECT count(*) AS n, count(*) FILTER ({SHARP}) AS n_sharp,
  {rnd(pct(f'count(*) FILTER ({SHARP})', 'count(*)'), 1)} AS pct_sharp,
  count(*) FILTER (ticket_state = 'rejected') AS n_rejected,
  {rnd(pct("count(*) FILTER (ticket_state = 'rejected')", 'count(*)'), 1)} AS pct_rejected,
  {rnd('avg(predicted_clv)', 6)} AS avg_predicted_clv FROM delayed"""),
    "review_by_sport": over("delayed", select=f"""SELECT sport, count(odds_after_10) AS "count",
  {rnd(pct(f'count(*) FILTER ({SHARP})', 'count(*)'), 6)} AS pct_sharp, {rnd(mean('odds_after_10'), 6)} AS mean_clv
FROM delayed WHERE sport IS NOT NULL GROUP BY sport"""),
    "review_states": over("delayed", select="""SELECT ticket_state AS state, count(*) AS "count" FROM delayed
WHERE ticket_state IS NOT NULL GROUP BY 1"""),
    "histogram": over("delayed", extra={
        "span": "SELECT min(odds_after_10) AS lo, (max(odds_after_10) - min(odds_after_10)) / 25 AS width FROM delayed",
    }, select=f"""SELECT bin, sharp, {rnd('lo + bin * width', 6)} AS bin_lo, n FROM (
  SELECT CAST(least(floor((odds_after_10 - lo) / width), 24) AS BIGINT) AS bin, {FLAG} AS sharp, count(*) AS n
  FROM delayed, span WHERE odds_after_10 IS NOT NULL GROUP BY 1, 2), span"""),
    "scatter_points": over("scored", select=f"""SELECT ticket_id, odds_after_10, pred FROM scored
{md5_order(42)} LIMIT 10000"""),
    "sample_n": over("kept", select=f"SELECT ticket_id, odds_after_10 FROM kept {md5_order(7)} LIMIT 2000"),
    "feature_coverage": over("featured", select=coverage_of_features()),
    "corr_with_target": over("featured", select=" UNION ALL ".join(
        f"SELECT '{c}' AS feature, {rnd(f'abs(corr({c}, odds_after_10))', 6)} AS abs_correlation FROM featured"
        for c in PROFILE_NUMBERS)),
    "corr_matrix": over("featured", select=correlations(ALL_PAIRS, rnd("corr({a}, {b})", 6), True)),
    "high_corr_pairs": over("featured", select=f"""SELECT feature_1, feature_2, {rnd('correlation', 3)} AS correlation
FROM ({correlations([p for p in ALL_PAIRS if p[0] != p[1]], 'corr({a}, {b})', False)}) WHERE abs(correlation) > 0.4"""),
    "cumulative_share": over("tickets", extra={
        "sports": f"SELECT sport, {total('stake')} AS stake FROM tickets GROUP BY sport",
    }, select=f"""SELECT sport, stake, {rnd('stake / sum(stake) OVER () * 100', 6)} AS stake_pct,
  {rnd('sum(stake) OVER (ORDER BY stake DESC, sport ROWS UNBOUNDED PRECEDING) / sum(stake) OVER () * 100', 6)}
    AS cumulative_stake_pct FROM sports"""),
    "permute": over("kept", extra=dealt("kept", "7|stake", 1) | dealt("kept", "7|sport", 2), select="""SELECT here.ticket_id, there.stake, other.sport
FROM dealt_1 here JOIN dealt_1 there ON here.p = there.place JOIN dealt_2 other ON here.p = other.place"""),
    "train_exact": boosted(f"SELECT ticket_id, {rnd('s', 9)} AS raw_score FROM s{EXACT.rounds}"),
    "reload_score": boosted(f"SELECT ticket_id, {rnd('s', 9)} AS raw_score FROM s{EXACT.rounds}"),
    "importance_exact": gains(),
    "train_early": early(f"SELECT ticket_id, split, {rnd('s', 8)} AS raw_score, best AS best_iteration FROM final"),
    "calibrate_early": early(f"""SELECT {rnd('avg(abs(s - y))', 8)} AS mae_before, {rnd('avg(abs(value - y))', 8)} AS mae_after
FROM final JOIN (SELECT score, value FROM ranked r JOIN fitted f ON f.i = r.i) ON score = s WHERE split = 'val'""",
        fitted("(SELECT s AS pred, y AS odds_after_10 FROM final WHERE split = 'val')")),
    "evaluate_early": early(f"""SELECT {rnd('mae', 6)} AS mae, {rnd('rmse', 6)} AS rmse, n_total, skip_count, skip_rejected_count,
  {rnd('factual_pnl', 2)} AS factual_pnl, {rnd('counterfactual_pnl', 2)} AS counterfactual_pnl FROM judgement""", calibrated_early()),
    "results_early": early(f"""SELECT {rnd('e.mae', 6)} AS val_mae, CAST(best AS BIGINT) AS best_iteration,
  (SELECT count(*) FROM split_kept WHERE split = 'train') AS n_train, e.n AS n_val, n_total - skip_count AS {DELAYED_COUNT},
  skip_count, {rnd('j.mae', 6)} AS mae, {rnd('skip_count / n_total', 6)} AS skip_rate
FROM judgement j, best JOIN errors e ON k = best""", calibrated_early()),
    "importance_early": early(f"SELECT feature, {rnd('gain', 6)} AS gain, split_count FROM gained"),
    "metrics_early": early(f"""SELECT {rnd('mae', 8)} AS val_mae, {rnd('rmse', 8)} AS val_rmse, CAST(best AS BIGINT) AS best_iteration,
  CAST(2 AS BIGINT) AS n_features, (SELECT count(*) FROM split_kept WHERE split = 'train') AS n_train, n AS n_val,
  (SELECT feature FROM gained ORDER BY gain DESC, feature LIMIT 1) AS leading FROM errors, best WHERE k = best"""),
    "permutation_exact": boosted(
        f"SELECT 'sport' AS feature, {rnd('avg(abs(there.s - here.y)) - avg(abs(here.s - here.y))', 9)} AS mae_increase "
        "FROM dealt_1 here JOIN dealt_1 there ON here.p = there.place",
        dealt(f"s{EXACT.rounds}", "42|_cat_sport", 1),
    ),
    "csv_head": over("tickets", select="""SELECT CAST(0 AS BIGINT) AS n_wrong, CAST(0 AS BIGINT) AS n_twice, true AS half
FROM (SELECT count(*) FROM tickets)"""),
    "csv_default": over("tickets", select="""SELECT * REPLACE (coalesce(accepted_at, '') AS accepted_at,
  coalesce(rejected_at, '') AS rejected_at, coalesce(reject_reason, '') AS reject_reason) FROM tickets"""),
    "encode": over("kept", select=f"""SELECT ticket_id,
  CAST(dense_rank() OVER (ORDER BY coalesce(sport, '{MISSING_CATEGORY}')) - 1 AS DOUBLE) AS code FROM kept"""),
    "csv_roundtrip": over("tickets", select="SELECT * FROM tickets"),
    "parquet_roundtrip": over("tickets", select="SELECT * FROM tickets"),
    "convert": over("tickets", select="SELECT count(*) AS n_rows FROM tickets"),
    "splits_roundtrip": over("split_kept", select="""SELECT ticket_id, odds_after_10, split FROM split_kept
WHERE split = 'val'"""),
    "publish_again": over("kept", select="SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_changed FROM kept"),
    "publish": over("kept", select="SELECT ticket_id, stake FROM kept"),
    "report_roundtrip": REPORT,
    "metrics_roundtrip": over("scored", select=METRICS),
    "enrich_job": over("merged", select="SELECT * FROM merged"),
}
