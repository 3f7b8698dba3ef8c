"""Explicit schemas of the five input tables and the fixed column lists."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

# --- fixed values: column names, types and order of the input files ----------------------
DELAY = "pending_delay"
DELAYED = "PENDING"
DELAYED_COUNT, DELAYED_RATE = "pending_count", "pending_rate"
TICKETS_DDL = """
    ticket_id string, created_at string, accepted_at string, rejected_at string,
    bettor_id string, pending_delay int, client_id int, cashout_stake double,
    reject_reason string, ticket_state string, match_id int, home_team string,
    away_team string, stake double, pnl double, selection_odds double,
    market_name string, market_type_id int, market_params string,
    market_selection string, client_name string, bos double, oaf double,
    ots_risk_tier_id bigint, sport_id bigint, sport string, tournament_id bigint,
    tournament string, odds_after_10 double, odds_after_30 double, odds_after_90 double
"""
BETTOR_STATS_DDL = """
    bettor_id string, sport string, market_type string, pnl double, margin double,
    stake double, avg_odds_after_10 double, avg_odds_after_30 double,
    avg_odds_after_90 double, rejected_stake double, rejected_pnl double
"""
REJECTED_DDL = """
    bettor_id string, sport string, market_type string, reject_reason string,
    rejected_stake double, rejected_pnl double, avg_rejected_odds_after_10 double,
    avg_rejected_odds_after_30 double, avg_rejected_odds_after_90 double
"""
RISK_TIER_DDL = """
    bettor_id string, ots_risk_tier_id bigint, pnl double, volume double, margin double
"""
STAKE_SIZE_DDL = "bettor_id string, mean_stake_size double"

TARGET = "odds_after_10"

LEAKED_COLUMNS = (
    "odds_after_10", "odds_after_30", "odds_after_90", "ticket_state", "pnl",
    "reject_reason", "accepted_at", "rejected_at",
)
METADATA_COLUMNS = (
    "ticket_id", "bettor_id", "created_at", "home_team", "away_team", "tournament",
    "client_name", "market_params",
)
CATEGORICAL_FEATURES = ("market_name", "market_selection", "sport", "odds_bucket")

DEFAULT_FEATURES = (
    "selection_odds", "stake", DELAY, "market_selection", "sport", "client_id",
    "market_type_id", "stake_ratio", "odds_bucket",
)
ENRICH_COLUMNS = (
    "bs_pnl", "bs_margin", "bs_stake", "bs_avg_odds_after_10", "bs_avg_odds_after_30",
    "bs_avg_odds_after_90", "bs_rejected_stake", "bs_rejected_pnl",
    "total_rejected_stake", "total_rejected_pnl", "n_reject_reasons",
    "avg_rejected_odds_after_10", "avg_rejected_odds_after_30",
    "avg_rejected_odds_after_90", "dominant_risk_tier", "risk_tier_total_pnl",
    "risk_tier_total_volume", "risk_tier_avg_margin", "mean_stake_size",
)
ENRICH_PREFIXES = ("bs_", "total_", "avg_rejected", "risk_tier", "dominant_")
ENRICH_NAMES = ("mean_stake_size", "n_reject_reasons")
INSPECT_PREFIXES = ("bs_", "total_", "avg_rejected", "risk_tier")
INSPECT_NAMES = ("mean_stake_size",)
FEATURE_GROUPS = {
    "Aggregate bettor-level": (
        "bs_avg_odds_after_10", "avg_rejected_odds_after_10", "bs_avg_odds_after_30",
        "avg_rejected_odds_after_30", "bs_avg_odds_after_90",
        "avg_rejected_odds_after_90", "bs_stake", "bs_pnl", "bs_margin",
        "bs_rejected_stake", "bs_rejected_pnl", "total_rejected_stake",
        "total_rejected_pnl", "risk_tier_total_pnl", "risk_tier_avg_margin",
        "risk_tier_total_volume", "mean_stake_size", "n_reject_reasons",
        "dominant_risk_tier",
    ),
    "Ticket-level": (
        "selection_odds", "stake", DELAY, "market_name", "market_selection",
        "sport", "sport_id", "tournament_id", "client_id", "ots_risk_tier_id",
        "market_type_id", "bos",
    ),
    "Engineered": ("stake_ratio", "odds_bucket"),
}
REVIEW_COLUMNS = (
    "sport", "market_name", "selection_odds", "stake", DELAY, "predicted_clv",
    "odds_after_10", "odds_after_30", "ticket_state", "bs_avg_odds_after_10", "bettor_id",
)
# -----------------------------------------------------------------------------------------

_TYPES = {"string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType()}


def _struct(ddl: str) -> StructType:
    # StructType.fromDDL needs a running session, which an import must not.
    out = StructType()
    for field in ddl.split(","):
        name, kind = field.split()
        out = out.add(name, _TYPES[kind])
    return out


TICKETS = _struct(TICKETS_DDL)
AGGREGATES = {
    "bettor_stats": _struct(BETTOR_STATS_DDL),
    "rejected": _struct(REJECTED_DDL),
    "risk_tier": _struct(RISK_TIER_DDL),
    "stake_size": _struct(STAKE_SIZE_DDL),
}


def enrich_columns(columns) -> list[str]:
    """Columns of a merged table that come from the four aggregates, by name."""
    return [c for c in columns if c.startswith(ENRICH_PREFIXES) or c in ENRICH_NAMES]


def inspect_columns(columns) -> list[str]:
    """The ones among them that the inspection counts nulls of."""
    return [c for c in columns if c.startswith(INSPECT_PREFIXES) or c in INSPECT_NAMES]
