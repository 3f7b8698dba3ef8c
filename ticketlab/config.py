"""Settings as plain dataclasses: rules, thresholds, split fractions, model parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from ticketlab.schema import DELAY


COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class Rule:
    """What a column has to be for a row to stay: a comparison, and what it is compared with."""

    column: str
    op: str
    value: float | int | str

    def __post_init__(self) -> None:
        if self.op not in COMPARISONS:
            raise ValueError(f"unknown operator {self.op!r} for {self.column}")


# --- fixed values: results depend on them ------------------------------------------------
DEFAULT_RULES = (
    Rule("bos", ">=", 1.0),
    Rule(DELAY, ">", 0),
    Rule(DELAY, "<=", 9),
)
DELAY_THRESHOLD = -0.02
SHARP_THRESHOLD = -0.01
ODDS_EDGES = (1.3, 1.7, 2.2, 3.5)
ODDS_LABELS = ("heavy_fav", "slight_fav", "even", "underdog", "longshot")
MISSING_CATEGORY = "__missing__"
HIGH_CORRELATION = 0.8
# -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SplitFractions:
    """Shares of the rows in time order; the rest is the test split."""

    train: float = 0.70
    val: float = 0.15


@dataclass(frozen=True)
class BoostParams:
    """Huber boosting; trees grow by leaf, without a limit of depth unless one is set."""

    rounds: int = 1000
    learning_rate: float = 0.05
    patience: int = 50
    max_leaves: int = 63
    max_depth: int | None = None
    min_leaf: int = 100
    feature_fraction: float = 0.8
    bagging_fraction: float = 0.8
    bagging_every: int = 5
    huber_delta: float = 0.9
    max_bins: int = 255
    seed: int = 42
    checkpoint_every: int = 20


@dataclass(frozen=True)
class Settings:
    rules: tuple[Rule, ...] = DEFAULT_RULES
    delay_below: float = DELAY_THRESHOLD
    split: SplitFractions = field(default_factory=SplitFractions)
    boost: BoostParams = field(default_factory=BoostParams)
    max_train_rows: int | None = None
    features: tuple[str, ...] = ()
