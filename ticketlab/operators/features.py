"""Engineered columns, feature selection and the leakage guard."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlab import functions as fn
from ticketlab.schema import (
    CATEGORICAL_FEATURES,
    DEFAULT_FEATURES,
    FEATURE_GROUPS,
    LEAKED_COLUMNS,
    METADATA_COLUMNS,
    TARGET,
)


def with_stake_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("stake_ratio", fn.stake_ratio())


def with_odds_bucket(df: DataFrame, closed: str = "left") -> DataFrame:
    return df.withColumn("odds_bucket", fn.odds_bucket(closed=closed))


def engineer(df: DataFrame, closed: str = "left") -> DataFrame:
    """Both engineered columns, each only if its inputs exist."""
    if {"stake", "mean_stake_size"} <= set(df.columns):
        df = with_stake_ratio(df)
    if "selection_odds" in df.columns:
        df = with_odds_bucket(df, closed)
    return df


def with_sharp(df: DataFrame, column: str = TARGET) -> DataFrame:
    return df.withColumn("sharp", fn.sharp_flag(column))


def fill_categories(df: DataFrame, columns: Iterable[str] = CATEGORICAL_FEATURES) -> DataFrame:
    return df.withColumns({c: fn.fill_category(c) for c in columns if c in df.columns})


def labels(df: DataFrame, column: str = TARGET) -> DataFrame:
    """The cleaned label alone, so that the scan reads one column."""
    return df.select(fn.clean_label(column).alias(column))


def resolve_features(df: DataFrame, configured: Sequence[str] = DEFAULT_FEATURES) -> list[str]:
    """Configured features that exist, in configured order."""
    present = set(df.columns)
    return [c for c in configured if c in present]


def chosen(names: Iterable[str]) -> list[str]:
    """The named features in the order of the feature groups."""
    names = set(names)
    return [c for group in FEATURE_GROUPS.values() for c in group if c in names]


def check_leakage(features: Iterable[str]) -> None:
    """Raise if a feature reveals the outcome or is an identifier."""
    features = list(features)
    leaked = [c for c in features if c in LEAKED_COLUMNS]
    metadata = [c for c in features if c in METADATA_COLUMNS]
    if leaked or metadata:
        raise ValueError(f"not usable as features: leaked {leaked}, metadata {metadata}")


def numeric_features(df: DataFrame, columns: Iterable[str]) -> list[str]:
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    kinds = dict(df.dtypes)
    return [c for c in columns if kinds[c] in numeric or kinds[c].startswith("decimal")]


def describe_columns(df: DataFrame) -> DataFrame:
    """Column names and types."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")
