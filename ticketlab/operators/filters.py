"""Row rules, their audit, and the target's validity."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlab import functions as fn
from ticketlab.config import DEFAULT_RULES, Rule
from ticketlab.schema import TARGET

_COMPARE = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}


def valid_target(df: DataFrame, column: str = TARGET, finite: bool = True) -> DataFrame:
    """Rows with a target; ``finite`` also drops NaN and infinities."""
    return df.filter(fn.is_finite(column) if finite else F.col(column).isNotNull())


def keep(df: DataFrame, rule: Rule) -> Column:
    """The rule as a predicate; NaN satisfies only ``!=``."""
    c = F.col(rule.column)
    condition = _COMPARE[rule.op](c, F.lit(rule.value))
    floating = df.schema[rule.column].dataType.typeName() in ("double", "float")
    return condition & ~F.isnan(c) if floating and rule.op in (">", ">=") else condition


def apply_rules(df: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """Rows that satisfy every rule; a null drops the row, an unknown column is skipped."""
    present = [keep(df, r) for r in rules if r.column in df.columns]
    return df.filter(reduce(lambda a, b: a & b, present)) if present else df


def rule_audit(df: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """Rows each rule would drop on its own, from one pass over the rules' columns."""
    rules = list(rules)
    n = F.count("*")
    entries = []
    for rule in rules:
        known = rule.column in df.columns
        if known:
            dropped = F.count_if(~F.coalesce(keep(df, rule), F.lit(False)))
        else:
            dropped = F.lit(None).cast("bigint")
        entries.append(
            F.struct(
                F.lit(rule.column).alias("column"),
                F.lit(rule.op).alias("op"),
                F.lit(str(rule.value)).alias("value"),
                F.lit("applied" if known else "missing column").alias("status"),
                dropped.alias("n_drop"),
                fn.percent(dropped, n).alias("pct_drop"),
            )
        )
    return df.agg(F.array(*entries).alias("audit")).select(F.inline("audit"))
