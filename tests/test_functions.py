"""Null, NaN, edge and zero-division rules of the column expressions."""


import pytest
from pyspark.sql import functions as F

from ticketlab import functions as fn
from ticketlab.config import Rule
from ticketlab.operators import features, filters

INF, NAN = float("inf"), float("nan")


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def apply(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


ODDS = [-1.0, 0.0, 1.0, 1.3, 1.31, 1.7, 2.2, 3.5, 99.0, INF, NAN, None]


def test_left_closed_bucket(spark):
    assert apply(column(spark, ODDS), fn.odds_bucket("x")) == [
        "heavy_fav", "heavy_fav", "heavy_fav", "slight_fav", "slight_fav", "even", "underdog",
        "longshot", "longshot", "longshot", "longshot", None,
    ]


def test_right_closed_bucket(spark):
    assert apply(column(spark, ODDS), fn.odds_bucket("x", "right")) == [
        None, None, "heavy_fav", "heavy_fav", "slight_fav", "slight_fav", "even", "underdog",
        "longshot", "longshot", None, None,
    ]


def test_stake_ratio_guard(spark):
    df = column(spark, [None, 0.0, -2.0, NAN, 4.0]).withColumn("stake", F.lit(10.0))
    assert apply(df, fn.stake_ratio("stake", "x")) == [None, None, None, None, 2.5]


def test_finite_and_clean_label(spark):
    df = column(spark, [None, NAN, INF, -INF, 0.5])
    assert apply(df, fn.is_finite("x")) == [False, False, False, False, True]
    assert apply(df, fn.clean_label("x")) == [0.0, 0.0, 0.0, 0.0, 0.5]


def test_tier_and_sharp(spark):
    df = column(spark, [None, NAN, -0.02, -0.0200001, -0.01, -0.011, 0.0])
    assert apply(df, fn.tier("x")) == ["SKIP", "SKIP", "SKIP", "PENDING", "SKIP", "SKIP", "SKIP"]
    assert apply(df, fn.is_sharp("x")) == [False, False, True, True, False, True, False]


def test_bands(spark):
    bands = [("A", -1.0), ("B", 1.0), ("C", None)]
    df = column(spark, [None, -2.0, -1.0, 0.0, 1.0, INF])
    assert apply(df, fn.band("x", bands)) == [None, "A", "B", "B", "C", "C"]


def test_round_half_away(spark):
    df = column(spark, [0.5, -0.5, 2.5, -2.5, 0.4, None])
    assert apply(df, fn.round_half_away("x", 0)) == [1.0, -1.0, 3.0, -3.0, 0.0, None]


def test_exact_total_does_not_depend_on_order(spark):
    values = [0.1] * 1000 + [1e9] + [-0.1] * 1000 + [-1e9]
    df = column(spark, values).repartition(7)
    assert df.agg(fn.total("x", 4)).first()[0] == 0.0
    assert df.agg(fn.total("x")).first()[0] == pytest.approx(0.0, abs=1e-4)


def test_exact_total_refuses_what_does_not_fit(spark):
    with pytest.raises(Exception, match="does not fit"):
        column(spark, [INF]).agg(fn.total("x", 4)).collect()


def test_ratio_by_zero_is_null(spark):
    df = column(spark, [0.0, 2.0, None])
    assert apply(df, fn.ratio(F.lit(1.0), F.col("x"))) == [None, 0.5, None]


def test_rules_drop_nulls_and_skip_missing_columns(spark):
    df = spark.createDataFrame(
        [(1, None, 1), (2, 1.0, 1), (3, 0.9, 5), (4, NAN, 5), (5, 2.0, 0), (6, 2.0, 9), (7, 2.0, 10), (8, 3.0, None)],
        "i int, bos double, pending_delay int",
    )
    assert [r["i"] for r in filters.apply_rules(df).orderBy("i").collect()] == [2, 6]
    extra = [Rule("bos", ">=", 1.0), Rule("nowhere", "==", 1)]
    assert filters.apply_rules(df, extra).count() == 5
    audit = {(r["column"], r["op"]): r for r in filters.rule_audit(df, extra).collect()}
    assert audit["bos", ">="]["n_drop"] == 3 and audit["bos", ">="]["pct_drop"] == 37.5
    assert audit["nowhere", "=="]["status"] == "missing column"


@pytest.mark.parametrize("op,kept", [("==", [2]), ("!=", [1, 3, 4]), ("<", [1]), ("<=", [1, 2]), (">", [3]), (">=", [2, 3])])
def test_rule_operators(spark, op, kept):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, NAN), (5, None)], "i int, x double")
    rows = filters.apply_rules(df, [Rule("x", op, 2.0)]).orderBy("i").collect()
    assert [r["i"] for r in rows] == kept


def test_rule_on_text_and_bad_operator(spark):
    df = spark.createDataFrame([("a",), ("b",)], "x string")
    assert filters.apply_rules(df, [Rule("x", "==", "a")]).count() == 1
    with pytest.raises(ValueError):
        filters.apply_rules(df, [Rule("x", "~", "a")])


def test_valid_target_modes(spark):
    df = column(spark, [None, NAN, INF, 1.0])
    assert filters.valid_target(df, "x").count() == 1
    assert filters.valid_target(df, "x", finite=False).count() == 3


def test_leakage_guard_and_feature_list(spark):
    df = spark.createDataFrame([(1.0, "a", 2)], "stake double, sport string, z int")
    assert features.resolve_features(df, ["sport", "nope", "stake"]) == ["sport", "stake"]
    features.check_leakage(["stake", "sport"])
    with pytest.raises(ValueError, match="pnl"):
        features.check_leakage(["stake", "pnl"])
    with pytest.raises(ValueError, match="bettor_id"):
        features.check_leakage(["bettor_id"])


def test_describe_fill_and_clean(spark):
    df = spark.createDataFrame([(None, NAN), ("x", 1.0)], "sport string, v double")
    listed = [tuple(r) for r in features.describe_columns(df).collect()]
    assert listed == [("sport", "string"), ("v", "double")]
    filled = features.fill_categories(df).select("sport").collect()
    assert sorted(r[0] for r in filled) == ["__missing__", "x"]
    assert fn.clean_numbers(df).filter("v IS NULL").count() == 1


def test_engineer_only_what_it_can(spark):
    df = spark.createDataFrame([(2.0,)], "selection_odds double")
    assert features.engineer(df).columns == ["selection_odds", "odds_bucket"]
