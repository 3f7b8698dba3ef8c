"""Bijections of positions and columns dealt by them."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ticketlab.operators import permutation


def plain(p, n, key):
    """The place of one position, number by number."""
    width = next(w for w in range(1, n + 1) if w * w >= n)
    lines = [list(range(s, min(s + width, n))) for s in range(0, n, width)]
    line, column = divmod(p, width)
    for turn in range(permutation.ROUNDS):
        by = line if turn % 2 == 0 else column
        draw = int(hashlib.md5(f"{key}|{turn}|{by}".encode()).hexdigest()[: permutation.DIGITS], 16)
        if turn % 2 == 0:
            column = (column + draw) % len(lines[line])
        else:
            line = (line + draw) % sum(len(x) > column for x in lines)
    return line * width + column


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 12, 16, 17, 90, 1000])
def test_every_place_is_given_once(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "position").withColumn("key", F.lit("5|x"))
    got = dict((r.position, r.to) for r in permutation.deal(rows, n).collect())
    assert got == {p: plain(p, n, "5|x") for p in range(n)}
    assert sorted(got.values()) == list(range(n))


def test_places_look_drawn(spark):
    n = 10_000
    keys = F.explode(F.array(F.lit("1|a"), F.lit("1|b"), F.lit("2|a")))
    rows = spark.range(n).select(F.col("id").alias("position"), keys.alias("key"))
    found = permutation.deal(rows, n).groupBy("key").agg(
        F.corr("position", "to").alias("r"), F.count_if(F.col("position") == F.col("to")).alias("fixed"),
        F.countDistinct((F.col("to") - F.col("position") + n) % n).alias("steps"),
    ).collect()
    assert len(found) == 3
    for row in found:
        # A drawn permutation of n has one fixed place on average and some 63 % of all steps.
        assert abs(row.r) < 0.04 and row.fixed < 8 and 0.55 * n < row.steps < 0.70 * n
    wide = permutation.deal(rows, n).groupBy("position").pivot("key").agg(F.first("to"))
    assert abs(wide.agg(F.corr("`1|a`", "`1|b`")).first()[0]) < 0.04


def test_groups_move_together_and_apart(spark):
    rows = spark.range(900).select(
        F.format_string("t%04d", "id").alias("ticket_id"), F.col("id").cast("double").alias("a"),
        F.when(F.col("id") % 3 > 0, F.col("id") * 2.0).alias("b"), F.concat(F.lit("s"), "id").alias("c"),
        F.col("id").cast("double").alias("d"),
    )
    out = permutation.permute(rows.repartition(7), [["a", "b"], "c", "d"], 3).collect()
    again = permutation.permute(rows.repartition(3), [["a", "b"], "c", "d"], 3).collect()
    assert sorted(out) == sorted(again) and len(out) == 900
    assert sorted(r._swap_a for r in out) == [float(i) for i in range(900)]
    assert sorted(r._swap_c for r in out) == sorted(f"s{i}" for i in range(900))
    assert all(r._swap_b == (r._swap_a * 2 if r._swap_a % 3 else None) for r in out)
    assert sum(r._swap_a == r._swap_d for r in out) < 8 and sum(r._swap_c == f"s{int(r._swap_a)}" for r in out) < 8


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    rows = spark.range(n).selectExpr("string(id) AS ticket_id", "double(id) AS a")
    out = permutation.permute(rows, ["a"], 1)
    assert out.columns == ["ticket_id", "a", "_swap_a"] and out.count() == n


def test_one_numbering_and_one_shuffle_of_values(spark, tmp_path):
    rows = spark.range(50).selectExpr("string(id) AS ticket_id", *[f"double(id) AS x{k}" for k in range(6)])
    plan = permutation.permute(rows, [f"x{k}" for k in range(6)], 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Sort" not in plan
