"""Steps that move or store less: joins by the keys in use, columns that training reads."""

from pyspark.sql import functions as F

from ticketlab.operators import enrich, order_stats
from ticketlab.plans import catalog
from ticketlab.schema import DEFAULT_FEATURES, TARGET
from ticketlab.sources import star


def test_a_join_by_bettor_counts_and_shuffles_no_other_key(spark, tickets):
    odd = tickets.withColumn("bettor_id", F.when(F.pmod(F.xxhash64("ticket_id"), F.lit(9)) > 0, F.lit("1")))
    rows = order_stats.pin(odd.unionByName(tickets).select("ticket_id", *enrich.KEYS, "stake"))
    side = star.stake_size(rows, 4)
    keyed = enrich.with_stake_size(rows, side, True).select("ticket_id", "bettor_id", "stake", "mean_stake_size")
    direct = enrich.with_stake_size(rows, side, False).select(*keyed.columns)
    assert sorted(map(repr, keyed.collect())) == sorted(map(repr, direct.collect()))
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert "_hot_bettor_id" in plan and "_hot_market_name" not in plan


def test_training_rows_are_those_of_all_columns(spark, folder):
    names = ["ticket_id", "created_at", TARGET, *DEFAULT_FEATURES]
    lean, whole = catalog.trainable(spark, folder), catalog.featured(spark, folder)
    assert sorted(map(repr, lean.select(*names).collect())) == sorted(map(repr, whole.select(*names).collect()))
    assert lean.count() > 1000
    stored = {c for f in lean.inputFiles() for c in spark.read.parquet(f).columns}
    assert "l_orderkey" in stored and not stored & set(catalog.UNTRAINED)
