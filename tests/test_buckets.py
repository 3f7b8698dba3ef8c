"""Large star tables are joined and enriched over tables in buckets, without a shuffle of their rows."""

import pytest
from pyspark.sql import functions as F

from ticketlab.operators import enrich, order_stats
from ticketlab.plans import catalog
from ticketlab.sources import files, star
from test_star_once import small  # noqa: F401

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def large(spark):
    """No side is small enough for a broadcast, as for large tables."""
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, "-1")
    yield
    spark.conf.set(THRESHOLD, before)


def said(df):
    return sorted(map(repr, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def odd(spark, tmp_path):
    rows = [(str(i % 40), i) for i in range(400)] + [("hot", i) for i in range(300)] + [(None, 1), (None, 2)]
    return spark.createDataFrame(rows, "k string, v int"), str(tmp_path)


def test_parts_hold_every_row_once(spark, odd, large):
    df, folder = odd
    parts, light = order_stats.in_parts(df, "k", 4, folder)
    assert [bucketed for _, bucketed in parts] == [True, False]
    assert said(parts[0][0].unionByName(parts[1][0])) == said(df)
    assert {r["k"] for r in parts[1][0].collect()} == {"hot", None}
    assert said(df.filter(light)) == said(parts[0][0])
    grouped = parts[0][0].groupBy("k", "v").count()
    assert "Exchange" not in plan(grouped.join(parts[0][0], ["k", "v"]))
    assert len(order_stats.in_parts(df.filter("k != 'hot'"), "k", 4, folder)[0]) == 1
    assert [r.name for r in spark.catalog.listTables() if r.name.startswith("bucketed_")] == []


@pytest.mark.parametrize("hot", [False, True])
def test_enrichment_of_large_tables_shuffles_no_row(spark, small, large, monkeypatch, hot):  # noqa: F811
    monkeypatch.setattr(order_stats, "heavy", lambda df, key, n: [df.agg(F.min(key)).first()[0]] if hot else [])
    base = star.base(spark, small)
    assert star.buckets(spark, small) and said(star.base_by_buckets(spark, small, 4)) == said(base)
    tickets = star.derive(base)
    expected = enrich.enrich(tickets, star.aggregates(tickets, 4), 4, False)
    for by_key in (None, True):
        found = catalog.merged(spark, small, by_key)
        assert said(found.select(*expected.columns)) == said(expected)
        assert hot or by_key or "Exchange" not in plan(found)


def test_files_of_large_tables_are_as_those_of_small_ones(spark, small, large):  # noqa: F811
    tickets = star.tickets(spark, small)
    assert said(catalog.csv_roundtrip(spark, small)) == said(tickets)
    assert catalog.convert(spark, small).first()["n_rows"] == 17
    head = catalog.csv_head(spark, small)
    assert (head.first()["n_wrong"], head.first()["n_twice"]) == (0, 0)
    assert "repartition" not in head._jdf.queryExecution().logical().toString().lower()


def test_job_joins_large_tables_by_buckets(spark, small, tmp_path, large, monkeypatch):  # noqa: F811
    tickets = star.tickets(spark, small)
    # A ticket without a bettor is kept and finds nothing.
    tickets = order_stats.pin(tickets.unionByName(tickets.limit(1).withColumn("bettor_id", F.lit(None).cast("string"))))
    sides, root = star.aggregates(tickets.filter("bettor_id is not null"), 4), f"{tmp_path}/job"
    expected = enrich.enrich(tickets, sides, 4, False)
    files.write_parquet(tickets, f"{root}/tickets")
    paths = {k: f"{root}/{k}.csv" for k in vars(sides)}
    for kind, side in vars(sides).items():
        files.write_csv(side, paths[kind])
    used = []
    by_buckets = enrich.enrich_by_buckets
    monkeypatch.setattr(enrich, "enrich_by_buckets", lambda *args: used.append(by_buckets(*args)) or used[-1])
    found = catalog.jobs.enrich_job(spark, f"{root}/tickets", paths, f"{root}/merged", scale=4)
    assert said(found.select(*expected.columns)) == said(expected) and found.count() == 18 and used
    assert said(catalog.enrich_job(spark, small)) == said(catalog._merged_rounded(catalog.merged(spark, small)).select(*found.columns))
