"""Rows read from a ticket file are compared with those written by id and hash, in one shuffle."""

from pyspark.sql import functions as F

from ticketlab.plans import catalog
from ticketlab.sources import files
from test_star_once import small  # noqa: F401


def test_rows_that_differ_or_repeat_are_counted(spark, small, monkeypatch):  # noqa: F811
    def head(spark, path, **_):
        rows = files.read_csv(spark, path, files.TICKETS, "null")
        first = rows.orderBy("ticket_id").limit(8)
        twice = first.orderBy("ticket_id").limit(1)
        unknown = twice.withColumn("ticket_id", F.lit("none"))
        changed = F.when(F.col("ticket_id") == rows.agg(F.min("ticket_id")).scalar(), -1.0).otherwise(F.col("stake"))
        return first.withColumn("stake", changed).unionByName(twice).unionByName(unknown)

    monkeypatch.setattr(files, "read_tickets_csv", head)
    found = catalog.csv_head(spark, small).first()
    # One of the first row's two copies was changed, and no row was written as "none".
    assert (found["n_wrong"], found["n_twice"]) == (2, 1)
    shown = catalog.csv_head(spark, small)._jdf.queryExecution().analyzed().toString()
    assert "lineitem" not in shown and "LeftOuter" not in shown
