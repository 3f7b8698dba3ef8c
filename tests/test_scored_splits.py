"""Splits are scored without storing their wide rows a second time."""

from ticketlab.operators import order_stats
from ticketlab.plans import catalog, jobs
from ticketlab.schema import TARGET


def test_a_split_is_stored_narrow_or_not_at_all(spark, tmp_path, folder, monkeypatch):
    root, kept = catalog._stored_early(spark, folder), []
    pin = order_stats.pin
    monkeypatch.setattr(order_stats, "pin", lambda df, *a: kept.append(df.columns) or pin(df, *a))
    jobs.calibrate_job(spark, root, 4)
    jobs.evaluate_job(spark, root, scale=4)
    assert [TARGET, "raw_score"] in kept and not [c for c in kept if "home_team" in c]
