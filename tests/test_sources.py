"""CSV rules, round trips, and what reaches the scan."""

import contextlib
import io
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ticketlab.operators import order_stats
from ticketlab.plans import jobs
from ticketlab.schema import AGGREGATES, TICKETS
from ticketlab.sources import files, star

HEADER = "bettor_id,sport,market_type,reject_reason,rejected_stake,rejected_pnl,a10,a30,a90".replace(
    "a10", "avg_rejected_odds_after_10").replace("a30", "avg_rejected_odds_after_30").replace(
    "a90", "avg_rejected_odds_after_90")


def write(tmp_path, *lines):
    path = tmp_path / "in.csv"
    path.write_text("\n".join((HEADER, *lines)) + "\n")
    return str(path)


def test_blanks_tokens_and_quotes(spark, tmp_path):
    path = write(tmp_path, '001,,"",NULL,NaN,inf,NULL,-inf,1e-3', '2,"a ""q"", b",m,x,-1.5,,N/A,nan,0')
    first, second = files.read_csv(spark, path, AGGREGATES["rejected"]).collect()
    assert tuple(first) == ("001", "", "", "NULL", None, float("inf"), None, float("-inf"), 0.001)
    assert tuple(second) == ("2", 'a "q", b', "m", "x", -1.5, None, None, None, 0.0)
    nulls = files.read_csv(spark, path, AGGREGATES["rejected"], blank_strings="null").first()
    assert nulls["sport"] is None and nulls["market_type"] is None and nulls["reject_reason"] == "NULL"


@pytest.mark.parametrize("bad", ["abc", "1.2.3", "--1"])
def test_malformed_number_raises(spark, tmp_path, bad):
    path = write(tmp_path, f"1,s,m,x,{bad},0,0,0,0")
    with pytest.raises(Exception, match="not a double"):
        files.read_csv(spark, path, AGGREGATES["rejected"]).collect()


def test_fraction_is_not_an_integer(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("bettor_id,ots_risk_tier_id,pnl,volume,margin\n1,1.5,0,0,0\n")
    with pytest.raises(Exception, match="not a bigint"):
        files.read_aggregate_csv(spark, str(path), "risk_tier").collect()


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("extra,mean_stake_size,bettor_id\nx,2.5,007\n")
    row = files.read_aggregate_csv(spark, str(path), "stake_size").first()
    assert row.asDict() == {"bettor_id": "007", "mean_stake_size": 2.5}
    path.write_text("bettor_id,wrong\n1,2\n")
    with pytest.raises(ValueError, match="mean_stake_size"):
        files.read_aggregate_csv(spark, str(path), "stake_size")


def test_limited_read_and_conversion(spark, tickets, tmp_path):
    files.write_csv(tickets, f"{tmp_path}/t.csv")
    assert files.read_tickets_csv(spark, f"{tmp_path}/t.csv", limit_rows=12).count() == 12
    done = jobs.convert(spark, f"{tmp_path}/t.csv", f"{tmp_path}/t").first()
    assert done["n_rows"] == tickets.count() and done["ratio"] > 1
    back = files.read_tickets(spark, f"{tmp_path}/t")
    assert back.dtypes == [(f.name, f.dataType.simpleString()) for f in TICKETS]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_first_bytes_hold_the_whole_lines(spark, tmp_path, monkeypatch, ending):
    monkeypatch.setattr(files, "PROBE", 7)
    path = tmp_path / "t.csv"
    lines = ["bettor_id,mean_stake_size", *[f"b{i}é,{i}.5" for i in range(40)]]
    raw = "".join(x + ending for x in lines).encode()
    path.write_bytes(raw)
    for limit in [*range(40, 90), len(raw) - 1, len(raw), len(raw) + 5]:
        (whole,) = files.head_paths(spark, str(path), limit, f"{tmp_path}/copies")
        part = raw[:limit]
        with open(whole.removeprefix("file:"), "rb") as f:
            assert f.read() == part[: part.rfind(b"\n") + 1]
    head = files.read_csv(spark, files.head_paths(spark, str(path), 80, f"{tmp_path}/copies"), AGGREGATES["stake_size"])
    assert [r.bettor_id for r in head.collect()] == [x.split(",")[0] for x in raw[:80].decode(errors="ignore").split(ending)[1:-1]]
    with pytest.raises(ValueError, match="no whole line"):
        files.head_paths(spark, str(path), 10)
    with pytest.raises(ValueError, match="positive"):
        files.head_paths(spark, str(path), 0)


def test_first_bytes_of_a_folder_and_their_conversion(spark, tickets, tmp_path):
    files.write_csv(tickets.repartition(5), f"{tmp_path}/t.csv")
    parts = sorted((tmp_path / "t.csv").glob("part-*.csv"))
    limit = sum(p.stat().st_size for p in parts[:2]) + parts[2].stat().st_size // 3
    found = files.head_paths(spark, f"{tmp_path}/t.csv", limit, f"{tmp_path}/copies")
    assert [f.removeprefix("file:") for f in found[:2]] == [str(p) for p in parts[:2]] and len(found) == 3
    cut = parts[2].read_bytes()[: parts[2].stat().st_size // 3]
    expected = sum(p.read_bytes().count(b"\n") - 1 for p in parts[:2]) + cut.count(b"\n") - 1
    folder = order_stats.shared_folder(spark).removeprefix("file:")
    before = set(Path(folder).iterdir())
    done = jobs.convert(spark, f"{tmp_path}/t.csv", f"{tmp_path}/t", limit_bytes=limit).first()
    assert done["n_rows"] == expected and done["csv_bytes"] == limit
    assert set(Path(folder).iterdir()) == before
    assert len(list((tmp_path / "t").glob("part-*.parquet"))) > 1


def test_splits_are_reused_pruned_and_redone(spark, tickets, tmp_path):
    path = f"{tmp_path}/splits"
    calls = []

    def build(n):
        def run():
            calls.append(n)
            return tickets.limit(n).selectExpr("ticket_id", "if(pending_delay > 4, 'train', 'val') AS split")
        return run

    assert files.ensure_splits(spark, path, build(50)).count() == 50
    assert files.ensure_splits(spark, path, build(60)).count() == 50
    assert files.ensure_splits(spark, path, build(70), overwrite=True).count() == 70
    assert calls == [50, 70]
    assert "PartitionFilters: [isnotnull(split" in plan(files.read_split(spark, path, "val"))


def test_unfinished_splits_are_rebuilt(spark, tickets, tmp_path):
    path = f"{tmp_path}/splits"
    df = tickets.selectExpr("ticket_id", "'train' AS split")
    files.write_splits(df, path)
    (tmp_path / "splits" / "_SUCCESS").unlink()
    assert files.ensure_splits(spark, path, lambda: df.limit(5)).count() == 5


def test_publish_verifies(spark, tickets, tmp_path):
    assert files.publish(tickets, f"{tmp_path}/out") == tickets.count()


def test_published_tables_keep_a_manifest_and_survive_failed_writes(spark, tickets, tmp_path):
    path = f"{tmp_path}/out"
    rows = tickets.select("ticket_id", "stake", "pnl").limit(500)
    rows = order_stats.pin(rows)
    files.publish(rows, path)
    assert files.changed_files(spark, path).count() == 0
    # A job that fails half way leaves the old table as it is, and nothing beside it.
    broken = rows.withColumn("stake", F.when(F.col("stake") > 0, F.raise_error(F.lit("lost")).cast("double")))
    with pytest.raises(Exception, match="lost"):
        files.publish(broken, path)
    assert spark.read.parquet(path).count() == 500 and [p.name for p in tmp_path.iterdir()] == ["out"]
    assert files.publish(order_stats.pin(rows.limit(20)), path) == 20
    assert spark.read.parquet(path).count() == 20 and [p.name for p in tmp_path.iterdir()] == ["out"]
    assert files.publish(rows.limit(0), f"{tmp_path}/none") == 0
    # One value changed, the same number of rows.
    name = next((tmp_path / "out").glob("part-*.parquet"))
    files.write_parquet(spark.read.parquet(path).withColumn("stake", F.col("stake") + F.when(F.col("ticket_id") == rows.first()[0], 1).otherwise(0)).coalesce(1), f"{tmp_path}/other")
    for old in (tmp_path / "out").glob(".*.crc"):
        old.unlink()
    name.write_bytes(next((tmp_path / "other").glob("part-*.parquet")).read_bytes())
    spark.catalog.refreshByPath(path)
    assert [r.file for r in files.changed_files(spark, path).collect()] == [name.name]


def test_a_write_that_reads_back_otherwise_is_refused(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/out"
    files.publish(spark.range(10).select(F.col("id").cast("string").alias("a")), path)
    write = files.write_parquet
    monkeypatch.setattr(files, "write_parquet", lambda df, to: write(df.withColumn("a", F.lit("x")), to))
    with pytest.raises(RuntimeError, match="not the 10 rows"):
        files.publish(spark.range(10).select(F.col("id").cast("string").alias("a")), path)
    assert spark.read.parquet(path).distinct().count() == 10


def test_missing_inputs_are_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="run convert first"):
        jobs.enrich_job(spark, f"{tmp_path}/none", {}, f"{tmp_path}/out")
    with pytest.raises(FileNotFoundError, match="rejected"):
        jobs.read_aggregates(spark, {"bettor_stats": "x"})
    with pytest.raises(FileNotFoundError, match="run train_job first"):
        jobs.evaluate_job(spark, f"{tmp_path}/model")


def test_ingest_end_to_end(spark, tickets, tmp_path):
    files.write_csv(tickets, f"{tmp_path}/t.csv")
    paths = {}
    for kind, df in vars(star.aggregates(tickets, 4)).items():
        paths[kind] = f"{tmp_path}/{kind}.csv"
        files.write_csv(df, paths[kind])
    n = jobs.ingest_job(spark, f"{tmp_path}/t.csv", paths, f"{tmp_path}/work", f"{tmp_path}/out")
    assert n == tickets.count() == spark.read.parquet(f"{tmp_path}/out").count()


def plan(df):
    text = io.StringIO()
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_filters_and_columns_reach_the_scan(spark, tickets):
    from ticketlab.operators import analytics, filters

    kept = plan(filters.apply_rules(filters.valid_target(tickets)).select("ticket_id"))
    pushed = kept[kept.index("PushedFilters"):]
    for part in ("GreaterThanOrEqual(bos,1.0)", "GreaterThan(pending_delay,0)", "LessThanOrEqual(pending_delay,9)", "IsNotNull(odds_after_10)"):
        assert part in pushed
    sport = plan(analytics.by_sport(tickets))
    read = sport[sport.index("ReadSchema"):].split("\n")[0]
    for name in ("sport", "bettor_id", "odds_after_10", "stake", "pnl"):
        assert f"{name}:" in read
    assert read.count(":") == 6
    assert "PythonUDF" not in kept + sport


def test_one_shuffle_of_the_wide_rows(spark, tickets):
    """In the one-shuffle form only one exchange carries the ticket columns."""
    from ticketlab.operators import enrich

    df = enrich.enrich(tickets, star.aggregates(tickets), by_key=True)
    wide = [line for line in plan(df).split("\n") if "ReadSchema" in line and "home_team" in line]
    assert len(wide) == 1


def test_scratch_tables_are_removed(spark, tickets):
    folder = Path(order_stats.shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    order_stats.quantile_list(tickets, "stake", [0.5])
    order_stats.keys_at(tickets, ["created_at", "ticket_id"], [10, 20])
    assert set(folder.iterdir()) == before
