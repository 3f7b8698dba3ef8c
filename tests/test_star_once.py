"""The star tables are joined once for an enrichment; CSV numbers stay out of whole-stage code."""

from datetime import datetime

import pytest

from ticketlab.operators import enrich
from ticketlab.plans import catalog
from ticketlab.sources import files, star


@pytest.fixture
def small(spark, tmp_path):
    day = datetime(1995, 3, 1)
    tables = {
        "lineitem": (
            [(o, o % 3 + 1, o % 10 + 1, n, 5.0, 100.0 * o, 0.04, 0.02, "N" if o % 2 else "A", "O", day)
             for o in range(1, 9) for n in (1, 7)] + [(1, 1, 2, 3, None, 7.0, None, 0.0, None, None, None)],
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
            "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
            "l_shipdate timestamp",
        ),
        "orders": ([(o, o % 2, day, "1-URGENT") for o in range(1, 9)],
                   "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string"),
        "customer": ([(0, 3, "BUILDING"), (1, 4, None)], "c_custkey bigint, c_nationkey int, c_mktsegment string"),
        "part": ([(p, f"part {p}", f"B{p}", "TIN", p) for p in (1, 2, 3)],
                 "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("by_key", [True, False])
def test_enrichment_reads_the_star_once(spark, small, by_key):
    tickets = star.tickets(spark, small)
    expected = enrich.enrich(tickets, star.aggregates(tickets, 4), 4, by_key)
    found = catalog.merged(spark, small, by_key)
    assert found.columns == expected.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
    assert found.count() == 17
    assert not [f for f in found.inputFiles() if "lineitem" in f]


def test_reports_on_the_aggregates_store_no_wide_tickets(spark, small):
    read = catalog.merged_sides(spark, small)
    assert "home_team" not in read.columns and not [f for f in read.inputFiles() if "lineitem" in f]
    assert catalog.QUERIES["coverage"](spark, small).count() == 19


def test_numbers_of_a_ticket_file_are_read_outside_whole_stage_code(spark, small, tmp_path):
    path = f"{tmp_path}/t.csv"
    files.write_csv(star.tickets(spark, small), path)
    read = files.read_tickets_csv(spark, path, blank_strings="null")
    assert "*(" not in read._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, read.collect())) == sorted(map(repr, star.tickets(spark, small).collect()))
