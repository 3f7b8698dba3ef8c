"""Resolving not-modified revisits of a web archive to the response they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlab.operators.order_stats import pin

# Headers that a not-modified answer may replace in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")

FULL, REVISIT = "response", "revisit"


def canonical_url(url: Column) -> Column:
    """Host, path and query that name a resource, whatever the scheme.

    The host is lower-cased and loses user, ``www.`` and the default ports; the path loses
    a slash at its end, an empty one is ``/``; the query loses ``utm_`` parameters and
    ``ref``, the others are sorted; the fragment goes. Null if there is no host.
    """
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", 1)
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(host, r"^.*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(/[^?]*)", 1), r"/+$", "")
    pairs = F.filter(
        F.split(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), "&"),
        lambda x: (x != "") & ~x.rlike(r"^(utm_[^=]*|ref)(=|$)"),
    )
    query = F.array_join(F.array_sort(pairs), "&")
    return F.when(
        host != "",
        F.concat(
            host,
            F.when(path == "", "/").otherwise(path),
            F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
        ),
    )


def weak(etag: Column) -> Column:
    """An entity tag for the weak comparison that validation uses."""
    return F.regexp_replace(etag, r"^W/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, with those of the answer that may replace them."""
    new = F.map_filter(fresh, lambda k, _: k.isin(*PERMITTED))
    old = F.map_filter(stored, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(old, new)


def latest_before(rows: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """``rows`` with ``before``: the last value that is not null in an earlier row of the key.

    Rows are cut into ranges of (key, order), so that a key with a third of all rows is
    spread over as many tasks as its rows need. Each range finds the last value within
    itself; what it takes over from earlier ranges is one row per key and range.
    """
    blocks = pin(
        rows.withColumn("_value", value)
        .repartitionByRange(key, *order)
        .withColumn("_block", F.spark_partition_id())
    )
    own = Window.partitionBy("_block", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("_value", ignorenulls=True)
    inside = blocks.withColumn("_inside", last.over(own))
    ends = (
        blocks.filter("_value is not null")
        .groupBy("_block", key)
        .agg(F.max_by("_value", F.struct(*order)).alias("_value"))
    )
    starts = blocks.select("_block", key).distinct().join(ends, ["_block", key], "left")
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = starts.withColumn("_carried", last.over(earlier)).filter("_carried is not null")
    return (
        inside.join(carried.select("_block", key, "_carried"), ["_block", key], "left")
        .withColumn("before", F.coalesce("_inside", "_carried"))
        .drop("_block", "_value", "_inside", "_carried")
    )


def resolve(records: DataFrame) -> DataFrame:
    """Per revisit: the response it stands for, whether its validators agree, and its headers.

    ``records`` has record_id, url, ts, kind (``response`` or ``revisit``), headers (a map
    with lower-case names) and digest. The response is the latest one of the same
    canonical URL before the revisit by (ts, record_id). Of responses equal in both the
    greatest by (digest, header lines) is the latest; one equal in both to the revisit
    is not before it. ``status`` is ``resolved`` if the entity tags agree, or without a
    tag on either side the last-modified dates; ``changed`` if they differ; ``unchecked``
    if no validator is on both sides; ``missing`` without an earlier response or without a canonical URL. A resolved
    revisit gets the response's digest and headers, of which the permitted ones are
    replaced by its own; else both are null.

    Null headers are none. Records with a null time are earlier than all others.
    Repeated records give repeated rows. Records of other kinds are ignored, as are
    other columns; an empty table gives an empty result.
    """
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = records.filter(F.col("kind").isin(FULL, REVISIT)).select(
        "record_id", "ts", (F.col("kind") == FULL).alias("full"), canonical_url(F.col("url")).alias("url"),
        F.coalesce("headers", empty).alias("headers"), "digest",
    )
    rows = rows.withColumn("lines", F.when(F.col("full"), header_lines(F.col("headers"))))
    value = F.when(F.col("full"), F.struct("record_id", "headers", "digest"))
    order = ["ts", "record_id", "full", "digest", "lines"]
    found = latest_before(rows, "url", order, value).filter("not full")
    stored = F.col("before.headers")
    tags = [weak(F.element_at(h, "etag")) for h in (stored, F.col("headers"))]
    dates = [F.element_at(h, "last-modified") for h in (stored, F.col("headers"))]
    known = F.col("before.record_id").isNotNull() & F.col("url").isNotNull()
    status = (
        F.when(~known, "missing")
        .when(tags[0].isNotNull() & tags[1].isNotNull(), F.when(tags[0] == tags[1], "resolved").otherwise("changed"))
        .when(dates[0].isNotNull() & dates[1].isNotNull(), F.when(dates[0] == dates[1], "resolved").otherwise("changed"))
        .otherwise("unchecked")
    )
    good = F.col("status") == "resolved"
    return found.withColumn("status", status).select(
        "record_id",
        F.col("url").alias("canonical_url"),
        "status",
        F.when(known, F.col("before.record_id")).alias("response_id"),
        F.when(good, F.col("before.digest")).alias("digest"),
        F.when(good, merged_headers(stored, F.col("headers"))).alias("headers"),
    )


def header_lines(headers: Column) -> Column:
    """Headers as ``name: value`` lines in order of their names."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.array_sort(lines), "\n")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Two records of each page: the response, and a later revisit of the same resource.

    The test tables hold pages and no archive. Times, validators and headers follow from
    the page's number and text, so that all outcomes occur: every tenth revisit has
    another entity tag, every fifth one none but the date, and one in seven comes before
    its response.
    """
    n, url = F.col("page_id"), F.col("url")
    tag, day = F.md5(F.coalesce("html", F.lit(""))), (n % 28).cast("string")
    response = F.create_map(
        F.lit("content-type"), F.lit("text/html"), F.lit("server"), F.concat(F.lit("s"), (n % 3).cast("string")),
        F.lit("cache-control"), F.lit("max-age=60"), F.lit("last-modified"), day,
        F.lit("etag"), tag, F.lit("date"), n.cast("string"),
    )
    other = F.when(n % 10 == 3, F.concat(F.lit("x"), tag)).when(n % 5 != 0, F.concat(F.lit("W/"), tag))
    revisit = F.create_map(
        F.lit("content-type"), F.lit("none"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("last-modified"), day,
        F.lit("etag"), other, F.lit("date"), (n + 1).cast("string"),
    )
    revisit = F.map_filter(revisit, lambda _, v: v.isNotNull())
    record = F.explode(
        F.array(
            F.struct((2 * n).alias("record_id"), url.alias("url"), (10 * n).alias("ts"), F.lit(FULL).alias("kind"),
                     response.alias("headers"), tag.alias("digest")),
            F.struct((2 * n + 1).alias("record_id"), F.concat(url, F.lit("#again")).alias("url"),
                     (10 * n + F.when(n % 7 == 2, -5).otherwise(5)).alias("ts"), F.lit(REVISIT).alias("kind"),
                     revisit.alias("headers"), F.lit(None).cast("string").alias("digest")),
        )
    )
    return pages.select(record.alias("r")).select("r.*")
