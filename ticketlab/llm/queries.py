"""Named queries of the operators over the test tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlab.llm import (
    bin_slack,
    chat,
    decontam,
    language,
    lattice,
    licenses,
    packing,
    partenum,
    prefix_trie,
    repair,
    token_counts,
    url_filters,
    warc,
)

WORD_BPE = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by rules, else by its host's place among the links."""
    return url_filters.judge(table(spark, sf_dir, "pages"))


@query
def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors at a cosine of 0.95."""
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, as copies or edited copies."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out())
    model = language.learn(docs.filter("doc_id is not null and not held_out"))
    return language.identify(docs, model).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "share", "mixture"
    )


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents grouped by five-word shingles at a Jaccard similarity of 0.8."""
    return partenum.similar_groups(table(spark, sf_dir, "documents"))


@query
def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits made from all pages, resolved to the latest earlier response."""
    found = warc.resolve(warc.records_of_pages(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", warc.header_lines(F.col("headers")))


ORACLE["op9_revisits"] = r"""
WITH records AS (
  SELECT 2 * page_id AS record_id, url, 10 * page_id AS ts, true AS is_full,
    page_id, md5(coalesce(html, '')) AS tag, md5(coalesce(html, '')) AS etag
  FROM pages
  UNION ALL
  SELECT 2 * page_id + 1, url, 10 * page_id + CASE WHEN page_id % 7 = 2 THEN -5 ELSE 5 END, false,
    page_id, NULL, CASE WHEN page_id % 10 = 3 THEN 'x' || md5(coalesce(html, ''))
      WHEN page_id % 5 <> 0 THEN md5(coalesce(html, '')) END
  FROM pages
), rests AS (
  SELECT *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)', 1) AS rest FROM records
), parts AS (
  SELECT *,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)),
      '^.*@', ''), ':(80|443)?$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*(/[^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))), '&') AS query
  FROM rests
), named AS (
  SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical_url
  FROM parts
), matched AS (
  SELECT *, last_value(CASE WHEN is_full THEN {'id': record_id, 'page': page_id, 'tag': tag} END IGNORE NULLS)
    OVER (PARTITION BY canonical_url ORDER BY ts, record_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base
  FROM named
), judged AS (
  SELECT *, CASE WHEN base IS NULL OR canonical_url IS NULL THEN 'missing'
    WHEN etag IS NOT NULL THEN CASE WHEN etag = base.tag THEN 'resolved' ELSE 'changed' END
    WHEN base.page % 28 = page_id % 28 THEN 'resolved' ELSE 'changed' END AS status
  FROM matched WHERE NOT is_full
)
SELECT record_id, canonical_url, status,
  CASE WHEN canonical_url IS NOT NULL THEN base.id END AS response_id,
  CASE WHEN status = 'resolved' THEN base.tag END AS digest,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-type: text/html'
    || chr(10) || 'date: ' || (page_id + 1) || chr(10) || 'etag: '
    || CASE WHEN etag IS NULL THEN base.tag ELSE 'W/' || etag END || chr(10)
    || 'last-modified: ' || (base.page % 28) || chr(10) || 'server: s' || (base.page % 3) END AS headers
FROM judged
"""


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, as read back from their format."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        "SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, :t AS text UNION ALL SELECT -7L, 1L, 'assistant', :t",
        args={"t": said},
    )
    return chat.digests(chat.format_chats(rows.union(extra)))


ORACLE["op10_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS r,
    regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS t
  FROM rows
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(r) + length(t) + length('<s>[INST]  [/INST]</s>'))::BIGINT AS formatted_chars
  FROM escaped GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars, true AS identical
FROM joined
"""


@query
def op12_full_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few sequences of at most 4096 tokens as found."""
    return bin_slack.pack_full(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


@query
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired at the least cost."""
    rows = table(spark, sf_dir, "conversations")
    return repair.with_all(repair.report(repair.repair(repair.damage(rows))), rows)


# CRC-32 of an ASCII string, bit by bit; list_reduce folds the bytes into the register.
_CRC = """
crc_steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), crc AS (
  SELECT k, xor(list_reduce(list_concat([4294967295],
      list_transform(range(1, length(k) + 1), lambda i: ord(substr(k, i, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS crc32
  FROM (SELECT DISTINCT {key} AS k FROM conversations), crc_steps
)"""

ORACLE["op11_turn_repair"] = (
    "WITH RECURSIVE"
    + _CRC.format(key="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    + r""", keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc32 % 20 AS kind
  FROM conversations JOIN crc ON k = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again
  FROM keyed
), judged AS (
  SELECT *, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE 'k' END AS fault
  FROM damaged
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM judged) GROUP BY conv_id
), dp AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': ''} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR) AS s1,
    {'c': 5::BIGINT, 'a': 'I'} AS s2, {'c': 10::BIGINT, 'a': 'II'} AS s3
  FROM counted
  UNION ALL
  SELECT conv_id, i, t0, t1, t2, list_min([t3, {'c': t2.c + 5, 'a': t2.a || 'I'}])
  FROM (
    SELECT conv_id, i, t0, t1, t3, list_min([x2, CASE WHEN t0 IS NOT NULL THEN {'c': t0.c + 5, 'a': t0.a || 'I'} END,
      CASE WHEN t1 IS NOT NULL THEN {'c': t1.c + 5, 'a': t1.a || 'I'} END,
      CASE WHEN t3 IS NOT NULL THEN {'c': t3.c + 5, 'a': t3.a || 'I'} END]) AS t2
    FROM (
      SELECT d.conv_id, r.i, stays, {'c': s0.c + 2, 'a': s0.a || 'D'} AS t0,
        list_min([CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 2, 'a': s1.a || 'D'} END,
          CASE WHEN stays AND initial = 's' THEN {'c': s0.c + extra, 'a': s0.a || 'K'} END]) AS t1,
        list_min([{'c': s2.c + 2, 'a': s2.a || 'D'}, CASE WHEN stays THEN list_min([
          {'c': s0.c + extra + fix_u, 'a': s0.a || is_u}, {'c': s3.c + extra + fix_u, 'a': s3.a || is_u},
          CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + extra + fix_u, 'a': s1.a || is_u} END]) END]) AS x2,
        list_min([{'c': s3.c + 2, 'a': s3.a || 'D'}, CASE WHEN stays THEN
          {'c': s2.c + extra + CASE WHEN initial = 'a' THEN 0 ELSE 1 END,
           'a': s2.a || CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END} END]) AS t3
      FROM dp d JOIN (
        SELECT *, fault IN ('k', 't') AS stays, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS extra,
          CASE WHEN initial = 'u' THEN 0 ELSE 1 END AS fix_u, CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END AS is_u
        FROM judged
      ) r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1
    )
  )
), best AS (
  SELECT c.*, list_min([s0, s3]) AS v
  FROM dp d JOIN counted c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = c.n
), letters AS (
  SELECT conv_id, v.a AS audit, unnest(range(1, length(v.a) + 1)) AS j FROM best
), placed AS (
  SELECT conv_id, j, substr(audit, j, 1) AS letter, length(replace(left(audit, j), 'I', '')) AS i,
    length(replace(left(audit, j), 'D', '')) AS o
  FROM letters
), edited AS (
  SELECT p.*, r.role, r.text, sum(CASE WHEN letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END)
    OVER (PARTITION BY p.conv_id) AS lead
  FROM placed p LEFT JOIN judged r ON letter <> 'I' AND r.i = p.i AND r.conv_id IS NOT DISTINCT FROM p.conv_id
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired
  FROM edited WHERE letter <> 'D' GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v.c, 0)::BIGINT AS cost,
  coalesce(v.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN best b ON a.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN texts t ON a.conv_id IS NOT DISTINCT FROM t.conv_id
"""
)


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct sequence of first turns of the rebuilt conversations, with subtree totals."""
    turns, convs = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.rebuild(turns, convs))


ORACLE["op13_prefix_trie"] = (
    "WITH "
    + _CRC.format(key="conv_id::VARCHAR")
    + r""", ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS source, crc32 % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM ordered) JOIN crc ON k = conv_id::VARCHAR
), taken AS (
  SELECT c.conv_id, i, role, text FROM convs c JOIN ordered o ON o.conv_id = source AND i <= h
  UNION ALL SELECT c.conv_id, 1000000000 + i, role, text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND i > h
), rebuilt AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
    string_agg(md5(role) || md5(text), '') OVER w AS prefix
  FROM taken WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), members AS (
  SELECT conv_id, depth, bytes, prefix FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT prefix, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved
  FROM members GROUP BY prefix
), kids AS (
  SELECT left(prefix, length(prefix) - 64) AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), ends AS (
  SELECT prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) AS back FROM members) WHERE back = 1
  GROUP BY prefix
), totals AS (
  SELECT left(w.prefix, (64 * d)::BIGINT) AS prefix, sum(saved)::BIGINT AS saved_tokens,
    count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM nodes) w LEFT JOIN kids k ON k.prefix = w.prefix
  GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = left(n.prefix, length(n.prefix) - 64)
LEFT JOIN kids k ON k.prefix = n.prefix LEFT JOIN ends e ON e.prefix = n.prefix JOIN totals t ON t.prefix = n.prefix
"""
)
