"""URL filter, revisits and chat format against plain versions; queries beside their SQL."""

import hashlib
import random

import pytest
from compare import difference

from ticketlab.llm import chat, queries, url_filters, warc


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, con, folder, name):
    assert difference(spark, con, name, folder) is None


def test_urls_are_cut_as_stated(spark):
    urls = {
        "HTTP://A.Example.ORG/Es/x?q#f": ("a.example.org", "/Es/x"),
        "x://y://z/p": ("y:", "//z/p"),
        "http://h?x/y": ("h", ""), "http://h#x": ("h", ""), "http://": ("", ""), "no scheme/x": ("", ""),
        None: ("", ""), "://É.org/a\nb?c": ("É.org", "/a\nb"), "a\nb://C/d": ("c", "/d"),
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: (r.h, r.p) for r in df.select("url", url_filters.host(df.url).alias("h"), url_filters.path(df.url).alias("p")).collect()}
    assert got == urls


def test_longest_rule_wins(spark):
    cases = {
        ("org", "/"): ("org/", "allow"), ("a.example.org", "/es/1"): ("example.org/es/", "block"),
        ("example.org", "/en/12"): ("example.org/en/1", "block"), ("notexample.org", "/es/"): ("org/", "allow"),
        ("example.org", ""): None, ("x.com", "/de/"): ("com/de/", "block"), ("x.com", "/en/"): None,
        ("xcom", "/de/"): None, ("", ""): None,
    }
    df = spark.createDataFrame(list(cases), "h string, p string")
    got = {(r.h, r.p): r.x and tuple(r.x) for r in df.select("h", "p", url_filters.rule_of(df.h, df.p).alias("x")).collect()}
    assert got == cases


def plain_scores(seeds, links):
    hosts = set(seeds) | {h for e in links for h in e}
    total = [sum(s[k] for s in seeds.values()) for k in (0, 1)]
    base = {h: [seeds.get(h, (0, 0))[k] / total[k] if total[k] else 0 for k in (0, 1)] for h in hosts}
    state = {h: list(v) for h, v in base.items()}
    out = {h: sum(w for (a, _), w in links.items() if a == h) for h in hosts}
    into = {h: sum(w for (_, b), w in links.items() if b == h) for h in hosts}
    d = url_filters.DAMPING
    for _ in range(1000):
        after = {h: [(1 - d) * v for v in base[h]] for h in hosts}
        for (a, b), w in links.items():
            after[b][0] += d * state[a][0] * w / out[a]
            after[a][1] += d * state[b][1] * w / into[b]
        state = after
    return state


def test_trust_goes_along_links_and_distrust_against_them(spark):
    rows = [
        (1, "http://good.org/x", '<a href="https://fine.net/a">'),
        (2, "http://bad.com/de/1", "<a href='//nowhere.net'>"),
        (3, "http://farm.net/1", '<A HREF="http://bad.com/de/1"> <a href=//BAD.com/2> <a href="/own">'),
        (4, "http://fine.net/1", None), (5, "http://new.net/1", ""), (6, None, "x"), (7, "nothing", None),
        (8, "http://a.b.farm.net/1", "href='http://farm.net/'"), (2, "http://bad.com/de/1", "<a href='//nowhere.net'>"),
    ]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, verdict string")
    links = {("good.org", "fine.net"): 1.0, ("bad.com", "nowhere.net"): 2.0, ("farm.net", "bad.com"): 1.0,
             ("a.b.farm.net", "farm.net"): 1.0, ("a.b.farm.net", "b.farm.net"): 1.0, ("b.farm.net", "a.b.farm.net"): 1.0,
             ("b.farm.net", "farm.net"): 1.0, ("farm.net", "b.farm.net"): 1.0}
    assert {(r.src, r.dst): r.weight for r in url_filters.host_links(pages).collect()} == links
    got = url_filters.judge(pages).collect()
    assert len(got) == len(rows)
    verdict = {r.page_id: r.verdict for r in got}
    assert verdict == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block"}
    scores = plain_scores({"good.org": (1, 0), "bad.com": (0, 2)}, links)
    for r in got:
        if r.host in scores:
            assert [r.trust, r.distrust] == pytest.approx(scores[r.host], abs=1e-9)
    assert url_filters.judge(pages.limit(0)).collect() == []


@pytest.mark.parametrize("fan_in", [10, 10_000])
def test_verdicts_do_not_depend_on_the_size_of_the_shares(spark, fan_in):
    """Three levels of so many hosts each; one host of each level is linked to by the whole next one."""
    level, number = f"floor(id / {fan_in})", f"id % {fan_in}"
    pages = spark.range(3 * fan_in).selectExpr(
        "id AS page_id",
        f"concat('http://l', {level}, 'x', {number}, '.net/') AS url",
        f"concat('<a href=\"http://', if({level} = 0, 'bad.com', concat('l', {level} - 1, 'x0.net')), '/\">') AS html",
    ).union(spark.createDataFrame([(-1, "http://bad.com/de/1", None)], "page_id long, url string, html string"))
    got = url_filters.judge(pages)
    assert got.filter("verdict = 'block' and distrust > 0").count() == 3 * fan_in + 1


@pytest.mark.parametrize("direct", [url_filters.DIRECT, 0])
def test_scores_are_settled_along_chains(spark, monkeypatch, direct):
    """A chain of 20 links to a blocked host, and a host whose trust and distrust settle late."""
    monkeypatch.setattr(url_filters, "DIRECT", direct)
    monkeypatch.setattr(url_filters, "TOLERANCE", 1e-4 if direct == 0 else url_filters.TOLERANCE)
    links = {(f"h{k + 1}", f"h{k}"): 1.0 for k in range(20)} | {("good", "a"): 1.0, ("a", "b"): 2.0, ("b", "good"): 1.0, ("b", "h0"): 1.0}
    seeds = {"h0": (0, 1), "good": (1, 0)}
    got = url_filters.propagate(
        spark.createDataFrame([(h, float(t), float(b)) for h, (t, b) in seeds.items()], "host string, trusted double, blocked double"),
        spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "src string, dst string, weight double"),
    )
    got = {r.host: [r.trust, r.distrust] for r in got.collect()}
    want = plain_scores(seeds, links)
    assert got.keys() == want.keys() and got["h20"][1] > 0
    for host, scores in want.items():
        assert got[host] == pytest.approx(scores, rel=1e-8 if direct else 1e-3, abs=0)


def test_the_end_of_a_long_chain_is_reached(spark):
    """Each host of 5000 links to the one before it, the first one to a blocked host."""
    pages = spark.range(5000).selectExpr(
        "id AS page_id", "concat('http://h', id, '.net/') AS url",
        "concat('<a href=\"//', if(id = 0, 'bad.com', concat('h', id - 1, '.net')), '/\">') AS html",
    ).union(spark.createDataFrame([(-1, "http://bad.com/de/1", None), (-2, "http://apart.net/", "")], "page_id long, url string, html string"))
    got = {r.page_id: r for r in url_filters.judge(pages).collect()}
    assert {k for k, r in got.items() if r.verdict == "block"} == set(got) - {-2}
    assert got[4999].distrust == url_filters.LEAST and got[4999].trust == 0


def test_scores_on_spark_have_the_same_floor(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "LEAST", 0.3)
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trusted double, blocked double")
    direct = {tuple(r) for r in url_filters.propagate(seeds, links).collect()}
    monkeypatch.setattr(url_filters, "DIRECT", 0)
    assert {tuple(r) for r in url_filters.propagate(seeds, links).collect()} == direct
    assert {r[0]: r[1] for r in direct} == pytest.approx({"a": 0.3, "b": 0.3, "c": 0.3})


def test_canonical_urls(spark):
    same = ["http://www.A.org:80/x/?b=2&utm_source=f&a=1#t", "https://u@a.org/x?a=1&b=2&ref=q", "HTTPS://a.org:443/x/?a=1&&b=2"]
    other = {"http://a.org": "a.org/", "http://a.org/": "a.org/", "http://a.org/?refer=1": "a.org/?refer=1", "x": None, None: None}
    df = spark.createDataFrame([(u,) for u in [*same, *other]], "u string")
    got = {r.u: r.c for r in df.select("u", warc.canonical_url(df.u).alias("c")).collect()}
    assert {got[u] for u in same} == {"a.org/x?a=1&b=2"} and {u: got[u] for u in other} == other


def plain_revisits(rows):
    out = []
    for i, url, ts, kind, headers, _ in rows:
        if kind != warc.REVISIT:
            continue
        before = [r for r in rows if r[3] == warc.FULL and r[1] == url and url and (r[2] is not None, r[2], r[0]) < (ts is not None, ts, i)]
        if not before:
            out.append((i, "missing", None, None))
            continue
        base = max(before, key=lambda r: (r[2] is not None, r[2], r[0]))
        old, new = base[4] or {}, headers or {}
        tag = [h["etag"].removeprefix("W/") if "etag" in h else None for h in (old, new)]
        day = [h.get("last-modified") for h in (old, new)]
        pair = tag if None not in tag else day
        status = "unchecked" if None in pair else "resolved" if pair[0] == pair[1] else "changed"
        merged = old | {k: v for k, v in new.items() if k in warc.PERMITTED} if status == "resolved" else None
        out.append((i, status, base[0], merged))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_revisits_take_the_latest_earlier_response(spark, parts):
    draw = random.Random(parts)
    rows = []
    for i in range(400):
        headers = {k: draw.choice("12") for k in ("etag", "last-modified", "vary", "server") if draw.random() < 0.6}
        if "etag" in headers and draw.random() < 0.5:
            headers["etag"] = "W/" + headers["etag"]
        url = draw.choice(["http://hot.org/"] * 5 + ["http://b.org/", "http://c.org/", None])
        rows.append((i, url, draw.choice([None, *range(30)]), draw.choice(["response", "revisit", "revisit", "request"]), draw.choice([headers, None, headers]), f"d{i}"))
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>, digest string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = warc.resolve(df.withColumn("status", df.url)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = sorted(plain_revisits(rows), key=lambda r: r[0])
    assert sorted(((r.record_id, r.status, r.response_id, r.headers) for r in got), key=lambda r: r[0]) == want
    assert all((r.digest == f"d{r.response_id}") == (r.status == "resolved") for r in got)
    assert len({r[1] for r in want}) == 4
    assert warc.resolve(df.limit(0)).collect() == []


def test_equal_responses_have_one_outcome(spark):
    """Responses equal in time and id: the greatest digest counts, then the header lines."""
    rows = [(1, "http://a.org/", 1, "response", {"etag": t}, d) for t, d in (("1", "d1"), ("2", "d1"), ("1", None), ("3", "d0"))]
    rows += [(2, "http://a.org/", 2, "revisit", {"etag": t}, None) for t in ("1", "2", "3")]
    rows += [(2, "http://a.org/", 2, "response", {"etag": "9"}, "d9")] * 2
    kind = "record_id long, url string, ts long, kind string, headers map<string,string>, digest string"
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        got = warc.resolve(spark.createDataFrame(rows, kind)).collect()
        assert sorted((r.status, r.response_id, r.digest or "") for r in got) == [("changed", 1, "")] * 2 + [("resolved", 1, "d1")]
        assert [r.headers["etag"] for r in got if r.headers] == ["2"]


def test_chats_are_read_back(spark):
    draw = random.Random(2)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "INST]", "/", "a", " ", "\n", "<\\s>", "[\\/INST]", "$1", "é", "🤦"]
    some = lambda n: "".join(draw.choice(parts) for _ in range(draw.randrange(n)))
    rows = [
        (c, t, some(4) if draw.random() < 0.2 else draw.choice(["user", "assistant"]), some(9))
        for c in range(120) for t in range(draw.randint(1, 5))
    ]
    rows += [(None, 0, None, None), (500, None, "user", "x"), (500, None, "user", "x"), (500, 0, "assistant", "x" * 100_000), (501, 1, "b", "z"), (501, 1, "a", "y")]
    df = spark.createDataFrame([(*r, "f") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    chats = chat.format_chats(df)
    texts = {r.conv_id: r for r in chats.collect()}
    assert all(r.identical for r in texts.values())
    digests = {r.conv_id: r for r in chat.digests(chats).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv]
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        d = digests[conv]
        assert [tuple(t) for t in texts[conv].turns] == turns
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (d.n_turns, d.loss_chars, d.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert d.formatted_chars == len(texts[conv].formatted)
        inner = texts[conv].formatted.replace("<s>", "").count("[INST]")
        assert inner == texts[conv].formatted.count("</s>") == len(turns)
    plain = spark.createDataFrame([(1, 0, "user", "nothing to escape <b>"), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(plain).first().formatted == "<s>user[INST] nothing to escape <b> [/INST]</s><s>assistant[INST] ok [/INST]</s>"
    assert chat.format_chats(df.limit(0)).collect() == []


def test_a_text_out_of_order_does_not_parse(spark):
    df = spark.createDataFrame([("<s>user[INST] a [/INST]</s>",), ("<s>user a [/INST]</s>",), ("[INST] a",)], "x string")
    assert [r.t and [tuple(t) for t in r.t] for r in df.select(chat.parse(df.x).alias("t")).collect()] == [[("user", "a")], None, None]
