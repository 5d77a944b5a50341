import re

import pytest

from palimpsest.llm import url_filter

SCHEMA = "page_id long, url string, html string, verdict string"


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def own(url):
    host, path = parts(url)
    fit = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fit, key=lambda r: len(r[1] + r[2])) if fit and host else None


def test_rules_on_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    odd = [None, "", "no scheme", "HTTP://EXAMPLE.com/en/7?x", "http://a.example.net/de/81#f", "x://xexample.net/de/8", "a://b://org/es/", "http://org/es", "http://net/de/?q=/en/", "ftp://com/en/", "http://c.com\n/en/", "://"]
    pages = pages.union(spark.createDataFrame([(-1 - i, u, None) for i, u in enumerate(odd)], "page_id long, url string, html string"))
    urls = {r.page_id: r.url for r in pages.collect()}
    got = url_filter.judge(pages).collect()
    assert len(got) == len(urls)
    for r in got:
        rule = own(urls[r.page_id])
        assert (r.host, r.path) == parts(urls[r.page_id])
        assert (r.rule, r.verdict) == ((rule[1] + rule[2], rule[0]) if rule else (None, "allow")), urls[r.page_id]


def page(canonical=None, refresh=None):
    return "<head>" + (f'<link data-x="1" REL="alternate Canonical" href="{canonical}">' if canonical else "") + (f"<META HTTP-EQUIV=refresh content='0; URL={refresh}'>" if refresh else "") + "</head>"


@pytest.fixture(scope="module")
def pages(spark):
    chain = [(100 + i, f"http://site.info/{i}", page(refresh=f"/{i + 1}")) for i in range(12)] + [(112, "http://site.info/12", page(canonical="https://bad.com/en/x"))]
    rows = chain + [
        (1, "http://bad.com/en/1", None),
        (2, "http://mirror.info/p", page(canonical="http://bad.com/en/1")),
        (3, "http://copy.info/q?a=1", page(refresh="http://mirror.info/p#top")),
        (4, "https://COPY.info/q?a=1", ""),
        (5, "http://fair.info/z", page(canonical="http://www.example.com/en/70")),
        (6, "http://fair.info/z#there", page(canonical="http://bad.com/en/2")),
        (7, "http://other.net/de/3", page(canonical="http://bad.com/en/1")),
        (8, "http://plain.info/", page(canonical="plain")),
        (9, None, page(canonical="http://bad.com/en/1")),
        (10, "http://mail.info/m", page(canonical="mailto:x@bad.com")),
        (2, "http://mirror.info/p", page(canonical="http://bad.com/en/1")),
    ]
    return spark.createDataFrame([(*r, "v") for r in rows], SCHEMA)


def test_blocks_reach_aliases(pages):
    got = {}
    rows = url_filter.judge(pages).collect()
    for r in rows:
        got.setdefault(r.page_id, set()).add((r.rule, r.verdict))
    assert len(rows) == pages.count()
    assert all(got[100 + i] == {(None, "block")} for i in range(13))
    assert got[1] == {("com/en/", "block")}
    assert got[2] == got[3] == got[4] == {(None, "allow")}  # an alias, 7, is explicitly allowed
    assert got[5] == got[6] == {(None, "allow")}
    assert got[7] == {("net/de/", "allow")} and got[8] == got[9] == got[10] == {(None, "allow")}
    without = url_filter.judge(pages.where("page_id <> 7"))
    assert {r.page_id: r.verdict for r in without.where("page_id in (2, 3, 4)").collect()} == {2: "block", 3: "block", 4: "block"}


def test_given_redirects(spark, pages):
    redirects = spark.createDataFrame([("http://plain.info/", "http://hop.info/"), ("http://hop.info/", "http://bad.com/en/9"), (None, "http://bad.com/en/9"), ("x", "y")], "url string, target string")
    got = url_filter.judge(pages.where("page_id = 8"), redirects, html_col=None).collect()
    assert [r.verdict for r in got] == ["block"]
    assert [r.verdict for r in url_filter.judge(pages.where("page_id = 8"), html_col=None).collect()] == ["allow"]


def test_empty_table(pages):
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_relative_targets(spark):
    from pyspark.sql import functions as F

    cases = [("q", "http://a.b/c/d?x", "http://a.b/c/q"), ("/q", "https://a.b/c", "https://a.b/q"), ("//h/q", "https://a.b/c", "https://h/q"), ("?z", "http://a.b/c", "http://a.b/c?z"), ("#z", "http://a.b/c", None), ("q", "http://a.b", "http://a.b/q"), ("HTTP://x/y", "http://a.b", "HTTP://x/y")]
    df = spark.createDataFrame(cases, "t string, b string, want string").select(url_filter.resolved(F.col("t"), F.col("b")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_dots_quotes_and_long_tags(spark):
    rows = [
        (1, "http://a.example/x/y/z?q", '<link rel="canonical" href="../w">'), (2, "http://a.example/x/", '<meta http-equiv=refresh content="0; url=./v/./u/.." >'),
        (3, "http://a.example/p", '<link title="a > b" data-x="' + "y" * 9000 + '" rel=canonical href="/q">'), (4, "http://a.example/r", '<link rel="canonical" href="/../../s#f">'),
    ]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, target string")
    got = {r.url: r.target for r in url_filter.alias_links(docs).collect()}
    assert got == {"http://a.example/x/y/z?q": "http://a.example/x/w", "http://a.example/x/": "http://a.example/x/v/", "http://a.example/p": "http://a.example/q", "http://a.example/r": "http://a.example/s#f"}
    judged = url_filter.judge(docs.union(docs)).collect()
    assert len(judged) == 8 and {r.verdict for r in judged} == {"allow"}
