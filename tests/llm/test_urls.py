"""URL filters against plain Python."""

import random
import re

from pyspark.sql import functions as F

from deployrisk.llm import urls
from deployrisk.llm.queries import BAD_LABELS, QUERIES, URL_RULES
from deployrisk.llm.urls import Rule


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, re.split(r"[?#]", rest[cut:])[0]


def plain_form(url):
    host, path = plain_parts(url)
    host = re.sub(r"(:80|:443)\Z", "", host.rsplit("@", 1)[-1])
    if not host:
        return None
    host = host.removeprefix("www.")
    path = re.sub(r"/index\.html?\Z", "/", path).rstrip("/").lstrip("/")
    asked = url.split("://", 1)[1].split("#")[0].partition("?")[2]
    kept = sorted(p for p in asked.split("&") if p and not re.fullmatch(r"(utm_.*|ref|fbclid|gclid)(=.*)?", p, re.S))
    return host + "/" + path + ("?" + "&".join(kept) if kept else "")


def plain_verdict(url, rules, forms):
    host, path = plain_parts(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        rule = max(fits, key=lambda r: len(r.name))
        return host, path, rule.name, rule.verdict
    return host, path, None, "block" if plain_form(url) in forms and plain_form(url) is not None else "allow"


ODD = [None, "", "no scheme", "http://", "http:///x", "HTTP://EXAMPLE.org", "http://example.org/es/", "https://a.b.example.org/en/1?x", "http://notexample.org/es/",
       "http://org/", "http://x.com/fr/a#b", "http://x.com?/de/", "http://x.com/de/://y.org/", "ftp://u:p@www.Bad.net:80/a/index.html?b=2&a=1&utm_x=3#t",
       "http://bad.net/a/?a=1&b=2", "http://bad.net/a?a=1", "http://x.com:443/de/q", "http://É.org/ünï", "a\nb://bad.net/a?a=1\n", "http://bad.net/" + "x" * 50000]


def test_verdicts_against_plain(spark):
    random.seed(3)
    hosts = ["bad.net", "www.bad.net", "m.bad.net", "example.org", "a.example.org", "x.com", "COM", "y.net:80", "org", ""]
    made = [f"{random.choice(['http', 'https', ''])}://{random.choice(hosts)}{random.choice(['', '/', '/es/', '/en/1', '/en/12', '/fr/', '/de/x', '/a/b//'])}"
            f"{random.choice(['', '?', '?ref=x', '?b=1&a=2', '?a=2&b=1&utm_s=1', '#top', '?#'])}" for _ in range(600)]
    every = ODD + made
    blocked = ["http://bad.net/a/b", "https://www.bad.net/?a=2&b=1", None, "junk", "http://y.net/en/1", "ftp://bad.net/a?b=2&a=1"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(every)], "page_id long, url string, host string, __x string")
    listed = spark.createDataFrame([(u,) for u in blocked], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, listed, URL_RULES).collect()}
    forms = {plain_form(u) for u in blocked} - {None}
    assert got == {i: plain_verdict(u, URL_RULES, forms) for i, u in enumerate(every)}
    assert {v[3] for v in got.values() if v[2] is None} == {"allow", "block"}
    assert urls.judge(pages, listed, URL_RULES).columns == ["page_id", "url", "__x", "host", "path", "rule", "verdict"]


def test_filter_lets_every_key_through_and_few_others(spark):
    keys = spark.range(20000).select(F.xxhash64("id").alias("key"))
    blocks = 20000 // urls.KEYS_PER_BLOCK
    asked = spark.range(100000).select("id", F.xxhash64("id").alias("__key"))
    found = urls.possible(asked, keys, blocks).groupBy((F.col("id") < 20000).alias("known")).agg(
        F.count("*").alias("n"), F.count_if("__possible").alias("through")).collect()
    counts = {r.known: (r.n, r.through) for r in found}
    assert counts[True] == (20000, 20000)
    assert counts[False][0] == 80000 and 0 < counts[False][1] < 800


def test_false_hits_are_removed(spark):
    """A filter of one full block lets everything through; the join still finds the listed ones alone."""
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.net/"), F.col("id")).alias("url"))
    listed = pages.filter("page_id % 10 = 0")
    old, urls.KEYS_PER_BLOCK = urls.KEYS_PER_BLOCK, 100000
    try:
        got = urls.judge(pages.union(pages), listed.union(listed), []).filter("verdict = 'block'").collect()
    finally:
        urls.KEYS_PER_BLOCK = old
    assert sorted(r.page_id for r in got) == sorted([*range(0, 300, 10)] * 2)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert urls.judge(none, some, URL_RULES).count() == 0
    assert urls.judge(some, none, [Rule("net", "/", "block")]).collect()[0].verdict == "block"
    assert urls.judge(some, none, []).collect()[0].verdict == "allow"
    assert urls.judge(some, some, []).collect()[0].verdict == "block"


def test_query_blocks_listed_hosts(spark, sf):
    got = QUERIES["op11_url_filter"](spark, sf).collect()
    assert got
    for r in got:
        bad = bool(set(r.host.split(".")) & set(BAD_LABELS))
        assert r.rule is not None or r.verdict == ("block" if bad else "allow")
