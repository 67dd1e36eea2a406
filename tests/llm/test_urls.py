"""URL verdicts against every rule by definition."""

from __future__ import annotations

import random
import time

from logfold.llm import urls
from logfold.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def judge(url, rules):
    host, path = parts(url)
    fits = [(len(h) + len(p), len(h), v == "block", v, h + p) for h, p, v in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[4], best[3] if best else "allow"


def check(spark, texts, rules):
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(texts)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, urls.rule_table(spark, rules)).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(texts)}


ODD = [None, "", "no scheme", "http://", "http:///p", "://Example.COM/en/x", "http://example.com", "http://example.com?x=/en/",
       "http://www.example.com/en/?q", "http://a.www.EXAMPLE.com/en/b#c", "http://notexample.com/en/", "http://x.net/es", "http://x.net/es/",
       "http://x..net/fr/a", "http://.net/es/", "http://net/es/1", "http://example.com/en/a://b.net/es/", "http://ÉXAMPLE.com/En/", "http://com/",
       "a\n://b.com/\n/en", "http://example.com/" + "a/" * 3000]


def test_rules_of_the_query(spark, sf):
    texts = ODD + [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    check(spark, texts, URL_RULES)


def test_random_rules_with_paths_that_end_anywhere(spark):
    rnd = random.Random(8)
    hosts = ["a.b.c", "b.c", "c", "x.b.c", "z"]
    paths = ["", "/", "/p", "/p/", "/p/q", "/p/q/r.html", "p"]
    rules = [(rnd.choice(hosts), rnd.choice(paths), rnd.choice(["allow", "block"])) for _ in range(15)]
    check(spark, [f"http://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', 'q', '/', '?x'])}" for _ in range(300)], rules)


def test_empty_tables_repeated_rows_and_bad_rules(spark):
    rules = urls.rule_table(spark, [(None, "/", "block"), ("", "/", "block"), ("com", None, "block"), ("com", "/", None)])
    df = spark.createDataFrame([(None, "http://a.com/x")] * 3, "page_id long, url string")
    assert {(r.rule, r.verdict) for r in urls.judge_urls(df, rules).collect()} == {(None, "allow")}
    assert urls.judge_urls(df, rules.where("verdict = 'x'")).count() == 3
    assert urls.judge_urls(df.where("url = 'x'"), rules).collect() == []


def test_very_long_addresses(spark):
    """Work is linear in the address: tens of thousands of slashes and labels take about as long as none."""
    texts = ["http://www.example.com/en/" + "a/" * 20_000, "http://" + "a." * 20_000 + "net/es/x", "http://x.net/fr/" + "/" * 20_000]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(texts * 4)], "page_id long, url string")
    rules = urls.rule_table(spark, URL_RULES)
    urls.judge_urls(df.limit(0), rules).collect()
    start = time.monotonic()
    got = urls.judge_urls(df, rules).collect()
    assert time.monotonic() - start < 20
    assert {(r.page_id % 3, r.rule, r.verdict) for r in got} == {(0, "www.example.com/en/", "allow"), (1, "net/es/", "block"), (2, "net/fr/", "block")}
    check(spark, texts, [("net", "/es/x", "block"), ("a.net", "", "allow"), ("com", "/" + "en/" + "a/" * 30, "block")])
