"""Url rules against a loop over all rules, nested and awkward hosts, and ranges cut anywhere."""

import random

import pytest

from tablekin.llm import url_filters
from tablekin.llm.queries import URL_RULES

RULES = "host string, path string, verdict string"
PAGES = "page_id long, url string, host int, _row string"


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fitting = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if None not in (h, p, v)
               and (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fitting, default=None)
    return host, path, best and best[3], best[2] if best else default


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame([(i, url, 5, "r") for i, url in enumerate(urls)], PAGES).repartition(3)
    got = url_filters.judge(pages, spark.createDataFrame(rules, RULES), **more)
    assert got.columns == ["page_id", "url", "_row", "host", "path", "rule", "verdict"]
    return [tuple(r)[3:] for r in sorted(got.collect(), key=lambda r: r["page_id"])]


AWKWARD = [None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/",
           "http://example.com/EN/", "http://xexample.com/en/", "http://a.b.example.com/en/1", "http://a.www.example.com/en/1", "http://net/es/",
           "http://x.net/fr/#a", "http://x.net?/fr/", "http://x.net#/fr/", "http://.com/", "http://com./", "http://a..net/es/", "a://b://c.com/en/",
           "http://example.com:80/en/", "http://é.com/en/", "http://É.com/", "http://x.net/es/\n/é", "http://x.com/" + "a" * 100_000, "http://" + "a." * 5_000 + "com/",
           "http://a\x00.com/\x00", "http://a b.com/ "]


def test_given_rules_on_awkward_urls(spark):
    urls = AWKWARD + ["http://x.net/es/1"] * 50
    assert judged(spark, urls, URL_RULES) == [plain(url, URL_RULES) for url in urls]


def test_nested_rules_equal_a_plain_search(spark, monkeypatch):
    pick = random.Random(3)
    name = lambda: ".".join(pick.choices(["a", "b", "aa", "com", "é", ""], k=pick.randint(1, 4)))
    road = lambda: "/" + "".join(pick.choices("ab/é", k=pick.randint(0, 5)))
    rules = {(name(), pick.choice(["", "/", road(), road()])): pick.choice(["allow", "block"]) for _ in range(150)}
    rules = [(*rule, verdict) for rule, verdict in rules.items()]
    urls = [f"x://{name()}{road()}" for _ in range(800)]
    expected = [plain(url, rules) for url in urls]
    assert judged(spark, urls, rules) == expected
    monkeypatch.setattr(url_filters, "RANGE_POINTS", 20)
    assert judged(spark, urls, rules) == expected


def test_rules_of_any_kind(spark):
    rules = [("A.com", "/", "allow"), ("a.com", "/", "block"), ("", "/x", "block"), (None, "/", "block"), ("b", None, "block"), ("b", "/", None)]
    urls = ["http://a.com/", "http://q/x", None, "http://b/"]
    assert [r[2:] for r in judged(spark, urls, rules)] == [("a.com/", "block"), ("/x", "block"), (None, "allow"), (None, "allow")]
    assert {r[3] for r in judged(spark, urls, [], default="block")} == {"block"}
    assert judged(spark, [], URL_RULES) == []


def test_allowed_pages_keep_their_columns(spark):
    pages = spark.createDataFrame([(1, "http://x.com/", 5, "r"), (2, "http://example.com/en/", 5, "r")], PAGES)
    got = url_filters.allowed(pages, spark.createDataFrame(URL_RULES, RULES))
    assert [tuple(r) for r in got.collect()] == [(1, "http://x.com/", 5, "r")] and got.columns == pages.columns


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://x.com/", 5, "r")], PAGES)
    plan = url_filters.judge(pages, spark.createDataFrame(URL_RULES, RULES))._jdf.queryExecution().toString()
    assert not [word for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if word in plan]


@pytest.mark.parametrize(("host", "key"), [("", ""), ("com", "com."), ("a.com", "com.a."), ("com.", ".com."), (".com", "com..")])
def test_reversed_hosts(spark, host, key):
    frame = spark.createDataFrame([(host,)], "host string")
    assert frame.select(url_filters.reversed_host(frame["host"])).first()[0] == key
