"""Url rules against a plain loop over all rules."""

import random

import pytest

from tracemill.llm.url_filter import url_filter


def judge(url, rules, default):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [r for r in rules if ("." + host).endswith("." + r[0]) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r)) if fits else None
    return host, path, best and best[0] + best[1], best[2] if best else default


@pytest.mark.parametrize("range_urls", [3, 40, 10_000])
def test_nested_rules_in_ranges(spark, range_urls):
    rng = random.Random(4)
    hosts = [".".join(rng.choice("abc") + rng.choice(["", "-x", "0"]) for _ in range(rng.randrange(1, 6))) for _ in range(150)] + ["hot.a.b"] * 150
    pages = [(i, f"http://{h}{rng.choice(['', '/', '/p/', '/p/q', '?x', '/q#'])}") for i, h in enumerate(hosts)] + [(None, None), (3, ""), (3, "")]
    rules = [(".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))), rng.choice(["/", "/p/", "/p/q"]), rng.choice(["allow", "block"])) for _ in range(40)]
    rules = list({r[:2]: r for r in rules}.values())
    got = url_filter(spark, spark.createDataFrame(pages, "page_id long, url string"), rules + rules[:3], "none", range_urls).collect()
    want = [(i, *judge(u, rules, "none")) for i, u in pages]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_one_label_for_all_urls(spark):
    """A rule of one label holds in every range, also where no boundary lies."""
    pages = spark.range(500).selectExpr("id as page_id", "concat('https://h', id, '.com/', id) as url")
    got = url_filter(spark, pages, [("com", "/", "block")], "none", 10)
    assert {(r.rule, r.verdict) for r in got.collect()} == {("com/", "block")} and got.count() == 500


def test_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (None, None)], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    got = url_filter(spark, pages, rules).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a.com", "/", None, "allow"), (None, "", "", None, "allow")]
