import random

import pytest

from candlemill.llm.url_filter import Rule, judge_urls

RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "a.example.org", "/es/x"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"), Rule("block", "whole.net", "")]


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
        host, rest = rest[:end].translate({i: i + 32 for i in range(65, 91)}), rest[end:]
        path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0] or [len(rest)])]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def test_against_plain_rules(spark):
    draw = random.Random(3)
    hosts = ["example.org", "A.Example.ORG", "b.a.example.org", "xorg", "org", "x.com", "com", "www.whole.net", "notexample.org", "ex.com:80", ""]
    urls = [f"{draw.choice(['http', 'https'])}://{draw.choice(hosts)}{draw.choice(['', '/', '/es/', '/es/x1', '/fr/a', '/de/', '/es', '?q=/de/', '#/fr/'])}" for _ in range(400)]
    urls += [None, "", "no scheme/de/", "http://", "a://b://c.org/", "http://É.org/ü?x", "http://" + "a." * 3000 + "org/" + "p" * 50_000]
    rows = [(i, u, "h", "k", "r") for i, u in enumerate(urls)] + [(0, urls[0], "h", "k", "r"), (None, urls[1], "h", "k", "r")]
    found = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, keys string, rule string"), RULES).collect()
    want = sorted([(r[0], *judge(r[1])) for r in rows], key=str)
    assert sorted([tuple(r) for r in found], key=str) == want
    plan = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, keys string, rule string"), RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Exchange" not in plan


def test_many_rules_are_exact(spark):
    rules = [Rule("block" if i % 3 else "allow", f"h{i}.net", "/p") for i in range(0, 3000, 7)]
    pages = spark.range(3000).selectExpr("id page_id", "concat('http://www.h', id, '.net/page') url")
    found = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, rules).collect()}
    assert found == {i: (f"h{i}.net/p", "block" if i % 3 else "allow") if i % 7 == 0 else (None, "allow") for i in range(3000)}


def test_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(pages, RULES).count() == 0 and judge_urls(pages, []).columns == ["page_id", "host", "path", "rule", "verdict"]


def test_a_filter_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr("candlemill.llm.url_filter.MOST_BITS", 64)
    with pytest.raises(ValueError):
        judge_urls(spark.range(5000).selectExpr("id page_id", "concat('http://h', id, '.net/') url"), [Rule("block", f"h{i}.net", "/") for i in range(40)]).count()
