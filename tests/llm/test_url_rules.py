"""URL rules against a plain loop over all rules."""

import random

import pytest
from compare import connect, difference

from heliograph.llm import queries, url_rules

URLS = [
    None, "", "no scheme", "://", "http://", "http:///path", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com",
    "http://example.com/en", "http://example.com/en/", "http://notexample.com/en/1", "http://a.b.c.d.net/es/q#f",
    "http://net/fr/", "http://x.net?/es/", "ftp://u@example.com:80/en/", "http://com/", "http://com./", "http://É.COM/é/",
    "http://a.example.com/en/?q=http://b.net/es/", "http://www.example.com/en/ü/" + "x" * 5000,
]


def plain(url, rules, otherwise="allow"):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [
        (len(h + p), len(h), h + p, v) for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else otherwise


def test_edges(spark):
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS + URLS[-3:])], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in
           url_rules.judge_urls(df, url_rules.rule_table(spark, queries.URL_RULES), salts=3).collect()}
    assert got == {i: plain(u, queries.URL_RULES) for i, u in enumerate(URLS + URLS[-3:])}


def test_nested_rules(spark):
    rng = random.Random(3)
    hosts = ["c", "b.c", "a.b.c", "x.c", "c.c"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/b"]
    rules = {(h, p) for h in hosts for p in paths if rng.random() < 0.6}
    rules = [(rng.choice(["allow", "block"]), h, p) for h, p in sorted(rules)]
    urls = [f"s://{rng.choice(['', 'z.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'x', '/b', '?q'])}" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in
           url_rules.judge_urls(df, url_rules.rule_table(spark, rules), otherwise="block").collect()}
    assert got == {i: plain(u, rules, "block") for i, u in enumerate(urls)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = url_rules.rule_table(spark, queries.URL_RULES)
    assert url_rules.judge_urls(pages, rules).count() == 0
    some = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_rules.judge_urls(some, rules.limit(0)).collect()[0].verdict == "allow"


@pytest.mark.parametrize("name", ["op8_url_rules"])
def test_query_equals_sql(spark, sf, name):
    assert difference(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE_SQL[name]) is None


def by_prefixes(url, table):
    host, path = plain(url, [])[:2]
    labels = host.split(".")
    fits = [
        (len(h + path[:n]), len(h), h + path[:n], table[h, path[:n]])
        for h in (".".join(labels[k:]) for k in range(len(labels))) for n in range(len(path) + 1) if (h, path[:n]) in table
    ]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_many_rules(spark):
    """A hundred thousand nested rules, a third of them of one host, and a third of all pages on it."""
    rng = random.Random(11)
    host = lambda: "busy.org" if rng.random() < 0.34 else f"h{rng.randrange(3000)}.{rng.choice(['com', 'org'])}"
    path = lambda n: "/" + "".join(rng.choice("abcdefgh/") for _ in range(rng.randrange(n)))
    table = {(host(), path(8)): rng.choice(["allow", "block"]) for _ in range(100_000)}
    urls = [f"s://{rng.choice(['', 'x.', 'y.z.'])}{host()}{path(14)}" for _ in range(5000)]
    rules = url_rules.rule_table(spark, [(v, h, p) for (h, p), v in table.items()])
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df, rules).collect()}
    assert got == {i: by_prefixes(u, table) for i, u in enumerate(urls)}


def test_rules_are_copied_to_busy_groups_only(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "POINTS", 100)
    rules = spark.createDataFrame([("busy", f"/{i}", "x") for i in range(50)] + [(f"g{i}", "/", "x") for i in range(300)], "group string, key string, entry string")
    points = spark.createDataFrame([("busy", f"/{i}") for i in range(1000)] + [(f"g{i}", "/1") for i in range(300)] + [("none", "/")], "group string, key string")
    rows = url_rules.sweep_rows(rules, points)
    assert rows.filter("turn = 1").count() == 1300
    assert rows.filter("turn = 0 AND group = 'busy'").groupBy("salt").count().count() == 10
    assert rows.filter("turn = 0").count() == 50 * 10 + 300


def test_stacks_over_block_bounds(spark):
    keys = ["", "a", "ab", "abc", "abd", "b", "ba", "bb", "bba", "bbab", "c"]
    rules = spark.createDataFrame([(g, k, g + k) for g in "xy" for k in keys], "group string, key string, entry string")
    want = {(g, k): [o for o in keys if k.startswith(o)] for g in "xy" for k in keys}
    for block in (1, 2, 3, 100):
        got = {(r.group, r.key): [s.key for s in r.stack] for r in url_rules.rule_stacks(rules, block).collect()}
        assert got == want


def test_clashing_columns(spark):
    names = ["page_id", "url", "_host", "_h", "_P", "key", "group", "salt", "stack", "path"]
    df = spark.createDataFrame([tuple([1, "http://a.net/es/1", *"12345678"]), tuple([2, None, *"12345678"])], names)
    got = url_rules.judge_urls(df, url_rules.rule_table(spark, [*queries.URL_RULES, ("block", None, "/"), ("block", "a.net", None)]))
    assert [c for c in got.columns if c not in ("host", "path", "rule", "verdict")] == [c for c in names if c != "path"]
    assert {(r.page_id, r.path, r.rule, r.key) for r in got.collect()} == {(1, "/es/1", "net/es/", "4"), (2, "", None, "4")}
