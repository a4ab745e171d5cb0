import random

import duckdb
import pytest

from quarry.llm import url_filter as u


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        rest = rest[n:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def cases():
    r = random.Random(6)
    labels = ["a", "b", "ab", "example", "net", "com", "WWW", "é", "", "com:80"]
    out = [None, "", "x", "://", "http://", "HTTP://Example.COM", "http://example.com/en/", "x?u=http://net/es/1", "a://\nb/c\nd?e", "http://notexample.com/en/"]
    for _ in range(1500):
        out.append("h://" + ".".join(r.choice(labels) for _ in range(r.randrange(0, 5))) + r.choice(["", "/", "?q", "#f"]) + "/".join(r.choice(["a", "b", "en", "es", ""]) for _ in range(r.randrange(4))) + r.choice(["", "?x=://", "#"]))
    return list(enumerate(out))


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(u, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(u, "INTERVAL_ROWS", 40)
    if not limit:
        monkeypatch.setattr(u, "BROADCAST_BYTES", 200)
    r = random.Random(7)
    rules = list({(h, p): (h, p, r.choice(["allow", "block"])) for h in ("com", "example.com", "a.com", "b.a.com", "net", "ab.net", "example", "a", "b.a") for p in ("/", "", "/a", "/en/", "/a/b") if r.random() < 0.7}.values())
    rows = cases()
    pages = spark.createDataFrame([(i, x, "h", "v") for i, x in rows], "page_id long, url string, key string, verdict string").repartition(3)
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in u.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: brute(x, rules) for i, x in rows}


def test_contract_rules_and_sql(spark):
    rows = cases()
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame(u.RULES, "host string, path string, verdict string")
    got = {x.page_id: tuple(x[1:]) for x in u.filter_urls(pages, rules).collect()}
    assert got == {i: brute(x, u.RULES) for i, x in rows}
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar)")
    c.executemany("insert into pages values (?, ?)", rows)
    assert {x[0]: tuple(x[1:]) for x in c.execute(f"select page_id, host, path, rule, verdict from ({u.oracle()})").fetchall()} == got
    assert u.filter_urls(pages.limit(0), rules).collect() == []
    assert {x.verdict for x in u.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
