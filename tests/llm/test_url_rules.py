import random
import re

import duckdb

from cohortfold.llm import queries, url_rules

SF = "/root/testdata/sf0.01"


def brute(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.DOTALL)
    host, path = (m[1].translate({65 + i: 97 + i for i in range(26)}), m[2]) if m else ("", "")
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, default)))


def told(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = url_rules.apply_rules(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    want = con.sql(queries.ORACLES["op4_url_filters"])
    got = queries.op4_url_filters(spark, SF)
    rows = got.select(want.columns).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(want.fetchall(), key=str)


def test_nested_rules_random(spark):
    rng = random.Random(5)
    labels, parts = ["a", "b", "com", "co", "x-y", "1"], ["", "e", "en", "/", "n/", "é"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randint(1, n)))
    path = lambda: "/" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(3), path()) for _ in range(150))}.values())
    urls = [rng.choice(["http://", "HTTPS://"]) + host(4).upper() + rng.choice(["", path(), path() + "?q=/x", "#f"]) for _ in range(600)]
    out = told(spark, urls, rules)
    assert out == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_edges(spark):
    rules = [("net", "/", "block"), ("net", "/", "allow"), ("", "/", "block"), (None, "/", "block"), ("net", None, "allow")]
    urls = [None, "", "net/", "://", "x://net", "x://net/", "x://a.NET/p?q#f", "x://inet/", "x://net:80/", "a://b://net/", "x://É.net/", "x://net/\n/z", "x://" + "a." * 2000 + "net/" + "p" * 5000]
    assert told(spark, urls, rules) == {i: brute(u, [("net", "/", "block")]) for i, u in enumerate(urls)}


def test_no_rows_repeated_rows_and_clashing_columns(spark):
    schema = "page_id long, url string, host string, path int, key string, stack string, bucket int, copies string, verdict string"
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    assert url_rules.apply_rules(spark.createDataFrame([], schema), rules).count() == 0
    rows = [(1, "x://net/", "h", 1, "k", "s", 1, "c", "v")] * 3 + [(None, "x://net/", None, None, None, None, None, None, None), (2, None, "h", 1, "k", "s", 1, "c", "v")]
    pages = spark.createDataFrame(rows, schema)
    out = url_rules.apply_rules(pages, rules)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted((r.page_id or 0, r.verdict) for r in out.collect()) == [(0, "block"), (1, "block"), (1, "block"), (1, "block"), (2, "allow")]
    assert {r.verdict for r in url_rules.apply_rules(pages, rules.limit(0), default="block").collect()} == {"block"}
