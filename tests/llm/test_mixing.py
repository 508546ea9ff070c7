import hashlib

import duckdb
from pyspark.sql import functions as F

from cohortfold.llm import mixing, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string"


def mix(spark, rows, weights=None, schema=SCHEMA, **more):
    docs = spark.createDataFrame(rows, schema)
    return docs, mixing.Mix(docs, {"lang": F.col("lang"), "source": F.col("source")}, weights or {}, **more)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.sql(queries.ORACLES["op9_mixing"])
    rows = queries.op9_mixing(spark, SF).select(want.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall())


def test_shortage_goes_to_siblings_before_ancestors(spark):
    # en has 1000 tokens (a 900, b 100), de 1000; equal weights and half the tokens: 500 each. b cannot take 250, so a takes 400.
    rows = [(i, "w " * 10, "en", "a" if i < 90 else "b") for i in range(100)] + [(100 + i, "w " * 10, "de", "c") for i in range(100)]
    _, m = mix(spark, rows, budget_ratio=(1, 2), max_epochs=1)
    assert {r._mix_source: r.alloc for r in m.plan.collect()} == {"a": 400, "b": 100, "c": 500}
    # With little German, English takes what German cannot.
    _, m = mix(spark, rows[:102], budget_ratio=(1, 2), max_epochs=1)
    assert {r._mix_source: r.alloc for r in m.plan.collect()} == {"a": 390, "b": 100, "c": 20}


def test_epochs_and_prefixes(spark):
    rows = [(i, "w " * (i % 7), "en" if i % 10 else "de", f"s{i % 3}") for i in range(300)]
    docs, m = mix(spark, rows, {"lang": {"de": 9}}, max_epochs=3, seed=5)
    plan = {(r._mix_lang, r._mix_source): r for r in m.plan.collect()}
    taken = {}
    for r in m.selection().collect():
        taken.setdefault((r.lang, r.source, r.epoch), {})[r.doc_id] = r.n_taken
    assert sum(r.alloc for r in plan.values()) > 0 and any(r.full_epochs == 3 for r in plan.values()) and any(r.rest for r in plan.values())
    for (lang, source), r in plan.items():
        leaf = {d: len(t.split()) for d, t, g, s in rows if (g, s) == (lang, source) and t.strip()}
        for e in range(r.full_epochs):
            assert taken.get((lang, source, e)) == leaf
        order = sorted(leaf, key=lambda d: (int(hashlib.md5(f"5:{r.full_epochs}:{d}".encode()).hexdigest()[:15], 16), d))
        want, left = {}, r.rest
        for d in order:
            if left <= 0:
                break
            want[d] = min(left, leaf[d])
            left -= want[d]
        assert taken.get((lang, source, r.full_epochs), {}) == want
    rows_out = m.apply(docs).collect()
    assert len(rows_out) == sum(len(x) for x in taken.values())


def test_text_ids_and_an_id_of_minus_one(spark):
    docs = [(f"d{i}", "w " * (i % 5 + 1), "en", "a") for i in range(50)] + [(None, "w w", "en", "a")]
    rows, m = mix(spark, docs, budget_ratio=(1, 2), max_epochs=1, schema="doc_id string, text string, lang string, source string")
    taken = m.selection().collect()
    assert sum(r.n_taken for r in taken) == sum(r.alloc for r in m.plan.collect()) and len(m.apply(rows).collect()) == len(taken)
    rows, m = mix(spark, [(None, "w " * 5, "en", "a"), (-1, "w " * 5, "en", "a")], budget_ratio=(1, 2), max_epochs=1)
    assert [r.n_taken for r in m.selection().collect()] == [5] and m.apply(rows).count() == 1


def test_edges(spark):
    schema = SCHEMA + ", tokens int, alloc string, n_tokens string, range int, key string, _mix_x int"
    docs, m = mix(spark, [], schema=schema)
    assert m.selection().count() == 0 and m.apply(docs).count() == 0 and m.apply(docs).columns == docs.columns
    extra = (1, "a", "b", 2, "k", 3)
    long = "w " * 200_000
    rows = [(1, None, "en", "a", *extra), (2, "", "en", "a", *extra), (3, "x", None, None, *extra), (4, "y z", "en", "a", *extra), (4, "y z", "en", "a", *extra), (None, "q", "en", "a", *extra), (6, long, "en", "c", *extra)]
    docs, m = mix(spark, rows, schema=schema, max_epochs=1)
    assert sorted((r.doc_id or 0, r.n_taken) for r in m.selection().collect()) == [(0, 1), (3, 1), (4, 4), (6, 200_000)]
    assert sorted(r.doc_id or 0 for r in m.apply(docs).collect()) == [0, 3, 4, 4, 6]
    _, m = mix(spark, rows, {"source": {"c": 0}}, schema=schema, max_epochs=1)
    assert 6 not in {r.doc_id for r in m.selection().collect()}
