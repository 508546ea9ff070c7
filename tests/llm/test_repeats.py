import hashlib
import random

import brute
import pytest

from cohortfold.llm import repeats

SF = "/root/testdata/sf0.001"


def found(spark, rows, size=20, schema="doc_id long, text string"):
    out = repeats.remove_repeats(spark.createDataFrame(rows, schema), size).collect()
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out}


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(spark, docs) == brute.repeats(docs)


@pytest.mark.parametrize("shards", [(20_000, 50_000), (7, 5)])
def test_random_texts_of_few_words(spark, monkeypatch, shards):
    # Few distinct words make equal windows, equal anchors and shared prefixes common; small shards split and copy.
    monkeypatch.setattr(repeats, "SHARD_WINDOWS", shards[0])
    monkeypatch.setattr(repeats, "SHARD_STRETCHES", shards[1])
    rng = random.Random(3)
    passages = [" ".join(rng.choice("abcde") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    docs = [(i, " ".join(rng.choice([rng.choice(passages), rng.choice("fghij")]) for _ in range(rng.randint(1, 12)))) for i in range(80)]
    docs += [(90, "same " * 300), (91, "same " * 45), (92, docs[3][1]), (93, docs[3][1])]
    assert found(spark, docs) == brute.repeats(docs)


def test_edges(spark):
    none = hashlib.sha256(b"").hexdigest()
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, None), (2, ""), (3, "\t \n"), (4, "few  words"), (5, "few words"), (6, long), (7, "x " + long), (7, "x " + long)]
    out = found(spark, rows)
    assert out[1] == out[2] == out[3] == (0, 0, none)
    assert out[4] == out[5] == (2, 0, hashlib.sha256(b"few words").hexdigest())
    assert out[6][:2] == (120_000, 0) and out[7] == (120_001, 120_000, hashlib.sha256(b"x").hexdigest())


def test_no_rows_null_ids_and_clashing_columns(spark):
    schema = "doc_id long, text string, n int, anchor string, start string, words int, sha int, runs int"
    assert repeats.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(1, text, 1, "a", "b", 1, 1, 1), (2, text, None, None, None, None, None, None), (None, text, 1, "a", "b", 1, 1, 1)]
    out = repeats.remove_repeats(spark.createDataFrame(rows, schema), with_text=True)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    assert {r.doc_id: (r.n_removed, r.kept_text) for r in out.collect() if r.doc_id} == {1: (0, text), 2: (25, "")}
    assert [(r.n_removed, r.kept_text) for r in out.collect() if r.doc_id is None] == [(0, text)]


@pytest.mark.parametrize("kind", ["long", "string", "smallint", "decimal(9,0)"])
def test_repeated_ids_with_other_words(spark, kind):
    rng = random.Random(8)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(6)]
    rows = [(rng.randint(10, 30), " ".join([rng.choice(passages), rng.choice("xyz"), rng.choice(passages)])) for _ in range(80)]
    rows += [(10, rows[0][1].replace(" ", "  ")), (9, "tail " + passages[0]), (9, passages[0] + " " + passages[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text")
    order = [tuple(r) for r in docs.selectExpr("doc_id", "xxhash64(text)", "text").distinct().orderBy("doc_id", "xxhash64(text)").collect()]
    first, want = {}, {}
    for at, (_, _, text) in enumerate(order):
        first.setdefault(" ".join(text.split()), at)
    told = brute.repeats([(at, order[at][2]) for at in first.values()])
    for at, (doc, _, text) in enumerate(order):
        stand = first[" ".join(text.split())]
        n = len(text.split())
        own = told[stand] if order[stand][0] == doc else (n, n, hashlib.sha256(b"").hexdigest())
        want.setdefault((doc, n), []).append(own)
    times = {(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    assert times == {(str(doc), *own) for (doc, _), all_ in want.items() for own in all_}
    texts = repeats.remove_repeats(docs, with_text=True).collect()
    assert len(texts) == len(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in texts)


def test_least_at():
    rng = random.Random(1)
    import numpy as np

    for width in (1, 2, 3, 8, 15):
        v = np.array([rng.randint(0, 9) for _ in range(50)])
        assert repeats._least_at(v, width).tolist() == [i + int(v[i:i + width].argmin()) for i in range(len(v) - width + 1)]
