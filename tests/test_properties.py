"""Properties of the leaf scores against a plain-Python brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortfold import BM25, Leaf, TfIdf, score_leaves
from cohortfold.operators.records import RecordMapping, map_records

K1, B = 1.2, 0.75
CODES = ["a", "b", "c", "d", "e", None]


def random_rows(seed, n_rows=400, n_patients=40, n_records=300):
    rng = random.Random(seed)
    rows = []
    for _ in range(n_rows):
        p = f"p{rng.randrange(n_patients)}"
        r = f"r{rng.randrange(n_records)}"  # record ids repeat on purpose
        rows.append((p, r, rng.choice(CODES), rng.random() * 100))
    return rows


def brute_force(rows, tests):
    """Expected {(criterion, patient): (tf, doc_len, score)} and evidence sets."""
    doc_len = Counter(p for p, _, _, _ in rows)
    n = len(doc_len)
    avg = sum(doc_len.values()) / n
    tf = Counter()
    evidence = defaultdict(set)
    for p, r, code, val in rows:
        for key, test in tests.items():
            if test(code, val):
                tf[(key, p)] += 1
                evidence[(key, p)].add(r)
    df = Counter(k for k, _ in tf)
    out = {}
    for (k, p), t in tf.items():
        idf = math.log((n - df[k] + 0.5) / (df[k] + 0.5) + 1)
        dl = doc_len[p]
        out[(k, p)] = (t, dl, idf * t * (K1 + 1) / (t + K1 * (1 - B + B * dl / avg)))
    return out, evidence, doc_len


def frame(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, "p string, r string, code string, val double").repartition(partitions)
    return map_records(df, RecordMapping("p", "r", {"code": "code", "value": "val"}))


def leaves_and_tests(k):
    leaves, tests = {}, {}
    for i in range(k):
        code = CODES[i % 5]
        lo = (i * 7) % 60
        key = f"L{i:03d}"
        leaves[key] = Leaf(key, "x", f"code = '{code}' AND value >= {lo}")
        tests[key] = lambda c, v, code=code, lo=lo: c == code and v >= lo
    return leaves, tests


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_match_brute_force(spark, seed):
    rows = random_rows(seed)
    leaves, tests = leaves_and_tests(4)
    expected, evidence, _ = brute_force(rows, tests)
    part = score_leaves(frame(spark, rows), leaves, materialize=None)
    got = {(r.criterion_uid, r.patient_uid): r for r in part.scores.collect()}
    assert set(got) == set(expected)
    for key, (tf, dl, score) in expected.items():
        assert got[key].tf == tf and got[key].doc_len == dl
        assert got[key].score == pytest.approx(score, rel=1e-12)
    ev = Counter((r.criterion_uid, r.patient_uid) for r in part.evidence.collect())
    assert ev == Counter({k: len(v) for k, v in evidence.items()})


@pytest.mark.parametrize("k", [1, 30, 200])
def test_long_and_wide_plans_agree(spark, k):
    rows = random_rows(7, n_rows=300)
    leaves, tests = leaves_and_tests(k)
    records = frame(spark, rows)
    long = score_leaves(records, leaves, plan="long", materialize=None).scores
    wide = score_leaves(records, leaves, plan="wide", materialize=None).scores
    cols = ["criterion_uid", "patient_uid", "tf", "doc_len", F.round("score", 9).alias("s")]
    assert sorted(long.select(cols).collect()) == sorted(wide.select(cols).collect())
    expected, _, _ = brute_force(rows, tests)
    assert long.count() == len(expected)


def test_invariants(spark):
    rows = random_rows(3, n_rows=600)
    leaves, _ = leaves_and_tests(5)
    part = score_leaves(frame(spark, rows), leaves, materialize=None)
    stats = part.stats.first()
    assert stats.n_docs == len({r[0] for r in rows})
    assert part.doc_len.agg(F.sum("doc_len")).first()[0] == len(rows)
    idf_max = {
        r.criterion_uid: math.log((stats.n_docs - r.doc_freq + 0.5) / (r.doc_freq + 0.5) + 1)
        for r in part.doc_freq.collect()
    }
    assert all(r.doc_freq <= stats.n_docs for r in part.doc_freq.collect())
    ev = Counter((r.criterion_uid, r.patient_uid) for r in part.evidence.collect())
    for r in part.scores.collect():
        assert r.score > 0
        assert r.score < idf_max[r.criterion_uid] * (K1 + 1)
        assert 1 <= r.tf <= r.doc_len
        assert ev[(r.criterion_uid, r.patient_uid)] <= r.tf


def test_partitioning_does_not_matter(spark):
    rows = random_rows(5)
    leaves, _ = leaves_and_tests(3)
    cols = ["criterion_uid", "patient_uid", "tf", F.round("score", 9).alias("s")]
    a = score_leaves(frame(spark, rows, 1), leaves, materialize=None).scores.select(cols).collect()
    b = score_leaves(frame(spark, list(reversed(rows)), 7), leaves, materialize=None).scores.select(cols).collect()
    assert sorted(a) == sorted(b)


def test_bm25_monotonic(spark):
    # Patient q has 1..5 matches out of 10 records; others fix N and avgdl.
    rows = [("q", f"m{i}", "a" if i < 5 else "z", 1.0) for i in range(10)]
    rows += [(f"o{j}", f"o{j}", "z", 1.0) for j in range(10)]
    rows += [("short", "s1", "a", 1.0), ("long", "l1", "a", 1.0)]
    rows += [("long", f"l{i}", "z", 1.0) for i in range(2, 20)]
    leaf = {"A": Leaf("A", "x", "code = 'a'")}
    got = {r.patient_uid: r.score for r in score_leaves(frame(spark, rows), leaf, materialize=None).scores.collect()}
    # Same tf (1), longer document -> lower score.
    assert got["short"] > got["long"]
    # Higher tf at a fixed length raises the score.
    rows2 = rows + [("q", "extra", "a", 1.0)]
    got2 = {r.patient_uid: r.score for r in score_leaves(frame(spark, rows2), leaf, materialize=None).scores.collect()}
    assert got2["q"] > got["q"] * 0.99


def test_parameters_and_custom_scorer(spark):
    rows = random_rows(11)
    leaves, tests = leaves_and_tests(2)
    expected, _, doc_len = brute_force(rows, tests)
    n = len(doc_len)
    df = Counter(k for k, _ in expected)
    got = {
        (r.criterion_uid, r.patient_uid): r.score
        for r in score_leaves(frame(spark, rows), leaves, scorer=TfIdf(), materialize=None).scores.collect()
    }
    for (k, p), (tf, _, _) in expected.items():
        assert got[(k, p)] == pytest.approx(tf * math.log(1 + n / df[k]))
    other = score_leaves(frame(spark, rows), leaves, scorer=BM25(k1=2.0, b=0.0), materialize=None)
    for r in other.scores.collect():
        tf = expected[(r.criterion_uid, r.patient_uid)][0]
        idf = math.log((n - df[r.criterion_uid] + 0.5) / (df[r.criterion_uid] + 0.5) + 1)
        assert r.score == pytest.approx(idf * tf * 3.0 / (tf + 2.0))


@pytest.mark.parametrize("k", [2, 30])
def test_scores_without_evidence_equal(spark, k):
    rows = random_rows(9, n_rows=500)
    leaves, _ = leaves_and_tests(k)
    records = frame(spark, rows)
    cols = ["criterion_uid", "patient_uid", "tf", "doc_len", F.round("score", 9).alias("s")]
    full = score_leaves(records, leaves, materialize=None).scores.select(cols).collect()
    lean = score_leaves(records, leaves, materialize=None, evidence=False)
    assert sorted(lean.scores.select(cols).collect()) == sorted(full)
    with pytest.raises(ValueError, match="evidence=False"):
        lean.evidence
