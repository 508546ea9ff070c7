"""The hand-worked two-source fixture (FIXTURES.md section 2)."""

import pytest

from cohortfold import AllOf, AnyOf, Leaf, Not, RecordSource, run_cohort_job, score_leaves
from cohortfold.operators.records import RecordMapping, map_records

UID_A = "3f2B8c1e-9D4a-4e7b-8C21-5a6F0d9e1B37"
UID_B = "c7E1d2a4-6B3f-4a9c-9E05-1f2D3c4b5A68"
JOB = "a1b2c3d4-e5f6-4a1b-9c8d-0e1f2a3b4c5d"

ROWS_A = [
    ("p1", "r1", "A"),
    ("p1", "r2", "A"),
    ("p1", "r2", "A"),
    ("p1", "r3", "B"),
    ("p2", "r4", "A"),
    ("p2", "r5", "x"),
    ("p3", "r6", "x"),
]
ROWS_B = [("p1", "n1", "A"), ("p4", "n2", "A"), ("p4", "n3", "x")]


def leaves():
    return Leaf(UID_A, "dx", "code = 'A'"), Leaf(UID_B, "dx", "code = 'B'")


def sources(spark):
    mapping = RecordMapping("p", "r", {"code": "code"})
    a = map_records(spark.createDataFrame(ROWS_A, "p string, r string, code string"), mapping)
    b = map_records(spark.createDataFrame(ROWS_B, "p string, r string, code string"), mapping)
    return [RecordSource("a", "dx", a), RecordSource("b", "dx", b)]


def by_key(rows, *keys):
    return {tuple(r[k] for k in keys): r for r in rows}


EXPECTED = {
    ("a", "A", "p1"): (3, 4, 0.470004, 0.640536),
    ("a", "A", "p2"): (1, 2, 0.470004, 0.499176),
    ("a", "B", "p1"): (1, 4, 0.980829, 0.759034),
    ("b", "A", "p1"): (1, 1, 0.182322, 0.211109),
    ("b", "A", "p4"): (1, 2, 0.182322, 0.160443),
}
NAME = {UID_A.upper(): "A", UID_B.upper(): "B"}


@pytest.mark.parametrize("plan", ["long", "wide"])
@pytest.mark.parametrize("materialize", ["write", "persist", None])
def test_leaf_scores(spark, plan, materialize):
    la, lb = leaves()
    got = {}
    for src in sources(spark):
        part = score_leaves(
            src.records,
            {la.key: la, lb.key: lb},
            source_id=src.source_id,
            entity_type="dx",
            plan=plan,
            materialize=materialize,
        )
        for r in part.scores.collect():
            got[(r.source_id, NAME[r.criterion_uid], r.patient_uid)] = (r.tf, r.doc_len, r.score)
        part.release()
    assert set(got) == set(EXPECTED)
    for key, (tf, dl, _idf, score) in EXPECTED.items():
        assert got[key][0] == tf and got[key][1] == dl
        assert got[key][2] == pytest.approx(score, abs=1e-6)


def test_evidence_and_cohort(spark):
    la, lb = leaves()
    expected = {
        "all": {"p1": 1.184856, "p2": 0.0, "p4": 0.0},
        "any": {"p1": 1.184856, "p2": 0.499176, "p4": 0.160443},
        "all_not": {"p1": 0.0, "p2": 0.499176, "p4": 0.160443},
    }
    trees = {
        "all": AllOf(la, lb),
        "any": AnyOf(la, lb),
        "all_not": AllOf(la, Not(lb)),
    }
    for name, tree in trees.items():
        res = run_cohort_job(spark, sources(spark), tree, JOB)
        rows = {r.person_uid: r for r in res.cohort.collect()}
        assert set(rows) == set(expected[name]), name
        for p, score in expected[name].items():
            assert rows[p].score == pytest.approx(score, abs=2e-6), (name, p)
            assert rows[p].job_uid == JOB.upper()
        ev = res.evidence.collect()
        assert len(ev) == 6
        got = sorted((NAME[r.node_uid], r.person_uid, r.evidence_uid, round(r.score, 6)) for r in ev)
        assert got == sorted(
            [
                ("A", "p1", "r1", 0.640536),
                ("A", "p1", "r2", 0.640536),
                ("A", "p2", "r4", 0.499176),
                ("B", "p1", "r3", 0.759034),
                ("A", "p1", "n1", 0.211109),
                ("A", "p4", "n2", 0.160443),
            ]
        )
        res.release()


def test_merge_value(spark):
    la, lb = leaves()
    res = run_cohort_job(spark, sources(spark), AnyOf(la), JOB)
    rows = {r.person_uid: r.score for r in res.cohort.collect()}
    assert rows["p1"] == pytest.approx(0.851645 / 2, abs=1e-6)
    res.release()
