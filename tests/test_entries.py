"""Leaves on the entries of array columns."""

import random

import pytest

from cohortfold import Leaf
from cohortfold.operators.matching import LeafMatcher, coded_counts, criteria_matches

SCHEMA = "patient_uid string, record_uid string, day int, `the lines` array<struct<code: string, value: double, at: struct<day: int>>>, more array<struct<code: string>>"


def rows(count=200, seed=3):
    rng = random.Random(seed)
    entry = lambda: rng.choice([None, (rng.choice([None, "a", "b", "c"]), rng.choice([None, 1.0, 5.0, 9.0]), rng.choice([None, (rng.randrange(9),)]))])
    lines = lambda: rng.choice([None, [], [entry() for _ in range(rng.randrange(6))], [entry() for _ in range(3)]])
    return [(f"p{i % 9}", f"r{i}", rng.choice([None, rng.randrange(9)]), lines(), rng.choice([None, [("a",), None]])) for i in range(count)]


def cases():
    """(SQL text, the same in Python over an entry and the record's day)."""
    return [
        ("entry.code = 'a' AND entry.value > 4", lambda e, d: e[0] == "a" and e[1] is not None and e[1] > 4),
        ("entry.code IN ('b', 'c') AND entry.at.day >= day", lambda e, d: e[0] in ("b", "c") and e[2] is not None and e[2][0] is not None and d is not None and e[2][0] >= d),
        ("entry.value IS NULL", lambda e, d: e[1] is None),
        ("entry.code = 'b' OR entry.value = 9", lambda e, d: e[0] == "b" or e[1] == 9),
    ]


def test_an_entry_passes_by_all_of_the_test(spark):
    data = rows()
    leaves, want = {}, set()
    for k, (text, holds) in enumerate(cases()):
        for least in (1, 2, 3):
            name = f"L{k}X{least}"
            leaves[name] = Leaf(name, "x", text, entry="the lines", entries=least)
            want |= {(name, r[1]) for r in data if sum(e is not None and holds(e, r[2]) for e in r[3] or ()) >= least}
    leaves["MORE"] = Leaf("MORE", "x", "entry.code = 'a'", entry="more")
    want |= {("MORE", r[1]) for r in data if r[4]}
    leaves["DAY"] = Leaf("DAY", "x", "day > 4")
    want |= {("DAY", r[1]) for r in data if r[2] is not None and r[2] > 4}
    df = spark.createDataFrame(data, SCHEMA)
    got = [(r[0], r[2]) for r in criteria_matches(df, leaves).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len({name for name, _ in want}) >= 10
    one_by_one = {(name, r[0]) for name, leaf in leaves.items() for r in df.where(leaf.condition()).select("record_uid").collect()}
    assert one_by_one == want


def test_one_pass_for_all_leaves_of_a_column(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    leaves = {f"L{k}": Leaf(f"L{k}", "x", f"entry.value > {k % 10} AND entry.code = 'a'", entry="the lines") for k in range(100)}
    matcher = LeafMatcher(df, leaves)
    assert matcher.patterns.columns == ["_bits_0", "_bits_1"] and not matcher.patterns.others
    plan = matcher.with_patterns()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2
    kept, counted = ({tuple(r) for r in coded_counts(df, leaves, keep).groupBy("patient_uid", "leaf").sum("n").collect()} for keep in (True, False))
    assert kept == counted and len(kept) > 9


def test_no_records(spark):
    leaves = {"L": Leaf("L", "x", "entry.code = 'a'", entry="the lines")}
    assert criteria_matches(spark.createDataFrame([], SCHEMA), leaves).count() == 0


@pytest.mark.parametrize("given", [{"codes": ["a"], "entry": "e"}, {"predicate": "x > 1", "entries": 2}, {"predicate": "entry.x > 1", "entry": "e", "entries": 0}])
def test_what_a_leaf_needs(given):
    with pytest.raises(ValueError):
        Leaf("a", "x", **given)
