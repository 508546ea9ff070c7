import math

import brute
import pytest

from cohortfold.llm import near_dup
from cohortfold.llm.components import components
from cohortfold.llm.shared import Scratch

SF = "/root/testdata/sf0.001"


def groups(spark, rows, size=3, percent=85, schema="doc_id long, text string"):
    found = near_dup.find_groups(spark.createDataFrame(rows, schema), size, percent).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in found}


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    # Chains: each next text has one more changed word, so that ends are linked only through the middle.
    base = [f"w{i}" for i in range(60)]
    docs += [(10_000 + k, " ".join([f"x{i}" if i < 2 * k else w for i, w in enumerate(base)])) for k in range(8)]
    docs += [(20_000 + k, " ".join([*base[20:], *[f"tail{k}{i}" for i in range(3 + k)]])) for k in range(6)]
    assert groups(spark, docs) == brute.near_dup(docs, 3, 85)


def test_pipeline_threshold(spark):
    base = [f"v{i}" for i in range(50)]
    docs = [(k, " ".join([*base[: 50 - k], *[f"n{k}{i}" for i in range(k)]])) for k in range(12)]
    assert groups(spark, docs, 5, 80) == brute.near_dup(docs, 5, 80)


def test_many_near_copies_and_strangers_of_one_bucket(spark):
    base = [f"b{i}" for i in range(80)]
    docs = [(k, " ".join([*base, f"own{k}"])) for k in range(120)]
    docs += [(500 + k, " ".join([*base[:62], *[f"s{k % 3}{i}" for i in range(16)], f"o{k}"])) for k in range(30)]
    assert groups(spark, docs) == brute.near_dup(docs, 3, 85)


def test_links_between_outsiders_only(spark):
    # Copies of one text with many edits each: outsiders of the centre's component, some of them linked through edits they share.
    base = [f"b{i}" for i in range(100)]

    def edited(k, places, word):
        return " ".join(f"{word}{i}" if i in places else w for i, w in enumerate(base))

    docs = [(k, edited(k, {k % 50}, f"e{k}x")) for k in range(40)]
    docs += [(100 + k, edited(k, set(range(2 * (k % 5), 100, 12)), f"s{k % 5}x") + f" t{k}") for k in range(25)]
    docs += [(200 + k, " ".join(base[: 84 + k % 4]) + f" u{k}") for k in range(8)]
    want = brute.near_dup(docs, 3, 85)
    assert len({g for _, g in want.values()}) > 3 and groups(spark, docs) == want


def test_edges(spark):
    long = " ".join(f"word{i % 5000}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "two words"), (7, long), (8, long), (8, long), (9, "Two  WORDS"), (10, "É é"), (11, "é É")]
    found = groups(spark, rows)
    assert found == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (5000, 7), 8: (5000, 7), 9: (1, 6), 10: (1, 10), 11: (1, 11)}
    assert near_dup.find_groups(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)


def test_no_rows_null_ids_and_clashing_columns(spark):
    schema = "doc_id long, text string, n long, band string, label int, component_id string, kept int, signature int"
    assert near_dup.find_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f", 1, "x", 1, "q", 0, 0), (2, "a b c d e f", None, None, None, None, None, None), (None, "a b c d e f", 2, "y", 2, "z", 1, 1)]
    found = near_dup.find_groups(spark.createDataFrame(rows, schema))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found.collect()) == [(0, 0, True), (1, 1, True), (2, 1, False)]


def test_bayes_bounds_never_drop_pairs_at_the_threshold():
    for percent in (80, 85):
        count, rows = near_dup.bands(percent)
        assert count * rows <= near_dup.HASHES and (1 - (percent / 100) ** rows) ** count <= near_dup.MISS
        for k, fewest in enumerate(near_dup._fewest(percent)):
            n = near_dup.BATCH * (k + 1)
            # A pair at the threshold has fewer equal hashes with a small probability only.
            below = sum(math.comb(n, m) * (percent / 100) ** m * (1 - percent / 100) ** (n - m) for m in range(fewest))
            assert below < 20 * near_dup.MISS


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(100, 101), (101, 102), (5, 5)], []])
def test_components(spark, edges):
    found = components(Scratch(spark), spark.createDataFrame(edges, "a long, b long"), "t").collect()
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert {r.node: r.label for r in found} == {x: 100 if x >= 100 else 0 for x in nodes}


