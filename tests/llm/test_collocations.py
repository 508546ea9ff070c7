import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortfold.llm import collocations, queries
from cohortfold.llm.hat_trie import HatTrie, counted, phrase_hashes

SCHEMA = "lang string, text string"


def expected(rows, least, longest=5, top=2000):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                f.update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and f[p[i:j]] <= a}
        found = []
        for p, a in candidates.items():
            if p in gone:
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, total[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def run(spark, rows, least, schema=SCHEMA, **options):
    out = collocations.collocations(spark.createDataFrame(rows, schema), least=least, **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def prose(seed, texts, vocabulary=30):
    rng = random.Random(seed)
    words = ["a", "B", "the", "of"] * 4 + [f"w{i}" for i in range(vocabulary)] + ["über", "ÉTÉ", "x-y", "…"]
    ends = [" "] * 12 + [". ", ", ", "\n", "\t", "  ", "!?", " ; ", "\x0b", "\xa0", "\r\n"]
    return [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 80)))) for _ in range(texts)]


@pytest.mark.parametrize("limits", [{}, {"burst": 20, "most": 150}])
def test_against_plain_python(spark, limits):
    rows = prose(1, 150) + [("en", "one two three four five six. " * 7), ("en", "one two three four five six seven")] * 2
    want = expected(rows, 4)
    assert len(want) > 100 and any(len(r[2].split()) == 5 for r in want)
    assert run(spark, rows, 4, **limits) == want


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert sorted(tuple(r) for r in queries.op11_collocations(spark, sf).collect()) == expected(rows, 100)


def test_top_of_each_language_with_ties(spark):
    rows = [("en", ". ".join(f"p{i} q{i}" for i in range(40))) for _ in range(3)] + [("de", "x y. x y. x y. z")]
    assert run(spark, rows, 3, top=7) == expected(rows, 3, top=7)


def test_overlaps_repeats_and_arithmetic(spark):
    rows = [("en", "ha " * 50)] * 3 + [(None, "ha ha ha")] * 3 + [("und", "ha ha, ha")] * 2
    assert run(spark, rows, 5) == expected(rows, 5)


def test_nulls_empties_long_texts_and_clashing_names(spark):
    rows = [(None, None, 1, "z"), ("en", "", 1, "z"), ("en", " ,. \n", 1, "z"), ("en", "up Down " * 20_000 + "x" * 100_000, 1, "z"), ("en", "one", 1, "z")]
    found = run(spark, rows, 3, schema=SCHEMA + ", n int, word string")
    assert found == expected([r[:2] for r in rows], 3)
    assert run(spark, [], 3) == [] and run(spark, [(None, None)], 1) == [] and run(spark, [("en", "a b")], 2) == []


def test_one_language_does_not_count_for_another(spark):
    rows = [("en", "a b"), ("de", "a b"), ("fr", "a b")]
    assert run(spark, rows, 2) == []


def test_another_seed_when_a_frequent_id_stands_for_two_words(spark, monkeypatch):
    rows = prose(3, 40, vocabulary=5)
    want = expected(rows, 3)
    seeds = []
    whole = collocations._words

    def narrow(batch, seed):
        ids, *rest = whole(batch, seed)
        return (ids % np.uint64(3) + np.uint64(1) if seed == 0 else ids), *rest

    def count_words(seed):
        seeds.append(seed)
        import pyarrow as pa

        def count_(batches):
            for batch in batches:
                ids, _, found, langs = narrow(batch, seed)
                text = np.searchsorted(found.first, np.arange(len(ids)), side="right") - 1
                data = found.data.tobytes()
                yield pa.record_batch([pa.array([langs[t] for t in text], pa.string()), pa.array([data[a:b].decode() for a, b in zip(found.start, found.end)], pa.string()),
                                       pa.array(ids.view(np.int64)), pa.array(np.ones(len(ids), np.int64))], names=["lang", "word", "id", "n"])

        return count_

    monkeypatch.setattr(collocations, "_count_words", count_words)
    assert run(spark, rows, 3) == want and seeds == [0, 1]


def test_trie_against_a_counter():
    rng = np.random.default_rng(5)
    trie, want, got = HatTrie(burst=16, most=120), Counter(), Counter()
    spilled = 0
    for _ in range(60):
        rows = rng.zipf(1.4, (200, 3)).clip(1, 60).astype(np.uint64)
        want.update(map(tuple, rows.tolist()))
        for _, found, n in trie.add(*counted(phrase_hashes(rows), rows)):
            spilled += 1
            got.update({tuple(r): c for r, c in zip(found.tolist(), n.tolist())})
        assert trie.root.size <= 120
    for _, found, n in trie.drain():
        got.update({tuple(r): c for r, c in zip(found.tolist(), n.tolist())})
    assert got == want and spilled > 5


def test_equal_hashes_are_told_apart():
    rows = np.array([[1, 2], [3, 4], [1, 2], [3, 4], [5, 6]], np.uint64)
    hashes = np.array([9, 9, 9, 9, 1], np.uint64)
    h, r, n = counted(hashes, rows)
    assert r.tolist() == [[5, 6], [1, 2], [3, 4]] and n.tolist() == [1, 2, 2] and h.tolist() == [1, 9, 9]
