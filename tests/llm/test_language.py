import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortfold.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    told = {r.doc_id: r for r in queries.op7_language(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(told) == len(docs) and all(told[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in docs)
    held = [told[r.doc_id].lang_pred == r.lang for r in docs if told[r.doc_id].held_out]
    assert np.mean(held) > 0.98 and all(0 <= r.score <= 1 for r in told.values())


def test_gradients_are_those_of_the_loss():
    # Against finite differences, with tanh itself: the training gradients are tanh's.
    rng = np.random.default_rng(0)
    gru = language.Gru((rng.standard_normal((6, 256)) * 0.3), rng.standard_normal((6, 2)) * 0.5)
    codes, mask = rng.integers(0, 4, (5, 3)), np.ones((5, 3))
    mask[3:, 1] = 0
    weight, kept = rng.standard_normal((5, 2, 3)), []
    whole = language._tanh
    language._tanh = lambda x, spare: np.tanh(x, out=x)
    try:
        gru.input, gru.state = gru.input.astype(np.float32), gru.state.astype(np.float32)
        gru.run(codes, mask, range(5), kept)
        got = gru.back(codes, mask, range(5), kept, weight)
        for value, gradient in zip((gru.input, gru.state), got):
            for at in [(0, 1), (3, 1), (5, 0)]:
                keep, ends = value[at], []
                for step in (1e-2, -1e-2):
                    value[at] = keep + step
                    ends.append((gru.run(codes, mask, range(5)) * weight).sum())
                value[at] = keep
                assert gradient[at] == pytest.approx((ends[0] - ends[1]) / 2e-2, abs=2e-2)
    finally:
        language._tanh = whole


def test_edges(spark):
    rows = [(i, "der die das und nicht " * 5 if i % 2 else "the and of that with " * 5, "de" if i % 2 else "en") for i in range(40)]
    rows += [(100, None, "en"), (101, "123 456", "en"), (102, "the of", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True), steps=60)
    assert model.languages == ["de", "en"]
    schema = "doc_id long, text string, lang string, score string, lang_pred int"
    more = [(1, None, "x", "s", 1), (2, "", None, None, None), (3, "12 !? 3", "x", "s", 1), (4, "und das nicht " * 30_000, "x", "s", 1), (5, "that", "x", "s", 1), (5, "that", "x", "s", 1), (None, "with the", "x", "s", 1)]
    out = language.predict(spark.createDataFrame(more, schema), model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in out) == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en"), (5, "en")]
    assert {r.score for r in out if r.lang_pred == "und"} == {0.0}
    empty = docs.limit(0)
    assert language.fit(empty, F.lit(True)) is None and language.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
