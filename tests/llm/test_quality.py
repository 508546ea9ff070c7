import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cohortfold.llm import quality, queries

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    told = {r.doc_id: r for r in queries.op8_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(told) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for d, r in told.items())
    held = [(told[r.doc_id].score, told[r.doc_id].predicted, r.quality) for r in labels if told[r.doc_id].held_out]
    score, predicted, y = map(np.array, zip(*held))
    assert (predicted == y).mean() > 0.97 and predicted[y == 1].mean() > 0.99
    assert (score[y == 1][:, None] > score[y == 0]).mean() > 0.98


def prose(n, seed):
    rng = random.Random(seed)
    words = [a + b for a in ("pla", "wor", "ca", "sen", "num", "bo", "ti", "the") for b in ("in", "ds", "lm", "tence", "ber", "ok", "de", "m")]
    return " ".join(rng.choice(words) for _ in range(n))


def junk(n, seed):
    return " ".join(w.upper() + "!!" for w in prose(n, seed).split())


def small(spark):
    docs = [(i, prose(80, i)) for i in range(90)] + [(100 + i, junk(80, i)) for i in range(90)]
    labels = [(d, int(d < 100)) for d, _ in docs]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_edges(spark):
    docs, labels = small(spark)
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (7, 1), (9999, 0)], labels.schema))
    model = quality.fit(docs, labels, F.lit(True))
    schema = "doc_id long, text string, score string, label int, quality string"
    rows = [(1, None, "a", 1, "q"), (2, "", None, None, None), (3, prose(200_000, 500), "a", 1, "q"), (4, junk(90, 501), "a", 1, "q"), (4, junk(90, 501), "a", 1, "q")]
    more = spark.createDataFrame(rows, schema)
    told = sorted((r.doc_id, r.score) for r in quality.score(more, model).collect())
    assert [d for d, _ in told] == [1, 2, 3, 4, 4] and told[0][1] == told[1][1] > 0.5 and told[2][1] > 0.9 and told[3][1] == told[4][1] < 0.1
    kept = quality.keep(more, model, 0.3)
    assert kept.columns == more.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    assert quality.score(more.limit(0), model).count() == 0


def test_without_labels(spark):
    docs, labels = small(spark)
    for some in (labels.limit(0), labels.filter("quality = 1")):
        assert {r.score for r in quality.score(docs, quality.fit(docs, some, F.lit(True))).collect()} == {0.5}
    assert quality.fit(docs.limit(0), labels, F.lit(True)) == quality.QualityModel()


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.random(300)
    knots, scores = quality._isotonic(x, (rng.random(300) < x).astype(float), np.ones(300))
    assert knots == sorted(knots) and scores == sorted(scores)
