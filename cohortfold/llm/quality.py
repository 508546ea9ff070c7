"""Quality classifier by compression with zstandard dictionaries.

One dictionary is trained on good, one on bad labelled text. A text is
compressed in short chunks with each (short, so that it cannot become its own
dictionary), and the difference of the two sizes over the text's length is
turned into the probability of a good label by isotonic regression on labelled
texts that the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortfold.llm.shared import map_arrow
from cohortfold.llm.words import utf8

DICTIONARY_BYTES = 64 << 10
CHUNK = 1024
LEVEL = 3
#: Rows of each label that a fit takes, and characters of each.
SAMPLE = 3000
SAMPLE_CHARS = 8192
#: A text's difference is averaged with that of so many bytes of ordinary good text.
PRIOR_BYTES = 64


def _dictionary(texts: list[bytes]) -> bytes:
    parts = [t[i:i + 4 * CHUNK] for t in texts for i in range(0, len(t), 4 * CHUNK)]
    whole = b"".join(parts)[-DICTIONARY_BYTES:]
    if len(parts) >= 100:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
        except zstandard.ZstdError:  # too little or too uniform text to train on
            pass
    return whole


@dataclass
class QualityModel:
    good: bytes = b""
    bad: bytes = b""
    prior: float = 0.0
    knots: list[float] = field(default_factory=lambda: [0.0])
    scores: list[float] = field(default_factory=lambda: [0.5])

    def _compressor(self, dictionary: bytes) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))

    def differences(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(size with the bad dictionary - size with the good one) per byte."""
        good, bad = self._compressor(self.good).compress, self._compressor(self.bad).compress
        out, view = np.empty(len(offsets) - 1), memoryview(np.ascontiguousarray(data))
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            more = 0
            for at in range(a, b, CHUNK):
                chunk = view[at:min(b, at + CHUNK)]
                more += len(bad(chunk)) - len(good(chunk))
            out[i] = (more + PRIOR_BYTES * self.prior) / (b - a + PRIOR_BYTES)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.interp(self.differences(data, offsets), self.knots, self.scores)


def _isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots of a rising function through the weighted means of pooled neighbours."""
    blocks: list[list[float]] = []  # sum of weight, of weighted y, of weighted x
    for xi, yi, wi in sorted(zip(x.tolist(), y.tolist(), weight.tolist())):
        blocks.append([wi, wi * yi, wi * xi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return [b[2] / b[0] for b in blocks], [min(max(b[1] / b[0], 0.001), 0.999) for b in blocks]


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """A model from at most about ``sample`` rows of each label (0, 1).

    Rows of ``labels`` (doc_id, label) for which ``learn_from`` (over doc_id)
    holds are taken by a hash of doc_id, the share of each label such that
    about ``sample`` rows of it are expected; ``docs`` gives their texts, of
    which the first ``SAMPLE_CHARS`` characters are learned from. That bounds
    what reaches the driver. Null labels, ids and texts are left out. Where
    either label has no rows, every score is 0.5.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL")
    rows = rows.filter(learn_from).distinct()
    count = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(count) < 2:
        return QualityModel()
    share = {k: min(1.0, sample / n) for k, n in count.items()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.withColumn("place", place).filter(F.col("place") < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    texts = docs.select("doc_id", F.col("text")).filter("text <> ''")
    found = texts.join(F.broadcast(chosen), "doc_id")  # about 2 * sample rows
    found = found.select("label", "doc_id", F.xxhash64("doc_id").alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    found = sorted((r.h, r.doc_id, r.label, r.text.encode()) for r in found.collect())
    part = {(k, side): [t for i, (_, _, y, t) in enumerate(found) if y == k and (i % 5 < 3) == side] for k in (0, 1) for side in (True, False)}
    if not all(part.values()):
        return QualityModel()
    model = QualityModel(_dictionary(part[1, True]), _dictionary(part[0, True]))

    def differences(texts: list[bytes]) -> np.ndarray:
        offsets = np.cumsum([0, *map(len, texts)])
        return model.differences(np.frombuffer(b"".join(texts), np.uint8), offsets)

    model.prior = float(np.median(differences(part[1, False])))
    good, bad = differences(part[1, False]), differences(part[0, False])
    x, y = np.concatenate([good, bad]), np.concatenate([np.ones(len(good)), np.zeros(len(bad))])
    weight = np.concatenate([np.full(len(good), 1 / share[1]), np.full(len(bad), 1 / share[0])])
    model.knots, model.scores = _isotonic(x, y, weight)
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of each row's whole text; a null text counts as empty."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.score(*utf8(batch.column("text"))))], names=["doc_id", "score"])

    id_type = docs.select("doc_id").dtypes[0][1]
    return map_arrow(docs.select("doc_id", "text"), scored, f"doc_id {id_type}, score double")


def keep(docs: DataFrame, model: QualityModel, threshold: float) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose score is at least ``threshold``."""
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(*utf8(batch.column(at))) >= threshold))

    return map_arrow(docs, kept, docs.schema)
