"""Near-duplicates by MinHash and sequential Bayesian verification.

1. Each document's set of word shingles gets a signature of minimum hashes.
   Documents with equal sets form a class, which its smallest doc_id stands
   for from here on.
2. Bands of the signature put class representatives into buckets. In each
   bucket all are compared with the smallest (the centre): a bucket of n gives
   n - 1 pairs, not n squared.
3. A pair's signatures are compared a batch of hashes at a time; once the
   posterior probability that the pair reaches the threshold falls below
   ``MISS``, the pair is dropped. Survivors are decided on their full sets.
4. Links make components. Where buckets connect documents of several components,
   pairs of different components are compared too, but only those that share
   one of the rare shingles which their cluster's centre lacks (see
   ``_open_pairs``): texts whose edits differ can be linked only through others.
5. Components are made again from all links.

A true link is missed only if no band of the pair agrees (below ``MISS`` by the
choice of bands) or if its posterior is below ``MISS``. Shingles are compared as
64-bit hashes, classes as 128-bit hashes of sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortfold.llm.components import components
from cohortfold.llm.shared import Scratch, map_arrow
from cohortfold.llm.words import gram_hashes, mix, slices, utf8, words

HASHES = 128
BATCH = 16
MISS = 1e-6

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_COLUMNS = 512


def bands(percent: int) -> tuple[int, int]:
    """(bands, rows of a band): the longest rows for which a pair at the threshold is missed below ``MISS``."""
    t = percent / 100
    rows = max(r for r in range(1, 17) if r == 1 or (1 - t**r) ** (HASHES // r) <= MISS)
    return HASHES // rows, rows


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; with fewer words than
    ``size`` the whole sequence is one shingle, without words there is none."""
    w = words(data, offsets, lower=True)
    hashes = w.hashes()
    grams = gram_hashes(hashes, size)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a:b - size + 1]))
        else:
            out.append(gram_hashes(hashes[a:b], b - a) if b > a else grams[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), _COLUMNS):
        np.minimum(least, (x[None, at:at + _COLUMNS] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return least


def _signed(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                sets = shingle_sets(*utf8(piece.column("text")), size)
                s1 = np.array([mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
                s2 = np.array([np.bitwise_xor.reduce(mix(~s)) if len(s) else 0 for s in sets], np.uint64)
                yield pa.record_batch([
                    piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                    pa.array([signature(s).tobytes() for s in sets], pa.binary()),
                ], names=["doc_id", "n", "s1", "s2", "signature"])

    return sign


def _banded(count: int, rows: int):
    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.stack([np.frombuffer(b.as_buffer(), np.uint32) for b in batch.column("signature")]) if batch.num_rows else np.zeros((0, HASHES), np.uint32)
            keys = np.empty((batch.num_rows, count), np.uint64)
            for k in range(count):
                h = np.full(batch.num_rows, k + 1, np.uint64)
                for r in range(rows):
                    h = mix(h + sig[:, k * rows + r])
                keys[:, k] = h
            again = pa.array(np.repeat(np.arange(batch.num_rows), count))
            yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), batch.column("doc_id").take(again), batch.column("n").take(again)], names=["band", "doc_id", "n"])

    return band


def _setted(size: int):
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                sets = shingle_sets(*utf8(piece.column("text")), size)
                yield pa.record_batch([
                    piece.column("doc_id"), pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
                ], names=["doc_id", "signature", "shingles"])

    return collect


@lru_cache(maxsize=4)
def _fewest(percent: int) -> list[int]:
    """For each batch end, the fewest equal hashes with which a pair goes on:
    with fewer, the posterior probability that its similarity reaches the
    threshold (from a uniform prior) is below ``MISS``."""
    grid = np.linspace(0, 1, 4001)[1:-1]
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(grid) + (n - m) * np.log1p(-grid)
        density = np.exp(log - log.max(axis=1, keepdims=True))
        reach = density[:, grid >= percent / 100].sum(axis=1) / density.sum(axis=1)
        out.append(int(np.argmax(reach > MISS)))
    return out


def _verified(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = lambda c: np.stack([np.frombuffer(b.as_buffer(), np.uint32) for b in batch.column(c)])
            equal = np.cumsum(matrix("signature_a") == matrix("signature_b"), axis=1, dtype=np.int32)
            na, nb = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
            open_ = np.ones(len(na), bool)
            for i, fewest in enumerate(_fewest(percent)):
                open_ &= equal[:, (i + 1) * BATCH - 1] >= fewest
            a, b = batch.column("shingles_a"), batch.column("shingles_b")
            linked = np.zeros(len(na), bool)
            for i in np.flatnonzero(open_).tolist():
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (a, b))
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                linked[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    return verify


def _sides(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the size, signature and shingles of both."""
    side = lambda k: candidates.select(*(F.col(c).alias(f"{c}_{k}") for c in ("n", "signature", "shingles")), F.col("doc_id").alias(k))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _verify(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with linked."""
    id_type = dict(pairs.dtypes)["a"]
    return map_arrow(_sides(pairs, candidates), _verified(percent), f"a {id_type}, b {id_type}, linked boolean")


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles a document has in common with its centre, and its others."""
    for batch in batches:
        common, private = [], []
        for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            inside = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
            common.append(int(inside.sum()))
            private.append(x[~inside].view(np.int64))
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(private, pa.list_(pa.int64()))],
                              names=["doc_id", "centre", "common", "private"])


def _mixed_clusters(scratch: Scratch, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, centre, label, of_centre) of the documents that buckets connect
    (``edges``: a, b) where they are of several components so far. The centre
    of such a cluster is the centre of most of its documents' buckets."""
    cluster = components(scratch, edges, "clusters")
    label = F.coalesce("label", "node").alias("label")
    named = labels.select("node", F.col("label"))
    member = scratch.write(cluster.withColumnRenamed("label", "cluster").join(named, "node", "left").select("node", "cluster", label), "clustered")
    mixed = member.groupBy("cluster").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("cluster")
    member = member.join(mixed, "cluster")
    degree = edges.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    centre = member.join(degree, "node").groupBy("cluster").agg(F.max(F.struct("degree", "node", "label")).alias("c"))
    centre = centre.select("cluster", F.col("c.node").alias("centre"), F.col("c.label").alias("of_centre"))
    return member.join(centre, "cluster").select(F.col("node").alias("doc_id"), "centre", "label", "of_centre")


def _open_pairs(scratch: Scratch, member: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``member`` (doc_id, centre, label, of_centre) with one
    centre and different labels that may be linked.

    The shingles that a pair shares are some that the centre has too, at most
    the smaller of what each has in common with it, and others. Where the first
    alone could do, both have nearly all their shingles in the centre. Else
    they share one of their others, and by the prefix principle one of the
    first few of each, the rarest in the cluster going first; so they meet in
    a join on (centre, shingle) that few rows enter. One of the two is not in
    the centre's component, so a cluster without outsiders gives no pair.
    """
    id_type = dict(member.dtypes)["centre"]
    both = _sides(member.select(F.col("doc_id").alias("a"), F.col("centre").alias("b")), candidates)
    apart = map_arrow(both, _apart, f"doc_id {id_type}, centre {id_type}, common long, private array<long>")
    known = member.join(apart, ["doc_id", "centre"]).withColumn("outside", F.col("label") != F.col("of_centre")).drop("of_centre")
    known = scratch.write(known.withColumn("n", F.col("common") + F.size("private")), "known")
    # A linked document shares percent of this one's shingles at least, and so many of those that the centre lacks.
    need = F.greatest(F.lit(1), F.ceil(F.lit(percent) * F.col("n") / 100).cast("long") - F.col("common"))
    row = known.select("doc_id", "centre", "label", "common", "n", "outside", need.alias("need"), F.explode("private").alias("shingle"))
    rare = row.groupBy("centre", "shingle").agg(F.count(F.lit(1)).alias("holders"))
    order = Window.partitionBy("doc_id", "centre").orderBy("holders", "shingle")
    row = row.join(rare, ["centre", "shingle"]).withColumn("place", F.row_number().over(order))
    first = row.filter((F.col("place") <= F.col("n") - F.col("common") - F.col("need") + 1) & (F.col("holders") > 1))
    first = scratch.write(first.drop("need", "holders", "place"), "first_shingles")
    sizes = F.col("x.n") + F.col("y.n")
    reach = lambda shared: (100 + percent) * shared >= percent * sizes
    same = F.col("x.centre") == F.col("y.centre")
    alike = (F.col("x.label") != F.col("y.label")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    inner = F.least("x.common", "y.common")
    most = inner + F.least(F.col("x.n") - F.col("x.common"), F.col("y.n") - F.col("y.common"))
    pair = [F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")]
    inside = known.drop("private").filter(f"100 * common >= {percent} * n")
    small = inside.filter("outside").alias("x").join(inside.alias("y"), same & alike & reach(inner)).select(*pair)
    meet = same & (F.col("x.shingle") == F.col("y.shingle"))
    others = first.filter("outside").alias("x").join(first.alias("y"), meet & alike & reach(most)).select(*pair)
    return small.unionByName(others).distinct()


def find_groups(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their
    sets of ``shingle_words``-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z
    lower-cased). component_id is the smallest doc_id reachable; ``kept`` says
    that it is the row's own. A document without words (null or empty text) is
    linked with nothing. Rows that repeat a doc_id are one document: with equal
    texts they are the same row twice, with different texts the document has
    the links of either. A null doc_id is linked with nothing. Other columns
    are not read. No documents: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    id_type = docs.dtypes[0][1]
    signed = map_arrow(docs, _signed(shingle_words), f"doc_id {id_type}, n long, s1 long, s2 long, signature binary")
    signed = scratch.write(signed, "signed")
    classes = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"))
    classes = scratch.write(classes, "classes")
    count, rows = bands(percent)
    chosen = signed.join(classes, ["doc_id", "n", "s1", "s2"]).select("doc_id", "n", "signature").distinct()
    banded = scratch.write(map_arrow(chosen, _banded(count, rows), f"band long, doc_id {id_type}, n long"), "banded")
    centres = banded.groupBy("band").agg(F.min("doc_id").alias("centre"), F.min_by("n", "doc_id").alias("n_centre"), F.count(F.lit(1)).alias("size"))
    shared = scratch.write(banded.join(centres.filter("size > 1").drop("size"), "band"), "shared")
    scratch.drop("banded")
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    scratch.tidy()

    wanted = shared.select("doc_id").distinct()
    texts = map_arrow(docs.join(wanted, "doc_id"), _setted(shingle_words), f"doc_id {id_type}, signature binary, shingles binary")
    candidates = scratch.write(texts.withColumn("n", (F.length("shingles") / 8).cast("long")).filter("n > 0"), "candidates")
    scratch.tidy()

    pairs = shared.filter((F.col("doc_id") != F.col("centre")) & fits(F.col("n"), F.col("n_centre")))
    pairs = pairs.select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct()
    verified = scratch.write(_verify(pairs, candidates, percent), "verified")
    scratch.tidy()
    links = verified.filter("linked").select("a", "b")
    labels = scratch.write(components(scratch, links, "first"), "labels")

    edges = shared.filter(F.col("doc_id") != F.col("centre")).select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct()
    member = scratch.write(_mixed_clusters(scratch, scratch.write(edges, "edges"), labels), "members")
    rest = scratch.write(_open_pairs(scratch, member, candidates, percent), "rest")
    if not rest.isEmpty():
        more = scratch.write(_verify(rest, candidates, percent).filter("linked").select("a", "b"), "more")
        if not more.isEmpty():
            labels = scratch.write(components(scratch, links.unionByName(more), "second"), "all_labels")
    scratch.drop("candidates", "shared")
    scratch.tidy()

    light = signed.select("doc_id", "n", "s1", "s2")
    stands = classes.withColumnRenamed("doc_id", "stand").join(labels.withColumnRenamed("node", "stand"), "stand", "left")
    stands = stands.select("n", "s1", "s2", F.coalesce("label", "stand").alias("component_id"))
    found = light.join(stands, ["n", "s1", "s2"], "left")
    if_none = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), if_none.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
