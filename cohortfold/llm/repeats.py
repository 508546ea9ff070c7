"""Substring dedup with repeated-phrase automata.

A window is ``size`` consecutive words of one document. Words covered by a
window that also starts earlier are removed.

1. Documents with equal words form a class; only its smallest doc_id goes on
   (in the others every window starts earlier), under a number in their order.
2. Each window has an anchor, its run of ``ANCHOR`` words of least hash; equal
   windows have equal anchors. One word in eight begins an anchor, so counting
   anchors costs an eighth of counting windows. Documents with an anchor that
   occurs twice are candidates.
3. Recurring windows are confirmed by counting the candidates' windows that
   have such an anchor; each gets its first place.
4. Confirmed passages are cut at anchors and dealt to shards by the anchor's
   hash, and so are the candidates' stretches of words. Each shard compiles an
   Aho-Corasick automaton over word numbers from its passages' windows and
   streams its stretches through it, which locates every occurrence on the
   words themselves. Shards have a bounded number of windows; one that many
   stretches visit is copied, one whose anchors have very many windows is
   split, so no anchor is too common.
5. Words under an occurrence that is not the first one are removed.

Windows are told apart by 64-bit hashes in step 3 only; step 4 compares words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortfold.llm.shared import Scratch, map_arrow
from cohortfold.llm.words import gram_hashes, slices, utf8, words

ANCHOR = 6
#: Windows in an automaton, and stretches that it streams, about.
SHARD_WINDOWS = 20_000
SHARD_STRETCHES = 50_000
_PIECE = 1 << 20


def _least_at(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in each run of ``width``."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        span += step
    return at


class _Windows:
    """The windows of some texts: ``first`` word, ``anchor`` place, ``hash`` and text ``of`` each."""

    def __init__(self, column: pa.Array, size: int):
        self.words = words(*utf8(column))
        hashes = self.words.hashes()
        first = self.words.first
        count = np.maximum(np.diff(first) - size + 1, 0)
        self.of = np.repeat(np.arange(len(count)), count)
        self.first = np.arange(int(count.sum())) + np.repeat(first[:-1] - (np.cumsum(count) - count), count)
        self.grams = gram_hashes(hashes, ANCHOR).view(np.int64)
        self.hashes, self.size = hashes, size
        if len(self.first):
            self.anchor = _least_at(gram_hashes(hashes, ANCHOR), size - ANCHOR + 1)[self.first]
        else:
            self.anchor = self.first

    def window_hashes(self, chosen: np.ndarray) -> np.ndarray:
        return gram_hashes(self.hashes, self.size).view(np.int64)[self.first[chosen]]

    def text(self, first: int, count: int) -> bytes:
        """``count`` words from word ``first`` on, joined by one space."""
        w = self.words
        return b" ".join(w.data[w.start[first]:w.end[first + count - 1]].tobytes().split())

    def runs(self, chosen: np.ndarray) -> list[tuple[int, int]]:
        """(place in ``chosen``, length) of each run of chosen neighbouring windows with one anchor."""
        if not len(chosen):
            return []
        new = np.ones(len(chosen), bool)
        new[1:] = (np.diff(chosen) != 1) | (np.diff(self.anchor[chosen]) != 0) | (np.diff(self.of[chosen]) != 0)
        at = np.flatnonzero(new)
        return list(zip(at.tolist(), np.diff(np.append(at, len(chosen))).tolist()))


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    ends = np.searchsorted(owner, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))


def _outlined(size: int):
    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", _PIECE):
                x = _Windows(piece.column("text"), size)
                new = np.ones(len(x.anchor), bool)
                new[1:] = (np.diff(x.anchor) != 0) | (np.diff(x.of) != 0)
                n = piece.num_rows
                yield pa.record_batch([
                    piece.column("doc_id"), piece.column("version"), pa.array(np.diff(x.words.first)),
                    pa.array([hashlib.sha256(x.words.joined(i)).hexdigest() for i in range(n)]),
                    _lists(x.grams[x.anchor[new]], x.of[new], n, pa.int64()),
                ], names=["doc_id", "version", "n_words", "sha", "anchors"])

    return outline


def _candidates(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, _Windows, np.ndarray]]:
    """Pieces of candidate documents (doc, text, anchors) with the windows whose anchor is listed."""
    for batch in batches:
        for piece in slices(batch, "text", _PIECE):
            x = _Windows(piece.column("text"), size)
            listed = piece.column("anchors").flatten()
            chosen = np.isin(x.grams[x.anchor], np.asarray(listed)) if len(x.anchor) else np.zeros(0, bool)
            yield piece, x, np.flatnonzero(chosen)


def _hashed(size: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x, chosen in _candidates(batches, size):
            value, of = x.window_hashes(chosen), x.of[chosen]
            order = np.lexsort((value, of))  # stable, so each window's first place leads
            value, of, chosen = value[order], of[order], chosen[order]
            new = np.ones(len(value), bool)
            new[1:] = (np.diff(value) != 0) | (np.diff(of) != 0)
            at = np.flatnonzero(new)
            chosen, of = chosen[at], of[at]
            yield pa.record_batch([
                pa.array(value[at]), pa.array(x.grams[x.anchor[chosen]]), piece.column("doc").take(pa.array(of)),
                pa.array(x.first[chosen] - x.words.first[of]), pa.array(np.diff(np.append(at, len(value)))),
            ], names=["window", "anchor", "doc", "start", "n"])

    return hashed


_STRETCH = "anchor long, doc long, start long, n int, words binary"


def _stretch_batch(piece: pa.RecordBatch, x: _Windows, chosen: np.ndarray) -> pa.RecordBatch:
    runs = x.runs(chosen)
    at = chosen[[a for a, _ in runs]] if runs else chosen[:0]
    of = x.of[at]
    return pa.record_batch([
        pa.array(x.grams[x.anchor[at]]), piece.column("doc").take(pa.array(of)), pa.array(x.first[at] - x.words.first[of]),
        pa.array([n for _, n in runs], pa.int32()),
        pa.array([x.text(f, n + x.size - 1) for f, (_, n) in zip(x.first[at].tolist(), runs)], pa.binary()),
    ], names=["anchor", "doc", "start", "n", "words"])


def _stretches(size: int):
    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x, chosen in _candidates(batches, size):
            yield _stretch_batch(piece, x, chosen)

    return stretches


def _passages(size: int):
    """Stretches of the windows at the listed ``starts`` of each document."""

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", _PIECE):
                x = _Windows(piece.column("text"), size)
                starts = piece.column("starts")
                of = np.repeat(np.arange(piece.num_rows), np.asarray(starts.value_lengths()))
                place = np.searchsorted(x.of, of) + np.asarray(starts.flatten())
                yield _stretch_batch(piece, x, np.sort(place))

    return passages


def _located(size: int):
    import ahocorasick

    names = ["doc", "start", "n"]

    def locate(passages: pa.Table, stretches: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        home, at = [], []
        for doc, start, n, text in zip(*(passages.column(c).to_pylist() for c in ("doc", "start", "n", "words"))):
            sequence = tuple([numbers.setdefault(w, len(numbers) + 1) for w in text.split(b" ")])
            for k in range(n):
                automaton.add_word(sequence[k:k + size], len(home))
                home.append(doc)
                at.append(start + k)
        found: list[tuple] = []
        if home:
            automaton.make_automaton()
            number = numbers.get
            for doc, start, text in zip(*(stretches.column(c).to_pylist() for c in ("doc", "start", "words"))):
                begin = end = -1
                for last, which in automaton.iter(tuple([number(w, 0) for w in text.split(b" ")])):
                    place = start + last - size + 1
                    if home[which] == doc and at[which] == place:
                        continue
                    if place != end:
                        if end > begin:
                            found.append((doc, begin, end - begin))
                        begin = place
                    end = place + 1
                if end > begin:
                    found.append((doc, begin, end - begin))
        columns = list(zip(*found)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    return locate


def _kept(size: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", _PIECE):
                w = words(*utf8(piece.column("text")))
                removed, shas, texts = [], [], []
                for i, runs in enumerate(piece.column("runs").to_pylist()):
                    own = w.of(i)
                    edge = np.zeros(len(own) + 1, np.int64)
                    for run in runs:
                        edge[run["start"]] += 1
                        edge[run["start"] + run["n"] + size - 1] -= 1
                    out = np.cumsum(edge[:-1]) > 0
                    text = b" ".join([x for x, o in zip(own, out.tolist()) if not o])
                    removed.append(int(out.sum()))
                    shas.append(hashlib.sha256(text).hexdigest())
                    texts.append(text)
                yield pa.record_batch([piece.column("doc"), pa.array(removed, pa.int64()), pa.array(shas), pa.array(texts, pa.binary()).cast(pa.string())],
                                      names=["doc", "n_removed", "kept_sha256", "kept"])

    return keep


def remove_repeats(docs: DataFrame, size: int = 20, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256
    (of the kept words joined by one space), and with ``with_text`` kept_text.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null or empty text has none.
    A word is removed if a window over it has its word sequence starting
    earlier too: in a smaller doc_id, or earlier in the same document. Windows
    are judged on the input. Rows that repeat a doc_id with the same words are
    one document told twice; with other words, they are documents of their own
    that follow one another in the order of ``xxhash64`` of their texts. A
    doc_id may have any type that has an order. Rows with a null doc_id are kept
    whole and not compared. Other columns are not read. No documents: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    id_type, key = docs.dtypes[0][1], ["doc_id", "version"]
    outline = map_arrow(docs, _outlined(size), f"doc_id {id_type}, version long, n_words long, sha string, anchors array<long>")
    outline = scratch.write(outline, "outline")
    classes = outline.filter("doc_id IS NOT NULL").groupBy("sha").agg(F.min(F.struct(*key)).alias("stand"))
    classes = scratch.write(classes.select("sha", "stand.*"), "classes")
    stands = outline.filter(f"n_words >= {size}").join(classes, ["sha", *key]).dropDuplicates(["sha", *key])
    # From here on a document is a number, which rises in the order of the documents.
    stands = stands.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("doc", F.monotonically_increasing_id())
    stands = scratch.write(stands.select("doc", *key, "anchors"), "stands")
    anchors = stands.select("doc", F.explode("anchors").alias("anchor"))
    counts = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counts = scratch.write(counts, "counts")
    listed = anchors.join(counts.select("anchor"), "anchor").groupBy("doc").agg(F.collect_set("anchor").alias("anchors"))
    listed = scratch.write(listed.join(stands.drop("anchors"), "doc"), "listed")
    scratch.drop("stands")
    scratch.tidy()
    candidates = scratch.write(docs.join(listed, key).dropDuplicates([*key, "doc"]), "candidates")
    scratch.tidy()

    hashed = map_arrow(candidates, _hashed(size), "window long, anchor long, doc long, start long, n long")
    confirmed = hashed.groupBy("window").agg(
        F.min("anchor").alias("anchor"), F.min_by("start", "doc").alias("start"), F.min("doc").alias("doc"), F.sum("n").alias("n")
    )
    confirmed = scratch.write(confirmed.filter("n > 1").drop("n"), "confirmed")
    scratch.tidy()
    starts = confirmed.groupBy("doc").agg(F.collect_list("start").alias("starts"))
    passages = map_arrow(candidates.select("doc", "text").join(starts, "doc"), _passages(size), _STRETCH)
    passages = scratch.write(passages, "passages")
    stretches = map_arrow(candidates, _stretches(size), _STRETCH)

    shards = max(1, -(-confirmed.count() // SHARD_WINDOWS))
    shard = F.pmod(F.col("anchor"), F.lit(shards)).cast("int").alias("shard")
    parts = confirmed.groupBy(shard).agg(F.ceil(F.count(F.lit(1)) / SHARD_WINDOWS / 2).cast("int").alias("parts"))
    copies = counts.groupBy(shard).agg(F.ceil(F.sum("n") / SHARD_STRETCHES).cast("int").alias("copies"))
    plan = scratch.write(parts.join(copies, "shard"), "shards")
    deal = lambda n: F.pmod(F.xxhash64("doc", "start"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    passages = passages.withColumn("shard", shard).join(plan, "shard")
    passages = passages.withColumn("part", deal("parts")).withColumn("copy", each("copies"))
    stretches = stretches.withColumn("shard", shard).join(plan, "shard")
    stretches = stretches.withColumn("copy", deal("copies")).withColumn("part", each("parts"))
    place, columns = ["shard", "part", "copy"], ["doc", "start", "n", "words"]
    located = passages.select(*place, *columns).groupBy(*place).cogroup(stretches.select(*place, *columns).groupBy(*place)).applyInArrow(
        _located(size), "doc long, start long, n long"
    )
    located = scratch.write(located, "located")
    scratch.drop("passages", "confirmed", "counts")
    scratch.tidy()

    runs = located.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    changed = map_arrow(candidates.select("doc", "text").join(runs, "doc"), _kept(size), "doc long, n_removed long, kept_sha256 string, kept string")
    if not with_text:
        changed = changed.drop("kept")
    changed = scratch.write(changed.join(listed.drop("anchors"), "doc").drop("doc"), "changed")
    scratch.drop("candidates", "located", "listed")
    scratch.tidy()

    of_class = classes.select("sha", F.col("doc_id").alias("stand"), "version").join(changed.withColumnRenamed("doc_id", "stand"), ["stand", "version"], "left")
    found = outline.drop("anchors").join(of_class.withColumnRenamed("version", "stand_version"), "sha", "left")
    here = F.col("doc_id").isNotNull()
    copy = here & (F.col("doc_id") > F.col("stand")) & (F.col("n_words") >= size)
    none = hashlib.sha256(b"").hexdigest()
    out = found.select(
        *key, "n_words",
        F.when(copy, F.col("n_words")).when(here, F.coalesce("n_removed", F.lit(0))).otherwise(0).alias("n_removed"),
        F.when(copy, none).when(here, F.coalesce("kept_sha256", "sha")).otherwise(F.col("sha")).alias("kept_sha256"),
        *([F.when(copy, "").when(here, F.col("kept")).alias("kept_text")] if with_text else []),
    )
    if with_text:
        whole = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)")), " ")
        whole = docs.select(F.col("doc_id").alias("whole_id"), F.col("version").alias("whole_version"), whole.alias("whole")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("whole_id")) & (F.col("version") == F.col("whole_version"))
        out = out.join(whole, same, "left").withColumn("kept_text", F.coalesce("kept_text", "whole")).drop("whole_id", "whole_version", "whole")
    return out.drop("version")
