"""Phrase collocations by HAT-trie counting.

Phrases are counted a length at a time. A phrase is as frequent as asked only
if both phrases that it holds of one word less are, so a pass counts just those
whose parts passed (a bitmap of set size tells which; where it errs, phrases
are counted in vain, never missed). In a pass each task counts its texts'
phrases in a HAT-trie of word ids and spills whole subtrees as sorted runs;
runs are shuffled by a phrase's first two words, its prefix partition, and
merged there as they stream by.

A word's id is a 64-bit hash of language and word. All distinct words are held
against each other: if a frequent id stands for two words, ids are made anew
with another seed. Phrases are compared by all their ids, so counts are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortfold.llm import hat_trie
from cohortfold.llm.hat_trie import HatTrie, counted, phrase_hashes
from cohortfold.llm.shared import Scratch, map_arrow, parallelism
from cohortfold.llm.words import Words, gram_hashes, mix, slices, utf8, words

LEAST = 100
LONGEST = 5
TOP = 2000
#: Bits of the map that tells frequent parts: 8 MB, whatever the input.
MAP_BITS = 26
#: Phrases in a row of a sorted run; prefix partitions for each shuffle partition.
RUN_PHRASES = 256
PREFIXES = 8
_SLICE_BYTES = 4 << 20
_ROW_WORDS = 4096
#: Rows that are worked on at a time: of ids, and of runs.
_ID_ROWS, _RUN_ROWS = 64, 256
# A-Z in lower case; what ends a piece becomes a line feed.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_LOWER[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 0x0A
_SIGN = np.uint64(1 << 63)


def _lang_code(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.md5(f"{seed}:{lang}".encode()).digest()[:8], "little")


def _words(batch: pa.RecordBatch, seed: int) -> tuple[np.ndarray, np.ndarray, Words, list[str]]:
    """Ids of the words of a batch (lang, text), which of them begin a piece, the words, and each text's lang."""
    data, offsets = utf8(batch.column("text"))
    found = words(_LOWER[data], offsets)
    langs = batch.column("lang").to_pylist()
    if not len(found.start):
        return np.zeros(0, np.uint64), np.zeros(0, bool), found, langs
    code = {lang: _lang_code(lang, seed) for lang in set(langs)}
    size = np.diff(found.first)
    ids = mix(found.hashes() ^ np.repeat(np.array([code[lang] for lang in langs], np.uint64), size))
    ids[ids == 0] = 1  # 0 parts pieces
    piece = np.cumsum(found.data == 0x0A, dtype=np.int32)[found.start]
    begins = np.append(True, piece[1:] != piece[:-1])
    begins[found.first[:-1][size > 0]] = True
    return ids, begins, found, langs


def _count_words(seed: int):
    def count_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", _SLICE_BYTES):
                ids, _, found, langs = _words(piece, seed)
                distinct, at, n = np.unique(ids, return_index=True, return_counts=True)
                data = found.data.tobytes()
                text = np.searchsorted(found.first, at, side="right") - 1
                yield pa.record_batch([
                    pa.array([langs[t] for t in text], pa.string()), pa.array([data[a:b] for a, b in zip(found.start[at], found.end[at])], pa.binary()).cast(pa.string()),
                    pa.array(distinct.view(np.int64)), pa.array(n.astype(np.int64)),
                ], names=["lang", "word", "id", "n"])

    return count_


class Frequent:
    """A bitmap of hashes: holds each one that was put in, and few others."""

    def __init__(self, hashes: DataFrame):
        place = hashes.select(F.shiftrightunsigned("h", 64 - MAP_BITS).alias("place"))
        cells = place.select(F.shiftright("place", 6).cast("int").alias("cell"), F.expr("shiftleft(1L, CAST(place & 63 AS INT))").alias("bit"))
        table = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2**MAP_BITS / 64 rows
        self.bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
        self.bits[np.asarray(table.column("cell"))] = np.asarray(table.column("bits"))

    @staticmethod
    def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        place = (hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64)
        return (bits[place >> 6] >> (place & 63)) & 1 == 1


def _sequences(seed: int, frequent: Broadcast):
    """Texts as rows of ids, with 0 between pieces and for words that are not frequent."""

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", _SLICE_BYTES):
                ids, begins, _, _ = _words(piece, seed)
                place = np.arange(len(ids)) + np.cumsum(begins)
                flat = np.zeros(len(ids) + int(begins.sum()) + 2, np.uint64)
                flat[place] = np.where(Frequent.holds(frequent.value, ids), ids, np.uint64(0))
                told = flat != 0
                told[1:-1] &= told[:-2] | told[2:]  # a word between two breaks is in no phrase
                told[0] = told[-1] = False
                flat[~told] = 0
                flat = flat[told | np.append(False, told[:-1])]  # one 0 after each stretch
                if not len(flat):
                    continue
                ends = np.flatnonzero(flat == 0) + 1
                cuts = np.unique(ends[np.searchsorted(ends, np.append(np.arange(_ROW_WORDS, len(flat), _ROW_WORDS), len(flat)))])
                yield pa.record_batch([pa.ListArray.from_arrays(np.append(0, cuts).astype(np.int32), flat.view(np.int64))], names=["ids"])

    return sequences


def _cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _runs(entries: hat_trie.Entries, prefixes: int) -> pa.RecordBatch:
    """A sorted run for each prefix partition, in rows of bounded size."""
    hashes, rows, n = entries
    part = (gram_hashes(rows[:, :2].ravel(), 2)[::2] % np.uint64(prefixes)).astype(np.int32)
    order = np.lexsort((hashes, part))
    hashes, rows, n, part = hashes[order], rows[order], n[order], part[order]
    begins = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    place = np.arange(len(part)) - np.repeat(begins, np.diff(np.append(begins, len(part))))
    cuts = np.append(np.flatnonzero(place % RUN_PHRASES == 0), len(part))
    low = (hashes[cuts[:-1]] ^ _SIGN).view(np.int64)
    width = rows.shape[1]
    return pa.record_batch([
        pa.array(part[cuts[:-1]]), pa.array(low), pa.ListArray.from_arrays((cuts * width).astype(np.int32), np.ascontiguousarray(rows).ravel().view(np.int64)),
        pa.ListArray.from_arrays(cuts.astype(np.int32), n),
    ], names=["part", "low", "words", "n"])


def _count_phrases(size: int, parts: Broadcast | None, prefixes: int, burst: int, most: int):
    """Runs of the phrases of ``size`` words whose parts of one word less are in the map ``parts``."""

    def count_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = HatTrie(burst, most)
        for batch in _cut(batches, _ID_ROWS):
            flat = np.asarray(batch.column("ids").flatten()).view(np.uint64)
            if len(flat) < size:
                continue
            breaks = np.append(0, np.cumsum(flat == 0))
            told = breaks[size:] == breaks[:-size]
            if parts is not None:
                passed = Frequent.holds(parts.value, gram_hashes(flat, size - 1))
                told &= passed[:-1] & passed[1:]
            rows = flat[np.flatnonzero(told)[:, None] + np.arange(size)]
            for entries in trie.add(*counted(phrase_hashes(rows), rows)):
                yield _runs(entries, prefixes)
        for entries in trie.drain():
            yield _runs(entries, prefixes)

    return count_


def _merge(size: int, least: int):
    """Phrases that occur ``least`` times, from runs in the order of their first hashes."""

    def frequent(entries: hat_trie.Entries) -> pa.RecordBatch:
        hashes, rows, n = entries
        keep = n >= least
        rows = np.ascontiguousarray(rows[keep])
        return pa.record_batch([
            pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * size, rows.ravel().view(np.int64)),
            pa.array(hashes[keep].view(np.int64)), pa.array(n[keep]),
        ], names=["words", "h", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int32), np.zeros((0, size), np.uint64), np.zeros(0, np.int64))
        for batch in _cut(batches, _RUN_ROWS):
            rows = np.asarray(batch.column("words").flatten()).view(np.uint64).reshape(-1, size)
            lengths = np.diff(np.asarray(batch.column("n").offsets))
            part = np.repeat(np.asarray(batch.column("part")), lengths)
            part, rows, n = (np.concatenate(c) for c in zip(held, (part, rows, np.asarray(batch.column("n").flatten()))))
            hashes = phrase_hashes(rows)
            last, low = batch.column("part")[-1].as_py(), np.array([batch.column("low")[-1].as_py()]).view(np.uint64)[0] ^ _SIGN
            done = (part < last) | ((part == last) & (hashes < low))  # no later run holds these
            yield frequent(counted(hashes[done], rows[done], n[done], part[done]))
            held = part[~done], rows[~done], n[~done]
        part, rows, n = held
        yield frequent(counted(phrase_hashes(rows), rows, n, part) if len(rows) else (np.zeros(0, np.uint64), rows, n))

    return merge


def count_phrases(
    docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST, burst: int = hat_trie.BURST, most: int = hat_trie.MOST_ENTRIES,
) -> tuple[DataFrame, list[DataFrame]]:
    """All words (lang, word, id, n), and for each length the phrases
    (words array of ids, h, n) that occur ``least`` times in their language."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    for seed in count():
        found = map_arrow(texts, _count_words(seed), "lang string, word string, id long, n long")
        vocabulary = scratch.write(found.groupBy("lang", "word", "id").agg(F.sum("n").alias("n")), f"words_{seed}")
        clash = vocabulary.groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).filter((F.col("words") > 1) & (F.col("n") >= least))
        if clash.isEmpty():
            break
        scratch.drop(f"words_{seed}")
    frequent = vocabulary.filter(F.col("n") >= least)
    levels = [frequent.select(F.array("id").alias("words"), F.col("id").alias("h"), "n")]
    share = lambda level: spark.sparkContext.broadcast(Frequent(level.select("h")).bits)
    passed = share(levels[0])
    sequences = scratch.write(map_arrow(texts, _sequences(seed, passed), "ids array<long>"), "sequences")
    passed.destroy()
    prefixes = PREFIXES * parallelism(spark)
    for size in range(2, longest + 1):
        parts = share(levels[-1]) if size > 2 else None
        runs = map_arrow(sequences, _count_phrases(size, parts, prefixes, burst, most), "part int, low long, words array<long>, n array<long>")
        runs = runs.repartition(parallelism(spark), "part").sortWithinPartitions("part", "low")
        levels.append(scratch.write(map_arrow(runs, _merge(size, least), "words array<long>, h long, n long"), f"phrases_{size}"))
        if parts is not None:
            parts.destroy()
    scratch.drop("sequences")
    return vocabulary, levels


def _scored(vocabulary: DataFrame, levels: list[DataFrame], least: int) -> DataFrame:
    """lang, words, a, l, r, n, score of each phrase of two words or more that no longer one matches in count."""
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    phrases = union([level.select("words", F.col("n").alias("a")) for level in levels[1:]])
    if len(levels) > 2:
        # Counts fall with length, so a longer phrase of the same count implies one that is a word longer.
        inner = union([level.select(F.slice("words", at, k).alias("words"), F.col("n").alias("a")) for k, level in enumerate(levels[2:], 2) for at in (1, 2)])
        phrases = phrases.join(inner, ["words", "a"], "left_anti")
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    langs = vocabulary.filter(F.col("n") >= least).select(F.col("id").alias("_first"), "lang").join(totals, "lang")
    phrases = phrases.withColumn("_first", F.element_at("words", 1)).join(langs, "_first").drop("_first")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumn("left", F.slice("words", F.lit(1), F.col("cut"))).withColumn("right", F.slice("words", F.col("cut") + 1, F.size("words")))
    known = union([level.select("words", "n") for level in levels])
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select(F.col("words").alias(side), F.col("n").alias(name)), side).drop(side)
    whole = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"CAST((1000 * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')}) AS LONG)")
    best = cuts.withColumn("score", score).groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "words", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, **limits: int) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line
    ends, and pieces at spaces and tabs into words. ``n`` counts the language's
    words, ``a`` the phrase's occurrences within pieces, ``l`` and ``r`` those
    of its parts at the cut with the lowest score, floor(1000 a n / (l r)).
    Phrases of 2 to ``longest`` words with ``least`` occurrences count; one
    inside a longer one that occurs as often goes. Order: score and a, both
    descending, then the phrase's bytes.

    A null lang counts as ``und``, a null text as empty; repeated rows count
    again. A word or text may be of any length. Other columns are not read. No
    phrase: no rows. ``limits``: ``burst`` and ``most``, the entries of a
    container and of a task's trie.
    """
    scratch = Scratch(docs.sparkSession)
    vocabulary, levels = count_phrases(docs, scratch, least, longest, **limits)
    order = [F.desc("score"), F.desc("a")]
    first = Window.partitionBy("lang").orderBy(*order)
    best = _scored(vocabulary, levels, least).withColumn("_rank", F.rank().over(first)).filter(F.col("_rank") <= top).drop("_rank")
    best = scratch.write(best.withColumn("key", F.monotonically_increasing_id()), "best")  # with all that tie for the last rank
    spelt = best.select("key", F.posexplode("words").alias("place", "id")).join(vocabulary.filter(F.col("n") >= least).select("id", "word"), "id")
    spelt = spelt.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("spelt"))
    named = best.join(spelt, "key").withColumn("phrase", F.array_join("spelt.word", " "))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
