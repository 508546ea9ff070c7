"""Token ids in Parquet files made for selective reads.

Documents are range partitioned and sorted by doc_id, encoded after the
shuffle (ids never cross the network) and written with one list of ids per
document. Ids are dictionary encoded, doc_id and counts delta encoded (writer
version 2); row groups and pages have set sizes, and as each file is sorted by
doc_id, its page indexes let a reader of some documents skip the other pages
of every column, and a reader of counts skip the ids.

Files hold: doc_id, part (the file's number in doc_id order), part_start (ids
of the part before the document), n_tokens, ids (array<int>, the end id
included).
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortfold.llm.shared import map_arrow, parallelism
from cohortfold.llm.words import mix, slices, utf8

END_ID = 0
#: Bytes, about, of the strings and ids that a Python worker remembers.
REMEMBERED = 64 << 20
#: Bytes of text that are split at a time, inside a text too, and strings that are encoded in one call.
_CHUNK = 2 << 20
_CALL = 1 << 14
#: What a remembered string takes besides its bytes and ids: hash, number, place and size of both.
_ENTRY = 48
_SCHEMA = "doc_id long, part int, part_start long, n_tokens int, ids array<int>"
_FILE_OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "compression": "zstd",
}
# Fixed value: how byte-level BPE splits a text into pieces. Of one that is
# letters, with a space or without, or one of these stops, there is nothing to split.
_STOPS = ".,;:!?"
_IS_STOP, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_IS_STOP[[ord(c) for c in _STOPS]] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
# White space beyond ASCII, by its two or three bytes of UTF-8.
_WIDE_SPACE = np.array(sorted(int.from_bytes(c.encode(), "big") for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))))
_rng = np.random.default_rng(0x70CE)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_POWERS = np.cumprod(np.full(1 << 8, np.uint64(0x9E3779B97F4A7C15)))


def _is_wide_space(b0: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Whether the bytes end (b1 b2, or b0 b1 b2) with wide white space."""
    two = (b1.astype(np.int64) << 8) | b2
    return np.isin(two, _WIDE_SPACE) | np.isin((b0.astype(np.int64) << 16) | two, _WIDE_SPACE)


def _starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where strings begin that the tokenizer never joins: at each text, at a
    space or line feed between two characters that are not white space, after
    such a line feed, and at one of ``_STOPS`` after a letter of ASCII."""
    ends = np.zeros(len(data) + 1, bool)
    ends[offsets] = True
    padded = np.concatenate([np.full(3, 0x20, np.uint8), data, np.full(3, 0x20, np.uint8)])
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    # Neighbours in the same text only.
    at = at[~_SPACE[padded[at + 2]] & ~_SPACE[padded[at + 4]] & ~ends[at] & ~ends[at + 1]]
    high = (padded[at + 2] >= 0x80) | (padded[at + 4] >= 0x80)
    wide = at[high] + 3
    zero = np.zeros(len(wide), np.uint8)
    odd = _is_wide_space(padded[wide - 3], padded[wide - 2], padded[wide - 1])
    odd |= _is_wide_space(zero, padded[wide + 1], padded[wide + 2]) | _is_wide_space(padded[wide + 1], padded[wide + 2], padded[wide + 3])
    high[high] = odd
    at = at[~high]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True
    begins[at] = True
    begins[at[data[at] == 0x0A] + 1] = True
    begins[1:-1] |= _IS_STOP[data[1:]] & _LETTER[data[:-1]]
    return np.flatnonzero(begins[:-1])


def _equal_strings(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of strings that follow one another and fill ``data``: one place of each
    that differs, its hash, and for every string which of these it is."""
    size = np.diff(np.append(start, len(data)))
    place = np.arange(len(data), dtype=np.int32)
    place -= np.repeat(start.astype(np.int32), size)
    codes = _BYTE_CODE[data] * _POWERS[place & 0xFF]
    if size.max() > 256:
        codes *= mix((place >> 8).astype(np.uint64)) | np.uint64(1)
    codes = mix(np.add.reduceat(codes, start) + size.astype(np.uint64))
    _, first, which = np.unique(codes, return_index=True, return_inverse=True)
    # Equal hashes: the same bytes? Those that are not stand for themselves.
    like = first[which]
    place += np.repeat(start[like].astype(np.int32), size)
    np.minimum(place, len(data) - 1, out=place)
    unlike = np.flatnonzero(data != data[place])
    differs = size != size[like]
    differs[np.searchsorted(start, unlike, side="right") - 1] = True
    if differs.any():
        alone = np.flatnonzero(differs)
        which[alone] = len(first) + np.arange(len(alone))
        first = np.append(first, alone)
    return first, codes[first], which


def _runs(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs, one after the other."""
    upto = np.cumsum(size)
    return np.repeat(at - upto + size, size) + np.arange(int(upto[-1]) if len(upto) else 0)


class _Ids:
    """Ids of strings: of each its number, and all ids in a row by number.

    Strings are found by hash and compared by their bytes. All is kept in a few
    arrays, a fraction of what Python's objects would take; one of strings that
    share a hash is found, the others are learned again where they occur.
    """

    def __init__(self):
        self.codes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # in order of the hashes
        self.data, self.length, self.begin = np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.size, self.flat, self.at = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)

    @property
    def bytes(self) -> int:
        return _ENTRY * len(self.size) + len(self.data) + 4 * len(self.flat)

    def find(self, codes: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of the strings at some places of ``data``; -1: not known."""
        out = np.full(len(codes), -1, np.int64)
        place = np.searchsorted(self.codes, codes)
        found = np.flatnonzero(place < len(self.codes))
        found = found[self.codes[place[found]] == codes[found]]
        number = self.number[place[found]]
        alike = self.length[number] == length[found]
        found, number = found[alike], number[alike]
        size = length[found]
        same = data[_runs(start[found], size)] == self.data[_runs(self.begin[number], size)]
        alike = np.logical_and.reduceat(same, np.cumsum(size) - size) if len(found) else np.zeros(0, bool)
        out[found[alike]] = number[alike]
        return out

    def add(self, codes: np.ndarray, data: np.ndarray, length: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Remember strings that follow one another in ``data``; their numbers."""
        number = len(self.size) + np.arange(len(codes))
        order = np.argsort(codes)
        place = np.searchsorted(self.codes, codes[order])
        self.codes, self.number = np.insert(self.codes, place, codes[order]), np.insert(self.number, place, number[order])
        self.begin = np.concatenate([self.begin, len(self.data) + np.cumsum(length) - length])
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.data, self.length = np.concatenate([self.data, data]), np.concatenate([self.length, length.astype(np.int32)])
        self.size, self.flat = np.concatenate([self.size, size.astype(np.int32)]), np.concatenate([self.flat, flat])
        return number

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes, and all ids in a row, of strings by number."""
        size = self.size[numbers].astype(np.int64)
        return size, self.flat[_runs(self.at[numbers], size)]


class Encoder:
    """Ids of texts, as the tokenizer gives them, with each word encoded once.

    A byte-level BPE splits a text before it merges, always at certain places
    (``_starts``); so a text's ids are those of its strings between them. Equal
    strings of a chunk are found by a hash of their bytes and compared byte by
    byte; each is encoded once, and remembered within ``REMEMBERED`` bytes. A
    text is never encoded in one piece, unless an added token has white space
    in it or takes some from its neighbours: then texts that hold it are.
    """

    def __init__(self, file: str, remembered: int = REMEMBERED, chunk: int = _CHUNK):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        #: Tokens that reach beyond a string, and whether one could be cut by ``_starts`` or hold letters only.
        self._reaching = [t.content for t in added if t.lstrip or t.rstrip or t.single_word or re.search(rf"\s|[A-Za-z][{_STOPS}]", t.content)]
        self._plain_added = {t.content for t in added if t.content.strip().isalpha()}
        #: The same merges for strings that are pieces already.
        self._merger = Tokenizer(self.tokenizer.model)
        self._merger.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._remembered, self._chunk = remembered, chunk
        self._known = _Ids()

    def _learn(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes, and all ids in a row, of strings that follow one another in ``data``."""
        raw, ends = data.tobytes(), np.cumsum(length).tolist()
        text = [raw[a:b].decode() for a, b in zip([0, *ends], ends)]
        simple = [t in _STOPS or (t[1:] if t[:1] == " " else t).isalpha() for t in text]
        if self._plain_added:
            simple = [s and not any(a in t for a in self._plain_added) for s, t in zip(simple, text)]
        size = np.zeros(len(text), np.int64)
        where, flat = [], []
        for lo in range(0, len(text), _CALL):
            are = np.array(simple[lo:lo + _CALL])
            if len(one := lo + np.flatnonzero(are)):
                found = self._merger.encode([text[i] for i in one.tolist()], is_pretokenized=True, add_special_tokens=False)
                size[one] = np.bincount(np.array(found.word_ids, np.int64), minlength=len(one))
                flat.append(np.array(found.ids, np.int32))
            rest = lo + np.flatnonzero(~are)
            found = self.tokenizer.encode_batch_fast([text[i] for i in rest.tolist()], add_special_tokens=False)
            size[rest] = [len(e.ids) for e in found]
            flat.append(np.array(list(chain.from_iterable(e.ids for e in found)), np.int32))
            where += [one, rest]
        where = np.concatenate(where)
        ids = np.concatenate(flat)
        out = np.empty_like(ids)
        out[_runs((np.cumsum(size) - size)[where], size[where])] = ids
        return size, out

    def _chunk_ids(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes, and all ids in a row, of the strings that fill ``data``."""
        if self._known.bytes > self._remembered:
            self._known = _Ids()
        first, codes, which = _equal_strings(data, start)
        begin, length = start[first], np.append(start[1:], len(data))[first] - start[first]
        numbers = self._known.find(codes, data, begin, length)
        if len(new := np.flatnonzero(numbers < 0)):
            strings = data[_runs(begin[new], length[new])]
            numbers[new] = self._known.add(codes[new], strings, length[new], *self._learn(strings, length[new]))
        return self._known.of(numbers[which])

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids in a row. A null is an empty text."""
        data, offsets = utf8(column)
        size, ids = np.zeros(len(offsets) - 1, np.int64), []
        start = _starts(data, offsets)
        cuts = np.searchsorted(start, np.arange(self._chunk, len(data), self._chunk))
        bounds = np.unique(np.concatenate([[0], cuts, [len(start)]]))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            a, b = start[lo], start[hi] if hi < len(start) else len(data)
            sizes, flat = self._chunk_ids(data[a:b], start[lo:hi] - a)
            size += np.bincount(np.searchsorted(offsets, start[lo:hi], side="right") - 1, sizes, len(size)).astype(np.int64)
            ids.append(flat)
        ids = np.concatenate([np.zeros(0, np.int32), *ids])
        for token in self._reaching:
            for i in [k for k, text in enumerate(column.to_pylist()) if text and token in text]:
                own = np.array(self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, np.int32)
                at = int(size[:i].sum())
                ids = np.concatenate([ids[:at], own, ids[at + size[i]:]])
                size[i] = len(own)
        return size, ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        size, ids = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(size)[:-1]) if texts else []


@lru_cache(maxsize=2)
def _encoder(file: str) -> Encoder:
    """Kept for the later tasks of a Python worker."""
    return Encoder(file)


def _encoding(file: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start, part = _encoder(file), 0, TaskContext.get().partitionId()
        for batch in batches:
            for piece in slices(batch, "text", _CHUNK):
                size, ids = encoder.encode_column(piece.column("text"))
                flat = np.insert(ids, np.cumsum(size), np.int32(END_ID))
                size += 1
                upto = np.cumsum(size)
                yield pa.record_batch([
                    piece.column("doc_id").cast(pa.int64()), pa.array(np.full(len(size), part, np.int32)), pa.array(start + upto - size),
                    pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(np.append(0, upto).astype(np.int32), flat),
                ], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
                start += int(upto[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, options: dict[str, str] | None = None) -> None:
    """Encode and write ``docs`` (doc_id, text) under ``path``.

    A null text counts as empty; every document ends with ``END_ID``. Rows come
    in ascending doc_id (null first), equal doc_ids in the order of their
    texts' hashes. No documents: files without rows. Other columns are not
    written. ``tokenizer_file`` is read by each task.
    """
    order = [F.col("doc_id"), F.col("text_hash")]
    rows = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    rows = rows.repartitionByRange(parallelism(docs.sparkSession), *order).sortWithinPartitions(*order)
    rows = map_arrow(rows.select("doc_id", "text"), _encoding(tokenizer_file), _SCHEMA)
    rows.write.options(**_FILE_OPTIONS, **(options or {})).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows. Filters on doc_id and unread columns cost no reads."""
    return spark.read.schema(_SCHEMA).parquet(path)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): ids of all parts before each, from the counts alone. A row for each file."""
    totals = read_tokens(spark, path).groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat = np.asarray(ids.values).astype("<u4", copy=False)
        at = np.asarray(ids.offsets)
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
        yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "part", "part_start")), batch.column("n_tokens").cast(pa.int64()), pa.array(sums, pa.int64())],
                              names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 (of
    the ids as little-endian unsigned 32-bit integers), read from the files."""
    rows = map_arrow(read_tokens(spark, path), _sums, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    starts = F.broadcast(part_starts(spark, path))  # a row for each file
    return rows.join(starts, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
