"""Leaf predicates as an index over record columns (inventory P4).

Leaves that compare one column with constants are not tested one by one. All
constants of a column are sorted; a record's value is placed among them by one
binary search, and its place tells which of the column's leaves hold. Places
at which the same leaves hold are one *class*, so a record comes down to a
small integer per column, however many leaves there are. Other predicates are
bits of a number. Classes, bits and code hits together are the record's
*pattern*: records are counted by pattern, and patterns become leaves
afterwards. Where the leaves of a column are nested, as thresholds are, a class
differs from the next by a leaf or two: what changes from class to class is
kept, too, and its size does not pass the leaves.

A comparison is ``column op constant`` with ``=``, ``<>``, ``!=``, ``<``,
``<=``, ``>``, ``>=``, ``BETWEEN`` or ``IN``, of a number column with numbers
or a text column with texts. Everything else counts as another predicate.
Leaves on the entries of an array column are bits, too, and all of a column's are
set in one pass over a record's entries.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortfold.plans.criteria import Leaf, entry_bits

#: Other predicates per number of bits.
BITS = 62
_DIGITS = 36
_CONSTANT = r"(?:-?\d+(?:\.\d+)?|'[^'\\]*')"
_COMPARISON = re.compile(
    rf"\s*`?([A-Za-z_]\w*)`?\s*(?:(=|<>|!=|<=|>=|<|>)\s*({_CONSTANT})|BETWEEN\s+({_CONSTANT})\s+AND\s+({_CONSTANT})|IN\s*\(\s*({_CONSTANT}(?:\s*,\s*{_CONSTANT})*)\s*\))\s*",
    re.IGNORECASE,
)
_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


def constant(values: object, schema: str) -> Column:
    """A constant array (of arrays) as one expression, whatever its size."""
    return F.from_json(F.lit(json.dumps(values)), schema)


@dataclass(frozen=True)
class Comparison:
    """``column`` lies in one of some closed or open intervals between constants."""

    column: str
    op: str
    texts: tuple[str, ...]

    def places(self, order: Mapping[object, int], key, last: int) -> set[int]:
        """Places at which this holds: 2j lies between the j-th and the next constant, 2j + 1 is the latter."""
        at = [2 * order[key(t)] + 1 for t in self.texts]
        if self.op in ("=", "IN"):
            return set(at)
        if self.op in ("<>", "!="):
            return set(range(last + 1)) - set(at)
        if self.op == "BETWEEN":
            return set(range(at[0], at[1] + 1))
        if self.op[0] == ">":
            return set(range(at[0] + (self.op == ">"), last + 1))
        return set(range(at[0] + (self.op == "<=")))


def comparison(predicate: object) -> Comparison | None:
    found = _COMPARISON.fullmatch(predicate) if isinstance(predicate, str) else None
    if found is None:
        return None
    column, op, single, low, high, listed = found.groups()
    if op:
        return Comparison(column, op, (single,))
    if low:
        return Comparison(column, "BETWEEN", (low, high))
    return Comparison(column, "IN", tuple(re.findall(_CONSTANT, listed)))


def _key_of(kind: T.DataType, texts: Sequence[str]):
    """How this column's constants are ordered, or None if they are not of its type."""
    quoted = [t.startswith("'") for t in texts]
    if kind == T.StringType():
        return (lambda t: t[1:-1].encode()) if all(quoted) else None
    if any(quoted) or not isinstance(kind, (*_EXACT, T.DoubleType)):
        return None
    if isinstance(kind, T.DoubleType):
        return float
    whole = max(len(t.lstrip("-").split(".")[0]) for t in texts)
    part = max(len(t.partition(".")[2]) for t in texts)
    return Decimal if whole + part <= _DIGITS else None


def _constants(kind: T.DataType, keys: Sequence[object]) -> Column:
    if kind == T.StringType():
        return constant([k.decode() for k in keys], "array<string>")
    if isinstance(kind, T.DoubleType):
        return constant(keys, "array<double>")
    scale = max(0, *(-k.as_tuple().exponent for k in keys)) if keys else 0
    if not scale and max(abs(k) for k in keys) < 1 << 62:
        return constant([int(k) for k in keys], "array<long>")
    return constant([f"{k:f}" for k in keys], "array<string>").cast(f"array<decimal(38,{scale})>")


class ColumnIndex:
    """The leaves on one column: constants, and the class of each place."""

    def __init__(self, name: str, kind: T.DataType, leaves: Sequence[tuple[int, Comparison]], key):
        self.name, self.kind = name, kind
        self.keys = sorted({key(t) for _, c in leaves for t in c.texts})
        order = {k: i for i, k in enumerate(self.keys)}
        last = 2 * len(self.keys)
        held: list[list[int]] = [[] for _ in range(last + 1)]
        for code, c in leaves:
            for place in c.places(order, key, last):
                held[place].append(code)
        sets = [tuple(sorted(codes)) for codes in held]
        #: Leaf codes of each class, in the order of their first places; class 0 holds none.
        self.classes = list(dict.fromkeys([(), *sets]))
        number = {codes: i for i, codes in enumerate(self.classes)}
        self.class_at = [number[codes] for codes in sets]
        #: What changes from one class to the next: a leaf that comes, or ``~leaf`` for one that goes.
        self.changes = [
            [*sorted(set(now) - set(before)), *(~c for c in sorted(set(before) - set(now)))]
            for before, now in zip(self.classes, self.classes[1:])
        ]
        #: Fewer changes than leaves held, as of thresholds: records are better counted by what changes.
        self.nested = sum(map(len, self.changes)) < sum(map(len, self.classes))

    def add(self, df: DataFrame, out: str) -> DataFrame:
        """Add the class of each row's value; NULL is in class 0.

        Each step of the search is a projection of its own that reads the last
        one's result twice, so steps are not folded into one another.
        """
        value, constants = F.col(f"`{self.name}`"), _constants(self.kind, self.keys)
        df = df.withColumn(out, F.lit(0))
        step = 1 << (len(self.keys).bit_length() - 1)
        while step:
            beyond = F.get(constants, F.col(out) + F.lit(step - 1)) < value
            df = df.withColumn(out, F.col(out) + F.when(beyond, F.lit(step)).otherwise(F.lit(0)))
            step >>= 1
        equal = F.when(F.get(constants, F.col(out)) == value, F.lit(1)).otherwise(F.lit(0))
        place = F.col(out) * F.lit(2) + equal
        found = F.get(constant(self.class_at, "array<int>"), place)
        return df.withColumn(out, F.when(value.isNotNull(), found).otherwise(F.lit(0)))


class Patterns:
    """The patterns of some leaves over records of a schema.

    ``leaves`` are (code, leaf) pairs; code leaves are not among them.
    """

    def __init__(self, schema: T.StructType, leaves: Sequence[tuple[int, Leaf]]):
        named: dict[str, list[T.StructField]] = {}
        for field in schema.fields:
            named.setdefault(field.name.lower(), []).append(field)
        by_column: dict[str, list[tuple[int, Comparison, Leaf]]] = {}
        self.others: list[tuple[int, Leaf]] = []
        on_entries: dict[str, list[tuple[int, Leaf]]] = {}
        for code, leaf in leaves:
            if leaf.entry is not None and leaf.entries == 1:
                on_entries.setdefault(leaf.entry.lower(), []).append((code, leaf))
                continue
            c = comparison(leaf.predicate) if leaf.entry is None else None
            if c is None or len(named.get(c.column.lower(), ())) != 1 or _key_of(named[c.column.lower()][0].dataType, c.texts) is None:
                self.others.append((code, leaf))
            else:
                by_column.setdefault(c.column.lower(), []).append((code, c, leaf))
        self.indexes: list[ColumnIndex] = []
        for name, found in by_column.items():
            field = named[name][0]
            key = _key_of(field.dataType, [t for _, c, _ in found for t in c.texts])
            if key is None:
                self.others += [(code, leaf) for code, _, leaf in found]
            else:
                self.indexes.append(ColumnIndex(field.name, field.dataType, [(code, c) for code, c, _ in found], key))
        chunked = lambda of: [of[i:i + BITS] for i in range(0, len(of), BITS)]
        self._chunks = chunked(self.others)
        self._plain = len(self._chunks)
        self._chunks += [chunk for of in on_entries.values() for chunk in chunked(of)]
        self.columns = [f"_class_{i}" for i in range(len(self.indexes))] + [f"_bits_{i}" for i in range(len(self._chunks))]

    def add(self, df: DataFrame) -> DataFrame:
        """Add the pattern columns."""
        for i, index in enumerate(self.indexes):
            df = index.add(df, f"_class_{i}")
        for i, chunk in enumerate(self._chunks):
            if i >= self._plain:
                df = df.withColumn(f"_bits_{i}", entry_bits([leaf for _, leaf in chunk]))
                continue
            bits = [F.when(leaf.condition(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, leaf) in enumerate(chunk)]
            while len(bits) > 1:
                bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])] + bits[len(bits) & ~1:]
            df = df.withColumn(f"_bits_{i}", bits[0])
        return df

    def any(self) -> list[Column]:
        """Conditions, one a pattern column, that some leaf holds."""
        return [F.col(name) != F.lit(0) for name in self.columns]

    @property
    def nested(self) -> list[int]:
        """Places of the nested indexes among the pattern columns."""
        return [i for i, index in enumerate(self.indexes) if index.nested]

    def leaves(self, nested: bool = True) -> list[Column]:
        """Arrays of leaf codes, one a pattern column (the nested ones among them or not)."""
        out = [
            F.get(constant([list(c) for c in index.classes], "array<array<int>>"), F.col(f"_class_{i}"))
            for i, index in enumerate(self.indexes) if nested or not index.nested
        ]
        for i, chunk in enumerate(self._chunks):
            codes = constant([code for code, _ in chunk], "array<int>")
            bits = F.col(f"_bits_{i}")
            out.append(F.filter(codes, lambda _, k: F.getbit(bits, k) == 1))  # noqa: B023 - called at once
        return out

    def changes(self, i: int, below: Column, upto: Column) -> Column:
        """What changes in a nested index after one class up to another (array of codes)."""
        of = self.indexes[i].changes
        ends = constant([0, *accumulate(map(len, of))], "array<int>")
        begin = F.get(ends, below)
        return F.slice(constant([c for change in of for c in change], "array<int>"), begin + F.lit(1), F.get(ends, upto) - begin)
