"""Criteria trees and their compilation to Spark Columns (inventory X2, A8).

A tree is built in Python from leaves (one record test each) and logical
nodes. The leaf test is a SQL boolean expression over the canonical record
columns, or membership of the record's code in a code list. Logical nodes fold
child results into a ``(matched, score)`` pair; the node rules are ours, as
the original leaves them to an external library:

=============  ===========================  =====================================
node           matched                      score
=============  ===========================  =====================================
Leaf           some source scored the leaf   merged leaf value (see ``merge``)
AllOf          every child matched           sum of child scores, else 0
AnyOf          some child matched            sum of matched children's scores
AtLeast(k)     >= k children matched         sum of matched children's scores,
                                             else 0
Not            the child did not match       0 (a gate only)
=============  ===========================  =====================================

An unmatched node always scores 0, so sums need no extra masking. Wide nodes
are folded as balanced expression trees to keep Column nesting shallow.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortfold.functions.ids import normalize_uid


class Criterion:
    uid: str

    @property
    def key(self) -> str:
        return normalize_uid(self.uid)


class Leaf(Criterion):
    """One record test for one entity type.

    ``predicate``: SQL text or a Column over the canonical record columns;
    NULL counts as no match. ``codes``: alternatively, a code list; a record
    matches when its ``code_column`` value is in the list. ``code_table``: the
    same with a DataFrame, whose first column holds the codes.

    ``entry`` names a column of arrays of structs (the codings, results or lines
    of a record). The predicate, SQL text, is then a test of one entry, whose
    fields it names ``entry.code``, beside the record's own columns; a record
    matches when at least ``entries`` of its entries pass, each by all of the
    test. An entry that is NULL, and an array that is, passes none.
    """

    def __init__(
        self,
        uid: str,
        entity_type: str,
        predicate: str | Column | None = None,
        *,
        codes: Iterable[str] | None = None,
        code_table: DataFrame | None = None,
        code_column: str = "code",
        entry: str | None = None,
        entries: int = 1,
    ) -> None:
        if sum(x is not None for x in (predicate, codes, code_table)) != 1:
            raise ValueError("a leaf needs exactly one of predicate, codes or code_table")
        if entry is not None and not isinstance(predicate, str):
            raise ValueError("a leaf on entries needs a predicate as SQL text")
        if entries < 1 or (entry is None and entries != 1):
            raise ValueError("a leaf needs entries >= 1, and an entry column for more than one")
        self.uid = str(uid)
        self.entity_type = entity_type
        self.predicate = predicate
        self.codes = tuple(dict.fromkeys(codes)) if codes is not None else None
        self.code_table = code_table
        self.code_column = code_column
        self.entry = entry
        self.entries = entries

    @property
    def by_code(self) -> bool:
        return self.predicate is None

    def condition(self) -> Column:
        """Boolean Column for a predicate leaf."""
        if self.predicate is None:
            raise ValueError(f"leaf {self.uid} is a code-list leaf")
        if self.entry is not None:
            passes = f"IF(entry IS NOT NULL AND coalesce(({self.predicate}), false), 1, 0)"
            return F.expr(f"aggregate(`{self.entry}`, 0, (held, entry) -> least(held + {passes}, {self.entries})) >= {self.entries}")
        if isinstance(self.predicate, str):
            return F.expr(self.predicate)
        return self.predicate

    def __repr__(self) -> str:
        test = self.predicate if not self.by_code else "code table" if self.codes is None else f"codes[{len(self.codes)}]"
        return f"Leaf({self.uid!r}, {self.entity_type!r}, {test!r})"


def entry_bits(leaves: Sequence[Leaf]) -> Column:
    """Bit i tells whether some entry passes leaf i: all ``leaves``, on one column and
    content with one entry, in one pass over the entries."""
    bits = [f"IF(coalesce(({leaf.predicate}), false), {1 << i}L, 0L)" for i, leaf in enumerate(leaves)]
    while len(bits) > 1:
        bits = [f"({a} | {b})" for a, b in zip(bits[::2], bits[1::2])] + bits[len(bits) & ~1:]
    passed = f"aggregate(`{leaves[0].entry}`, 0L, (held, entry) -> IF(entry IS NULL, held, held | {bits[0]}))"
    return F.expr(f"coalesce({passed}, 0L)")


class _Logical(Criterion):
    def __init__(self, *children: Criterion, uid: str | None = None) -> None:
        if len(children) == 1 and isinstance(children[0], (list, tuple)):
            children = tuple(children[0])
        if not children:
            raise ValueError(f"{type(self).__name__} needs at least one child")
        self.children: tuple[Criterion, ...] = tuple(children)
        self.uid = str(uid) if uid is not None else str(uuid.uuid4())

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(map(repr, self.children))})"


class AllOf(_Logical):
    pass


class AnyOf(_Logical):
    pass


class AtLeast(_Logical):
    def __init__(self, k: int, *children: Criterion, uid: str | None = None) -> None:
        super().__init__(*children, uid=uid)
        if not 0 <= k:
            raise ValueError("AtLeast needs k >= 0")
        self.k = k

    def __repr__(self) -> str:
        return f"AtLeast({self.k}, {', '.join(map(repr, self.children))})"


class Not(_Logical):
    def __init__(self, child: Criterion, uid: str | None = None) -> None:
        super().__init__(child, uid=uid)

    @property
    def child(self) -> Criterion:
        return self.children[0]


def iter_leaves(node: Criterion) -> Iterator[Leaf]:
    if isinstance(node, Leaf):
        yield node
    elif isinstance(node, _Logical):
        for child in node.children:
            yield from iter_leaves(child)
    else:
        raise TypeError(f"unknown criterion node {node!r}")


def leaves_by_type(tree: Criterion) -> dict[str, dict[str, Leaf]]:
    """entity type -> (upper-cased uid -> leaf). A repeated uid: last one wins."""
    out: dict[str, dict[str, Leaf]] = {}
    for leaf in iter_leaves(tree):
        out.setdefault(leaf.entity_type, {})[leaf.key] = leaf
    return out


def leaf_keys(tree: Criterion) -> list[str]:
    """Distinct upper-cased leaf ids in first-seen order."""
    return list(dict.fromkeys(leaf.key for leaf in iter_leaves(tree)))


@dataclass
class FoldLevel:
    """One level of a tree fold: how its nodes (by place) combine their children.

    ``parent`` and ``default`` are by child place: the node it belongs to, and
    1 if the child is matched where none of its leaves is. ``base`` counts such
    children of a node; a node is matched when its number of matched children
    lies in ``least .. most``, and then scores their sum if ``scored``. The last
    child and the last node are void: rows that belong to no leaf of the tree.
    """

    parent: list[int]
    default: list[int]
    base: list[int]
    least: list[int]
    most: list[int]
    scored: list[int]


def fold_levels(tree: Criterion) -> tuple[list[tuple[str, int]], list[FoldLevel]]:
    """(leaf id, place) pairs of the deepest level, and the levels from there to the root.

    Leaves above the deepest level are carried down to it, so each level has
    one kind of row.
    """
    levels: list[list[Criterion]] = [[tree]]
    parents: list[list[int]] = []
    while not parents or any(not isinstance(n, Leaf) for n in levels[-1]):
        below: list[Criterion] = []
        parent: list[int] = []
        for i, node in enumerate(levels[-1]):
            children = [node] if isinstance(node, Leaf) else list(node.children)
            below += children
            parent += [i] * len(children)
        levels.append(below)
        parents.append(parent)

    default = [0] * len(levels[-1])
    out: list[FoldLevel] = []
    for depth in range(len(parents) - 1, -1, -1):
        nodes, parent = levels[depth], parents[depth]
        size, base = [0] * len(nodes), [0] * len(nodes)
        for child, up in enumerate(parent):
            size[up] += 1
            base[up] += default[child]
        least, most, scored = [], [], []
        for node, n in zip(nodes, size):
            if isinstance(node, Not):
                least, most, scored = [*least, 0], [*most, 0], [*scored, 0]
            else:
                need = n if isinstance(node, AllOf) else node.k if isinstance(node, AtLeast) else 1
                least, most, scored = [*least, need], [*most, n], [*scored, 1]
        void = len(nodes) if depth else 0
        out.append(FoldLevel([*parent, void], [*default, 0], [*base, 0], [*least, 1], [*most, 0], [*scored, 0]))
        default = [int(lo <= b <= hi) for b, lo, hi in zip(base, least, most)]
    return [(leaf.key, i) for i, leaf in enumerate(levels[-1])], out


def balanced(items: Sequence[Column], op: Callable[[Column, Column], Column]) -> Column:
    """Fold ``items`` pairwise so the expression depth is log2(len)."""
    items = list(items)
    if not items:
        raise ValueError("nothing to fold")
    while len(items) > 1:
        nxt = [op(items[i], items[i + 1]) for i in range(0, len(items) - 1, 2)]
        if len(items) % 2:
            nxt.append(items[-1])
        items = nxt
    return items[0]


def _sum(cols: Sequence[Column]) -> Column:
    return balanced(cols, lambda a, b: a + b)


def compile_tree(node: Criterion, value_of: Callable[[str], Column]) -> tuple[Column, Column]:
    """(matched, score) Columns for ``node``.

    ``value_of(uid)`` gives the merged leaf value Column, NULL when the
    patient has no score for that leaf.
    """
    zero = F.lit(0.0)
    if isinstance(node, Leaf):
        v = value_of(node.key)
        return v.isNotNull(), F.coalesce(v, zero)
    parts = [compile_tree(c, value_of) for c in node.children]
    matched = [m for m, _ in parts]
    scores = [s for _, s in parts]
    if isinstance(node, AllOf):
        ok = balanced(matched, lambda a, b: a & b)
        return ok, F.when(ok, _sum(scores)).otherwise(zero)
    if isinstance(node, AnyOf):
        return balanced(matched, lambda a, b: a | b), _sum(scores)
    if isinstance(node, AtLeast):
        hits = _sum([m.cast("int") for m in matched])
        ok = hits >= F.lit(node.k)
        return ok, F.when(ok, _sum(scores)).otherwise(zero)
    if isinstance(node, Not):
        return ~matched[0], zero
    raise TypeError(f"unknown criterion node {node!r}")
