"""Counts of phrases of word ids in a HAT-trie that spills."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from cohortfold.llm.words import gram_hashes

#: Entries of a container beyond which it bursts, and of a trie beyond which it spills.
BURST = 1 << 15
MOST_ENTRIES = 1 << 20
#: Words that the trie's nodes tell apart; below, containers only grow.
DEPTH = 2

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def phrase_hashes(rows: np.ndarray) -> np.ndarray:
    """``gram_hashes`` of phrases that are rows of word ids."""
    return gram_hashes(rows.ravel(), rows.shape[1])[::rows.shape[1]]


def counted(hashes: np.ndarray, rows: np.ndarray, n: np.ndarray | None = None, group: np.ndarray | None = None) -> Entries:
    """Distinct phrases with their counts, by (group and) hash. Phrases are told
    apart by all their words; of equal hashes they come in the words' order."""
    order = np.argsort(hashes, kind="stable") if group is None else np.lexsort((hashes, group))
    for again in (False, True):
        h, r = hashes[order], rows[order]
        same = h[1:] == h[:-1]
        differs = (r[1:] != r[:-1]).any(axis=1)
        if again or not (same & differs).any():
            break
        order = np.lexsort([*rows.T[::-1], hashes] + ([] if group is None else [group]))
    begins = np.flatnonzero(np.concatenate([[True], ~same | differs]))[:len(h)] if len(h) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begins, len(h))) if n is None else np.add.reduceat(n[order], begins) if len(h) else n
    return h[begins], r[begins], counts.astype(np.int64, copy=False)


def _joined(parts: list[Entries]) -> Entries:
    return tuple(np.concatenate(column) for column in zip(*parts))


class _Container:
    """A hash table of phrases: sorted by hash, and what came since it was last merged."""

    def __init__(self, parts: list[Entries]):
        self.parts, self.merged = parts, 0
        self.size = sum(len(p[0]) for p in parts)

    def add(self, part: Entries) -> None:
        self.parts.append(part)
        self.size += len(part[0])

    def entries(self) -> Entries:
        if len(self.parts) > 1:
            self.parts = [counted(*_joined(self.parts))]
        self.merged = self.size = len(self.parts[0][0])
        return self.parts[0]


class _Node:
    """Children by ranges of one word: containers, or nodes of a single word."""

    def __init__(self, depth: int, child: _Container):
        self.depth, self.children = depth, [child]
        self.lows = np.zeros(1, np.uint64)

    def add(self, part: Entries, burst: int) -> None:
        if len(self.children) == 1:
            return self._give(0, part, burst)
        place = np.searchsorted(self.lows, part[1][:, self.depth], side="right") - 1
        order = np.argsort(place, kind="stable")
        place = place[order]
        cuts = np.flatnonzero(np.diff(place)) + 1
        targets = [(self.children[place[run[0]]], order[run]) for run in np.split(np.arange(len(place)), cuts) if len(run)]
        for child, rows in targets:  # children may burst as others are given their rows
            i = next(k for k, c in enumerate(self.children) if c is child)
            self._give(i, tuple(column[rows] for column in part), burst)

    def _give(self, i: int, part: Entries, burst: int) -> None:
        child = self.children[i]
        if isinstance(child, _Node):
            return child.add(part, burst)
        child.add(part)
        if child.size > burst and child.size > 2 * child.merged:
            child.entries()
            self._burst(i, burst)

    def _burst(self, i: int, burst: int) -> None:
        child = self.children[i]
        if child.size <= burst:
            return
        hashes, rows, n = child.entries()
        word = rows[:, self.depth]
        middle = np.partition(word, len(word) // 2)[len(word) // 2]
        below = word < middle
        if not below.any():
            below = word == middle
            if below.all():
                if self.depth < min(DEPTH, rows.shape[1]) - 1:
                    node = _Node(self.depth + 1, child)
                    self.children[i] = node
                    node._burst(0, burst)
                return
            middle = word[~below].min()
        halves = [_Container([(hashes[m], rows[m], n[m])]) for m in (below, ~below)]
        self.children[i:i + 1] = halves
        self.lows = np.insert(self.lows, i + 1, middle)
        self._burst(i + 1, burst)
        self._burst(i, burst)

    def entries(self) -> Entries:
        return _joined([c.entries() for c in self.children])

    @property
    def size(self) -> int:
        return sum(c.size for c in self.children)


class HatTrie:
    """Counts of phrases of one length.

    Containers are hash tables of whole ranges of words; one that holds more
    than ``burst`` phrases is divided, and once it is a single word's, it
    becomes a node for the word that follows. With more than ``most`` entries
    in all, the largest subtrees are spilled whole until half are left.
    """

    def __init__(self, burst: int = BURST, most: int = MOST_ENTRIES):
        self.burst, self.most = burst, most
        self.root: _Node | None = None

    def add(self, hashes: np.ndarray, rows: np.ndarray, n: np.ndarray) -> Iterator[Entries]:
        """Add distinct phrases; yields the subtrees that are spilled."""
        if not len(hashes):
            return
        if self.root is None:
            self.root = _Node(0, _Container([]))
        self.root.add((hashes, rows, n), self.burst)
        if self.root.size > self.most:
            for child in self.root.children:
                child.entries()
            if self.root.size > self.most:
                yield from self._spill()

    def _spill(self) -> Iterator[Entries]:
        root, size = self.root, self.root.size
        for child in sorted(root.children, key=lambda c: -c.size):
            if size <= self.most // 2:
                break
            entries = child.entries()
            size -= len(entries[0])
            yield entries
            root.children[next(k for k, c in enumerate(root.children) if c is child)] = _Container([tuple(column[:0] for column in entries)])

    def drain(self) -> Iterator[Entries]:
        """All that is left."""
        if self.root is not None:
            yield self.root.entries()
            self.root = None
