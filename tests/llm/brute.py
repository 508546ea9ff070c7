"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

import regex

from cohortfold.llm import templates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {65 + i: 97 + i for i in range(26)}


def shingles(text, size):
    w = WORD.findall((text or "").translate(_LOWER))
    if len(w) >= size:
        return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def near_dup(docs, size, percent):
    """{doc_id: (n_shingles, component_id)} for (doc_id, text) pairs."""
    sets = {d: shingles(t, size) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in ids}


def repeats(docs, size=20):
    """{doc_id: (n_words, n_removed, kept_sha256)}."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - size + 1):
            window = tuple(w[i:i + size])
            if window in seen:
                gone.update(range(i, i + size))
            seen.add(window)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shared_runs(docs, items, least):
    """{(doc_id, item_id): longest run of equal bare lower-case words}, runs of at least ``least``."""
    bare = lambda t: [x for x in (re.sub(r"[^\w<>]+|_", "", w.lower()) for w in WORD.findall(t or "")) if x]
    out = Counter()
    for i, item in items:
        b = bare(item)
        at = {}
        for k in range(len(b) - 2):
            at.setdefault(tuple(b[k:k + 3]), []).append(k)
        for d, text in docs:
            a = bare(text)
            for p in range(len(a) - 2):
                for k in at.get(tuple(a[p:p + 3]), ()):
                    n = 0
                    while p + n < len(a) and k + n < len(b) and a[p + n] == b[k + n]:
                        n += 1
                    out[d, i] = max(out[d, i], n)
    return {k: n for k, n in out.items() if n >= least}


_UNITS = set(templates.UNITS)
_LETTER = regex.compile(r"[\p{L}\p{N}]")


def template_words(text):
    """(template word, the same with all that may be names as such, value) of each word, told one word at a time."""
    text = (text or "").translate({ord(c): " " for c in "<>\x01"})
    told, before = [], ""
    for word in WORD.findall(text):
        before, last = word[-1], before
        at = next((i for i, c in enumerate(word) if _LETTER.match(c)), len(word))
        capital = at < len(word) and regex.match(r"\p{Lu}", word[at]) is not None
        bare = "".join(c for c in word.lower() if _LETTER.match(c))
        if capital and at == 0 and last and regex.match(r"[\p{Ll},;:]", last):
            told.append(("<name>", "<name>", bare))
            continue
        may_be = capital and (not last or at > 0 or regex.match(r"[^\p{L}\p{N},;:]", last) is not None)
        if regex.fullmatch(r"[^\p{L}\p{N}]*[0-9][0-9.,:/]*[^\p{L}\p{N}]*", word):
            told.append(("<num>", "<num>", bare))
        elif told and told[-1][0] == "<num>" and at == 0 and bare in _UNITS and regex.fullmatch(r"[a-z]+[^\p{L}\p{N}]*", word.lower()):
            told.append(("<unit>", "<unit>", bare))
        else:
            told.append((bare, "<name>" if may_be else bare, bare))
    return [w for w in told if w[2]]


def leaks(docs, items, min_run=13, pure=11):
    """{(doc_id, item_id): (run_tokens, n_slots, same_values)} over all alignments that share ``pure`` words or a whole
    shorter item in one reading, where 5 literals are among them or all values are equal; ``pure=8``: the most that may be found."""
    out = {}
    for i, item in items:
        b = template_words(item)
        if not b:
            continue
        need = min(len(b), max(11, min(min_run, len(b) - 1)))
        span = min(len(b), pure) if len(b) > 11 else len(b)
        for d, text in docs:
            a = template_words(text)
            best = None
            for shift in range(1 - len(b), len(a)):
                part = [(b[j], a[j + shift]) for j in range(len(b)) if 0 <= j + shift < len(a)]
                if len(part) >= span and _alike(part, span, pure):
                    best = max(filter(None, (best, _best(part, need, True), _best(part, need, False))), default=None)
            if best:
                out[d, i] = best[1:]
    return out


def _alike(part, span, pure):
    for at in range(len(part) - span + 1):
        x = part[at:at + span]
        if all(p[2] == q[2] for p, q in x):
            return True
        for kind in (0, 1):
            literal = sum(not p[kind].startswith("<") for p, _ in x)
            if all(p[kind] == q[kind] for p, q in x) and literal >= (5 if pure == 11 or span < 8 else 0):
                return True
    return False


def _best(part, need, plain):
    cells = []
    for (t, n, iv), (dt, dn, dv) in part:
        if plain:
            cells.append((t, iv, dv, t == dt))
        else:
            word = n if n == "<name>" or not dt.startswith("<") else (t if t.startswith("<") else dt)
            cells.append((word, iv, dv, t == dt or iv == dv or n == dn == "<name>"))
    best = None
    for begin in range(len(cells)):
        stands = {}
        for end in range(begin, len(cells)):
            t, iv, dv, same = cells[end]
            if not same or (t.startswith("<") and stands.setdefault((t, iv), dv) != dv):
                break
            if end + 1 - begin >= need:
                slots = [(x, y) for w, x, y, _ in cells[begin:end + 1] if w.startswith("<")]
                told = (plain, end + 1 - begin, len(slots), all(x == y for x, y in slots))
                best = told if best is None else max(best, told)
    return best
