"""Main text of HTML pages: a linear-chain conditional random field over leaf blocks.

Each block of a page is main text or not. Features are the tags and the words
of class, id and role names of all elements around it, and its own length,
links and letters; neighbours are tied by transition weights. Weights are found
by maximum likelihood (forward and backward sums in numpy); Viterbi decodes.

Labelled pages: a bounded sample of the given pages that mark their main text
with ``article`` or ``main``, once as they are, and again laid out anew, with
known labels: the same blocks inside other containers, with menus, headers,
footers, sidebars, notices, adverts, forms and reader comments of many namings
around and between them.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortfold.llm.html_blocks import Block, blocks, text_features
from cohortfold.llm.shared import map_arrow

#: Pages that a fit takes, the longest of them, and layouts made of each.
SAMPLE = 300
SAMPLE_CHARS = 40_000
LAYOUTS = 3
STEPS = 150

# Elements and names that hold main text, and those that do not.
MAIN_ELEMENTS = ("article", "main")
OTHER_ELEMENTS = frozenset("nav aside footer header form button select label menu dialog".split())
MAIN_NAMES = "content article post entry story body main text page prose markdown single blog news container wrapper".split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav sitemap tabs pagination pager".split(),
    "header": "header masthead banner top logo branding toolbar".split(),
    "footer": "footer copyright colophon bottom legal credits".split(),
    "aside": "sidebar widget related recommended aside rail trending popular tags toc".split(),
    "div": (
        "ad ads advert advertisement sponsored promo banner cookie cookies consent notice alert popup modal overlay paywall gdpr "
        "share social toolbar byline"
    ).split(),
    "form": "form newsletter subscribe signup login search contact feedback".split(),
    "section": "comments comment replies reply disqus discussion responses reviews".split(),
}


def _is_other(block: Block) -> bool:
    return any(f"in {e}" in block.around for e in OTHER_ELEMENTS) or any(
        f"named {n}" in block.around for names in OTHER_NAMES.values() for n in names
    )


def marked(page: str) -> tuple[list[Block], list[int]] | None:
    """The page's blocks and labels after its own marks, if it has any."""
    found = blocks(page)
    labels = [int(any(f"in {e}" in b.around for e in MAIN_ELEMENTS) and not _is_other(b)) for b in found]
    return (found, labels) if any(labels) else None


def lay_out(main: list[str], other: list[str], rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page with ``main`` as its main text among blocks of ``other``, and the labels of its blocks."""
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    labels: list[int] = []

    def attributes(names: list[str], sure: bool) -> str:
        if not sure and rng.random() < 0.3:
            return ""
        name = pick(names)
        if rng.random() < 0.4:
            name += pick(["-wrap", "_box", " block", "-area", " col", "-1"])
        return f' {pick(["class", "id"])}="{name}"'

    def aside() -> str:
        element = pick(list(OTHER_NAMES))
        named = attributes(OTHER_NAMES[element], element in ("div", "section"))
        outer = element if element in ("div", "section") or rng.random() < 0.6 else "div"
        if outer == "div" and not named:
            named = f' class="{pick(OTHER_NAMES[element])}"'
        parts = []
        for _ in range(int(rng.integers(1, 6))):
            text = pick(other)
            if element in ("nav", "header", "form"):
                text = " ".join(text.split()[: int(rng.integers(1, 5))]) or "x"
            elif rng.random() < 0.5:
                text = " ".join(text.split()[: int(rng.integers(3, 40))]) or "x"
            text = html.escape(text)
            if element == "nav":
                parts.append(f'<li><a href="/">{text}</a></li>')
            elif element == "form":
                parts.append(pick(["<label>{}</label>", "<p>{}</p>", "<button>{}</button>"]).format(text))
            else:
                parts.append(pick(["<p>{}</p>", "<div>{}</div>", "<p>{}</p>", "<li>{}</li>", "<h3>{}</h3>"]).format(text))
            labels.append(0)
        inner = "".join(parts)
        return f"<{outer}{named}>{'<ul>' + inner + '</ul>' if element == 'nav' else inner}</{outer}>"

    def content() -> str:
        outer = pick(["article", "main", "div", "div", "section"])
        parts, bare = [], False
        short = 0.05 if rng.random() < 0.85 else 0.9
        for i, text in enumerate(main if rng.random() < 0.85 else main[:1]):
            if rng.random() < short:
                text = " ".join(text.split()[: int(rng.integers(1, 4))])
            tag = "h1" if i == 0 and rng.random() < 0.5 else pick(["p"] * 8 + ["h2", "li", "blockquote", "pre", "td", "div"])
            bare = not bare and rng.random() < 0.1  # text between elements; two in a row would be one block
            parts.append(html.escape(text) if bare else f"<{tag}>{html.escape(text)}</{tag}>")
            labels.append(1)
            if rng.random() < 0.08:
                parts.append(aside())
        return f"<{outer}{attributes(MAIN_NAMES, outer == 'div')}>{''.join(parts)}</{outer}>"

    page = "".join(aside() for _ in range(int(rng.integers(0, 4))))
    page += content()
    page += "".join(aside() for _ in range(int(rng.integers(0, 5))))
    if rng.random() < 0.5:
        page = f"<div{attributes(['container', 'wrapper', 'page', 'site', 'root'], False)}>{page}</div>"
    return f"<html><body>{page}</body></html>", labels


def block_features(found: list[Block]) -> list[list[str]]:
    return [["any", *b.around, *text_features(b, i, len(found))] for i, b in enumerate(found)]


@dataclass
class Crf:
    """``weights``: of main over not main, by feature. ``steps``: from label to label. ``begin``: of the first label."""

    weights: dict[str, float]
    steps: np.ndarray
    begin: np.ndarray

    def decode(self, scores: list[float]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        (s00, s01), (s10, s11) = self.steps.tolist()
        off, on = self.begin[0], self.begin[1] + scores[0]
        back: list[tuple[int, int]] = []
        for score in scores[1:]:
            a, b, c, d = off + s00, on + s10, off + s01, on + s11
            back.append((int(b > a), int(d > c)))
            off, on = max(a, b), max(c, d) + score
        label = int(on > off)
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]

    def main_text(self, page: str) -> str:
        """The main blocks' text, joined by one space."""
        found = blocks(page)
        if not found:
            return ""
        weight, known = self.weights.get, {}
        scores = []
        for i, b in enumerate(found):
            if b.around not in known:
                known[b.around] = weight("any", 0.0) + sum(weight(f, 0.0) for f in b.around)
            scores.append(known[b.around] + sum(weight(f, 0.0) for f in text_features(b, i, len(found))))
        return " ".join(b.text for b, label in zip(found, self.decode(scores)) if label)


def train(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, decay: float = 1e-3) -> Crf:
    """Maximum likelihood over ``pages`` (blocks and labels), all sequences side by side."""
    pages = [p for p in pages if p[0]]
    rows = [f for found, _ in pages for f in block_features(found)]
    number = {f: i for i, f in enumerate(sorted({f for row in rows for f in row}))}
    which = np.array([number[f] for row in rows for f in row])
    of = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
    size = np.array([len(labels) for _, labels in pages])
    span, n = int(size.max()), len(pages)
    page = np.repeat(np.arange(n), size)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    truth = np.zeros((span, n), int)
    truth[place, page] = [y for _, labels in pages for y in labels]
    inside = np.arange(span)[:, None] < size

    w, a, b = np.zeros(len(number)), np.zeros((2, 2)), np.zeros(2)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, a, b)]
    told = truth[place, page]
    pairs = inside[1:]
    told_steps = np.array([[(pairs & (truth[:-1] == i) & (truth[1:] == j)).sum() for j in (0, 1)] for i in (0, 1)])
    told_begin = np.array([(truth[0] == 0).sum(), (truth[0] == 1).sum()])
    for step in range(steps):
        emit = np.zeros((span, n, 2))
        emit[place, page, 1] = np.bincount(of, w[which], len(rows))
        ahead, behind = np.empty_like(emit), np.zeros_like(emit)
        ahead[0] = emit[0] + b
        for t in range(1, span):
            ahead[t] = emit[t] + np.logaddexp(ahead[t - 1][:, :1] + a[0], ahead[t - 1][:, 1:] + a[1])
        for t in range(span - 2, -1, -1):
            after = emit[t + 1] + behind[t + 1]
            told_next = np.logaddexp(a[:, 0] + after[:, :1], a[:, 1] + after[:, 1:])
            behind[t] = np.where(inside[t + 1][:, None], told_next, 0.0)
        final = ahead[size - 1, np.arange(n)]
        total = np.logaddexp(final[:, 0], final[:, 1])
        on = np.exp(ahead + behind - total[:, None])
        joint = ahead[:-1, :, :, None] + a + (emit + behind)[1:, :, None, :] - total[:, None, None]
        likely_steps = (np.exp(np.minimum(joint, 0.0)) * pairs[:, :, None, None]).sum(axis=(0, 1))
        gradients = (
            np.bincount(which, (on[place, page, 1] - told)[of], len(w)) / n + decay * w, (likely_steps - told_steps) / n, (on[0].sum(axis=0) - told_begin) / n
        )
        for p, g, (first, second) in zip((w, a, b), gradients, moments):
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            p -= 0.1 * (first / (1 - 0.9 ** (step + 1))) / (np.sqrt(second / (1 - 0.99 ** (step + 1))) + 1e-8)
    return Crf({f: float(w[i]) for f, i in number.items()}, a, b)


def fit(pages: DataFrame, page_id: str = "page_id", page: str = "html", sample: int = SAMPLE, seed: int = 0) -> Crf:
    """Train on about ``sample`` of the pages that mark their main text and have
    at most ``SAMPLE_CHARS`` characters, taken by a hash of their id."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(page).alias("html"))
    rows = rows.filter(F.col("html").rlike(r"(?i)<(article|main)[\s>]") & (F.length("html") <= SAMPLE_CHARS) & F.col("page_id").isNotNull())
    share = min(1.0, sample / max(1, rows.count()))
    place = F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = sorted(rows.filter(place < share).distinct().collect())
    labelled = [x for x in (marked(r.html) for r in chosen) if x]
    rng = np.random.default_rng(seed)
    other = [b.text for found, labels in labelled for b, y in zip(found, labels) if not y] or ["Home", "About us", "Contact"]
    prose = [b.text for found, labels in labelled for b, y in zip(found, labels) if y] or ["Some main text of a page, as any page has it."]
    mains = [[b.text for b, y in zip(found, labels) if y][:60] for found, labels in labelled] or [prose]
    made = []
    for main in mains * LAYOUTS:
        around = other + [prose[int(rng.integers(len(prose)))] for _ in range(len(other) // 2 + 1)]
        laid, labels = lay_out(main, around, rng)
        found = blocks(laid)
        if len(found) == len(labels):
            made.append((found, labels))
    return train(labelled + made)


def extract(pages: DataFrame, model: Crf, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, text and n_chars (code points) of each row's whole page.

    Character references are decoded, white space within a block becomes one
    space, blocks are joined by one space. A null or empty page, or one without
    main text, has an empty text. Other columns are not read.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.main_text(p.as_py() or "") for p in batch.column("_page")]
            columns = [batch.column(k) for k in keep]
            yield pa.record_batch([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    rows = pages.select(*keep, F.col(page).alias("_page"))
    kinds = dict(rows.dtypes)
    return map_arrow(rows, extracted, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", text string, n_chars long")
