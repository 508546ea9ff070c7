"""Leaf blocks of an HTML page: their text, the elements around them, and features of both."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

# Elements by how they are read.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
#: No text; without an end they go on to the end of the page.
RAW_TAGS = frozenset("script style template textarea title".split())
#: No text either, unless their end is missing.
SKIPPED_TAGS = frozenset("head noscript iframe svg canvas audio video annotation annotation-xml".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these just above it.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
    "tfoot": {"tr", "td", "th", "thead", "tbody"},
}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    around: frozenset[str]
    tag: str
    linked: int


def _element_features(tag: str, attributes: str) -> list[str]:
    out = [f"in {tag}"]
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                out.append("hidden")
            elif name in ("class", "id", "role"):
                out += [f"named {w}" for w in _WORD.findall(_CAMEL.sub(" ", value).lower())]
    return out


def blocks(page: str) -> list[Block]:
    """Blocks with text in page order. Inline elements (formulas and the content
    of objects too) do not end a block; scripts, styles, the head, comments and
    the like have no text. Where the end of a head, drawing, video and the like is
    missing, its content is read as if it had not begun."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = [("", frozenset())]
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    links = linked = 0
    endless: set[str] = set()

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1][1], stack[-1][0], linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text)

    def pop() -> None:
        open_tags[stack.pop()[0]] -= 1

    at, end = 0, len(page)
    while at < end:
        found = _TAG.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at:found.start()])
        at = found.end()
        slash, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW_TAGS or tag in SKIPPED_TAGS:
            if not slash and not attributes.endswith("/") and tag not in endless:
                after = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                if after is not None:
                    at = after.end()
                elif tag in RAW_TAGS:
                    at = end
                else:
                    endless.add(tag)
        elif tag == "br":
            add(" ")
        elif tag == "a":
            links = 0 if slash else 1
        elif tag in BLOCK_TAGS:
            close()
            links = 0
            if slash:
                if open_tags[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            else:
                if stack[-1][0] == "p":
                    pop()
                for _ in ENDS.get(tag, ()):
                    if stack[-1][0] in ENDS[tag]:
                        pop()
                if tag not in VOID_TAGS:
                    around = stack[-1][1]
                    new = [f for f in _element_features(tag, attributes) if f not in around]
                    stack.append((tag, around.union(new) if new else around))
                    open_tags[tag] += 1
    close()
    return out


def text_features(block: Block, place: int, total: int) -> list[str]:
    """Features of a block's own tag, its text and its place in the page."""
    text = block.text
    size, words = len(text), text.count(" ") + 1
    out = [f"tag {block.tag}", f"words {min(words.bit_length(), 8)}", f"linked {4 * min(block.linked, size) // size}"]
    if text[-1] in ".!?:;…。":
        out.append("ends a sentence")
    if "©" in text:
        out.append("copyright")
    letters = sum(map(str.isalpha, text[:200]))
    out.append(f"letters {4 * letters // min(size, 200)}")
    if place == 0:
        out.append("first")
    if place == total - 1:
        out.append("last")
    return out
