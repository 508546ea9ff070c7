"""Benchmark decontamination by template canonicalisation (native).

Numbers, names and units become typed placeholders, so a benchmark question
and a copy with other parameters have the same template. Words are lower-cased
and stripped of punctuation. Every document's template is cut into windows of
``WINDOW`` words at each ``STRIDE``-th place, every benchmark item's at each
place: a shared run of ``WINDOW + STRIDE - 1`` words or more holds one of the
document's windows whatever its offset, and a document emits a quarter of its
windows only. Where such a window has few literal words, the document emits its
values instead, for verbatim copies, and the windows of that least length around
it, for others. Shorter items are one window of their own length, which documents
then emit at each place. Windows are hash-joined; for each document, item and alignment
that they point at, all shared runs are measured on the words themselves, and
cut where their slots disagree: one value of the item must always stand for one
value of the document.

Words that are capitalised where any word is are read both ways, as a word and as
a name, and words of equal value match in any case: windows of both kinds are
joined, too. Where the plain template holds no leak of a pair, its runs under
these readings are judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortfold.llm.shared import Scratch

WINDOW = 8
STRIDE = 4
MIN_RUN = 13
#: A window needs so many words that are no placeholder.
MIN_LITERAL = 5
#: The kind of a word that may be a name: more than the words of any window, so kinds can be summed up.
_NAMED = 16

# The units that become a placeholder after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec secs min mins h hr hrs "
    "hour hours minute minutes second seconds day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles "
    "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres "
    "dollar dollars euro euros cent cents percent degree degrees"
).split()

_MARK = "\u0001"
_SPACE = r"[\x20\x09-\x0D]"
_NAME_START = rf"([\p{{Ll}},;:]{_SPACE}+)(\p{{Lu}})"
_EDGE = r"[^\p{L}\p{N}\x20\x09-\x0D]"
#: A capital that begins a text or a sentence, or stands behind a quote or bracket.
_SENTENCE_START = rf"(^{_SPACE}*|[^\p{{L}}\p{{N}},;:\x20\x09-\x0D]{_SPACE}+|{_SPACE}(?={_EDGE}))({_EDGE}*)(\p{{Lu}})"
_NAME = rf"{_MARK}[^\x20\x09-\x0D]+"
_NUMBER = rf"(^|{_SPACE})[^\p{{L}}\p{{N}}\x20\x09-\x0D]*[0-9][0-9.,:/]*[^\p{{L}}\p{{N}}\x20\x09-\x0D]*($|{_SPACE})"
_UNIT = rf"(<num>{_SPACE}+)>?({'|'.join(UNITS)})([^\p{{L}}\p{{N}}<>\x20\x09-\x0D]*)($|{_SPACE})"
_PUNCTUATION = r"[^\p{L}\p{N}<>\x20\x09-\x0D]+"


def template(text: Column) -> Column:
    """The text with placeholders; its words are those of the text, one for one,
    but that a word of punctuation only is empty. Words that may be names, for
    they are capitalised where any word is, have ``>`` before them."""
    text = F.coalesce(text, F.lit(""))
    text = F.regexp_replace(F.translate(text, "<>" + _MARK, "   "), _SENTENCE_START, "$1>$2$3")
    text = F.regexp_replace(text, _NAME_START, rf"$1{_MARK}$2")
    text = F.lower(F.regexp_replace(text, _NAME, "<name>"))
    for _ in range(2):  # neighbours share the space between them
        text = F.regexp_replace(text, _NUMBER, "$1<num>$2")
    text = F.regexp_replace(text, _UNIT, "$1<unit>$4")
    return F.regexp_replace(text, _PUNCTUATION, "")


def _values(text: Column) -> Column:
    """The lower-case values of the template words."""
    clean = F.translate(F.coalesce(text, F.lit("")), "<>" + _MARK, "   ")
    return F.filter(F.split(F.regexp_replace(F.lower(clean), _PUNCTUATION, ""), rf"{_SPACE}+"), lambda w: w != "")


def _cut(df: DataFrame, text: str, *others: str) -> DataFrame:
    """For each template word: words, the same with all that may be names as such (named), values, and
    kinds (0: placeholder, ``_NAMED``: may be a name, 1: others)."""
    marked = F.filter(F.split(template(F.col(text)), rf"{_SPACE}+"), lambda w: w != "")
    df = df.select(*others, marked.alias("marked"), _values(F.col(text)).alias("values"))
    return df.select(
        *others, "values", F.expr("transform(marked, w -> IF(startswith(w, '>'), substring(w, 2), w))").alias("words"),
        F.expr("transform(marked, w -> IF(startswith(w, '>'), '<name>', w))").alias("named"),
        F.expr(f"transform(marked, w -> IF(startswith(w, '<'), 0, IF(startswith(w, '>'), {_NAMED}, 1)))").alias("kinds"),
    )


def _literals(words: str) -> str:
    return f"size(filter({words}, w -> NOT startswith(w, '<')))"


def _window(words: str, place: str, length: int) -> str:
    """The words from a place on, one by one: to slice an array in a lambda function copies all of it."""
    return ", ".join(f"{words}[{place} + {k}]" for k in range(length))


def _kinds(place: str, length: int) -> str:
    """What a window's words are (``_TELLS``), from the sum of their kinds; NULL beyond the end."""
    return f"get({_OF_SUM}, {' + '.join(f'get(kinds, {place} + {k})' for k in range(length))})"


def _grid(places: str, length: int = WINDOW) -> str:
    """(i, k) for each place: what its window's words are."""
    return f"transform({places}, i -> struct(i, {_kinds('i', length)} AS k))"


def _windows(grid: str, told: str, words: str = "words", length: int = WINDOW) -> str:
    """(at, hash) for the places of a grid for which ``told`` holds."""
    return f"transform(filter({grid}, x -> {told}), x -> struct(x.i AS at, xxhash64({_window(words, 'x.i', length)}) AS hash))"


def _places(step: int, length: int = WINDOW) -> str:
    return f"IF(size(words) < {length}, array(), sequence(0, size(words) - {length}, {step}))"


#: Every run that is told of has so many words or more.
_LONG = WINDOW + STRIDE - 1


def _tells(plain: int, names: int) -> int:
    """Bits by the number of literal words and of those that may be names:
    1: the window of ``WINDOW`` values is another than that of template words (copies with the same values are found, in any case);
    2, 8: enough words are literal, so that copies with other values are found, without and with names; 4, 16: too few are."""
    few, few_named = plain + names < MIN_LITERAL, plain < MIN_LITERAL
    return (plain + names < WINDOW) + 2 * (not few) + 4 * few + 8 * (names > 0 and not few_named) + 16 * few_named


_OF_SUM = f"array({', '.join(str(_tells(k % _NAMED, k // _NAMED)) for k in range(_LONG * _NAMED + 1))})"
_SLOTS = "x.k & 1 > 0"
_TOLD = {"words": "x.k & 2 > 0", "named": "x.k & 8 > 0"}
_FEW = {"words": "x.k & 4 > 0", "named": "x.k & 16 > 0"}
_READINGS = ("values", "words", "named")


def _doc_windows(docs: DataFrame, short: list[tuple[int, bool]]) -> DataFrame:
    """(hash, doc_id, doc_at) of a document's windows, from its cut.

    At each place of the grid its windows of ``WINDOW`` words; where one has few
    literal words, those of ``_LONG`` words up to ``STRIDE - 1`` places before. At each
    place windows of the length of ``short`` items (length, whether some has enough
    literal words). Places and windows are rows, not entries that lambda functions
    walk: Spark compiles what is done with rows, and interprets lambda functions. A
    window is one number: place, reading, whether it is such a near one, and length.
    """
    places = "IF(size(words) = 0, array(), sequence(0, size(words) - 1))" if short else _places(STRIDE)
    at = docs.select("doc_id", *_READINGS, "kinds", F.explode(F.expr(places)).alias("i"))
    at = at.withColumn("i", F.col("i").cast("long"))
    at = at.select("*", F.expr(f"IF(i % {STRIDE} = 0 AND i + {WINDOW} <= size(words), {_kinds('i', WINDOW)}, NULL)").alias("k"))

    def window(reading: str, length: int, place: str = "i", near: bool = False) -> str:
        return f"({place}) * 128 + {32 * _READINGS.index(reading) + 16 * near + length}"

    def on_grid(told: str, windows: str) -> str:
        return f"IF({told.replace('x.k', 'k')}, {windows}, array())"

    found = [on_grid(_SLOTS, f"array({window('values', WINDOW)})")]
    for words in ("words", "named"):
        near = [f"IF(i >= {b} AND i - {b} + {_LONG} <= size(words), {window(words, _LONG, f'i - {b}', True)}, NULL)" for b in range(STRIDE)]
        found += [on_grid(_TOLD[words], f"array({window(words, WINDOW)})"), on_grid(_FEW[words], f"array({', '.join(near)})")]
    for n, told in short:
        some = [window(words, n) for words in (_READINGS if told else _READINGS[:1])]
        found.append(f"IF(i + {n} <= size(words), array({', '.join(some)}), array())")
    rows = at.select("doc_id", *_READINGS, "kinds", F.explode(F.expr(f"concat({', '.join(found)})")).alias("w"))
    rows = rows.select("doc_id", *_READINGS, "kinds", "w", F.expr("CAST(shiftright(w, 7) AS INT) AS at"), F.expr("CAST(shiftright(w, 5) & 3 AS INT) AS reading"))
    told = f"{_kinds('at', _LONG)} & IF(reading = {_READINGS.index('words')}, 2, 8) > 0"
    rows = rows.filter(f"w IS NOT NULL AND (w & 16 = 0 OR {told})")
    of = F.expr("CASE reading " + " ".join(f"WHEN {i} THEN {r}" for i, r in enumerate(_READINGS)) + " END")
    return rows.select(F.xxhash64(F.slice(of, F.col("at") + 1, F.expr("CAST(w & 15 AS INT)"))).alias("hash"), "doc_id", F.col("at").alias("doc_at"))


def _judged(aligned: DataFrame) -> DataFrame:
    """The best consistent stretch of each pair, over all runs of all its alignments,
    and over those of the ``plain`` reading before others.

    ``part`` holds an alignment's words (t, iv, dv, same). Each run of ``need``
    words is cut where a value of the item stands for another than it did at
    its last place: no stretch holds both places.
    """
    runs = F.expr("""
        filter(zip_with(filter(sequence(0, size(part) - 1), j -> part[j].same AND (j = 0 OR NOT part[greatest(j - 1, 0)].same)),
                        filter(sequence(0, size(part) - 1), j -> part[j].same AND (j = size(part) - 1 OR NOT part[least(j + 1, size(part) - 1)].same)),
                        (a, b) -> struct(a + 1 AS a, b - a + 1 AS n)), r -> r.n >= need)""")
    runs = aligned.filter(F.size("part") > 0).select("doc_id", "item_id", "plain", "need", "part", F.explode(runs).alias("r"))
    runs = runs.select("doc_id", "item_id", "plain", "need", F.expr("slice(part, r.a, r.n)").alias("run"))
    slots = F.expr("""array_sort(filter(transform(run, (p, i) -> struct(p.t AS t, p.iv AS iv, i AS i, p.dv AS dv)), x -> startswith(x.t, '<')))""")
    runs = runs.withColumn("slots", slots)
    cuts = F.expr("""
        array_append(array_sort(transform(filter(sequence(1, greatest(size(slots) - 1, 1)),
            k -> k < size(slots) AND slots[k].t = slots[k - 1].t AND slots[k].iv = slots[k - 1].iv AND slots[k].dv <> slots[k - 1].dv),
            k -> struct(slots[k].i AS end, slots[k - 1].i + 1 AS begin))), struct(size(run) AS end, 0 AS begin))""")
    runs = runs.withColumn("cuts", cuts)
    stretches = F.expr("""
        filter(transform(cuts, (c, k) -> struct(coalesce(array_max(transform(slice(cuts, 1, k), x -> x.begin)), 0) AS a, c.end AS b)),
               s -> s.b - s.a >= need)""")
    found = runs.select("doc_id", "item_id", "plain", "run", F.explode(stretches).alias("s"))
    found = found.select("doc_id", "item_id", "plain", F.expr("slice(run, s.a + 1, s.b - s.a)").alias("s"))
    slots = F.filter("s", lambda p: p["t"].startswith("<"))
    same = F.forall(slots, lambda p: p["iv"] == p["dv"])
    told = F.struct("plain", F.size("s").cast("long").alias("run_tokens"), F.size(slots).cast("long").alias("n_slots"), same.alias("same_values"))
    return found.groupBy("doc_id", "item_id").agg(F.max(told).alias("best")).select("doc_id", "item_id", "best.run_tokens", "best.n_slots", "best.same_values")


def find_leaks(docs: DataFrame, items: DataFrame, min_run: int = MIN_RUN, text: str = "text", doc_id: str = "doc_id",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per leaking (doc_id, item_id): run_tokens, n_slots, same_values.

    A document leaks an item if they share a run of template words of at least
    ``min_run`` words, or of all but one word of a shorter item (never under
    ``WINDOW + STRIDE - 1``), or a whole item of no more words than that, and
    the slots of the run are consistent. Of such an item with fewer than
    ``MIN_LITERAL`` literal words, only copies with the same values count. So it
    is with a run all of whose windows of ``WINDOW + STRIDE - 1`` words have
    fewer. A run with slots that are not is judged by its
    stretches that are, whole verbatim passages among them. ``same_values``: no
    slot was re-parameterised. The longest such stretch of the pair is told, and
    of template words alone before those that need the other readings.

    Null and empty texts and rows with a null id match nothing; rows that
    repeat an id are told once, with their longest run; other columns are not
    read.
    """
    scratch = Scratch(docs.sparkSession)
    least = _LONG
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).filter("item_id IS NOT NULL AND item_text IS NOT NULL")
    items = _cut(items.distinct(), "item_text", "item_id", "item_text")
    items = scratch.write(items.filter(F.size("words") > 0), "items")
    told = f"{_literals('words')} >= {MIN_LITERAL}"
    whole = f"transform(IF({told}, array(words, named, values), array(values)), w -> struct(0 AS at, xxhash64(w) AS hash))"
    windows = [_windows(_grid(_places(1, n), n), _TOLD[words], words, n) for words in ("words", "named") for n in (WINDOW, least)]
    windows.append(_windows(_grid(_places(1)), _SLOTS, "values"))
    item_windows = F.expr(f"IF(size(words) <= {least}, {whole}, concat({', '.join(windows)}))")
    item_windows = scratch.write(
        items.select("item_id", F.explode(item_windows).alias("w")).select("w.hash", "item_id", F.col("w.at").alias("item_at")).distinct(),
        "item_windows",
    )
    short = items.filter(F.size("words") <= least).groupBy(F.size("words").alias("n")).agg(F.max(F.expr(told)).alias("told"))
    short = [(r.n, r.told) for r in short.collect()]  # a row for each length
    cut = _doc_windows(_cut(docs, "text", "doc_id"), short)
    hits = cut.join(item_windows, "hash").select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    hits = scratch.write(hits, "hits")
    found = scratch.write(docs.join(hits.select("doc_id").distinct(), "doc_id").distinct(), "found_docs")
    found = _cut(found, "text", "doc_id").select("doc_id", F.struct("words", "named", "values").alias("doc"))
    asked = items.select("item_id", F.struct("words", "named", "values").alias("item"))
    aligned = hits.join(found, "doc_id").join(asked, "item_id")
    part = F.expr("""
        transform(filter(sequence(0, size(item.words) - 1), j -> j + shift >= 0 AND j + shift < size(doc.words)),
                  j -> struct(item.words[j] AS t, doc.words[j + shift] AS dt, item.named[j] AS n, doc.named[j + shift] AS dn,
                              item.values[j] AS iv, doc.values[j + shift] AS dv))""")
    aligned = aligned.select("doc_id", "item_id", F.size("item.words").alias("item_size"), part.alias("part"))
    readings = F.expr("""
        array(struct(true AS plain, transform(part, p -> struct(p.t AS t, p.iv AS iv, p.dv AS dv, p.t = p.dt AS same)) AS part),
              struct(false AS plain, transform(part, p -> struct(
                  IF(p.n = '<name>' OR NOT startswith(p.dt, '<'), p.n, IF(startswith(p.t, '<'), p.t, p.dt)) AS t, p.iv AS iv, p.dv AS dv,
                  p.t = p.dt OR p.iv = p.dv OR (p.n = '<name>' AND p.dn = '<name>') AS same)) AS part))""")
    aligned = aligned.select("doc_id", "item_id", "item_size", F.explode(readings).alias("r"))
    aligned = aligned.select("doc_id", "item_id", "item_size", "r.plain", "r.part")
    need = F.least(F.col("item_size"), F.greatest(F.lit(least), F.least(F.lit(min_run), F.col("item_size") - 1)))
    return _judged(aligned.select("doc_id", "item_id", "plain", need.alias("need"), "part"))
