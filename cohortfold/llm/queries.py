"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortfold.llm import ann, collocations, html_crf, language, mixing, near_dup, quality, repeats, templates, token_files, url_rules, warc, whitening
from cohortfold.llm.shared import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _crc(doc_id) -> F.Column:
    """crc32 of the doc_id as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def op1_html_text(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    return html_crf.extract(pages, html_crf.fit(pages))


def op2_near_dup(spark, sf_dir):
    return near_dup.find_groups(_read(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op3_repeats(spark, sf_dir):
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"), size=20)


def op6_nearest(spark, sf_dir):
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op4_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.apply_rules(_read(spark, sf_dir, "pages"), rules)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_files(spark, sf_dir):
    path = Scratch(spark).path("tokens")
    token_files.write_tokens(_read(spark, sf_dir, "documents"), path, tokenizer_file())
    return token_files.checksums(spark, path)


def op7_language(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    held_out = _crc(F.col("doc_id")) % 3 == 1
    predicted = language.predict(docs, language.fit(docs, ~held_out))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUALITY_AT = 0.3


def quality_model(docs, labels):
    return quality.fit(docs, labels, _crc(F.col("doc_id")) % 5 != 0)


def op8_quality(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(docs, _read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_AT).cast("int").alias("predicted")
    )


#: Domains of the given documents: ranges of their sources' numbers.
DOMAINS = {"web": (0, 4), "books": (5, 9), "code": (10, 14)}
MIX_WEIGHTS = {
    "domain": {"web": 4, "books": 3, "code": 2, "other": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
}


def mix_levels():
    number = F.expr("try_cast(regexp_extract(source, '^src([0-9]+)$', 1) AS INT)")
    domain = F.lit("other")
    for name, (lo, hi) in DOMAINS.items():
        domain = F.when(number.between(lo, hi), name).otherwise(domain)
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op9_mixing(spark, sf_dir):
    return mixing.Mix(_read(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, max_epochs=2, seed=7).selection()


def op10_decontamination(spark, sf_dir):
    return templates.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_collocations(spark, sf_dir):
    return collocations.collocations(_read(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op12_whitening(spark, sf_dir):
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


#: Bytes of a record's block; about one page in ten is longer.
WARC_SEGMENT_BYTES = 8192


def op13_warc(spark, sf_dir):
    path = Scratch(spark).path("archives")
    warc.write_archives(_read(spark, sf_dir, "pages"), path, segment_bytes=WARC_SEGMENT_BYTES)
    found = warc.resolved(warc.read_archives(spark, path))
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_near_dup": op2_near_dup,
    "op3_repeats": op3_repeats,
    "op4_url_filters": op4_url_filters,
    "op5_token_files": op5_token_files,
    "op6_nearest": op6_nearest,
    "op7_language": op7_language,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_whitening": op12_whitening,
    "op13_warc": op13_warc,
}


def _op4_sql():
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH rules(rhost, rpath, v) AS (VALUES {rules}),
u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages)
SELECT page_id, host, path,
  (SELECT rhost || rpath FROM rules
   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
   ORDER BY length(rhost || rpath) DESC, length(rhost) DESC LIMIT 1) AS rule,
  coalesce((SELECT v FROM rules
   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
   ORDER BY length(rhost || rpath) DESC, length(rhost) DESC LIMIT 1), 'allow') AS verdict
FROM u"""


def mix_sql(epochs: int, seed: int, documents: str = "documents") -> str:
    """CTEs up to ``plan`` (leaf, tokens, alloc, full, rest) and ``ordered`` (the next epoch's prefix sums)."""
    domain = "CASE " + " ".join(f"WHEN n BETWEEN {lo} AND {hi} THEN '{d}'" for d, (lo, hi) in DOMAINS.items()) + " ELSE 'other' END"
    weight = {k: "CASE " + " ".join(f"WHEN {k} = '{n}' THEN {w}" for n, w in of.items()) + " ELSE 1 END" for k, of in MIX_WEIGHTS.items()}

    def share(name, cols, parent, w):
        up = f"JOIN {parent} USING ({', '.join(cols[:-1])})" if cols[:-1] else f"CROSS JOIN {parent}"
        part = f"PARTITION BY {', '.join(cols[:-1])}" if cols[:-1] else ""
        return f"""
{name}_n AS (SELECT {', '.join(cols)}, sum(cap)::BIGINT AS cap, ({w})::BIGINT AS w FROM leaves GROUP BY ALL),
{name}_o AS (SELECT *,
    sum(w) OVER ({part}) - coalesce(sum(w) OVER ({part} ORDER BY cap / w, {cols[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rw,
    b - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {cols[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rb
  FROM {name}_n {up}),
{name}_f AS (SELECT *, cap * rw <= rb * w AS full_ FROM {name}_o),
{name} AS (SELECT {', '.join(cols)}, CASE WHEN full_ THEN cap ELSE
    ((b - coalesce(sum(cap) FILTER (full_) OVER ({part}), 0)) * w) // sum(w) FILTER (NOT full_) OVER ({part}) END::BIGINT AS b
  FROM {name}_f)"""

    cols = ["domain", "lang", "source"]
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    TRY_CAST(regexp_extract(source, '^src([0-9]+)$', 1) AS INT) AS n,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM {documents}),
tok AS (SELECT doc_id, {domain} AS domain, lang, source, sum(tokens)::BIGINT AS tokens FROM docs WHERE tokens > 0 GROUP BY ALL),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, (sum(tokens) * {epochs})::BIGINT AS cap FROM tok GROUP BY ALL),
root AS (SELECT sum(tokens)::BIGINT AS b FROM leaves),
{share('l1', cols[:1], 'root', weight['domain'])},
{share('l2', cols[:2], 'l1', weight['lang'])},
{share('l3', cols, 'l2', '1')},
plan AS (SELECT *, b // tokens AS full_epochs, b % tokens AS rest FROM leaves JOIN l3 USING (domain, lang, source)),
ordered AS (
  SELECT t.*, full_epochs, rest, coalesce(sum(t.tokens) OVER (
      PARTITION BY domain, lang, source
      ORDER BY ('0x' || substr(md5('{seed}:' || full_epochs || ':' || doc_id), 1, 15))::BIGINT, doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM tok t JOIN plan USING (domain, lang, source))"""


def _op9_sql():
    return mix_sql(2, 7) + """
SELECT doc_id, domain, lang, source, epoch, tokens AS n_taken
FROM ordered, LATERAL (SELECT unnest(range(full_epochs)) AS epoch)
UNION ALL
SELECT doc_id, domain, lang, source, full_epochs, least(tokens, rest - before) FROM ordered WHERE before < rest"""


def _op10_sql(documents: str = "documents") -> str:
    """The operator's rule, with windows compared as text and runs found as islands."""
    space, punctuation = r"[\x20\x09-\x0D]", r"[^\p{L}\p{N}<>\x20\x09-\x0D]+"
    clean = "translate(coalesce(text, ''), '<>' || chr(1), '   ')"
    template = f"regexp_replace({clean}, '([\\p{{Ll}},;:]{space}+)(\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g')"
    template = f"lower(regexp_replace({template}, chr(1) || '[^\\x20\\x09-\\x0D]+', '<name>', 'g'))"
    edge = r"[^\p{L}\p{N}\x20\x09-\x0D]*"
    for _ in range(2):
        template = f"regexp_replace({template}, '(^|{space}){edge}[0-9][0-9.,:/]*{edge}($|{space})', '\\1<num>\\2', 'g')"
    units = "|".join(templates.UNITS)
    template = f"regexp_replace({template}, '(<num>{space}+)({units})([^\\p{{L}}\\p{{N}}<>\\x20\\x09-\\x0D]*)($|{space})', '\\1<unit>\\4', 'g')"
    template = f"regexp_replace({template}, '{punctuation}', '', 'g')"
    values = f"regexp_replace(lower({clean}), '{punctuation}', '', 'g')"

    def words(name, key, table):
        return f"""
{name}_p AS (
  SELECT {key}, list_filter(list_zip(string_split_regex({template}, '{space}'), string_split_regex({values}, '{space}')), lambda q: q[1] <> '') AS p
  FROM (SELECT DISTINCT {key}, text FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL)),
{name} AS (SELECT {key}, len(p) AS size, unnest(range(len(p))) AS pos, unnest(p)[1] AS t, unnest(p)[2] AS v, p FROM {name}_p)"""

    def windows(name, key, step):
        slice_ = f"list_transform(p[pos + 1:pos + {templates.WINDOW}], lambda x: x[1])"
        return f"""
{name}_w AS (
  SELECT {key}, pos, {slice_} AS w FROM {name}
  WHERE pos % {step} = 0 AND pos + {templates.WINDOW} <= size
    AND len(list_filter({slice_}, lambda x: NOT starts_with(x, '<'))) >= {templates.MIN_LITERAL})"""

    least = templates.WINDOW + templates.STRIDE - 1
    return f"""
WITH {words('d', 'doc_id', documents)}, {words('b0', 'item_id', 'benchmark')},
b AS (SELECT * FROM b0 WHERE size > {least}), {windows('d', 'doc_id', templates.STRIDE)}, {windows('b', 'item_id', 1)},
hits AS (SELECT DISTINCT doc_id, item_id, d_w.pos - b_w.pos AS shift FROM d_w JOIN b_w USING (w)),
cells AS (
  SELECT h.doc_id, h.item_id, shift, b.size, b.pos, b.t, b.v AS iv, d.v AS dv, b.t = d.t AS same,
    row_number() OVER (PARTITION BY h.doc_id, h.item_id, shift ORDER BY b.pos)
      - row_number() OVER (PARTITION BY h.doc_id, h.item_id, shift, b.t = d.t ORDER BY b.pos) AS island
  FROM hits h JOIN b USING (item_id) JOIN d ON d.doc_id = h.doc_id AND d.pos = b.pos + shift),
runs AS (
  SELECT doc_id, item_id, shift, min(pos) AS begin_, count(*) AS run, any_value(size) AS size,
    count(*) FILTER (starts_with(t, '<')) AS slots,
    count(DISTINCT (t, iv, dv)) FILTER (starts_with(t, '<')) AS triples, count(DISTINCT (t, iv)) FILTER (starts_with(t, '<')) AS pairs,
    coalesce(bool_and(iv = dv) FILTER (starts_with(t, '<')), true) AS same_values
  FROM cells WHERE same GROUP BY doc_id, item_id, shift, island),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY run DESC, begin_) = 1)
SELECT doc_id, item_id, max({{'run': run, 'slots': slots, 'same': same_values}}).run AS run_tokens,
  max({{'run': run, 'slots': slots, 'same': same_values}}).slots AS n_slots, max({{'run': run, 'slots': slots, 'same': same_values}}).same AS same_values
FROM longest WHERE run >= greatest({least}, least({templates.MIN_RUN}, size - 1)) AND triples = pairs
GROUP BY doc_id, item_id"""


ORACLES = {"op4_url_filters": _op4_sql(), "op9_mixing": _op9_sql(), "op10_decontamination": _op10_sql()}
