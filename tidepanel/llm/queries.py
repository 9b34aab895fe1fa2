"""Registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.llm import collocations, exact_topk, hmm_lm, jaccard_join, language_id, mixing, packing, piece_encoding, quality_classifier, quality_rules, run_detection, toxicity, warc
from tidepanel.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- 1 quality classifier

@query("op1_quality_classifier")
def op1(spark, sf):
    return quality_classifier.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


# ---------------------------------------------------------------- 2 exact top-k

@query("op2_exact_topk", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5""")
def op2(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return exact_topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


# ---------------------------------------------------------------- 3 packing

@query("op3_best_fit_packing")
def op3(spark, sf):
    return packing.pack(table(spark, sf, "documents"), tokenizer_path())


# ---------------------------------------------------------------- 4 quality rules

_COUNTS_SQL = rf"""words AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
grams AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) > 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY 1),
lines AS (SELECT doc_id, sum(c) AS n, sum(c - 1) AS dup FROM (SELECT doc_id, line, count(*) AS c
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(a.n, 0) AS BIGINT) AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
  len(list_filter(range(1, len(w)), lambda i: w.w[i] = w.w[i + 1])) AS n_same_next
  FROM words w LEFT JOIN again a USING (doc_id) LEFT JOIN lines l USING (doc_id))"""
_FAILS_SQL = " OR ".join(f"({c})" for _, c in quality_rules.RULES)
_BASE_SQL = " OR ".join(f"({c})" for n, c in quality_rules.RULES if n in quality_rules.BASE)


@query("op4_quality_rules", f"""WITH {_COUNTS_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_BASE_SQL}) AS base_failed, NOT ({_FAILS_SQL}) AS kept FROM m""")
def op4(spark, sf):
    out = quality_rules.apply_policy(quality_rules.ledger(quality_rules.measure(table(spark, sf, "documents"))))
    return out.select("doc_id", *quality_rules.MEASURES[:5], "base_failed", "kept")


# ---------------------------------------------------------------- 5 LM scoring

@query("op5_hmm_lm")
def op5(spark, sf):
    return hmm_lm.score(table(spark, sf, "documents"))


# ---------------------------------------------------------------- 6 language identification

@query("op6_language_id")
def op6(spark, sf):
    """Documents: the declared language is their ``lang``, the host their ``source``."""
    out = language_id.identify(table(spark, sf, "documents"), host=F.col("source"))
    kept = F.col("language").isin(*language_id.LANGUAGES) & (F.col("confidence") >= language_id.CONFIDENCE)
    return out.select("doc_id", "declared", "language", "text_language", F.round("confidence", 9).alias("confidence"), kept.alias("kept"))


@query("pages_language_id")
def pages_language(spark, sf):
    """The same operator with all its evidence: markup language, address suffix and host."""
    pages = table(spark, sf, "pages")
    host = language_id.host_of("url")
    seen = pages.select("page_id", warc.plain_text(F.coalesce("html", F.lit(""))).alias("text"), host.alias("host"),
                        F.regexp_extract("html", warc.LANGUAGE, 1).alias("lang"))
    out = language_id.identify(seen.withColumn("lang", F.when(F.col("lang") != "", F.col("lang"))), declared="lang",
                               suffix=language_id.suffix_of(F.col("host")), host=F.when(F.col("host") != "", F.col("host")), keep=("page_id", "host"))
    return out.select("page_id", "host", "declared", "language", "text_language", F.round("confidence", 9).alias("confidence"))


# ---------------------------------------------------------------- 7 WARC derivatives

def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _sql_text(c: str) -> str:
    c = f"regexp_replace({c}, '{warc.DROP}', ' ', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '{warc.BREAK}', chr(10), 'g'), '{warc.TAG}', '', 'g')"
    part = lambda pattern: f"regexp_extract(x, '{pattern}', 1)"
    code = f"""coalesce(TRY_CAST({part("^#([0-9]{1,7});")} AS BIGINT), TRY_CAST('0x' || nullif({part("^#[xX]([0-9A-Fa-f]{1,6});")}, '') AS BIGINT))"""
    char = (f"CASE WHEN {code} = 160 THEN ' ' WHEN {code} BETWEEN 1 AND 1114111 AND {code} NOT BETWEEN 55296 AND 57343 THEN chr(CAST({code} AS INTEGER)) "
            f"WHEN {code} IS NOT NULL THEN chr(65533) ELSE entities[{part('^([A-Za-z][A-Za-z0-9]*);')}] END")
    c = (f"array_to_string(list_transform(string_split({c}, '&'), lambda x, i: CASE WHEN i = 1 THEN x WHEN {char} IS NOT NULL "
         f"THEN {char} || regexp_replace(x, '^[^;]*;', '') ELSE '&' || x END), '')")
    c = f"regexp_replace({c}, '{warc.SPACES}', ' ', 'g')"
    return f"regexp_replace(regexp_replace({c}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


def _sql_id(*parts: str) -> str:
    return f"regexp_replace(md5(concat_ws('|', {', '.join(parts)})), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '<urn:uuid:\\1-\\2-\\3-\\4-\\5>')"


_ENTITIES_SQL = "MAP {" + ", ".join(f"'{name}': '{char.replace(chr(39), chr(39) * 2)}'" for name, char in warc.ENTITIES.items()) + "}"
_LINE = "chr(13) || chr(10)"
_WARC_SQL = f"""WITH r AS (SELECT page_id, {_sql_id("'response'", "CAST(page_id AS VARCHAR)", "url", f"'{warc.DATE}'", "'sha256:' || sha256(coalesce(html, ''))")} AS refers_to, url AS target_uri, '{warc.DATE}' AS date,
  coalesce(html, '') AS payload, {_ENTITIES_SQL} AS entities FROM pages),
f AS (SELECT *, trim(regexp_replace(regexp_extract(payload, '{warc.TITLE}', 1), '\\s+', ' ', 'g')) AS title,
  regexp_extract(payload, '{warc.LANGUAGE.replace("'", "''")}', 1) AS lang, list_transform(regexp_extract_all(payload, '{_quoted(warc.LINK)}', 1), lambda x: regexp_replace(x, '^["'']|["'']$', '', 'g')) AS links FROM r),
d AS (SELECT page_id, refers_to, target_uri, date, 'sha256:' || sha256(payload) AS source_digest, unnest([
  {{'record_type': 'metadata', 'content_type': 'application/warc-fields', 'block': 'source-content-type: text/html; charset=utf-8' || {_LINE}
    || CASE WHEN title <> '' THEN 'title: ' || title || {_LINE} ELSE '' END || CASE WHEN lang <> '' THEN 'language: ' || lang || {_LINE} ELSE '' END
    || 'outlinks: ' || len(links) || {_LINE} || coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || x || {_LINE}), ''), '')}},
  {{'record_type': 'conversion', 'content_type': 'text/plain; charset=utf-8', 'block': {_sql_text("payload")}}}]) AS k FROM f)
SELECT page_id, k.record_type AS record_type, {_sql_id("k.record_type", "refers_to")} AS record_id, refers_to,
  CASE WHEN k.record_type = 'conversion' THEN {_sql_id("'metadata'", "refers_to")} END AS concurrent_to, target_uri, date, k.content_type AS content_type,
  CAST(strlen(k.block) AS BIGINT) AS content_length, source_digest, 'sha256:' || sha256(k.block) AS block_digest, k.block AS block FROM d"""


@query("op7_warc_derivatives", _WARC_SQL)
def op7(spark, sf):
    return warc.derive(warc.responses(table(spark, sf, "pages")))


# ---------------------------------------------------------------- 8 toxicity

@query("op8_toxicity")
def op8(spark, sf):
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


# ---------------------------------------------------------------- 9 n-gram Jaccard join

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query("op9_ngram_jaccard_join", rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)""")
def op9(spark, sf):
    return jaccard_join.join_documents(table(spark, sf, "documents"))


# ---------------------------------------------------------------- 10 mixing

@query("op10_source_mixing")
def op10(spark, sf):
    out = mixing.mix(table(spark, sf, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


# ---------------------------------------------------------------- 11 SentencePiece encoding

@query("op11_piece_encoding")
def op11(spark, sf):
    out = piece_encoding.encode(table(spark, sf, "documents"), tokenizer_path("piece_bpe_32k.model"), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


# ---------------------------------------------------------------- 12 collocations

@query("op12_collocations", rf"""WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS MATERIALIZED (SELECT lang, p, CAST(count(*) AS HUGEINT) AS f FROM (SELECT lang, unnest(flatten([w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])])) AS p FROM w) GROUP BY 1, 2),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE NOT contains(p, ' ') GROUP BY 1),
c AS MATERIALIZED (SELECT lang, p, f AS a, string_split(p, ' ') AS s FROM f WHERE f >= {collocations.LEAST} AND contains(p, ' ')),
cuts AS (SELECT lang, p, s, a, k, array_to_string(s[1:k], ' ') AS x, array_to_string(s[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, len(s))) AS k FROM c)),
scored AS (SELECT cuts.*, x.f AS l, y.f AS r, {collocations.SCALE} * a * a // (x.f * y.f) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.p = cuts.x JOIN f y ON y.lang = cuts.lang AND y.p = cuts.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (SELECT lang, q, max(a) AS a FROM (SELECT lang, a, unnest([s[1] || ' ' || s[2], s[2] || ' ' || s[3]]) AS q FROM c WHERE len(s) = 3) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.q = best.p WHERE longer.a IS NULL OR 100 * longer.a < {collocations.WITHIN} * best.a)
SELECT lang, rank, p AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= {collocations.TOP}""")
def op12(spark, sf):
    return collocations.mine(table(spark, sf, "documents"))


# ---------------------------------------------------------------- 13 periodic runs

def _repeated_tail() -> Column:
    """The text whose words from the a-th on repeat the p words there, where the id's hash asks for it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), r"[ \x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(F.col("text"))


@query("op13_periodic_runs")
def op13(spark, sf):
    found = run_detection.find(table(spark, sf, "documents").select("doc_id", _repeated_tail().alias("text")))
    best = run_detection.strongest()
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", *(f"best.{c}" for c in ("start", "length", "period")), F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")
