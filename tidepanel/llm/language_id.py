"""Language identification by Bayesian evidence fusion (operator 6).

Four kinds of evidence meet in one posterior per document:

* text: a multinomial over hashed byte trigrams, counted over all rows by declared language;
* declared markup language: P(declared | language), from counts of declared language against
  the language of the text;
* address suffix: P(suffix | language), counted likewise;
* host prior: P(language | host), smoothed in a hierarchy: host towards its suffix, suffix
  towards the whole collection, each by grouped aggregation.

A text may also be in none of these languages, ``OTHER``. A text of another language is expected
to be ``MARGIN`` nats per trigram less likely than texts of the language it resembles most
are on average, but never less than under equal buckets; rows that declare another language
train it too, at half weight, so that wrong declarations do not draw texts of a known language.
``OTHER`` has votes, a prior, hosts, suffixes and declarations like the languages.

A text of several languages is judged by windows of about ``WINDOW`` trigrams: the share of
the text whose windows are in the language found multiplies its confidence. A text of one
window has no share.

A row's own vote is taken out of the host and suffix counts (leave one out), so a single
document does not confirm itself. The text's log likelihood is divided by ``DAMP``, because
trigrams overlap and are not independent.

Edge cases: a NULL or empty text, NULL or unknown declarations, suffixes and hosts carry no
evidence, and the rest decides; with no evidence at all the collection's prior is returned;
declared languages outside ``LANGUAGES`` train ``OTHER``; repeated rows count each; an empty
table gives no rows. A language of few rows has a flat table, which hardly tells its texts from
those of other languages.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.llm.common import cut_lineage, join_checked, rows_of, text_bytes

LANGUAGES = ("en", "de", "fr", "es")
BUCKETS = 1 << 14
CHUNK = 1 << 10
DAMP = 3.0
KAPPA = 20.0
ALPHA = 0.5
CONFIDENCE = 0.6
OTHER = "other"
MARGIN = 2.0
HEAVIEST = 0.02
WINDOW = 128
HOSTS = 200_000  # rows of host counts that are still broadcast


def trigrams(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the byte trigrams of a text, A-Z lowered, digits left out."""
    b = np.frombuffer(text.lower().translate(None, b"0123456789"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(7)).astype(np.int64) % buckets


def likelihood_table(rows: DataFrame, languages: Sequence[str], buckets: int = BUCKETS) -> np.ndarray:
    """log P(trigram | language), buckets x languages, and in a last column the same of all
    rows that declare another language. Tasks add up their own counts; a few rows per task
    and language are merged by bucket range. The result has a fixed size."""
    at = {x: i for i, x in enumerate(languages)}
    size = len(languages) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((size, buckets), np.int64)
        for b in batches:
            for declared, text in rows_of(b):
                if declared:
                    counts[at.get(declared, size - 1)] += np.bincount(trigrams(text, buckets), minlength=buckets)
        for i in np.flatnonzero(counts.any(1)):
            for c in range(0, buckets, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([c], pa.int32()), pa.array([counts[i, c:c + CHUNK].tobytes()])],
                                                 ["lang", "first", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist())
        return pa.table({"lang": t.column("lang")[:1], "first": t.column("first")[:1], "counts": pa.array([total.tobytes()])})

    kind = "lang int, first int, counts binary"
    counts = np.zeros((size, buckets))
    for r in rows.select("_declared", "_text").mapInArrow(run, kind).groupBy("lang", "first").applyInArrow(add, kind).collect():
        counts[r[0], r[1]:r[1] + CHUNK] = np.frombuffer(r[2], np.int64)
    return np.ascontiguousarray((np.log(counts + ALPHA) - np.log((counts + ALPHA).sum(1, keepdims=True))).T)


def floors(table: np.ndarray) -> np.ndarray:
    """Log likelihood per trigram that ``OTHER`` gives a text that resembles a language. A bucket
    weighs at most ``HEAVIEST`` in the average, so one endless repetition does not set it."""
    weight = np.minimum(np.exp(table), HEAVIEST)
    return np.maximum((weight * table).sum(0) / weight.sum(0) - MARGIN, -np.log(len(table)))


def text_evidence(text: bytes, table: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Damped log likelihood of a text per language and of ``OTHER``, and the share of the
    text that is in each language."""
    n = len(floor)
    x = trigrams(text, len(table))
    if not len(x):
        return np.zeros(n + 1), np.ones(n)
    rows, strange = table[x, :n], table[x, n] - np.log(2.0)

    def other(best: np.ndarray) -> np.ndarray:
        return np.maximum(floor[best], strange)

    known = rows.sum(0) / DAMP
    ll = np.append(known, other(known.argmax()).sum() / DAMP)
    parts = len(x) // WINDOW
    if parts < 2:
        return ll, np.ones(n)
    first = np.arange(parts) * len(x) // parts
    length = np.diff(first, append=len(x))
    part = np.add.reduceat(rows, first, axis=0)
    part = np.column_stack([part, np.add.reduceat(other(np.repeat(part.argmax(1), length)), first)]) / DAMP
    e = np.exp(part - part.max(1, keepdims=True))
    return ll, ((e / e.sum(1, keepdims=True)) * length[:, None]).sum(0)[:n] / len(x)


def identify(docs: DataFrame, text: str = "text", declared: str | None = "lang", suffix: Column | None = None, host: Column | None = None,
             keep: Sequence[str] = ("doc_id",), languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """The columns ``keep``, then ``declared, language, confidence, text_language,
    posterior, other``. ``language`` is one of ``languages`` or ``OTHER``; ``other`` is the
    probability of ``OTHER`` and ``posterior`` (array in the order of ``languages``) holds if it
    is one of them."""
    n = len(languages)
    none = F.lit(None).cast("string")
    rows = docs.select(
        *keep, F.lower(F.substring_index(F.trim(F.col(declared)), "-", 1)).alias("_declared") if declared else none.alias("_declared"),
        F.lower(suffix).alias("_suffix") if suffix is not None else none.alias("_suffix"),
        F.lower(host).alias("_host") if host is not None else none.alias("_host"), text_bytes(text).alias("_text"))
    table = likelihood_table(rows, languages)
    floor = floors(table[:, :n])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [text_evidence(t, table, floor) for t in b.column(len(b.columns) - 1).to_pylist()]
            lists = []
            for k, size in enumerate((n + 1, n)):
                flat = pa.array(np.concatenate([g[k] for g in got]) if got else np.zeros(0))
                lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * size), flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *lists], [*b.schema.names[:-1], "_ll", "_share"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    seen = rows.mapInArrow(likely, ", ".join([*fields, "_ll array<double>", "_share array<double>"]))
    best = F.array_max("_ll")
    vote = F.when((best < 0) & (F.size(F.filter("_ll", lambda x: x == best)) == 1), F.array_position("_ll", best).cast("int") - 1)
    seen = cut_lineage(seen.withColumn("_vote", vote))

    votes = [F.sum((F.col("_vote") == i).cast("long")).alias(f"v{i}") for i in range(n + 1)]
    overall = seen.agg(*votes).first()
    prior = np.array([float(x or 0) + 1.0 for x in overall])
    strange = float(prior[n] / prior.sum())
    prior = (prior[:n] / prior[:n].sum()).tolist()
    # P(declared | language) and P(suffix | language) in the bounded vocabulary of languages and "other".
    spoken = F.when(F.col("_declared").isin(*languages), F.col("_declared")).otherwise(F.lit("?"))
    confusion = {r[0]: r[1:] for r in seen.filter("_declared is not null").groupBy(spoken.alias("d")).agg(*votes).collect()}
    totals = [sum(float(v[i] or 0) for v in confusion.values()) for i in range(n + 1)]
    said = {d: [float(np.log(((float(confusion.get(d, [0] * (n + 1))[i] or 0)) + 1.0) / (totals[i] + n + 1.0))) for i in range(n + 1)] for d in (*languages, "?")}
    by_suffix = seen.filter("_suffix is not null").groupBy("_suffix").agg(*votes)
    by_host = seen.filter("_host is not null").groupBy("_host", "_suffix").agg(*votes)
    sums = [overall[i] or 0 for i in range(n + 1)]

    def renamed(df: DataFrame, mark: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"_of{c}") for c in df.columns if c in ("_host", "_suffix")), *(F.col(f"v{i}").alias(f"{mark}{i}") for i in range(n + 1)))

    s, h = renamed(by_suffix, "s"), renamed(by_host, "h").withColumnRenamed("_of_suffix", "_host_suffix")
    joined = join_checked(seen, s, F.col("_suffix") == F.col("_of_suffix"), "left", HOSTS)
    joined = join_checked(joined, h, (F.col("_host") == F.col("_of_host")) & F.col("_suffix").eqNullSafe(F.col("_host_suffix")), "left", HOSTS)
    known = F.array(*map(F.lit, languages))
    spoken = F.when(F.col("_declared").isNull(), F.lit(-1)).otherwise(F.coalesce(F.nullif(F.array_position(known, F.col("_declared")).cast("int"), F.lit(0)), F.lit(n + 1)) - 1)
    counts = [F.array(*(F.coalesce(F.col(f"{mark}{i}"), F.lit(0)).cast("double") for i in range(n + 1))) for mark in "sh"]
    said = np.array([*(said[d] for d in (*languages, "?")), [0.0] * (n + 1)])
    decide = _decide(languages, np.array(prior), strange, np.array(sums, float), said, host is None)
    names = F.array(*map(F.lit, [*languages, OTHER]))
    found = decide("_ll", "_share", F.coalesce("_vote", F.lit(-1)), spoken, F.col("_suffix").isNotNull(), *counts)
    scored = joined.withColumn("_found", found)
    return scored.select(*keep, F.col("_declared").alias("declared"), F.col("_found.language").alias("language"), F.col("_found.confidence").alias("confidence"),
                         F.when(F.col("_vote").isNotNull(), F.element_at(names, F.col("_vote") + 1)).alias("text_language"),
                         F.col("_found.posterior").alias("posterior"), F.col("_found.other").alias("other"))


def _decide(languages: Sequence[str], prior: np.ndarray, strange: float, sums: np.ndarray, said: np.ndarray, by_suffix: bool):
    """The fused decision as one Arrow function of the small columns of a row: text evidence,
    vote, declared language and leave-one-out counts of suffix and host."""
    n = len(languages)

    def rows(x: pa.Array, size: int) -> np.ndarray:
        return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)

    def decide(ll: pa.Array, share: pa.Array, vote: pa.Array, spoken: pa.Array, has_suffix: pa.Array, s: pa.Array, h: pa.Array) -> pa.Array:
        vote = vote.to_numpy(zero_copy_only=False)
        own = np.arange(n + 1) == vote[:, None]
        s, h = (np.maximum(rows(x, n + 1) - own, 0.0) for x in (s, h))
        sn, hn = s[:, :n].sum(1), h[:, :n].sum(1)
        at_suffix = (s[:, :n] + KAPPA * prior) / (sn + KAPPA)[:, None]
        at_host = (h[:, :n] + KAPPA * at_suffix) / (hn + KAPPA)[:, None]
        # OTHER against all languages together, smoothed likewise.
        other = (s[:, n] + KAPPA * strange) / (sn + s[:, n] + KAPPA)
        other = (h[:, n] + KAPPA * other) / (hn + h[:, n] + KAPPA)
        score = rows(ll, n + 1) + said[spoken.to_numpy(zero_copy_only=False)] + np.column_stack([np.log(at_host), np.log(other / (1 - other))])
        if by_suffix:  # log P(suffix | language) up to what all languages share
            score = score + np.where(has_suffix.to_numpy(zero_copy_only=False)[:, None], np.log((s + KAPPA * np.append(prior, strange)) / (sums + KAPPA)), 0.0)
        whole, known = (np.exp(x - x.max(1, keepdims=True)) for x in (score, score[:, :n]))
        whole, known = (x / x.sum(1, keepdims=True) for x in (whole, known))
        pick = whole.argmax(1)
        part = np.column_stack([rows(share, n), np.ones(len(pick))])
        line = np.arange(len(pick))
        posterior = pa.ListArray.from_arrays(pa.array(np.arange(len(pick) + 1, dtype=np.int32) * n), pa.array(known.ravel()))
        return pa.StructArray.from_arrays(
            [pa.array(np.array([*languages, OTHER], object)[pick], pa.string()), pa.array(whole[line, pick] * part[line, pick]), posterior, pa.array(whole[:, n])],
            ["language", "confidence", "posterior", "other"])

    # Not to be moved or repeated by filters on what it finds.
    return F.arrow_udf(decide, "language string, confidence double, posterior array<double>, other double").asNondeterministic()


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def suffix_of(host: Column) -> Column:
    """The last label of a host name; NULL without one."""
    return F.when(F.length(host) > 0, F.regexp_extract(host, r"([^.]*)\.?$", 1))
