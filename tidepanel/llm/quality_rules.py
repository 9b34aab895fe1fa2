"""Quality rules as a bitmask ledger (operator 4).

Every text is read once: ``measure`` counts, ``ledger`` stores one bit for each rule
that fails next to the measurements. Policies are versions of a mask over these bits,
so a new policy, or the effect of leaving a rule out, needs no second pass over texts:
``apply_policy`` masks the bits and ``ablation`` adds up (bits, count) pairs.

Edge cases: a NULL text has no words and fails ``few_words``; a NULL ``doc_id`` is kept
as it is; repeated rows are measured each; an empty table gives an empty ledger. Other
columns of the input are passed by (``keep``) or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.llm.common import text_bytes

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_same_next")
# Byte classes of the measurements.
SYMBOLS = b"#*$%&|<>"
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SPACES = b" \t\n\x0b\x0c\r"

# Rules in bit order: (name, condition under which it fails). All arithmetic is on integers.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("shouting", "2 * n_upper > n_letters"),
    ("duplicate_lines", "n_dup_lines >= 5 AND 100 * n_dup_lines > 50 * n_lines"),
    ("stutter", "100 * n_same_next > 30 * n_words"),
)
BASE = ("few_words", "repeated_words")
# Versions of the policy: which rules reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": tuple(n for n, _ in RULES),
}


def _repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    m = n - width + 1
    key, span = ids[:m], len(seen)
    for i in range(1, width):  # windows are numbered exactly, no hash
        if span * len(seen) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            span = m
        key, span = key * len(seen) + ids[i:m + i], span * len(seen)
    order = np.argsort(key, kind="stable")
    eq = key[order][1:] == key[order][:-1]
    if not eq.any():
        return 0
    hit = np.zeros(n + 1, np.int64)
    twice = np.zeros(m, bool)
    twice[order[1:][eq]] = True
    twice[order[:-1][eq]] = True
    at = np.flatnonzero(twice)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + width, -1)
    return int((np.cumsum(hit)[:n] > 0).sum())


def _measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    letters = len(text) - len(text.translate(None, LETTERS))
    upper = len(text) - len(text.translate(None, LETTERS[:26]))
    chars = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, SPACES)))
    return (len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), dup, _repeat_words(words), lines, letters, upper,
            sum(map(eq, words, words[1:])))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and one LONG column for each of ``MEASURES``."""
    src = docs.select(*keep, text_bytes(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([_measure(t) for t in b.column(len(keep)).to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *(pa.array(c) for c in got.T)], [*keep, *MEASURES])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]
    return src.mapInArrow(run, ", ".join([*fields, *(f"{m} long" for m in MEASURES)]))


def ledger(measured: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Adds ``fail_bits``: bit ``i`` is set where rule ``i`` fails."""
    bits: Column = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(rules):
        bits = bits + F.when(F.expr(fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return measured.withColumn("fail_bits", bits)


def mask_of(names: tuple[str, ...], rules: tuple[tuple[str, str], ...] = RULES) -> int:
    at = {n: i for i, (n, _) in enumerate(rules)}
    return sum(1 << at[n] for n in names)


def apply_policy(ledgered: DataFrame, version: str = "v1") -> DataFrame:
    """Adds ``base_failed``, ``kept`` and the policy's ``version``."""
    bits = F.col("fail_bits")
    return ledgered.withColumns({
        "base_failed": bits.bitwiseAND(F.lit(mask_of(BASE))) != 0,
        "kept": bits.bitwiseAND(F.lit(mask_of(POLICIES[version]) | mask_of(BASE))) == 0,
        "version": F.lit(version),
    })


def ablation(ledgered: DataFrame, version: str = "v1", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """For each rule of a policy: how many documents it fails, how many it alone rejects,
    and how many are kept with all rules and without it. One aggregate over distinct bit
    patterns; the rest works on these counts."""
    mask = mask_of(POLICIES[version], rules)
    patterns = ledgered.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("docs"))
    one = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
                              for i, (n, _) in enumerate(rules) if mask >> i & 1)))
    add = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("docs"))), F.lit(0))
    return (patterns.withColumn("r", one).select("bits", "docs", "r.rule", "r.bit").groupBy("rule")
            .agg(add(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("fails"),
                 add(F.col("bits") == F.col("bit")).alias("rejects_alone"),
                 add(F.col("bits") == 0).alias("kept"),
                 add((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("kept_without")))
