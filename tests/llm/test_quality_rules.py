import random
import re

from tidepanel.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    again = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_counts_against_brute_force(docs_of):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", "a b c d e", "a b c d e a b c d e", "x " * 400, "é|ü\n\n é|ü\r\né|ü", "long" * 5000,
             *("".join(rng.choice(["a ", "b ", "c\n", "dd ", "# ", "\t", "é "]) for _ in range(rng.randint(1, 120))) for _ in range(150))]
    docs = docs_of(list(enumerate(texts)) + [(None, "a b"), (0, None)])
    got = qr.apply_policy(qr.ledger(qr.measure(docs))).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = brute(texts[r.doc_id] if r.doc_id is not None else "a b")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (r.doc_id, want)
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)


def test_many_distinct_words_are_numbered_exactly():
    words = [f"{i}".encode() for i in range(30000)]
    assert qr._repeat_words(words + [b"z"] + words[:7]) == 14


def test_ablation_counts_bits(docs_of):
    docs = docs_of([(1, "a b"), (2, "# # # # # # # # # # # #"), (3, " ".join("word%d" % i for i in range(20))), (4, "# #")])
    led = qr.ledger(qr.measure(docs))
    bits = {r.doc_id: r.fail_bits for r in led.collect()}
    got = {r.rule: r for r in qr.ablation(led).collect()}
    for i, (name, _) in enumerate(qr.RULES):
        assert got[name].fails == sum(b >> i & 1 for b in bits.values())
        assert got[name].rejects_alone == sum(b == 1 << i for b in bits.values())
        assert got[name].kept == sum(b == 0 for b in bits.values())
        assert got[name].kept_without == got[name].kept + got[name].rejects_alone
    assert qr.ablation(led.limit(0)).collect() == []


def test_bad_labels_go_and_good_ones_stay(spark, documents):
    from tests.llm.conftest import SF
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in qr.apply_policy(qr.ledger(qr.measure(documents))).collect()}
    good = [kept[d] for d, q in labels.items() if q == 1]
    bad = [kept[d] for d, q in labels.items() if q == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / max(len(bad), 1) < 0.3
