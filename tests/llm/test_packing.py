import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidepanel.llm import packing
from tidepanel.llm.queries import tokenizer_path

PATH = tokenizer_path()
REFERENCE = Tokenizer.from_file(PATH)
ENCODE = packing.encoder(open(PATH, "rb").read())


def best_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, c in enumerate(bins) if c >= n]
        if fits:
            bins[min(fits, key=bins.__getitem__)] -= n
        else:
            bins.append(size - n)
    return sorted(bins)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t\r\x0b\x1c\x85\xa0ab1!'sé<|endoftext|>", max_size=60)))
def test_ids_are_the_tokenizers(text):
    assert ENCODE(text).tolist() == REFERENCE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 7, 16, 50])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 120))]
    counts = Counter(lengths)
    runs = packing.plan(counts, size)
    used, left = defaultdict(set), defaultdict(lambda: size)
    for i, (n, rank, first, q, offset) in enumerate(runs):
        end = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == n else counts[n]
        for r in range(rank, end):
            s, o = first + (r - rank) // q, offset + (r - rank) % q * n
            assert not used[s] & set(range(o, o + n))
            used[s] |= set(range(o, o + n))
            left[s] -= n
    assert sorted(left.values()) == best_fit(lengths, size)
    assert all(used[s] == set(range(size - left[s])) for s in left)


def check(rows, texts, size):
    """Round trip: every document's ids in order, sequences gapless and as few as best fit."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = [*REFERENCE.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for i, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at)
            assert r.ids_crc32 == crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            assert r.length == size or r.piece == 0
            at += r.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    assert len(by_seq) == len(best_fit([r.length for r in rows], size))


def test_small_sequences_and_edges(docs_of):
    texts = {1: None, 2: "", 3: "one two three " * 40, 4: "same text", 5: "same text", 6: "x" * 300, 7: "a b c d e f g", 8: " "}
    rows = packing.pack(docs_of(list(texts.items())), PATH, size=32).collect()
    check(rows, texts, 32)
    assert packing.pack(docs_of([(None, "a"), (9, "b"), (9, "b")]), PATH).count() == 3
    assert packing.pack(docs_of([(1, "a")]).limit(0), PATH).collect() == []


def test_table(documents):
    check(packing.pack(documents, PATH).collect(), {r.doc_id: r.text for r in documents.collect()}, packing.SIZE)
