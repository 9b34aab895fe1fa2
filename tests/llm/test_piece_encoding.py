from hashlib import sha256

import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import SF
from tidepanel.llm import piece_encoding
from tidepanel.llm.queries import QUERIES, tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = piece_encoding.Model(PATH)
ENCODER, DECODER = piece_encoding.Encoder(MODEL), piece_encoding.Decoder(MODEL)
PARTS = [" ", "  ", "▁", "a", "e", "the", " the", "\n", "\t", "é", "ß", "한", "😀", "\x00", "1", "23", "²", ".", "==", "aaaa", "ing", " " * 7, "字", "ﷺ", "́"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=16).map("".join)))
def test_ids_are_the_librarys(text):
    ids = LIBRARY.encode(text)
    assert ENCODER.encode(text).tolist() == ids
    assert DECODER.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 258), st.integers(0, MODEL.ids["▁the"])), max_size=8))
def test_any_ids_decode_as_the_library_does(ids):
    assert DECODER.decode(ids) == LIBRARY.decode(ids)


def test_backtracking_agrees_with_plain_merging():
    """Without chunks, memos or a model file's help: every prefix of mixed texts."""
    text = "▁▁▁unbelievablyoverlappingabababab▁▁thethethe"
    for i in range(len(text)):
        plain = [x for s in MODEL.merge(text[i:]) for x in MODEL.fallback(s)]
        assert ENCODER.search(text[i:]) == plain


@pytest.mark.parametrize("text", [" " * 20_001, "a" * 20_000, "=-" * 9000, "naïve" * 9000])
def test_long_words(text):
    assert ENCODER.encode(text).tolist() == LIBRARY.encode(text)


def test_full_memos_change_nothing(monkeypatch):
    monkeypatch.setattr(piece_encoding, "MEMO_CHUNKS", 3)
    monkeypatch.setattr(piece_encoding, "MEMO_PAIRS", 2)
    encoder = piece_encoding.Encoder(MODEL)
    for text in ("some words and some more of them", "words again, unfamiliarish ones"):
        assert encoder.encode(text).tolist() == LIBRARY.encode(text)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(open(PATH, "rb").read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        piece_encoding.Model(str(tmp_path / "m"))


def test_edges(docs_of, spark):
    texts = {1: None, 2: "", 3: " ", 4: "same", 5: "same", 6: "\n\n", 7: "▁x", 8: "word " * 5000}
    got = {r.doc_id: r for r in piece_encoding.decode(piece_encoding.encode(docs_of(list(texts.items())), PATH), PATH).collect()}
    for doc, text in texts.items():
        ids = LIBRARY.encode(text or "")
        assert got[doc].ids == ids and got[doc].text == LIBRARY.decode(ids)
    assert piece_encoding.encode(docs_of([(None, "a"), (9, "b"), (9, "b")]), PATH).count() == 3
    assert piece_encoding.encode(docs_of([(1, "a")]).limit(0), PATH).collect() == []
    assert piece_encoding.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().text == ""


def test_query_against_the_library(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op11_piece_encoding"](spark, SF).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc, text in rows:
        ids = LIBRARY.encode(text or "")
        assert (got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256) == (
            len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(LIBRARY.decode(ids).encode()).hexdigest())
