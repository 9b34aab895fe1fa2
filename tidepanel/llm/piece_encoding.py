"""Exact SentencePiece BPE encoding by backtracking, and decoding (operator 11).

A merge-type model joins the neighbouring symbols whose concatenation is the piece of highest
score, the leftmost of equals, until no piece can be formed. The encoder finds the result
without running those merges over the text, from two facts that follow from merges being
local: a sequence of pieces is the encoding of its text if and only if each two neighbours
alone encode to themselves; and every prefix has one encoding only, so a position from which
the text cannot be finished is lost for good. Hence

* one Aho-Corasick pass over the reversed text gives the longest piece that starts at every
  position, a table leads to the next shorter one;
* a piece is taken if it fits the one before it, checked by re-merging the two (memoised);
* positions that cannot be finished are marked in a bitfield, and the encoder steps back.

Texts fall into chunks first where no piece can cross, as the vocabulary shows: before white
space marks, between letters and other characters, and around characters outside the pieces'
alphabet, which become bytes. Chunks of up to ``MEMO_CHARS`` characters are remembered per Python
worker in bounded memos.

Edge cases: NULL and empty texts give no ids and decode to an empty text; a lone mark of white
space (``U+2581``) in a text counts as a space, as in the library; rows repeat as they come;
very long texts and very long words are encoded whole, in time linear in their length; an
empty table gives no rows. Models that normalise, have no byte pieces, or hold user-defined
or unused pieces are refused.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import rows_of, text_bytes

SPACE = "▁"
MEMO_CHARS = 64
ODD = 100
MEMO_CHUNKS = 300_000
MEMO_PAIRS = 800_000


class Model:
    """What encoder and decoder need of a SentencePiece file; travels to tasks by broadcast."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds = proto.ModelProto.SentencePiece
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if train.model_type != proto.TrainerSpec.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte pieces and leading white space marks")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that leave texts as they are")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == kinds.NORMAL}
        self.bytes = [0] * 256
        self.surface = []
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
            self.surface.append(bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL
                                else train.unk_surface.encode() if p.type == kinds.UNKNOWN else p.piece.replace(SPACE, " ").encode())
        self.control = {i for i, p in enumerate(spec.pieces) if p.type == kinds.CONTROL}
        self.leading = {i for s, i in self.ids.items() if s.startswith(SPACE)}
        alphabet = {c for s in self.ids for c in s}
        #: What a position can hold: pieces that merging does reach, and characters that are no piece alone.
        self.units = [s for s in self.ids if len(self.merge(s)) == 1] + sorted(alphabet - self.ids.keys())
        self.chunks = self._chunks()
        self._encoder: Encoder | None = None

    def _chunks(self) -> str:
        """A pattern of chunks that no piece crosses: white space marks lead letters or other
        characters, as far as the pieces keep them apart; else the whole text."""
        if any(SPACE in s.lstrip(SPACE) for s in self.ids):
            return r"(?s).+"
        odd = ""  # word characters that pieces join with others count as others
        while len(odd) <= ODD:
            letter, other = rf"[^\W\d_{odd}]", rf"(?:[^\w{SPACE}]|[\d_{odd}])"
            mixed = re.compile(rf"({letter})(?:{other})|{other}({letter})")
            more = {x for s in self.ids for pair in mixed.findall(s) for x in pair if x}
            if not more:
                return rf"{SPACE}*(?:{letter}+|{other}+)|{SPACE}+"
            odd += "".join(sorted(more))
        return rf"{SPACE}*[^{SPACE}]+|{SPACE}+"

    def merge(self, text: str) -> list[str]:
        """The plain merge procedure, for short texts."""
        score, none = self.scores.get, float("-inf")
        parts = list(text)
        joined = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while joined and (best := max(joined)) > none:
            i = joined.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if i:
                joined[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(joined):
                joined[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def encoder(self) -> Encoder:
        """The encoder of this process: a reused Python worker keeps it, with its memos, from task to task."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder

    def fallback(self, text: str) -> list[int]:
        """The ids of a unit: its own, or those of its bytes."""
        i = self.ids.get(text)
        return [i] if i is not None else [self.bytes[b] for b in text.encode()]


class Encoder(dict):
    """Chunk to the tuple of its ids; the dict itself is the memo."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.units = model, model.units
        number = {s: i for i, s in enumerate(self.units)}
        self.size = [len(s) for s in self.units]
        self.out = [model.fallback(s) for s in self.units]
        self.shorter = [next((number[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in number), None) for s in self.units]
        self.whole = {s: (model.ids[s],) for s in self.units if s in model.ids}
        self.automaton = ahocorasick.Automaton()
        for s, i in number.items():
            self.automaton.add_word(s[::-1], i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.find = re.compile(model.chunks).findall

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the texts of both units ends with just these two."""
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        parts = self.model.merge(self.units[a] + self.units[b])
        found = self.pairs[a << 32 | b] = len(parts) == 2 and parts[0] == self.units[a]
        return found

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        found = self.whole.get(chunk) or tuple(self.search(chunk))
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO_CHUNKS:
                self.clear()
            self[chunk] = found
        return found

    def search(self, text: str) -> list[int]:
        """Ids of a chunk; characters that no unit holds stand alone."""
        n, found, start = len(text), [], 0
        # Matches that end at one place of the reversed text come by falling length; turned round, the longest stays.
        longest = dict(reversed(list(self.automaton.iter(text[::-1]))))
        for stop in (i for i in range(n + 1) if n - 1 - i not in longest) if len(longest) < n else (n,):
            for unit in self.path(longest, n - 1, start, stop):
                found += self.out[unit]
            if stop < n:
                found += self.model.fallback(text[stop])
            start = stop + 1
        return found

    def path(self, longest: dict[int, int], last: int, start: int, stop: int) -> list[int]:
        """The one chain of fitting units from ``start`` to ``stop``; ``longest`` counts places from the end."""
        size, shorter, known = self.size, self.shorter, self.pairs.get
        chosen: list[int] = []
        at = start
        unit = longest[last - at] if at < stop else None
        lost = None  # a bit per position, once one cannot be finished
        while at < stop:
            while unit is not None:
                to = at + size[unit] - start
                if lost is None or not lost[to >> 3] >> (to & 7) & 1:
                    if not chosen:
                        break
                    fit = known(chosen[-1] << 32 | unit)
                    if self.fits(chosen[-1], unit) if fit is None else fit:
                        break
                unit = shorter[unit]
            if unit is None:
                if not chosen:
                    raise RuntimeError("a text without an encoding: the pieces do not cover their alphabet")
                if lost is None:
                    lost = bytearray((stop - start) // 8 + 1)
                lost[at - start >> 3] |= 1 << (at - start & 7)
                unit = chosen.pop()
                at -= size[unit]
                unit = shorter[unit]
            else:
                chosen.append(unit)
                at += size[unit]
                unit = longest[last - at] if at < stop else None
        return chosen

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        marked = (SPACE if self.model.prefix else "") + text.replace(" ", SPACE)
        return np.fromiter(chain.from_iterable(map(self.__getitem__, self.find(marked))), np.int32)


def _each_byte(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


class Decoder:
    def __init__(self, model: Model):
        codecs.register_error("each_byte", _each_byte)
        self.model = model

    def decode(self, ids: list[int]) -> str:
        """Surfaces of the pieces; the first piece loses the white space mark that encoding added."""
        m = self.model
        runs, first = [ids], next((i for i in ids if m.surface[i]), None)
        if not m.control.isdisjoint(ids):  # they part bytes that would make one character
            cuts = [-1, *(i for i, x in enumerate(ids) if x in m.control), len(ids)]
            runs = [ids[a + 1:b] for a, b in zip(cuts, cuts[1:])]
        text = "".join(b"".join(map(m.surface.__getitem__, r)).decode("utf-8", "each_byte") for r in runs)
        return text[1:] if m.prefix and first in m.leading else text


def _shared(spark, model: str):
    return spark.sparkContext.broadcast(Model(model))  # one vocabulary file


def encode(docs: DataFrame, model: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id`` and ``ids``, the ids of the whole text without begin or end ids; with ``decoded``
    also the ``text`` that :func:`decode` gives for them, in the same pass."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    shared = _shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = shared.value.encoder(), Decoder(shared.value)
        for b in batches:
            found = [encoder.encode(t.decode("utf-8", "replace")) for _, t in rows_of(b)]
            edges = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            out = {"doc_id": b.column(0), "ids": pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))}
            if decoded:
                out["text"] = pa.array([decoder.decode(x.tolist()) for x in found], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return src.mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * decoded)


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``doc_id``, ``ids`` and the ``text`` they stand for; NULL ids stand for an empty text."""
    src = encoded.select("doc_id", F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    shared = _shared(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for b in batches:
            column = b.column(1)
            flat, edges = column.values.to_numpy(), column.offsets.to_numpy()
            texts = [decoder.decode(flat[x:y].tolist()) for x, y in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), column, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return src.mapInArrow(run, "doc_id long, ids array<int>, text string")
