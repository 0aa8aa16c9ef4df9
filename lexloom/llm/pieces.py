"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

One scan of a text visits, at every position, all pieces that end there (the automaton's state and its output links) and
relaxes the best score of that position from that of the piece's start. A character that no path covers falls back to
its UTF-8 bytes. Decoding restores every text exactly: spaces are pieces of their own marker, a literal marker
character is coded as bytes, and one space put before a text is taken off again.

Scores are those of the model's file. A BPE model stores negated merge ranks, under which the best path prefers few and early
pieces; zipf=True reads rank r as -ln(r + 1) instead, the log-probability of Zipf's law. As in the library's unigram models a
character without a piece scores UNKNOWN below the least piece, and with such a model the ids are the library's own. Texts are coded as
they are, without the model's normaliser, so that decoding restores them.

If no piece goes on past a space or holds a line end, as checked on loading, texts are cut there without changing any best path, and
each worker remembers the ids of cut pieces.

Defined results: a null text is empty and has no ids; ties prefer the longer last piece; repeated rows are coded alike;
an empty table gives an empty table; columns named in keep pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexloom.llm.common import Memory, small_batches

MARK = "▁"
#: Added to the least piece score for a character without pieces.
UNKNOWN = -10.0
_CUT = regex.compile(r"\n| *[^ \n]+| +").findall
_models: dict[int, "Pieces"] = {}


class Pieces:
    """A SentencePiece model file, ready to encode and decode."""

    def __init__(self, model: bytes, zipf: bool = False):
        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
        normal = [i for i in range(len(names)) if not (own.is_control(i) or own.is_byte(i) or own.is_unused(i) or own.is_unknown(i))]
        raw = {i: own.get_score(i) for i in normal}
        self.byte_ids = {int(n[1:-1], 16): i for i, n in enumerate(names) if own.is_byte(i)}
        self.scores = {i: -math.log(1 - raw[i]) if zipf else raw[i] for i in normal}
        self.names = {names[i].replace(MARK, " "): i for i in normal}
        self.byte_score = min(self.scores.values()) + UNKNOWN
        self.automaton = ahocorasick.Automaton()
        for name, i in self.names.items():
            self.automaton.add_word(name, (len(name), i, self.scores[i]))
        self.automaton.make_automaton()
        self.cuts = not any(regex.search(r"[^ ] |\n", n) for n in self.names)
        self.bytes = [names[i].replace(MARK, " ").encode() for i in range(len(names))]
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])
        self.remembered = Memory(self._best)

    def _best(self, text: str) -> bytes:
        """Ids (uint32) of the best path through a text whose spaces stand for markers."""
        n, low, fall = len(text), -math.inf, self.byte_score
        best, size, piece = [0.0] + [low] * n, [0] * (n + 1), [-1] * (n + 1)
        done = 0
        for last, (length, i, score) in self.automaton.iter(text):
            end = last + 1
            while done < last:  # positions before this end have met all their pieces
                done += 1
                alone = best[done - 1] + fall
                if alone > best[done]:
                    best[done], size[done], piece[done] = alone, 1, -1
            reached = best[end - length] + score
            if reached > best[end] or (reached == best[end] and length > size[end]):
                best[end], size[end], piece[end] = reached, length, i
        while done < n:
            done += 1
            alone = best[done - 1] + fall
            if alone > best[done]:
                best[done], size[done], piece[done] = alone, 1, -1
        out, at = [], n
        while at:
            if piece[at] < 0:
                out += [self.byte_ids[b] for b in reversed(text[at - 1].encode())]
            else:
                out.append(piece[at])
            at -= size[at]
        return np.array(out[::-1], "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian uint32 ids of a whole text."""
        if not text:
            return b""
        if not self.cuts:
            return self._best(" " + text)
        out = b"".join(map(self.remembered.__getitem__, _CUT(" " + text)))
        self.remembered.age()
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:]


def _model(spec: bytes, zipf: bool = False) -> Pieces:
    key = hash((spec, zipf))
    if key not in _models:
        _models.clear()
        _models[key] = Pieces(spec, zipf)
    return _models[key]


def _load(rows: DataFrame, model_file: str):
    small_batches(rows.sparkSession)
    with open(model_file, "rb") as f:
        return rows.sparkSession.sparkContext.broadcast(f.read())


def encode_pieces(docs: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), zipf: bool = False) -> DataFrame:
    """The keep columns and piece_ids (binary, little-endian uint32) of every whole text; the model file is broadcast."""
    sent = _load(docs, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value, zipf)
        for batch in batches:
            ids = pa.array([model.encode(t) for t in batch.column(len(keep)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids], [*keep, "piece_ids"])

    rows = docs.select(*keep, text)
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), T.StructField("piece_ids", T.BinaryType())]))


def decode_pieces(encoded: DataFrame, model_file: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """encoded with the text of its ids in place of them."""
    sent = _load(encoded, model_file)
    keep = [c for c in encoded.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value)
        for batch in batches:
            texts = pa.array([None if x is None else model.decode(x) for x in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], [*keep, text])

    rows = encoded.select(*keep, ids)
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), T.StructField(text, T.StringType())]))
