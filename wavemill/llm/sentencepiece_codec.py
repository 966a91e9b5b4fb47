"""SentencePiece encoding and decoding.

One Aho-Corasick automaton holds all pieces. It runs over a part of the text once; at every
position its output links give all pieces that end there, and each relaxes the best score of
that position. A character that no piece covers is spelled in byte pieces. A piece sign in the
text itself is spelled in bytes too, so decoding gives back every text exactly.

The public model file is of the merge kind; its scores (minus a merge's rank) serve as the
Viterbi's scores, so ids can differ from those of the merge procedure.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces as P
from .common import Memo, documents, map_rows


class Codec:
    """Encodes and decodes texts; parts that came lately are remembered."""

    def __init__(self, path: str):
        import ahocorasick

        self.pieces = P.load(path)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.pieces.ids.items():
            self.automaton.add_word(piece, (len(piece), self.pieces.scores[piece], i))
        self.automaton.make_automaton()
        self.memo = Memo(self._part)

    def _part(self, part: str) -> bytes:
        """Best ids of a part, as little-endian 32-bit integers; of equal ones the longest last piece."""
        text = "".join(P.SIGN if c == " " else "\0" if c == P.SIGN else c for c in part)
        n, lost = len(text), -float("inf")
        best, back = [0.0] + [lost] * n, [None] * (n + 1)
        at, unknown = 0, self.pieces.unknown
        for end, (length, score, i) in self.automaton.iter(text):
            end += 1
            while at < end - 1:  # positions at which no piece ends
                at += 1
                if best[at - 1] + unknown > best[at]:
                    best[at], back[at] = best[at - 1] + unknown, (1, -1)
            if (new := best[end - length] + score) > best[end]:
                best[end], back[end] = new, (length, i)
        while at < n:
            at += 1
            if best[at - 1] + unknown > best[at]:
                best[at], back[at] = best[at - 1] + unknown, (1, -1)
        ids: list[int] = []
        while n:
            length, i = back[n]
            ids += [i] if i >= 0 else [self.pieces.bytes_from[b] for b in reversed(part[n - 1].encode())]
            n -= length
        return np.array(ids[::-1], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, P.split(text, self.pieces)))

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space that stands before every text goes."""
        text = b"".join(map(self._spelled().__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")
        return text[1:] if text[:1] == " " else text

    def _spelled(self) -> list[bytes]:
        if not hasattr(self, "_bytes"):
            byte = {i: bytes([b]) for b, i in enumerate(self.pieces.bytes_from)}
            self._bytes = [byte.get(i, p.replace(P.SIGN, " ").encode() if p in self.pieces.scores else b"") for i, p in enumerate(self.pieces.by_id)]
        return self._bytes


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids: the token ids of each whole text (null text: empty, which has none)."""

    def make():
        codec = Codec(model)
        return lambda doc_id, text: (doc_id, np.frombuffer(codec.encode(text.decode()), "<u4").astype(np.int32))

    return map_rows(documents(docs), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text: what the ids spell (null ids: empty)."""

    def make():
        codec = Codec(model)
        return lambda doc_id, ids: (doc_id, codec.decode(np.array(ids or [], "<u4").tobytes()))

    return map_rows(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), make, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian 32-bit ids), round_trip: decoded text equals it.

    A row for each input row, in one pass and without a shuffle. Null texts are empty; empty
    texts have no tokens. Repeated rows have equal ids. Other columns are not read.
    """

    def make():
        codec = Codec(model)

        def one(doc_id, data):
            text = data.decode()
            ids = codec.encode(text)
            return doc_id, len(ids) // 4, zlib.crc32(ids), codec.decode(ids) == text

        return one

    return map_rows(documents(docs), make, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
