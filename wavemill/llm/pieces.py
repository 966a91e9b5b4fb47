"""The pieces and scores of a SentencePiece model file, and how texts part before its Viterbi.

Spaces become the piece sign and one is put first. No piece of such a model has the sign after
another character, or a line end, so a best segmentation of a text is the best ones of its parts
in a row: spaces with what follows them up to the next space or line end. Where a model breaks
that rule a text is one part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

SIGN = "▁"
#: What an unknown character costs more than the worst piece.
UNKNOWN_PENALTY = 10.0


@dataclass
class Pieces:
    scores: dict[str, float]
    ids: dict[str, int]
    by_id: list[str]
    bytes_from: list[int]
    unknown: float
    longest: int
    parts: re.Pattern = field(repr=False)


def load(path: str) -> Pieces:
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    by_id = [m.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    scores = {by_id[i]: m.get_score(i) for i in plain}
    of_bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    simple = not any("\n" in p or SIGN in p.lstrip(SIGN) for p in scores)
    parts = re.compile(r" *[^ \n]+| +|\n") if simple else re.compile(r"(?s).+")
    return Pieces(scores, {by_id[i]: i for i in plain}, by_id, of_bytes, min(scores.values()) - UNKNOWN_PENALTY, max(map(len, scores)), parts)


def split(text: str, pieces: Pieces) -> list[str]:
    """The parts of a text, the space that stands before every text included; '' has none."""
    return pieces.parts.findall(f" {text}") if text else []
