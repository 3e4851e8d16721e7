"""Pieces and text form of a SentencePiece model file, as both tokenizer operators read them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import sentencepiece

SPACE = "▁"


@dataclass(frozen=True)
class PieceModel:
    pieces: dict[str, int]  # ordinary pieces
    scores: list[float]
    byte_ids: list[int]  # ids of the byte pieces, empty without byte fallback
    unknown: int
    dummy_prefix: bool
    plain: bool  # spaces become SPACE and nothing else changes
    processor: sentencepiece.SentencePieceProcessor = field(repr=False)

    def normalized(self, text: str) -> str:
        """The text as pieces see it."""
        if not self.plain:
            return self.processor.normalize(text)
        text = text.replace(" ", SPACE)
        return SPACE + text if text and self.dummy_prefix else text

    @property
    def cuts_at_space(self) -> bool:
        """True if no piece holds a SPACE behind another character."""
        return not any(SPACE in p.lstrip(SPACE) for p in self.pieces)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """Read a model file; cached for the life of a worker process."""
    from sentencepiece import sentencepiece_model_pb2 as formats

    with open(path, "rb") as file:
        raw = file.read()
    return parse(raw, formats)


def parse(raw: bytes, formats) -> PieceModel:
    proto = formats.ModelProto()
    proto.ParseFromString(raw)
    kinds = formats.ModelProto.SentencePiece
    pieces, byte_ids, unknown = {}, [], 0
    for i, piece in enumerate(proto.pieces):
        if piece.type in (kinds.NORMAL, kinds.USER_DEFINED):
            pieces[piece.piece] = i
        elif piece.type == kinds.BYTE:
            byte_ids.append(i)
        elif piece.type == kinds.UNKNOWN:
            unknown = i
    spec = proto.normalizer_spec
    plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces
    return PieceModel(
        pieces,
        [p.score for p in proto.pieces],
        byte_ids if proto.trainer_spec.byte_fallback else [],
        unknown,
        spec.add_dummy_prefix,
        plain,
        sentencepiece.SentencePieceProcessor(model_proto=raw),
    )
