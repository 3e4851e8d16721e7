"""SentencePiece encoding and decoding: Viterbi over an Aho-Corasick automaton.

All pieces of a model file go into one Aho-Corasick automaton. A text is read
once; at each position the automaton's output links name every piece that ends
there, longest first, and each relaxes the best score of a segmentation up to that
position. Scores are added in double precision. On equal scores the longer last
piece wins. A character that is no piece alone costs the lowest score less 10 and
becomes its byte pieces, or the unknown piece in models without them.

No piece reaches back over the start of a word (a space behind another character)
in models that say so; there the best segmentations of the words, which are kept,
make up that of the text. Otherwise the text is one word.

Decoding puts the pieces' bytes behind each other and drops the prefix space, so
it gives back every text of a model with byte pieces and no normalisation; only
the sign U+2581, which stands for a space in pieces, comes back as a space.

Null and empty texts have no pieces and decode to an empty text. Repeated rows are
encoded each; other columns are kept.
Very long texts are encoded whole. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from . import piece_model
from .batches import add_column
from .piece_model import SPACE, PieceModel

MOST_WORDS = 150_000  # segmentations kept by a worker; then it begins anew, with the same results
UNKNOWN_PENALTY = 10.0
NOWHERE = float("-inf")
UNKNOWN_SURFACE = " ⁇ ".encode()


class Codec:
    def __init__(self, model: PieceModel):
        self.model = model
        lowest = min((model.scores[i] for i in model.pieces.values()), default=0.0)
        self.unknown_score = lowest - UNKNOWN_PENALTY
        self.by_space = model.cuts_at_space
        self.word = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        surfaces = [b""] * len(model.scores)
        for piece, i in model.pieces.items():
            surfaces[i] = piece.replace(SPACE, " ").encode()
        for value, i in enumerate(model.byte_ids):
            surfaces[i] = bytes([value])
        surfaces[model.unknown] = UNKNOWN_SURFACE
        self.surfaces = pa.array(surfaces, pa.binary())
        self.singles = {p for p in model.pieces if len(p) == 1}
        self.words: dict[str, array] = {}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Length, score and id of each piece; workers that only decode don't build it."""
        found = ahocorasick.Automaton()
        for piece, i in self.model.pieces.items():
            found.add_word(piece, (len(piece), self.model.scores[i], i))
        found.make_automaton()
        return found

    def viterbi(self, text: str) -> array:
        """Best segmentation of normalised text, in one pass from left to right."""
        size = len(text)
        best = [NOWHERE] * (size + 1)
        best[0] = 0.0
        length_at, id_at = [1] * (size + 1), [-1] * (size + 1)  # the last piece of the best segmentation
        if self.singles.issuperset(text):
            for last, (length, score, i) in self.automaton.iter(text):
                end = last + 1
                total = best[end - length] + score
                if total > best[end]:
                    best[end], length_at[end], id_at[end] = total, length, i
        else:
            ending: list[list] = [[] for _ in range(size + 1)]
            for last, piece in self.automaton.iter(text):
                ending[last + 1].append(piece)
            for end in range(1, size + 1):
                if text[end - 1] not in self.singles:
                    ending[end].append((1, self.unknown_score, -1))
                for length, score, i in ending[end]:
                    total = best[end - length] + score
                    if total > best[end]:
                        best[end], length_at[end], id_at[end] = total, length, i
        out = array("i")
        end = size
        while end:
            i = id_at[end]
            if i >= 0:
                out.append(i)
            elif self.model.byte_ids:
                out.extend(self.model.byte_ids[b] for b in reversed(text[end - 1].encode("utf-8", "surrogatepass")))
            elif not out or out[-1] != self.model.unknown:  # neighbouring unknown characters are one piece
                out.append(self.model.unknown)
            end -= length_at[end]
        out.reverse()
        return out

    def encode(self, text: str) -> array:
        """Piece ids of a whole text."""
        text = self.model.normalized(text)
        if not text:
            return array("i")
        if not self.by_space:
            return self.viterbi(text)
        if SPACE + SPACE in text:
            words = self.word.findall(text)
        else:
            words = [SPACE + w for w in text.split(SPACE)]
            if text[0] == SPACE:
                del words[0]
            else:
                words[0] = words[0][1:]
        out = array("i")
        known = self.words
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = self.viterbi(w)
            out.extend(ids)
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        return [np.frombuffer(self.encode(t), np.int32) for t in texts]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0]

    def decode_all(self, rows: pa.ListArray) -> list[str]:
        """The text of each row's ids: the bytes of all pieces, taken at once and cut at the rows' ends."""
        flat = rows.flatten()
        pieces = self.surfaces.take(flat)
        starts = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset :] if len(pieces) else np.zeros(1, np.int32)
        data = memoryview(pieces.buffers()[2] or b"")
        lengths = np.array(pc.fill_null(pc.list_value_length(rows), 0))
        ends = starts[np.concatenate([[0], np.cumsum(lengths)])]
        texts = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist())]
        return [t[1:] if self.model.dummy_prefix and t.startswith(" ") else t for t in texts]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a model file; one per worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(piece_model.load(path))
    return _codecs[path]


def encode(documents: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``documents`` with the piece ids of ``text`` as array<int>."""

    def compute(texts: list[str | None]) -> pa.Array:
        return _lists(codec(path).encode_all([t or "" for t in texts]))

    return add_column(documents, text, out, T.ArrayType(T.IntegerType()), compute)


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its piece ids; null ids are none."""

    def compute(rows: pa.ListArray) -> pa.Array:
        return pa.array(codec(path).decode_all(rows), pa.string())

    return add_column(encoded, ids, out, T.StringType(), compute, as_arrow=True)
