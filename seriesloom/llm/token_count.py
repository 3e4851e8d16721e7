"""Token counts by a compiled finite-state transducer.

A BPE vocabulary is compiled into a deterministic transducer over characters.
While a text is read, its tokens so far are those of the prefix; one more character
can only change tokens inside the longest suffix that some piece still begins with.
So a state is that suffix (a node of the pieces' Aho-Corasick automaton) with, for
each of its positions, the last token of the prefix ending there and the number of
tokens relative to now. A transition carries the change of the token count; the sum
along the path is the count. A token may follow another if merging the two as one
text leaves them apart, and the last token of a prefix is the longest that may
follow the one before it. States and transitions are made when first met and kept.

Texts are cut into chunks. The transducer is back in its start state wherever a
word begins (no piece holds a space behind another character), so a chunk there is
a word and its state map one number. Words longer than ``CHUNK`` characters, and
texts of vocabularies whose pieces cross spaces, are cut further; the map of such a
chunk leads from an entry state to an exit state and a count. Maps are kept by
(entry, chunk), composed in order, and the counts of all texts of a batch are
differences of one prefix sum.

A null text is empty and has no tokens. Repeated rows are counted each.

Very long texts are counted whole, in chunks, and long words by chunk maps. Repeated rows are
counted each; counts have no ties. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import piece_model
from .batches import add_column
from .piece_model import SPACE, PieceModel

CHUNK = 256
MOST_STATES, MOST_WORDS = 250_000, 800_000  # kept by a worker; beyond that it begins anew, with the same counts
START = 0


class Merges:
    """Merging by rank, leftmost first, of short texts."""

    def __init__(self, model: PieceModel):
        self.rank = {p: -model.scores[i] for p, i in model.pieces.items()}

    def tokens(self, text: str) -> list[str]:
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Transducer:
    """States, transitions and chunk maps of one model."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.merges = Merges(model)
        self.byte_fallback = bool(model.byte_ids)
        self.long = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.by_space = model.cuts_at_space
        self._pairs: dict[tuple[str, str], bool] = {}
        self._build_nodes()
        self.clear()
        self.words = _Words(self)

    def _build_nodes(self) -> None:
        """The Aho-Corasick automaton: nodes are prefixes of pieces, with the longest proper suffix that is a node."""
        usable = {p for p in self.model.pieces if len(p) == 1 or self.merges.tokens(p) == [p]}
        nodes = {""} | {p[:k] for p in usable for k in range(1, len(p) + 1)}
        self.nodes = nodes
        self.usable = usable
        inner = set()  # text on both sides of a cut inside some piece
        for p in self.model.pieces:
            inner.update((p[k - 1 : k + 1]) for k in range(1, len(p)))
        self.touching = inner

    def clear(self) -> None:
        self.key_of = {("", ("",), (0,)): START}
        self.states = [("", ("",), (0,))]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.maps: dict[tuple[int, str], tuple[int, int]] = {}

    def follows(self, left: str, right: str) -> bool:
        """Whether the two tokens stay apart when merged as one text."""
        if not left or left[-1] + right[0] not in self.touching:
            return True
        known = self._pairs.get((left, right))
        if known is None:
            known = self._pairs[left, right] = self.merges.tokens(left + right) == [left, right]
        return known

    def cost(self, char: str) -> int:
        """Tokens of a character that stays alone."""
        if char in self.model.pieces or not self.byte_fallback:
            return 1
        return len(char.encode("utf-8", "surrogatepass"))

    def move(self, state: int, char: str) -> tuple[int, int]:
        """Next state and change of the count."""
        known = self.moves[state].get(char)
        if known is not None:
            return known
        node, lasts, counts = self.states[state]
        suffix = node + char
        while suffix and suffix not in self.nodes:
            suffix = suffix[1:]
        if not suffix:  # no piece holds it
            made = (("", ("",), (0,)), self.cost(char))
        else:
            depth = len(suffix)
            token, count = char, counts[-1] + self.cost(char)
            for size in range(depth, 1, -1):
                if suffix[-size:] in self.usable and self.follows(lasts[-size], suffix[-size:]):
                    token, count = suffix[-size:], counts[-size] + 1
                    break
            kept = tuple(c - count for c in counts[len(counts) - depth :])
            made = ((suffix, (*lasts[len(lasts) - depth :], token), (*kept, 0)), count)
        key, change = made
        to = self.key_of.get(key)
        if to is None:
            to = self.key_of[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][char] = (to, change)
        return to, change

    def chunk_map(self, state: int, chunk: str) -> tuple[int, int]:
        """Where a chunk leads from an entry state, and the tokens it adds."""
        known = self.maps.get((state, chunk))
        if known is None:
            to, count = state, 0
            for char in chunk:
                got = self.moves[to].get(char)
                to, change = got if got is not None else self.move(to, char)
                count += change
            known = self.maps[state, chunk] = (to, count)
        return known

    def count_long(self, text: str) -> int:
        """Maps of consecutive chunks, composed."""
        state, count = START, 0
        for at in range(0, len(text), CHUNK):
            state, more = self.chunk_map(state, text[at : at + CHUNK])
            count += more
        return count

    def chunks(self, text: str) -> list[str]:
        """The text cut where the transducer is in its start state."""
        text = self.model.normalized(text)
        if not self.by_space:
            return [text] if text else []
        if SPACE + SPACE in text or "\x1f" in text or "\n" in self.model.pieces or not text:
            return self.long.findall(text)
        # a line feed is no part of any piece, so a chunk may end on either side of it
        return text.replace(SPACE, "\x1f" + SPACE).replace("\n", "\x1f\n\x1f").split("\x1f")

    def count(self, texts: list[str]) -> np.ndarray:
        """Token counts of whole texts."""
        if len(self.states) + len(self.maps) > MOST_STATES:
            self.clear()
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        sizes, counts = np.zeros(len(texts), np.int64), []
        for k, text in enumerate(texts):
            chunks = self.chunks(text)
            sizes[k] = len(chunks)
            counts.extend(map(self.words.__getitem__, chunks))
        total = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]


class _Words(dict):
    """Token count of each chunk that begins in the start state."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        count = self.transducer.count_long(word) if len(word) > CHUNK else self._short(word)
        self[word] = count
        return count

    def _short(self, word: str) -> int:
        state, count, moves = START, 0, self.transducer.moves
        for char in word:
            got = moves[state].get(char)
            state, change = got if got is not None else self.transducer.move(state, char)
            count += change
        return count


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The compiled transducer of a model file; one per worker process."""
    if path not in _compiled:
        _compiled[path] = Transducer(piece_model.load(path))
    return _compiled[path]


def token_counts(documents: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``documents`` with the token count of ``text``; other columns are kept."""

    def compute(texts: list[str | None]) -> pa.Array:
        return pa.array(transducer(path).count([t or "" for t in texts]), pa.int64())

    return add_column(documents, text, out, T.LongType(), compute)


def with_limit(counted: DataFrame, limit: int, count: str = "n_tokens") -> DataFrame:
    return counted.withColumn("over_limit", F.col(count) > limit)
