"""Quality classifier: a byte-level convolutional network in NumPy.

The UTF-8 bytes of a whole text, followed by zeros, become positions with the
learned embedding of their byte and one channel that is 1 where the last
``GRAM`` bytes already stood at most ``LAGS[-1]`` bytes before. Learned filters
over ``WIDTH`` positions slide over everything; consecutive chunks share the
``WIDTH - 1`` positions on which a filter crosses from one into the next. Each
filter is max-pooled within a chunk of ``CHUNK`` positions, a dense layer turns
the pooled values into the chunk's logit, and the mean logit of all chunks of
the text, the whole text thus, becomes one probability.

Training is bounded: at most ``sample_docs`` labelled rows, chosen by a hash of
the id, and at most ``TRAIN_CHUNKS`` chunks of each, evenly spaced over its text.
Scoring reads every byte.

Null and empty texts are one chunk of padding and get that chunk's probability.
Labels that are null are no labels. Without labels every score is 0.5. Rows with
the same id are scored each. Extra columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import add_column

EMBED, WIDTH, FILTERS, CHUNK = 8, 6, 20, 128
GRAM, LAGS = 4, range(3, 41)
TRAIN_CHUNKS = 16
SAMPLE_DOCS = 4000
THRESHOLD = 0.7
GAP = LAGS[-1]  # padding behind each text, so that no text sees its neighbour
BLOCK = 1 << 13  # positions per matrix product: fits in a core's cache


@dataclass(frozen=True)
class Model:
    embed: np.ndarray  # (256, EMBED); byte 0, the padding, stays zero
    filters: np.ndarray  # (WIDTH * (EMBED + 1), FILTERS)
    bias: np.ndarray  # (FILTERS,)
    dense: np.ndarray  # (FILTERS,)
    offset: float


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for the fold that training never sees; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def repeats(data: np.ndarray) -> np.ndarray:
    """1 where the GRAM bytes ending here also end some lag before; padding never repeats."""
    found = np.zeros(len(data), bool)
    for lag in LAGS:
        if len(data) < lag + GRAM:
            break
        same = data[lag:] == data[:-lag]
        run = same[3:] & same[2:-1] & same[1:-2] & same[:-3]
        found[lag + 3 :] |= run
    found &= data != 0
    return found.astype(np.float32)


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts behind each other, each between zeros and filled up to whole chunks; chunks of each."""
    lead = bytes(WIDTH - 1)
    chunks = np.array([-(-(len(lead) + len(t) + GAP) // CHUNK) for t in texts], np.int64)
    data = b"".join((lead + t.replace(b"\0", b"\1")).ljust(n * CHUNK, b"\0") for t, n in zip(texts, chunks))
    return np.frombuffer(data, np.uint8), chunks


def patches(data: np.ndarray, repeated: np.ndarray, embed: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The filters' inputs at positions start to stop, as rows."""
    take = data[start : stop + WIDTH - 1]
    plane = np.empty((len(take), EMBED + 1), np.float32)
    plane[:, :EMBED] = embed[take]
    plane[:, EMBED] = repeated[start : stop + WIDTH - 1]
    step = plane.strides[0]
    return np.lib.stride_tricks.as_strided(
        plane, (stop - start, WIDTH * (EMBED + 1)), (step, plane.strides[1]), writeable=False
    )


def pooled(data: np.ndarray, model: Model) -> np.ndarray:
    """Max of each filter over each chunk, before the rectifier."""
    repeated = np.concatenate([repeats(data), np.zeros(WIDTH, np.float32)])
    data = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    size = len(data) - WIDTH
    out = np.empty((size // CHUNK, FILTERS), np.float32)
    for start in range(0, size, BLOCK):
        stop = min(start + BLOCK, size)
        values = patches(data, repeated, model.embed, start, stop) @ model.filters
        out[start // CHUNK : stop // CHUNK] = values.reshape(-1, CHUNK, FILTERS).max(1)
    return out + model.bias


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    """One probability per text."""
    data, chunks = padded(texts)
    logits = np.maximum(pooled(data, model), 0) @ model.dense + np.float32(model.offset)
    starts = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    means = np.add.reduceat(logits.astype(np.float64), starts) / chunks
    return 1 / (1 + np.exp(-np.clip(means, -30, 30)))


def neutral() -> Model:
    """The model without labels: every score is 0.5."""
    shape = (WIDTH * (EMBED + 1), FILTERS)
    return Model(np.zeros((256, EMBED), np.float32), np.zeros(shape, np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 0.0)


def fit(samples: list[bytes], labels: np.ndarray, epochs: int = 18, batch: int = 64, rate: float = 0.006, seed: int = 7) -> Model:
    """Train by Adam on the mean chunk logit of each sample; ``samples`` are whole chunks."""
    if not len(samples):
        return neutral()
    random = np.random.default_rng(seed)
    share = np.clip(labels.mean(), 0.02, 0.98)
    params = {
        "embed": random.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "filters": random.normal(0, 0.3, (WIDTH * (EMBED + 1), FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "dense": random.normal(0, 0.2, FILTERS).astype(np.float32),
        "offset": np.array([np.log(share / (1 - share))], np.float32),
    }
    params["embed"][0] = 0
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(samples))
        pace = rate * (1 - epoch / epochs) + rate * 0.05
        for at in range(0, len(order), batch):
            picked = order[at : at + batch]
            grads = _gradients([samples[i] for i in picked], labels[picked], params)
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(params["embed"], params["filters"], params["bias"], params["dense"], float(params["offset"][0]))


def _gradients(samples: list[bytes], labels: np.ndarray, params: dict) -> dict:
    data, chunks = padded(samples)
    repeated = np.concatenate([repeats(data), np.zeros(WIDTH, np.float32)])
    size = len(data)
    data = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    rows = patches(data, repeated, params["embed"], 0, size)
    values = np.concatenate([rows[a : a + BLOCK] @ params["filters"] for a in range(0, size, BLOCK)]).reshape(-1, CHUNK, FILTERS)
    where = values.argmax(1)  # a maximum passes its gradient to one position
    top = np.take_along_axis(values, where[:, None, :], 1)[:, 0] + params["bias"]
    active = np.maximum(top, 0)
    owner = np.repeat(np.arange(len(chunks)), chunks)
    logits = np.bincount(owner, active @ params["dense"], len(chunks)) / chunks + params["offset"][0]
    error = ((1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels) / len(labels)).astype(np.float32)
    per_chunk = error[owner] / chunks[owner].astype(np.float32)
    back = per_chunk[:, None] * params["dense"] * (top > 0)
    at = where + np.arange(len(where))[:, None] * CHUNK
    chosen = rows[at]  # (chunks, FILTERS, inputs)
    grads = {
        "filters": np.einsum("cf,cfi->if", back, chosen) + 1e-4 * params["filters"],
        "bias": back.sum(0),
        "dense": active.T @ per_chunk + 1e-4 * params["dense"],
        "offset": np.array([error.sum()], np.float32),
    }
    into = (back[:, :, None] * params["filters"].T[None]).reshape(len(at), FILTERS, WIDTH, EMBED + 1)[..., :EMBED]
    bytes_at = data[at[:, :, None] + np.arange(WIDTH)].ravel()
    flat = into.reshape(-1, EMBED)
    grads["embed"] = np.stack([np.bincount(bytes_at, flat[:, e], 256) for e in range(EMBED)], 1).astype(np.float32)
    grads["embed"][0] = 0
    return grads


def excerpt(text: bytes) -> bytes:
    """At most TRAIN_CHUNKS chunks, evenly spaced from the first to the last byte."""
    if len(text) <= TRAIN_CHUNKS * CHUNK:
        return text
    starts = np.linspace(0, len(text) - CHUNK, TRAIN_CHUNKS).astype(int)
    return b"".join(text[s : s + CHUNK] for s in starts)


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [excerpt((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(texts, pa.binary())], ["doc_id", "label", "part"])


def train(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, label: str = "quality") -> Model:
    """Fit on at most ``sample_docs`` rows of ``labels`` outside the held-out fold.

    The driver receives at most sample_docs * TRAIN_CHUNKS * CHUNK bytes (8 MB).
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & ~held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_docs)
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = (
        texts.join(F.broadcast(chosen), "doc_id")
        .mapInArrow(_excerpts, "doc_id long, label int, part binary")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label", "part")
        .limit(sample_docs)
        .collect()
    )
    return fit([bytes(r["part"]) for r in rows], np.array([r["label"] for r in rows], np.float32))


def score(documents: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``documents`` with a column ``out``; other columns are kept."""

    def compute(texts: list[str | None]) -> pa.Array:
        return pa.array(scores([(t or "").encode() for t in texts], model), pa.float64())

    return add_column(documents, "text", out, T.DoubleType(), compute)
