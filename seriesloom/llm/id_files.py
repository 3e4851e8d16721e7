"""Token ids in binary files, each document compressed with a dictionary shared by all.

``write`` encodes texts, ends each with ``end_id``, and writes files in ascending
order of the document id. A file is a row of zstandard frames, one per document,
then a compressed index and a footer:

    frame, line feed, frame, line feed, ..., index, footer, line feed

A frame holds the document's ids as little-endian unsigned integers of 2 bytes, or 4
where the vocabulary needs them. The index has each document's id, its frame's offset
and length and its number of ids; the footer has the number of documents and ids, the
place of the index and the SHA-256 of the dictionary, without which no frame is read.
Files are written by Spark's own writer and committer, whose line feed after each row is
the one between frames, so that any file system Spark knows can hold them, and a lost
executor's task writes its file again. Beside the files lie ``dictionary`` (one
row) and ``manifest`` (a row per file: documents, ids, and the ids of all files before).

The dictionary is trained on the serialized arrays of about SAMPLE_DOCS documents chosen by
a hash, the first SAMPLE_CHARS of each; it changes sizes, never ids. Too few samples
for the trainer mean an empty dictionary. ``read`` gives all documents back; ``fetch``
reads a single one, by the index, without touching the other frames.

Words: with a byte-level pre-tokenizer words are encoded apart from each other, so a
worker asks the library once for each word that it has not met lately, many words in one
call. Texts in which a space stands between other white space, and texts for other
tokenizers, go to the library whole.

A null text is an empty one: its only id is the end. Null ids come first; documents with
equal ids stand in the order of a hash of their text, and repeated rows stay, each
with ids of its own. A very long text is one frame. Extra columns are ignored. An empty
table makes a manifest without rows and reads as an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .batches import bound_batches, slices

SHARD_BYTES = 32 << 20  # of text in a file, about: what a task sorts
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 1 << 14, 1 << 16
LEVEL = 3
MOST_WORDS = 100_000  # beyond which a generation that a worker remembers ends with the batch, of at most LONGEST_WORD letters
LONGEST_WORD = 64
NEW_WORDS = 1 << 15  # asked of the library and kept at a time
TOGETHER, CALL = 200, 16  # words in one text for the library, texts in a call
WORDS = 1 << 17  # put together at a time
BATCH_TEXT = 10_000_000  # encoded at a time: a word that repeats in it is looked up once
READ_IDS = 1 << 19  # in a batch that is read
MAGIC = b"IDF1"
FOOTER = "<4sB3x32sQQQQ"  # magic, bytes of an id, dictionary, documents, ids, place and length of the index
FOOTER_BYTES = struct.calcsize(FOOTER)
BYTE_LEVEL_SPACE = "\u0120"  # fixed value: a space in a byte-level vocabulary
# a space between other white space, or after it at the end, as RE2 has it
INNER_SPACE = r"[\s\v\p{Z}\x1c-\x1f\x{85}] (?:[\s\v\p{Z}\x1c-\x1f\x{85}]|\z)"


class Encoder:
    """Texts to ids by the tokenizers library, as bytes of a fixed width."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; read at the first call
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = "<u2" if len(vocabulary) <= 1 << 16 else "<u4"
        special = parts.get("added_tokens") or []
        before = parts.get("pre_tokenizer") or {}
        by_word = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or " " in t["content"] for t in special)
        self.by_word = by_word and plain and not any(parts.get(c) for c in ("normalizer", "truncation", "padding", "post_processor"))
        # ids of tokens that begin with a space; these begin a word
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(BYTE_LEVEL_SPACE)]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """Words are cut before a space, where the library cuts too, but for a space between other white space."""
        whole = np.array(pc.match_substring_regex(texts, INNER_SPACE)) if self.by_word else np.ones(len(texts), bool)
        rest, places = np.flatnonzero(whole), np.flatnonzero(~whole)
        out: list[bytes] = [b""] * len(texts)
        if len(rest):
            for i, ids in zip(rest, self._by_library(texts.take(pa.array(rest)).to_pylist())):
                out[i] = ids
            texts = texts.take(pa.array(places))
        if not len(places):
            return out
        split = pc.split_pattern(texts, " ")
        words = split.flatten()
        first = np.asarray(split.offsets)[:-1] - split.offsets[0].as_py()
        heads = words.take(pa.array(first)).to_pylist()  # these have no space before them
        distinct = words.dictionary_encode()
        number = np.array(distinct.indices)
        number[first] = len(distinct.dictionary) + np.arange(len(first))
        listed = distinct.dictionary.to_pylist()
        del split, words, distinct  # as large as the texts, each
        data = [*self._of_words(listed), *self._by_library(heads)]
        ids, size = np.frombuffer(b"".join(data), self.kind), int(self.kind[-1])
        length = np.fromiter(map(len, data), np.int32, len(data)) // size
        start = np.cumsum(length, dtype=np.int32) - length
        ends = [*first[1:].tolist(), len(number)]
        a = 0
        while a < len(ends):  # documents of about WORDS words, to hold few places at a time
            b = max(a + 1, int(np.searchsorted(ends, first[a] + WORDS, side="right")))
            some = number[first[a] : ends[b - 1]]
            own = length[some]
            end = np.cumsum(own, dtype=np.int64)
            place = np.repeat(start[some] - (end - own).astype(np.int32), own)
            place += np.arange(len(place), dtype=np.int32)
            joined = ids[place].tobytes()
            cuts = [*((end - own)[first[a:b] - first[a]] * size).tolist(), len(joined)]
            for i, x, y in zip(places[a:b], cuts, cuts[1:]):
                out[i] = joined[x:y]
            a = b
        return out

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words with a space before them; asks the library for those not known.

        Words are kept in two generations: when the young one is full it becomes the old
        one, from which a word that occurs again moves to the young one.
        """
        found = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        for a in range(0, len(missing), NEW_WORDS):
            new = []
            for i in missing[a : a + NEW_WORDS]:
                found[i] = ids = self.old.pop(words[i], None)
                if ids is None:
                    new.append(i)
                else:
                    self.known[words[i]] = ids
            fresh = self._words([words[i] for i in new])
            for i in new:
                found[i] = fresh[words[i]]
                if len(words[i]) <= LONGEST_WORD:
                    self.known[words[i]] = found[i]
        if len(self.known) > MOST_WORDS:
            self.known, self.old = {}, self.known
        return found

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words with a space before them, many in one call."""
        inner = [w for w in words if w and w == w.strip()]
        found, alone = {}, [w for w in words if not w or w != w.strip()]
        parts = [inner[i : i + TOGETHER] for i in range(0, len(inner), TOGETHER)]
        for part, ids in ((p, i) for a in range(0, len(parts), CALL) for p, i in zip(parts[a:], self._ids([" " + " ".join(p) for p in parts[a : a + CALL]]))):
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(part) and starts[0] == 0:
                data, size = ids.astype(self.kind).tobytes(), int(self.kind[-1])
                edges = [*(starts * size).tolist(), len(data)]
                found.update(zip(part, [data[a:b] for a, b in zip(edges, edges[1:])]))
            else:
                alone += part
        found.update(zip(alone, self._by_library([" " + w for w in alone])))
        return found

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_library(self, texts: list[str]) -> list[bytes]:
        return [ids.astype(self.kind).tobytes() for ids in self._ids(texts)]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder that a Python worker keeps, with the words it knows."""
    return Encoder(path)


def _end(end_id: int, kind: str) -> bytes:
    return np.array([end_id], kind).tobytes()


def _ordered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"))


def train(texts: list[str], tokenizer_path: str, end_id: int = 0) -> bytes:
    """A dictionary from the ids of some texts; empty if they are too few for the trainer."""
    own = encoder(tokenizer_path)
    samples = [b + _end(end_id, own.kind) for b in own.encode(pa.array(texts, pa.string()))] if texts else []
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 20)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _measured(rows: DataFrame) -> tuple[int, list[str]]:
    """Bytes of all texts, and beginnings of about SAMPLE_DOCS texts chosen by a hash of id and place in the table, from one scan."""
    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))
    place = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id(), F.lit(11)), F.lit(1 << 30))
    chosen = F.when(place < int((1 << 30) * share), F.struct(place.alias("place"), F.substring("text", 1, SAMPLE_CHARS).alias("text")))
    size, found = rows.select(F.octet_length("text").alias("size"), chosen.alias("chosen")).agg(F.sum("size"), F.collect_list("chosen")).first()
    return size or 0, [r.text for r in sorted(found)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined, or cut, to about BATCH_TEXT bytes of text."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "text", BATCH_TEXT):
            held.append(part)
            size += part.nbytes
            if size >= BATCH_TEXT:
                held, size = pa.Table.from_batches(held).combine_chunks().to_batches(), 0
                yield held.pop()
    if size:
        held = pa.Table.from_batches(held).combine_chunks().to_batches()
        yield held.pop()


def _release() -> None:
    """Memory that a worker has free goes back to the system, for the executor's other workers."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Files of ids below ``path``, with their dictionary and manifest."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = _ordered(docs, doc_id, text)
    size, sample = _measured(rows)
    dictionary = train(sample, tokenizer_path, end_id)
    digest = hashlib.sha256(dictionary).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, compressor = encoder(tokenizer_path), _compressor(dictionary)
        end, width = _end(end_id, own.kind), np.dtype(own.kind).itemsize
        known, ids, offsets, lengths, counts, at = [], [], [], [], [], 0
        for part in _together(batches):
            data = own.encode(part.column(1))
            frames = [compressor.compress(b + end) for b in data]
            sizes = np.array([len(f) for f in frames], np.int64)
            known.append(np.array(part.column(0).is_valid(), np.uint8))
            ids.append(np.array(part.column(0).fill_null(0), np.int64))
            offsets.append(at + np.cumsum(sizes + 1) - sizes - 1)
            lengths.append(sizes)
            counts.append(np.array([len(b) // width + 1 for b in data], np.int64))
            at += int(sizes.sum()) + len(sizes)
            out = pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["value"])
            del part, data, frames
            _release()
            yield out
        if known:
            n_ids = sum(int(c.sum()) for c in counts)
            index = zstandard.ZstdCompressor().compress(b"".join(np.concatenate(c).tobytes() for c in (ids, offsets, lengths, counts, known)))
            footer = struct.pack(FOOTER, MAGIC, width, digest, sum(map(len, known)), n_ids, at, len(index))
            yield pa.RecordBatch.from_arrays([pa.array([index + footer], pa.binary())], ["value"])

    tie = F.xxhash64("text")
    files = max(1, -(-size // shard_bytes))
    ordered = rows.withColumn("tie", tie).repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    framed = ordered.select("doc_id", "text").mapInArrow(run, "value binary")
    framed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/ids")
    spark.createDataFrame([(bytearray(dictionary), digest.hex(), int(end_id))], "dictionary binary, sha256 string, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    totals = _files(spark, path).mapInArrow(_totals, "file string, n_docs long, n_ids long")
    totals.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{path}/manifest")


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ids")
    return files.where("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        feet = [footer(c.as_py()) for c in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[2] for f in feet], pa.int64()), pa.array([f[3] for f in feet], pa.int64())], ["file", "n_docs", "n_ids"])


def footer(data: bytes) -> tuple[int, bytes, int, int, int, int]:
    """Bytes of an id, dictionary hash, documents, ids, place and length of the index, from the end of a file."""
    magic, *rest = struct.unpack(FOOTER, data[-FOOTER_BYTES - 1 : -1])
    if magic != MAGIC:
        raise ValueError("no file of ids")
    return tuple(rest)


def index(data: bytes, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets, lengths, numbers of ids, and whether the id is not null, per document."""
    plain = zstandard.ZstdDecompressor().decompress(data)
    numbers = np.frombuffer(plain, "<i8", 4 * n_docs).reshape(4, n_docs)
    return *numbers, np.frombuffer(plain, np.uint8, n_docs, 32 * n_docs)


def stored_dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row.dictionary).hexdigest() != row.sha256:
        raise ValueError("the dictionary is not the one that was stored")
    return bytes(row.dictionary)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, and its ids.

    The checksum is of the ids as little-endian unsigned 32-bit integers. Without
    ``ids`` the arrays stay in the task that read them.
    """
    dictionary = stored_dictionary(spark, path)
    digest = hashlib.sha256(dictionary).digest()
    schema = "file string, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = _decompressor(dictionary)
        for batch in batches:
            for i in range(batch.num_rows):
                yield from documents(batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer(), decompressor)

    def documents(file: str, content: pa.Buffer, decompressor: zstandard.ZstdDecompressor) -> Iterator[pa.RecordBatch]:
        data = memoryview(content)
        width, used, n_docs, _, place, size = footer(bytes(data[-FOOTER_BYTES - 1 :]))
        if used != digest:
            raise ValueError(f"{file} was written with another dictionary")
        names, offsets, lengths, counts, known = index(bytes(data[place : place + size]), n_docs)
        starts = np.cumsum(counts) - counts
        parts = np.cumsum(counts) // READ_IDS
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), n_docs]
        for a, b in zip(edges, edges[1:]):
            arrays, sums = [], []
            for j in range(a, b):
                frame = decompressor.decompress(data[offsets[j] : offsets[j] + lengths[j]])
                found = np.frombuffer(frame, f"<u{width}").astype("<u4")
                if len(found) != counts[j]:
                    raise ValueError(f"{file}: document {j} has {len(found)} ids, its index says {counts[j]}")
                sums.append(zlib.crc32(found))
                arrays.append(found.astype(np.int32) if ids else None)
            columns = [
                pa.array([file] * (b - a), pa.string()),
                pa.array(names[a:b], pa.int64(), mask=known[a:b] == 0),
                pa.array(starts[a:b], pa.int64()),
                pa.array(counts[a:b], pa.int64()),
                pa.array(sums, pa.int64()),
            ]
            if ids:
                columns.append(pa.array(arrays, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    found = _files(spark, path).mapInArrow(run, schema)
    starts = spark.read.parquet(f"{path}/manifest").select("file", F.col("start").alias("before"))
    out = ["doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"]
    return found.join(starts, "file").select(*out, *["ids"] * ids)


def fetch(spark: SparkSession, path: str, file: str, place: int) -> tuple[int | None, np.ndarray]:
    """The id and the ids of the document at a place of a file; reads footer, index and one frame."""
    jvm = spark._jvm
    name = jvm.org.apache.hadoop.fs.Path(f"{path}/ids/{file}")
    system = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    end = system.getFileStatus(name).getLen()
    stream = system.open(name)

    def part(at: int, size: int) -> bytes:
        stream.seek(int(at))
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size)))

    try:
        width, used, n_docs, at, size = (f := footer(part(end - FOOTER_BYTES - 1, FOOTER_BYTES + 1)))[:3] + f[4:]
        dictionary = stored_dictionary(spark, path)
        if used != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{file} was written with another dictionary")
        names, offsets, lengths, _, known = index(part(at, size), n_docs)
        frame = _decompressor(dictionary).decompress(part(offsets[place], lengths[place]))
        return (int(names[place]) if known[place] else None), np.frombuffer(frame, f"<u{width}").astype(np.uint32)
    finally:
        stream.close()
