"""Id files, conversation repair and hard negatives, against the library and plain loops."""

import functools
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import conversation_repair as repair, hard_negatives, id_files, queries
from seriesloom.sources import staging

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

DATA = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


# ---- id files


def library_ids(path, texts, end=0):
    found = tokenizers.Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids + [end] for e in found]


ODD = [chr(c) for c in range(0x500)] + ["<|endoftext|>"] * 100 + [" "] * 400 + ["'s", "\n", "\r\n", "　", "\x85", "\x1c"] * 20 + [chr(c) for c in (0x558, 0x323B0, 0x1F600, 0x4E00)] * 10


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_library(path):
    r = random.Random(3)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 50))) for _ in range(3000)] + ["", "a" * 5000, " " * 3000]
    encoder = id_files.Encoder(path)
    expected = [np.array(ids[:-1], encoder.kind).tobytes() for ids in library_ids(path, texts)]
    assert encoder.encode(pa.array(texts)) == expected
    assert encoder.encode(pa.array(texts[::-1])) == expected[::-1]  # words are known now


def test_the_library_is_asked_without_copies_of_the_texts(monkeypatch):
    """What is cut from the texts is given up first, and a batch that goes on is not held behind it."""
    texts = pa.array([" ".join(f"w{i * 1000 + j}" for j in range(1000)) for i in range(300)])
    encoder = id_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ask, seen, before = id_files.Encoder._words, [], pa.total_allocated_bytes()

    def asked(self, words):
        seen.append((len(words), pa.total_allocated_bytes() - before))
        return ask(self, words)

    monkeypatch.setattr(id_files.Encoder, "_words", asked)
    found = encoder.encode(texts)
    assert found[7] == np.array(encoder.tokenizer.encode(texts[7].as_py()).ids, encoder.kind).tobytes()
    assert max(n for n, _ in seen) <= id_files.NEW_WORDS and max(held for _, held in seen) < texts.nbytes
    monkeypatch.setattr(id_files, "BATCH_TEXT", 100_000)
    held = pa.total_allocated_bytes()
    batches = (pa.RecordBatch.from_arrays([pa.array([i]), pa.array(["x" * 200_000])], ["doc_id", "text"]) for i in range(3))
    for part in id_files._together(batches):
        assert pa.total_allocated_bytes() - held < 500_000


@pytest.fixture(scope="module")
def written(spark):
    """Documents in many small files: null, empty, repeated, odd and very long texts, ids null and repeated."""
    r = random.Random(4)
    rows = [(i, "".join(r.choice(ODD) for _ in range(r.randint(0, 80)))) for i in r.sample(range(-500, 500), 300)]
    rows += [(501, None), (502, ""), (503, "same text here"), (503, "same text here"), (503, "another"), (None, "no id"), (None, None), (504, "wordy text, quite long " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS ids", "2L AS tie", "'v' AS value")
    path = staging.staging_path(spark, "ids-test")
    id_files.write(docs.repartition(7), path, BYTES, shard_bytes=4000)
    return rows, path


def test_files_give_all_ids_back_in_order(spark, written):
    rows, path = written
    found = id_files.read(spark, path).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in found) == [(r.doc_id is not None, r.doc_id or 0) for r in found]
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    expected = sorted((str(i), ids) for (i, _), ids in zip(rows, library_ids(BYTES, [t for _, t in rows])))
    assert sorted((str(r.doc_id), r.ids) for r in found) == expected
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in found)
    assert spark.read.parquet(f"{path}/manifest").count() > 3


def test_one_document_is_fetched_by_the_index(spark, written):
    _, path = written
    manifest = spark.read.parquet(f"{path}/manifest").orderBy("file").collect()
    everything = {(r.start): (r.doc_id, r.ids) for r in id_files.read(spark, path).collect()}
    file = manifest[len(manifest) // 2]
    at = file.start
    for place in range(file.n_docs):
        doc_id, ids = id_files.fetch(spark, path, file.file, place)
        assert (doc_id, ids.tolist()) == everything[at]
        at += len(ids)


def test_a_wrong_dictionary_is_refused(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i % 7} of some words") for i in range(400)], "doc_id long, text string")
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    id_files.write(docs, first, BYTES)
    id_files.write(docs.withColumn("text", F.concat("text", F.lit(" more"))), second, BYTES)
    assert id_files.stored_dictionary(spark, first) != id_files.stored_dictionary(spark, second) != b""
    spark.read.parquet(f"{second}/dictionary").write.mode("overwrite").parquet(f"{first}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        id_files.read(spark, first).collect()


def test_dictionary_makes_short_documents_smaller():
    r = random.Random(5)
    phrases = ["".join(r.choice("abcdefgh ") for _ in range(40)) for _ in range(30)]
    data = [b for b in id_files.Encoder(BYTES).encode(pa.array([" ".join(r.sample(phrases, 3)) for _ in range(2000)]))]
    dictionary = id_files.zstandard.train_dictionary(8192, data[:1000]).as_bytes()
    size = lambda d: sum(len(id_files._compressor(d).compress(b)) for b in data[1000:])
    assert size(dictionary) < 0.5 * size(b"")


def test_no_documents_make_no_ids(spark):
    path = staging.staging_path(spark, "ids-empty")
    id_files.write(spark.createDataFrame([], "doc_id long, text string"), path, BYTES)
    assert id_files.read(spark, path).collect() == []


def test_op11_over_the_table(spark):
    docs = queries.read(spark, DATA, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    found = queries.op11_token_files(spark, DATA).orderBy("doc_id").collect()
    at = 0
    for r, d, ids in zip(found, docs, library_ids(BYTES, [d.text for d in docs]), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# ---- conversations


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "sound")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """Cheapest edits by trying all, whole audits compared as text."""

    @functools.cache
    def best(i, written, inserted):
        """Cost, audit and rows from row i on, for what has been written (as much as matters), after so many insertions."""
        options = []
        legal = lambda initial: (written + initial) in ("s", "u", "su", "sua", "ua", "uau", "uaua", "suau")
        after = lambda initial: {"s": "s", "u": "u", "su": "u", "sua": "ua", "ua": "ua", "uau": "u"}.get(written + initial, "?")
        if i == len(rows):
            if written in ("", "ua"):
                options.append((0, "", ()))
        else:
            role, text = rows[i][2:]
            extra = 3 if faults[i] == "truncated" else 0
            cost, audit, made = best(i + 1, written, 0)
            options.append((4 + cost, "D" + audit, made))
            if faults[i] in ("sound", "truncated"):
                for paid, name, letter in ((0, role, "K"), (3, "user", "R"), (3, "assistant", "R")):
                    if name[:1] and legal(name[:1]):
                        cost, audit, made = best(i + 1, after(name[:1]), 0)
                        options.append((paid + extra + cost, letter + audit, ((name, text), *made)))
        if inserted < 3:
            for name in ("user", "assistant"):
                if legal(name[:1]):
                    cost, audit, made = best(i, after(name[:1]), inserted + 1)
                    options.append((3 + cost, "I" + audit, ((name, ""), *made)))
        return min(options, default=(10**9, "?", ()))

    return best(0, "", 0)


def plain_result(rows):
    """The contract's row of every conversation."""
    damaged, out = plain_damage(rows), {}
    for conv in {r[0] for r in rows}:
        own = [r for r in damaged if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        faults = plain_faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, made = plain_repair(own, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def odd_conversations():
    r = random.Random(6)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Under", "usher", "émile"]
    texts = ["Fine.", "Well!", "What?", "no end", "", " \n\t", " ", "Tail. \n", "Cut, ", None, "A\x85", ".", "Fine.\x0b"]
    rows = []
    for conv in [*range(150), None]:
        for turn in range(r.randint(1, 9)):
            at = r.choice([turn, turn, turn, None, turn * 2 - 1])
            rows.append((conv, at, r.choice(roles), r.choice(texts) if r.random() < 0.7 else f"Text {r.random()}."))
    rows += [(1000, i % 40, "user" if i % 2 else "assistant", f"Line {i % 11}." if i % 3 else "x") for i in range(200)]
    rows += rows[:20]  # repeated rows
    return [*dict.fromkeys(rows[-20:]), *rows]


def test_repair_equals_trying_all_edits(spark, monkeypatch):
    rows = odd_conversations()
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS audit", "1 AS place", "2 AS letters", "3 AS fault", "4 AS digest")
    monkeypatch.setattr(queries, "read", lambda *_: made.repartition(5))
    found = queries.op12_conversation_repair(spark, DATA).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found} == plain_result(rows)
    assert len(found) == len({r[0] for r in rows})


def test_automaton_shares_suffixes_and_stays_small():
    r = random.Random(7)
    letters = "abcdefghijklmnop"
    signatures = sorted({"".join(r.choice(letters) for _ in range(r.randint(0, 4))) + r.choice(["aeim", "eiei", "fjeiei"]) * r.randint(0, 3) for _ in range(2000)}, key=lambda s: s[::-1])
    together = repair.SuffixAutomaton()
    for s in signatures:
        assert together.audit(s) == repair.SuffixAutomaton().audit(s)
    suffixes = {s[i:] for s in signatures for i in range(len(s))}
    assert together.nodes == len(suffixes)  # each made once
    for _ in range(2000):
        repair_text = "".join(r.choice(letters) for _ in range(30))
        together.audit(repair_text)
    assert len(together.register) < 1000


def test_a_long_conversation_is_cut_into_ranges(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Line {i}.") for i in range(5000)] + [(2, 0, "user", "Hello.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    signed = {r.conv_id: r.signature for r in repair.signatures(df).collect()}
    assert signed == {1: "ei" * 2500, 2: "e"}
    reported = repair.report(df)
    repaired = repair.repair(df, reported).where("conv_id = 1").collect()
    assert [r.place for r in repaired] == list(range(5000)) and {r.edit for r in repaired} == {"K"}


def test_empty_conversations(spark, monkeypatch):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(queries, "read", lambda *_: empty)
    assert queries.op12_conversation_repair(spark, DATA).collect() == []
    text_ids = spark.createDataFrame([("c", 0, "user", "Hm.")], "conv_id string, turn long, role string, text string")
    assert [tuple(r) for r in repair.repair(text_ids, repair.report(text_ids)).collect()] == [("c", 0, "K", 0, "user", "Hm."), ("c", 1, "I", None, "assistant", "")]


def test_op12_over_the_table(spark):
    rows = [tuple(r) for r in queries.read(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op12_conversation_repair(spark, DATA).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found} == plain_result(rows)


# ---- hard negatives


def plain_mine(rows, k=5):
    """Loops over whole numbers; rows are (id, label, components)."""
    kept = []
    for i, label, x in rows:
        if i is None or label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        kept.append((i, label, [int(np.floor(256 * float(v))) for v in x]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, x in {(i, label, tuple(x)) for i, label, x in kept if i % 100 == 0}:
        others = sorted(((-score(x, y), j, other) for j, other, y in kept if j != i))
        for s, j in [(s, j) for s, j, other in others if other == label][:k]:
            negatives = [(t, n) for t, n, other in others if other != label and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(negatives[:k], 1)]
    return sorted(out)


def mined(spark, rows, kind="float", **sizes):
    df = spark.createDataFrame([(i, label, x, 1, 2) for i, label, x in rows], f"vec_id long, label int, embedding array<{kind}>, row long, planes long")
    return sorted(tuple(r) for r in hard_negatives.mine(df.repartition(3), F.expr("vec_id % 100 = 0"), **sizes).collect())


def test_negatives_equal_plain_loops(spark):
    r = np.random.default_rng(8)
    rows = [(i * 25, int(r.integers(0, 4)), np.round(r.normal(0, 0.4, 13), 2).tolist()) for i in range(240)]
    rows += [(1, None, [0.1] * 13), (2, 1, None), (3, 1, [float("nan")] * 13), (4, 2, [None] * 13), (5, 2, [float("inf")] * 13), (None, 2, [0.5] * 13)]
    rows += [(6, 1, [0.5] * 4), (7, 1, []), (100, 3, rows[4][2]), rows[8], rows[9], rows[9]]  # short, empty, one id twice, repeated rows
    rows += [(9000 + i, 1, rows[0][2]) for i in range(60)]  # ties
    assert mined(spark, rows, "double", chunk=16, block=4) == plain_mine(rows)
    assert mined(spark, rows, "double") == plain_mine(rows)


@pytest.mark.parametrize("scale", [1e-3, 1.0, 3e6])
def test_scores_of_any_size_are_exact(spark, scale):
    r = np.random.default_rng(9)
    rows = [(i * 50, int(r.integers(0, 3)), (r.normal(0, scale, 8)).tolist()) for i in range(40)]
    assert mined(spark, rows, "double") == plain_mine(rows)


def test_lookups_are_inner_products():
    r = np.random.default_rng(10)
    for dims, most in ((1, 3), (8, 200), (21, 9), (64, 1 << 20)):
        values = r.integers(-most, most, (50, dims))
        planes = int(most).bit_length() + 1
        packed = hard_negatives.pack(values, planes)
        padded = hard_negatives.unpack(packed)
        assert (padded[:, :dims] == values).all() and not padded[:, dims:].any()
        found = hard_negatives.scores(hard_negatives.tables(padded[:7], np.int64), packed)
        assert (found == values @ values[:7].T).all()


def test_no_anchors_and_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [0.5]), (2, 1, [0.25])]) == []
    assert mined(spark, [(0, 1, []), (1, 1, []), (2, 2, [])]) == [(0, 1, 1, 2, 0, 0)]
