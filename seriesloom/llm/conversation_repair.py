"""Repairing the structure of conversations by cheapest edits, found once per shared suffix.

A conversation is its rows by turn (nulls first; rows of the same turn by role, then by a
hash of the text). A row is blank (nothing but white space), a duplicate (role and text
seen earlier in the conversation), truncated (last character that is no white space is not
one of ``.!?``) or sound; the first that holds counts. Edits: keep (K) costs 0, give
another role (R, user or assistant) 3, delete (D) 4, insert an empty row (I, user or
assistant) 3; blank and duplicate rows must be deleted, a truncated row that stays
costs 3 more. The repaired roles must read ``(s?(ua)+)?`` by their initials. The audit is
the initials of the cheapest edits in order, the least in ASCII order of equally cheap.

What the edits depend on is a row's initial and fault, one letter of sixteen: the
conversation's signature. Signatures of all conversations are made distinct, sorted by
their reversed letters and read by an automaton that grows from the end: a node
is a suffix, shared by all signatures that end in it, and gets its cost-to-go and best edits
once for each of the four states of the grammar. Nodes whose costs differ by a
constant alone behave alike and share one entry of the register, so the register stays
small; a node holds its register entry, its cost and the node of the shorter suffix.
The edits that may tie have different initials, so a node's least audit begins with the
least initial, and audits are read off along the path.

Texts do not travel for that: rows are marked, duplicates found by the smallest turn of
each (conversation, role, text), rows ranged by conversation and turn, and letters
joined to pieces where they lie, so a long conversation is never gathered, only its
letters. ``repair`` then streams each conversation's rows past its audit, in one
partition but row by row.

Nulls: a null role or text is one space; a null turn is before all others; a null
conversation id is a conversation like others. Empty and very long texts are rows like
others. Repeated rows are duplicates, whatever their turn. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import stage
from .batches import bound_batches, slices

BLANK_CHARS = " \t\n\x0b\x0c\r"
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
INITIALS = "sua"  # any other initial fits nowhere
LEGAL_PAIRS = ("su", "ua", "au")
RESPELL, DELETE, INSERT, TRUNCATED_COST = 3, 4, 3, 3
# States of the grammar: nothing yet, after s, after u, after a
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
MADE = tuple(max(n) for n in NEXT)  # the initial that a new or respelled row gets in each state
ENDS = (START, AFTER_A)
ROLE = {"u": "user", "a": "assistant"}
ROW_COLUMNS = ["conv_id", "turn", "role", "text"]


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults dealt by a checksum of id and turn.

    Of twenty equal shares one loses the row, one its text, one its ``.!?``, one gets the
    row twice and one the role user. Nulls are one space, but turns stay null.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    dealt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault")).where("fault <> 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return dealt.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        copies.alias("copy"),
    ).drop("copy")


def _plain(rows: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    role, text = F.coalesce(F.col("role").cast("string"), blank), F.coalesce(F.col("text").cast("string"), blank)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def _initial(role: str = "role") -> Column:
    """Place of a role's initial in INITIALS, or their number."""
    found = F.instr(F.lit(INITIALS), F.substring(role, 1, 1))  # 1 for an empty role too
    return F.when((F.length(role) == 0) | (found == 0), len(INITIALS)).otherwise(found - 1)


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps: a letter per row in order, and turns that are missing between others."""
    text = F.rtrim("text", F.lit(BLANK_CHARS))
    fault = F.when(F.length(text) == 0, BLANK).when(~F.substring(text, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    marks = _plain(rows).select("conv_id", "turn", "role", "digest", _initial().alias("initial"), fault.alias("fault"))
    distinct = marks.groupBy(*marks.columns).agg(F.count(F.lit(1)).alias("copies"))
    distinct = stage(distinct, "turns")
    earliest = distinct.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("earliest"))
    joined = distinct.join(earliest, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    letter = lambda what: F.char(F.lit(ord("a")) + 4 * F.col("initial") + what)
    again = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    new = F.struct("turn").eqNullSafe(F.col("earliest"))
    letters = F.concat(letter(F.when(new, F.col("fault")).otherwise(again)), F.repeat(letter(again), (F.col("copies") - 1).cast("int")))
    ranged = joined.select("conv_id", "turn", "role", "digest", letters.alias("letters"))
    order = ["conv_id", "turn", "role", "digest"]
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "letters")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The letters of a conversation that lie in this range, joined."""
        at, current, held = TaskContext.get().partitionId(), None, []
        for batch in batches:
            ids, texts, joined = [], [], []
            for conv, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and conv != current:
                    ids.append(current)
                    joined.append("".join(held))
                    held = []
                current = conv
                held.append(more)
            if ids:
                yield _batch([ids, [at] * len(ids), joined], batch.schema.field(0).type)
            held = ["".join(held)]
        if held:
            yield _batch([[current], [at], ["".join(held)]], kind)

    kind = pa.string() if dict(rows.dtypes)["conv_id"] == "string" else pa.int64()
    found = ranged.withColumn("conv_id", F.col("conv_id") if kind == pa.string() else F.col("conv_id").cast("long"))
    id_type = "string" if kind == pa.string() else "long"
    found = found.mapInArrow(pieces, f"conv_id {id_type}, piece long, letters string")
    in_order = F.array_sort(F.collect_list(F.struct("piece", "letters")))  # a row per range the conversation reaches
    whole = found.groupBy("conv_id").agg(F.array_join(F.transform(in_order, lambda x: x["letters"]), "").alias("signature"))
    turn = F.col("turn").cast("decimal(38,0)")
    gaps = distinct.groupBy(F.col("conv_id").alias("c")).agg(F.coalesce((F.max(turn) - F.min(turn) + 1 - F.count_distinct("turn")).cast("long"), F.lit(0).cast("long")).alias("gaps"))
    return whole.join(gaps, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "signature", "gaps")


def _batch(columns: list, kind: pa.DataType) -> pa.RecordBatch:
    arrays = [pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["conv_id", "piece", "letters"])


class SuffixAutomaton:
    """Costs-to-go and best edits of suffixes, for signatures that come sorted by their reversed letters.

    ``path`` holds the nodes of the current signature's suffixes from the empty one on: the
    register's entry and the cost that it stands above. A new signature keeps the nodes
    of the suffix it shares with the one before; sorting makes a node be made once.
    """

    def __init__(self):
        self.register: dict[tuple, tuple] = {}
        self.reversed = ""
        self.path = [(self._entry(None, tuple(0 if q in ENDS else None for q in range(4))), 0)]
        self.nodes = 0

    def _entry(self, letter: str | None, after: tuple) -> tuple:
        """Costs (least 0), best edit per state, and by how much the costs were lowered.

        ``after`` has the cost-to-go of the shorter suffix in each state, None where
        none ends there.
        """
        found = self.register.get((letter, after))
        if found is None:
            options: list[list[tuple[int, str]]] = [[] for _ in range(4)]
            if letter is None:
                for q, cost in enumerate(after):
                    options[q] += [(cost, "")] if cost is not None else []
            else:
                initial, fault = divmod(ord(letter) - ord("a"), 4)
                extra = TRUNCATED_COST if fault == TRUNCATED else 0
                for q in range(4):
                    options[q].append((DELETE + after[q], "D"))
                    if fault in (SOUND, TRUNCATED):
                        options[q].append((RESPELL + extra + after[NEXT[q][MADE[q]]], "R"))
                        kept = NEXT[q].get(INITIALS[initial : initial + 1])
                        if kept is not None:
                            options[q].append((extra + after[kept], "K"))
            best = [min(o, default=(1 << 40, "I")) for o in options]
            for _ in range(4):  # an insertion leaves the suffix as it is; three lead from any state to any
                for q in range(4):
                    best[q] = min(best[q], (INSERT + best[NEXT[q][MADE[q]]][0], "I"))
            low = min(cost for cost, _ in best)
            found = self.register[letter, after] = (tuple(cost - low for cost, _ in best), "".join(e or "." for _, e in best), low)
        return found

    def audit(self, signature: str) -> tuple[int, str]:
        """Least cost, and the least audit of that cost."""
        letters = signature[::-1]
        shared, most = 0, min(len(letters), len(self.reversed))
        while shared < most and letters[shared] == self.reversed[shared]:
            shared += 1
        del self.path[shared + 1 :]
        self.reversed = letters
        for letter in letters[shared:]:
            entry, base = self.path[-1]
            made = self._entry(letter, entry[0])
            self.path.append((made, base + made[2]))
            self.nodes += 1
        out, state, depth = [], START, len(letters)
        cost = self.path[depth][0][0][START] + self.path[depth][1]
        while True:
            edit = self.path[depth][0][1][state]
            if edit == ".":
                return cost, "".join(out)
            out.append(edit)
            if edit in "IR":
                state = NEXT[state][MADE[state]]
            elif edit == "K":
                state = NEXT[state][INITIALS[(ord(letters[depth - 1]) - ord("a")) // 4]]
            depth -= edit != "I"


def audits(signed: DataFrame) -> DataFrame:
    """signature, cost, audit of every distinct signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            costs, found = zip(*map(automaton.audit, texts)) if texts else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64()), pa.array(found, pa.string())], ["signature", "cost", "audit"])

    bound_batches(signed.sparkSession)
    by_end = signed.select("signature").distinct().withColumn("end", F.reverse("signature"))
    # the last letters are enough to bring signatures with a common end together
    ranged = by_end.repartitionByRange(F.substring("end", 1, 64)).sortWithinPartitions("end")
    return ranged.select("signature").mapInArrow(run, "signature string, cost long, audit string")


def report(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    signed = stage(signatures(rows), "signatures")
    solved = signed.join(audits(signed), "signature")
    letters = lambda fault: "".join(chr(ord("a") + 4 * i + fault) for i in range(4))
    count = lambda fault: (F.length("signature") - F.length(F.translate("signature", letters(fault), ""))).cast("long")
    initials = F.translate("signature", "".join(chr(ord("a") + i) for i in range(16)), "".join((INITIALS + "x")[i // 4] for i in range(16)))
    # each row but the first is legal if the pair it ends is: pairs overlap, so look ahead
    legal = F.regexp_count(initials, F.lit("(?:s(?=u)|u(?=a)|a(?=u))"))
    illegal = F.greatest(F.length("signature") - 1, F.lit(0)) - legal
    return solved.select(
        "conv_id", "gaps", count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated"), illegal.cast("long").alias("illegal"), "cost", "audit"
    )


def repair(rows: DataFrame, reported: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), edit, turn, role, text; inserted rows have no turn and an empty text.

    Conversations come one after the other within a partition, rows in order.
    """
    bound_batches(rows.sparkSession)
    id_type = "string" if dict(rows.dtypes)["conv_id"] == "string" else "long"
    body = _plain(rows).select(F.col("conv_id").cast(id_type).alias("conv_id"), F.lit(1).alias("part"), F.col("turn").cast("long").alias("turn"), "role", "text", "digest")
    none = F.lit(None)
    heads = reported.select(
        F.col("conv_id").cast(id_type).alias("conv_id"), F.lit(0).alias("part"), none.cast("long").alias("turn"), none.cast("string").alias("role"),
        F.col("audit").alias("text"), none.cast("binary").alias("digest"),
    )
    together = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest")
    names = ["conv_id", "place", "edit", "turn", "role", "text"]
    kinds = [pa.string() if id_type == "string" else pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, conv = "", 0, START, 0, None
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[tuple] = []
                for conv_id, kind, turn, role, text in zip(*(part.column(i).to_pylist() for i in range(5))):
                    if kind == 0:
                        while at < len(audit):  # what is left of the conversation before are insertions
                            out.append((conv, place, "I", None, ROLE[MADE[state]], ""))
                            state, at, place = NEXT[state][MADE[state]], at + 1, place + 1
                        audit, at, state, place, conv = text, 0, START, 0, conv_id
                        continue
                    while audit[at] == "I":
                        out.append((conv, place, "I", None, ROLE[MADE[state]], ""))
                        state, at, place = NEXT[state][MADE[state]], at + 1, place + 1
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        role = ROLE[MADE[state]] if edit == "R" else role
                        out.append((conv, place, edit, turn, role, text))
                        state, place = NEXT[state][role[:1]], place + 1
                if out:
                    yield _rows(out)
        out = []
        while at < len(audit):
            out.append((conv, place, "I", None, ROLE[MADE[state]], ""))
            state, at, place = NEXT[state][MADE[state]], at + 1, place + 1
        if out:
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return together.select("conv_id", "part", "turn", "role", "text").mapInArrow(run, f"conv_id {id_type}, place long, edit string, turn long, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` joined by line feeds; ``repaired`` straight from ``repair``."""
    id_type = dict(repaired.dtypes)["conv_id"]
    kind = pa.string() if id_type == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            done = []
            for conv, place, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if place == 0:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    current, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield _hashes(done)
        if state is not None:
            yield _hashes([(current, state.hexdigest())])

    def _hashes(done: list[tuple]) -> pa.RecordBatch:
        ids, hashes = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])

    return repaired.select("conv_id", "place", "role", "text").mapInArrow(run, f"conv_id {id_type}, repaired_sha256 string")
