"""Conversation structure repair: the cheapest edits that give a conversation the role order `(s?(ua)+)?`.

Each conversation is searched depth first by branch and bound with an explicit stack. A node is (rows read, role expected
next); its children are the edits Delete, Insert, Keep and Rerole, visited in ASCII order, so that paths are completed in the
order of their audits. A suffix bound (the same rows with a free beginning and end) cuts off what cannot beat the incumbent
(cost, audit), and a dominance table per node cuts off prefixes that cost no less than one met before, whose audit is
smaller. The bound lies at most a few units below the truth wherever a conversation is cut, so the search stays linear in
its rows. Rows come sorted from Spark and pass as a stream: texts are never gathered, only one code per row is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreview.llm.common import table

ROLES = {"u": "user", "a": "assistant"}
DELETE, INSERT, REROLE, OPEN_END = 3, 2, 2, 1
"""Costs fixed by the contract; a truncated row that stays costs OPEN_END more."""
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
_NEXT = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
"""State after the role that a state expects: an assistant after a user, else a user."""
LEGAL = {"su", "ua", "au"}
FORCED, OPEN = 4, 8
"""Bits of a row's code beside its role (0 other, 1 system, 2 user, 3 assistant): must be deleted; truncated."""
_ROLE_CODE = {"s": 1, "u": 2, "a": 3}


def suffix_bounds(codes: bytes) -> tuple[list[int], list[int], list[int]]:
    """Least cost of the rows from i on at the start, and when a user or an assistant is expected; the end is free."""
    start, user, assistant = ([0] * (len(codes) + 1) for _ in range(3))
    for i in range(len(codes) - 1, -1, -1):
        code, next_user, next_assistant = codes[i], user[i + 1], assistant[i + 1]
        u, a, system = DELETE + next_user, DELETE + next_assistant, DELETE + start[i + 1]
        if not code & FORCED:
            stays, role = OPEN_END if code & OPEN else 0, code & 3
            u = min(u, next_assistant + stays + (0 if role == 2 else REROLE))
            a = min(a, next_user + stays + (0 if role == 3 else REROLE))
            if role == 1:
                system = min(system, next_user + stays)
        user[i], assistant[i] = min(u, INSERT + a), min(a, INSERT + u)
        start[i] = min(system, user[i])
    return start, user, assistant


def search(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows given by their codes, the ASCII-least audit among equals."""
    n = len(codes)
    start, user, assistant = suffix_bounds(codes)
    bounds = (start, user, assistant, user)

    def children(i: int, state: int) -> list[tuple[str, int, int, int]]:
        out = []
        if i < n:
            out.append(("D", i + 1, state, DELETE))
        out.append(("I", i, _NEXT[state], INSERT))
        if i < n and not codes[i] & FORCED:
            stays, role = OPEN_END if codes[i] & OPEN else 0, codes[i] & 3
            if role == 1 and state == START:
                out.append(("K", i + 1, AFTER_SYSTEM, stays))
            elif role == (3 if state == AFTER_USER else 2):
                out.append(("K", i + 1, _NEXT[state], stays))
            out.append(("R", i + 1, _NEXT[state], REROLE + stays))
        return out

    # The first incumbent: always the child with the least cost and bound.
    i, state, best, dive = 0, START, 0, bytearray()
    while i < n or state not in (START, AFTER_ASSISTANT):
        edit, i, state, cost = min(children(i, state), key=lambda c: (c[3] + bounds[c[2]][c[1]], c[1] == i, c[0]))
        best += cost
        dive += edit.encode()
    audit, proven = bytes(dive), False  # proven: the incumbent comes from the search, so later equals are not smaller
    met = [[1 << 60] * (n + 1) for _ in range(4)]
    path = bytearray()
    stack = [(0, START, 0, 0, 0)]  # rows read, state, cost, length of the path, edit that led here
    while stack:
        i, state, cost, depth, edit = stack.pop()
        limit = best - 1 if proven else best
        if cost + bounds[state][i] > limit or cost >= met[state][i]:
            continue
        met[state][i] = cost
        del path[max(depth - 1, 0):]
        if edit:
            path.append(edit)
        if i == n and state in (START, AFTER_ASSISTANT):
            if cost < best or bytes(path) <= audit:
                best, audit, proven = cost, bytes(path), True
            continue
        for edit, j, to, more in reversed(children(i, state)):
            stack.append((j, to, cost + more, depth + 1, ord(edit)))
    return best, audit.decode()


def _first_copies(keys: list[bytes]) -> np.ndarray:
    """Whether a 16-byte key is the first of its kind."""
    pairs = np.frombuffer(b"".join(keys), np.dtype([("a", "<u8"), ("b", "<u8")]))
    first = np.zeros(len(keys), bool)
    first[np.unique(pairs, return_index=True)[1]] = True
    return first


class _Conversation:
    """What is kept of a conversation while its rows pass: a code and a digest per row, and counters."""

    def __init__(self):
        self.codes, self.blanks, self.keys = bytearray(), [], []
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0
        self.before = ""

    def add(self, turn, role: str, blank: bool, ended: bool, key: bytes) -> None:
        initial = role[:1]
        if self.codes and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        self.codes.append(_ROLE_CODE.get(initial, 0) | (FORCED if blank else 0 if ended else OPEN))
        self.keys.append(key)

    def report(self) -> dict:
        codes = np.frombuffer(bytes(self.codes), np.uint8)
        blank = codes & FORCED > 0
        duplicate = ~blank & ~_first_copies(self.keys) if len(codes) else blank
        truncated = ~blank & ~duplicate & (codes & OPEN > 0)
        codes = np.where(duplicate, codes & 3 | FORCED, codes).astype(np.uint8)
        cost, audit = search(codes.tobytes())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": int(blank.sum()), "duplicate": int(duplicate.sum()), "truncated": int(truncated.sum()),
                "illegal": self.illegal, "cost": cost, "audit": audit}


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
_OUT = 4096
"""Rows of an output batch."""


def _rows(turns: DataFrame) -> DataFrame:
    present = F.coalesce("present", F.lit(False)) if "present" in turns.columns else F.lit(True)
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), present.alias("present")).withColumn("digest", F.sha2("text", 256))


_ORDER = ("conv_id", "part", "turn", "role", "digest")


def find_repairs(turns: DataFrame) -> DataFrame:
    """One row per conversation of `turns(conv_id, turn, role, text[, present])` with the columns of REPORT.

    Rows go by turn, nulls first, ties by role and SHA-256 of the text; null role and text are one space; rows whose `present`
    is false or null only say that the conversation exists. A null conv_id is a conversation. First fault of a row: blank
    (nothing but ASCII white space), duplicate (role and text seen earlier), truncated (last visible character not `.!?`).
    A conversation without rows costs 0. Other columns are not read. Memory: some 400 bytes per row of a
    conversation, whatever its texts.
    """
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    work = _rows(turns).select(
        "conv_id", "turn", "role", "digest", "present", F.lit(0).alias("part"), (last == "").alias("blank"), last.isin(".", "!", "?").alias("ended"),
        F.unhex(F.md5(F.concat_ws("\n", F.base64(F.col("role").cast("binary")), "digest"))).alias("key"))
    kind = work.schema["conv_id"].dataType
    work = work.repartition("conv_id").sortWithinPartitions(*_ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found, conversation, current = ["conv_id", *REPORT], [], None, None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(found, schema)

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type)] + [(c, pa.string() if c == "audit" else pa.int64()) for c in REPORT])
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "present", "blank", "ended", "key"))
            for conv_id, turn, role, present, blank, ended, key in zip(*columns):
                if conversation is None or conv_id != current:
                    if conversation is not None:
                        found.append({"conv_id": current} | conversation.report())
                    conversation, current = _Conversation(), conv_id
                    if len(found) >= _OUT:
                        yield flush()
                        found.clear()
                if present:
                    conversation.add(turn, role, blank, ended, key)
        if conversation is not None:
            found.append({"conv_id": current} | conversation.report())
            yield flush().select(names)

    counts = ", ".join(f"{c} {'string' if c == 'audit' else 'bigint'}" for c in REPORT)
    return work.mapInArrow(run, f"conv_id {kind.simpleString()}, {counts}")


def apply_repairs(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, position, edit, turn, role, text), rows of a conversation together and in order.

    `found(conv_id, audit)` comes from `find_repairs` over the same turns. Deleted rows are missing, inserted ones have an
    empty text and no turn. The audit goes ahead of the rows of its conversation in the same sorted stream.
    """
    rows = _rows(turns).filter("present").select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "text")
    audits = found.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"),
                          F.col("audit").alias("text"))
    work = rows.unionByName(audits).repartition("conv_id").sortWithinPartitions(*_ORDER).drop("digest")
    kind = work.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, current, audit, at, position, state = [], 0, None, "", 0, 0, START
        schema = None

        def put(edit: str, turn, role: str, text: str) -> None:
            nonlocal size, position, state
            initial = role[:1]
            state = AFTER_SYSTEM if initial == "s" else AFTER_USER if initial == "u" else AFTER_ASSISTANT
            out.append({"conv_id": current, "position": position, "edit": edit, "turn": turn, "role": role, "text": text})
            position, size = position + 1, size + len(text)

        def expected() -> str:
            return ROLES["a" if state == AFTER_USER else "u"]

        def inserts() -> None:
            nonlocal at
            while audit[at:at + 1] == "I":
                put("I", None, expected(), "")
                at += 1

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()),
                                ("role", pa.string()), ("text", pa.string())])
            for conv_id, part, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "text"))):
                if part == 0:
                    current, audit, at, position, state = conv_id, text, 0, 0, START
                else:
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        put(edit, turn, role if edit == "K" else expected(), text)
                inserts()
                if len(out) >= _OUT or size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
                    size = 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return work.mapInArrow(run, f"conv_id {kind.simpleString()}, position bigint, edit string, turn bigint, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `role:text` joined by line ends, of rows as `apply_repairs` hands them on."""
    kind = repaired.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done, schema = None, None, [], None
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("repaired_sha256", pa.string())])
            for conv_id, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text"))):
                if position == 0:
                    if state is not None:
                        done.append({"conv_id": current, "repaired_sha256": state.hexdigest()})
                    current, state = conv_id, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if len(done) >= _OUT:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if state is not None:
            done.append({"conv_id": current, "repaired_sha256": state.hexdigest()})
            yield pa.RecordBatch.from_pylist(done, schema)

    return repaired.select("conv_id", "position", "role", "text").mapInArrow(run, f"conv_id {kind.simpleString()}, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): rows damaged by the CRC-32 of `conv_id:turn`, nulls read as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    work = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return work.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("present"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def op12_repair(spark, sf_dir):
    turns = damage(table(spark, sf_dir, "conversations"))
    found = find_repairs(turns)
    done = digests(apply_repairs(turns, found)).withColumnRenamed("conv_id", "_conv")
    every = found.join(done, found["conv_id"].eqNullSafe(F.col("_conv")), "left")
    return every.select("conv_id", *REPORT, F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
