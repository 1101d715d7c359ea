"""Conversation repair against a cheapest-first search over whole edit sequences."""

import heapq
import random
import re
import zlib

import pytest
from helpers import sha
from pyspark.sql import functions as F

from docreview.llm import repair

SPACE = " \t\n\x0b\x0c\r"
GOAL = re.compile(r"(s?(ua)+)?")


def brute(roles, forced, opened):
    """Cheapest (cost, audit) over all edit sequences, by cost and then audit; a prefix is kept per (rows read, role order)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, order = heapq.heappop(heap)
        if i == len(roles) and GOAL.fullmatch(order):
            return cost, audit
        key = i, order[:1], order[-1:]
        if key in seen:
            continue
        seen.add(key)
        for edit, j, role, more in [("D", i + 1, "", 3), ("I", i, "u", 2), ("I", i, "a", 2), ("K", i + 1, (roles[i][:1] or "?") if i < len(roles) else "", 0), ("R", i + 1, "u", 2), ("R", i + 1, "a", 2)]:
            new = order + role
            if edit != "I" and (i == len(roles) or (edit in "KR" and forced[i])):
                continue
            if edit in "KR" and opened[i]:
                more += 1
            if re.fullmatch(r"s?(ua)*u?", new):
                heapq.heappush(heap, (cost + more, audit + edit, j, new))
    raise AssertionError


def expected(rows):
    """rows: (turn, role, text) after damage, null turn None."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
    seen, blank, duplicate, truncated = set(), [], [], []
    for _, role, text in rows:
        visible = text.strip(SPACE)
        blank.append(not visible)
        duplicate.append(bool(visible) and (role, text) in seen)
        truncated.append(bool(visible) and not duplicate[-1] and visible[-1] not in ".!?")
        seen.add((role, text))
    roles = [r for _, r, _ in rows]
    initials = [r[:1] for r in roles]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = brute(roles, [a or b for a, b in zip(blank, duplicate)], truncated)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    out, at, last = [], 0, ""
    for edit in audit:
        wanted = "assistant" if last == "u" else "user"
        if edit == "I":
            out.append((wanted, ""))
        else:
            _, role, text = rows[at]
            at += 1
            if edit == "D":
                continue
            out.append((role if edit == "K" else wanted, text))
        last = out[-1][0][:1]
    return (gaps, sum(blank), sum(duplicate), sum(truncated), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out)))


def damaged(rows):
    """conv_id -> rows after damage, of (conv_id, turn, role, text) with nulls."""
    text = lambda x: " " if x is None else str(x)
    out = {}
    for conv, turn, role, body in rows:
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, body = text(role), text(body)
        if kind == 0:
            continue
        body = "" if kind == 1 else re.sub("[.!?]", "", body) if kind == 2 else body
        kept += [(turn, "user" if kind == 4 else role, body)] * (2 if kind == 3 else 1)
    return out


def whole_query(spark, rows, tmp_path):
    kinds = "conv_id long, turn int, role string, text string, present boolean, audit string"
    spark.createDataFrame([(*r, False, "x") for r in rows], kinds).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    done = repair.op12_repair(spark, str(tmp_path)).collect()
    got = {r.conv_id: tuple(r[c] for c in (*repair.REPORT, "repaired_sha256")) for r in done}
    assert len(got) == len(done)
    return got


def test_search_against_brute_force():
    rng = random.Random(5)
    names = {0: "x", 1: "s", 2: "u", 3: "a"}
    for _ in range(3000):
        codes = bytes(rng.choice((0, 1, 2, 2, 2, 3, 3, 3)) | rng.choice((0, 0, 0, repair.FORCED, repair.OPEN)) for _ in range(rng.randrange(9)))
        roles = [names[c & 3] for c in codes]
        want = brute(roles, [bool(c & repair.FORCED) for c in codes], [bool(c & repair.OPEN) for c in codes])
        assert repair.search(codes) == want, codes


@pytest.mark.parametrize("unit", [b"\x02", b"\x03", b"\x01\x02", b"\x00", b"\x02\x03", b"\x02\x06\x0b"])
def test_long_conversations_stay_linear(unit):
    codes = unit * (30_000 // len(unit))
    cost, audit = repair.search(codes)
    assert cost <= 3 * len(codes) and len(audit) >= len(codes)


def test_random_conversations(spark, tmp_path):
    rng = random.Random(9)
    texts = ["Yes.", "Yes.", "no", "", None, " \t\n", "Well?\n", "Why ", "long " * 30_000 + ".", "\U0001F600!", "a.b", "x "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 12)):
            at = rng.choice([turn, turn, turn, turn + 3, None, -turn])
            rows += [(conv, at, rng.choice(roles), rng.choice(texts))] * rng.choice([1, 1, 1, 1, 2])
    assert whole_query(spark, rows, tmp_path) == {conv: expected(kept) for conv, kept in damaged(rows).items()}


def test_corpus(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in (*repair.REPORT, "repaired_sha256")) for r in repair.op12_repair(spark, sf).collect()}
    assert got == {conv: expected(kept) for conv, kept in damaged(rows).items()}


def test_repaired_rows(spark):
    turns = spark.createDataFrame([(1, 2, "assistant", "b."), (1, 1, "user", "a."), (1, 3, "assistant", " "), (1, 4, "user", "c"), (2, 1, "tool", "x!")],
                                  "conv_id long, turn long, role string, text string")
    found = repair.find_repairs(turns)
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {1: (6, "KKDD"), 2: (3, "D")}
    done = repair.apply_repairs(turns, found).orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.position, r.edit, r.turn, r.role, r.text) for r in done] == [(1, 0, "K", 1, "user", "a."), (1, 1, "K", 2, "assistant", "b.")]


def test_empty(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.find_repairs(turns).collect() == []
    assert repair.digests(repair.apply_repairs(turns, repair.find_repairs(turns))).collect() == []


def test_hot_conversation(spark):
    turns = spark.range(20_000).select(F.lit(7).alias("conv_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                       F.concat(F.col("id").cast("string"), F.lit(".")).alias("text")).withColumnRenamed("id", "turn")
    (row,) = repair.find_repairs(turns).collect()
    assert (row.cost, row.audit) == (0, "K" * 20_000)
