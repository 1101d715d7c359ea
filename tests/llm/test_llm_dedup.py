"""Exact, line and near-duplicate operators on small tables with nulls, ties, repeated rows and clashing names."""

import random
import weakref
from types import SimpleNamespace

import numpy as np
import pytest
from helpers import brute_components, brute_lines, documents, sha

from docreview.llm import common, exact_dedup, line_dedup, minhash


def test_exact(spark):
    rows = [(1, "a"), (2, "a"), (3, "b"), (None, "b"), (5, None), (6, ""), (7, "x" * 200_000), (8, "x" * 200_000), (9, "A"), (10, "a "),
            (11, "same"), (11, "same")]
    got = exact_dedup.exact_dedup(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept, r.text_sha256))
    assert by[1] == [(2, 2, False, sha("a"))] and by[2] == [(2, 2, True, sha("a"))]
    assert by[None] == [(3, 2, False, sha("b"))] and by[5] == [(6, 2, False, sha(""))]
    assert by[7][0][:3] == (8, 2, False) and by[9] == [(9, 1, True, sha("A"))]
    assert sorted(x[2] for x in by[11]) == [False, True]


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(documents(spark, [])).collect() == []


def test_exact_full_filter(spark, monkeypatch):
    """A filter far too small lets everything into the shuffle; the result is the same."""
    monkeypatch.setattr(exact_dedup, "MAX_SLOTS", 64)
    rows = [(i, f"t{i % 150}") for i in range(300)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(documents(spark, rows)).collect()}
    assert got == {i: (150 + i % 150, 2) for i in range(300)}


def test_exact_unique_rows_skip_the_shuffle(spark):
    rows = documents(spark, [(i, f"t{i}") for i in range(1000)]).selectExpr("doc_id AS id", "text AS digest")
    marks = exact_dedup.repeated_slots(rows, 1 << 15)
    assert exact_dedup.with_suspicion(rows, marks, 1 << 15).filter("_suspect").count() < 60


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000, 30_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        levels, index = line_dedup.build_hash(keys)
        assert sorted(index.tolist()) == list(range(len(keys)))
        order = np.argsort(index)
        prints = keys.view(np.int64)[order]
        shard = line_dedup.Shard([len(x) for x in levels], b"".join(np.packbits(x).tobytes() for x in levels),
                                 prints.tobytes(), prints.tobytes(), prints.tobytes())
        assert (shard.find(keys, keys.view(np.int64)) == index).all()
        strangers = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        found = shard.find(strangers, strangers.view(np.int64))
        assert set(strangers[found >= 0].tolist()) <= set(keys.tolist())


LINES = [
    (3, "A repeated line here\nshort\nOnly once in three\n\n"), (1, "  a REPEATED line here\t\nshort"), (2, None), (7, ""),
    (5, "a repeated line here\na repeated line here\nunique line of five"), (None, "unique line of five\nx"), (8, "ÄÖÜ äöü ÄÖ\rb"),
    (9, "äöü äöü äö\rb\nÄÖÜ äöü ÄÖ\rB"), (10, "123456789\n1234567890"), (11, "123456789\n 1234567890 "),
    (12, "repeated row of twelve"), (12, "repeated row of twelve"), (13, "\n".join(f"line number {i % 7000}" for i in range(9000))),
    (14, "line number 6999\nline number 1"),
]


def test_lines(spark):
    got = line_dedup.dedup_lines(documents(spark, LINES)).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_lines(LINES), key=key)


def test_lines_keep_other_columns(spark):
    row = line_dedup.dedup_lines(documents(spark, [(1, "x")])).select("row.*", "kept").first()
    assert (row.id, row.row, row.n, row.kept) == (1, "row", 9, "x")


def test_lines_empty(spark):
    assert line_dedup.dedup_lines(documents(spark, [])).collect() == []


def test_hot_line_is_split(spark):
    rows = [(i, f"the very common line\nown line number {i}") for i in range(3000)]
    got = line_dedup.dedup_lines(documents(spark, rows)).select("row.doc_id", "n_dropped").collect()
    assert {r.doc_id: r.n_dropped for r in got} == {i: int(i > 0) for i in range(3000)}


def near_rows(seed=3, groups=12):
    rng = random.Random(seed)
    rows, n = [], 0
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((2, 5, 30, 120)))]
        for _ in range(rng.choice((1, 3, 9))):
            words = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10_000)}"
            rows.append((n, rng.choice((" ", "\n", " \t")).join(words)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "z " * 50_000)]


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near(spark, words, percent):
    rows = near_rows()
    docs = documents(spark, rows, extra=False).withColumnRenamed("doc_id", "doc")
    got = {r.doc: (r.n, r.root) for r in minhash.near_components(docs, words, percent).collect()}
    assert got == brute_components(rows, words, percent)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_large_group(spark, seed):
    """One group of copies with few or many edits, some shared by a family of them: links, and many near misses."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    families = [base]
    for _ in range(4):
        words = list(rng.choice(families))
        for _ in range(rng.choice((2, 4, 8))):
            words[rng.randrange(90)] = f"f{rng.randrange(10_000)}"
        families.append(words)
    rows = []
    for i in range(260):
        words = list(rng.choice(families))
        for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 6))):
            words[rng.randrange(90)] = f"e{rng.randrange(10_000)}"
        rows.append((i, " ".join(words[:rng.choice((90, 90, 90, 80))])))
    docs = documents(spark, rows, extra=False).withColumnRenamed("doc_id", "doc")
    got = {r.doc: (r.n, r.root) for r in minhash.near_components(docs, 3, 85).collect()}
    want = brute_components(rows, 3, 85)
    assert got == want and 10 < len({v[1] for v in want.values()}) < 250


def test_near_chain(spark):
    """Links that no leader has: each text resembles its neighbours only."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i:8 * i + 100])) for i in range(30)]
    docs = documents(spark, rows, extra=False).withColumnRenamed("doc_id", "doc")
    got = {r.doc: (r.n, r.root) for r in minhash.near_components(docs, 3, 80).collect()}
    assert got == brute_components(rows, 3, 80) and len({v[1] for v in got.values()}) == 1


def test_near_null_ids_and_repeated_rows(spark):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (2, "other words are in this text")]
    docs = documents(spark, rows, extra=False).withColumnRenamed("doc_id", "doc")
    got = sorted(((r.doc is None, r.doc or 0), r.root) for r in minhash.near_components(docs, 3, 85).collect())
    assert got == [((False, 2), 2), ((False, 4), 4), ((False, 4), 4), ((True, 0), 4)]


def test_near_rows_that_share_an_id(spark):
    """Each row is linked by its own text: a chain over an id with two texts, and rows without an id."""
    rng = random.Random(11)
    a, b, c = ([f"{x}{rng.randrange(10_000)}" for _ in range(60)] for x in "abc")
    rows = [(1, a), (1, b), (2, [*b, "plus"]), (3, [*a, "plus"]), (None, c), (None, [*c, "plus"]), (None, b[:20]), (7, b[:20]), (7, [])]
    docs = documents(spark, [(d, " ".join(w)) for d, w in rows], extra=False).withColumnRenamed("doc_id", "doc")
    got = sorted((r.doc is None, r.doc or 0, r.n, r.root) for r in minhash.near_components(docs, 3, 85).collect() if r.root is not None)
    assert got == [(False, 1, 58, 1), (False, 1, 58, 1), (False, 2, 59, 1), (False, 3, 59, 1), (False, 7, 0, 7), (False, 7, 18, 7), (True, 0, 18, 7)]
    kept = minhash.one_of_each(documents(spark, [(d, " ".join(w)) for d, w in rows]), words=3, percent=85).collect()
    size = sorted((r.doc_id is None, r.doc_id or 0, len(r.text.split())) for r in kept)
    assert [x[:2] for x in size] == [(False, 1), (False, 1), (False, 7), (False, 7), (True, 0)]
    assert kept[0].source == "src" and kept[0].row == "row" and len(kept[0]) == 7


def test_one_of_each_repeated_rows(spark):
    rows = [(1, "a b c d e f")] * 5 + [(None, "u v w x y z")] * 4 + [(5, "")] * 3 + [(6, None), (9, "alone in the world of texts")]
    got = sorted((r.doc_id or 0, r.text or "") for r in minhash.one_of_each(documents(spark, rows)).collect())
    assert got == [(0, "u v w x y z"), (1, "a b c d e f"), (5, ""), (5, ""), (5, ""), (6, ""), (9, "alone in the world of texts")]
    assert minhash.one_of_each(documents(spark, [])).collect() == []


def test_near_empty(spark):
    docs = documents(spark, [], extra=False).withColumnRenamed("doc_id", "doc")
    assert minhash.near_components(docs).collect() == []


def test_signature_estimates_likeness():
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.uint64))
    for share in (0.2, 0.5, 0.9):
        n = 2000
        k = int(n * share)
        a, b = pool[:n], pool[n - k:2 * n - k]
        same = (minhash.signature(a, 512) == minhash.signature(b, 512)).mean()
        assert abs(same - k / (2 * n - k)) < 0.08


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (100, 98)], "u long, v long")
    got = {r.v: r.root for r in minhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 99: 98, 100: 98}


def test_cut_lets_go_of_the_plan():
    """The plan that was run is gone when garbage is collected, else its shuffle files stay for another step."""
    plans, alive = [], []
    collect = SimpleNamespace(gc=lambda: alive.append(plans[0]() is not None))
    context = SimpleNamespace(getCheckpointDir=lambda: "set", _jvm=SimpleNamespace(System=collect))
    session = SimpleNamespace(conf={"spark.checkpoint.dir": "/shared"}, sparkContext=context)

    class Plan:
        def __init__(self):
            self.sparkSession = session
            plans.append(weakref.ref(self))

        def checkpoint(self, eager):
            return "rows"

    out = common.cut(Plan())
    assert out == "rows" and alive == [False]
