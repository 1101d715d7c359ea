"""Hand-computed rows for the constants and the cases SQL cannot say."""

from datetime import datetime, timedelta
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docreview.operators import evaluation as E
from docreview.operators import layout as L
from docreview.operators import metadata as M
from docreview.operators import retrieval as R
from docreview.operators import risk as K
from docreview.operators import state as W
from docreview.operators import text as X
from docreview.sources import files as SF


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_masking(spark):
    df = spark.createDataFrame([("call 13812345678 or 213812345678",), ("号11010119900101123X号",), ("a.b@c.org",)], "text string")
    got = [r.masked for r in X.mask_pii(df).collect()]
    assert got == ["call <phone> or 213812345678", "号<id_number>号", "<email>"]


def test_cleaning(spark):
    df = spark.createDataFrame([("  a \t b\n\n\n\nc ",)], "text string")
    assert X.clean_text(df).first().cleaned == "a b\n\nc"


def test_rrf_and_similarity(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, 1, "vector", 0), (1, 11, 0.5, 2, "vector", 0), (1, 11, 8.0, 1, "bm25", 1)],
                                 "query_id long, doc_id long, score double, rank long, channel string, priority int")
    fused = R.rrf_fuse(hits, 5)
    got = {r.doc_id: r for r in R.fused_similarity(hits, fused).collect()}
    assert got[11].fusion_rrf == pytest.approx(1 / 62 + 1 / 61) and got[11].pos == 1 and got[11].channels == "bm25,vector"
    assert got[11].similarity == pytest.approx(0.65 * 0.5 + 0.35 * 1.0)
    assert got[10].similarity == pytest.approx(0.9 * 0.85)


def test_cells_are_exact_and_ivf_recalls(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=8)], i % 3) for i in range(300)]
    vectors = spark.createDataFrame(data, "doc_id long, embedding array<double>, category int")
    asks = spark.createDataFrame([(i, v) for i, v, _ in data[:20]], "query_id long, embedding array<double>")
    cells = R.build_cells(vectors, 10)
    exact = rows(R.vector_topk(asks, vectors, 5))
    assert rows(R.cells_topk(asks, cells, 5)) == exact
    near = {r[:2] for r in rows(R.ivf_topk(asks, cells, 5, nprobe=5))}
    assert len(near & {r[:2] for r in exact}) >= 0.7 * len(exact)


def test_bm25_on_a_tiny_corpus(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, "c d"), (4, "")], "doc_id long, text string")
    index = R.bm25_index(docs)
    assert rows(index.postings) == [(1, 3, "a", 1), (1, 3, "b", 2), (2, 2, "b", 1), (2, 2, "c", 1), (3, 2, "c", 1), (3, 2, "d", 1)]
    assert tuple(index.stats.first()) == (4, 7 / 4)
    ask = spark.createDataFrame([(7, "a")], "query_id long, text string")
    top = R.bm25_topk(ask, index, 5).collect()
    want = (np.log(3.5) - np.log(1.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / 1.75))
    assert [(r.doc_id, r.score) for r in top] == [(1, pytest.approx(want, abs=1e-4))]


def test_chunks_cover_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    chunks = X.chunk_documents(docs, 400, 60, cut_at=r"(?<=[.!?])\s+|\n").join(docs.withColumnRenamed("text", "whole"), "doc_id")
    seen = {}
    for r in chunks.orderBy("doc_id", "chunk_index").collect():
        whole = r.whole.replace("\r\n", "\n").replace("\r", "\n").strip()
        assert r.chunk_id == f"{r.doc_id}:{r.chunk_index:04d}"
        last = seen.get(r.doc_id, 0)
        assert whole[last:r.start].strip() == "" and r.end > r.start
        squeeze = lambda s: "".join(s.split())  # pieces are joined by line ends, whatever stood between them
        assert squeeze(r.text).endswith(squeeze(whole[r.start:r.end]))
        seen[r.doc_id] = r.end
    assert len(seen) == docs.filter(F.trim("text") != "").count()
    with pytest.raises(ValueError):
        X.chunk_documents(docs, 100, 100)


def test_numerals_and_tracing(spark):
    df = spark.createDataFrame([("十",), ("二十一",), ("一百零三",), ("42",), ("x",), ("两千",)], "t string")
    assert [r[0] for r in df.select(K.numeral(F.col("t"))).collect()] == [10, 21, 103, 42, None, 2000]


def test_score_levels(spark):
    df = spark.createDataFrame([(1, 1, ["probation_insurance", "non_compete"]), (1, 2, ["resignation"]), (2, 1, [])],
                               "doc_id long, clause_id long, categories array<string>")
    got = {r.doc_id: r for r in K.risk_score(df).collect()}
    assert (got[1].score, got[1].level, got[1].risk_ratio) == (55, "low", 1.5)
    assert (got[2].score, got[2].level) == (100, "safe")


def brute_admission(events, limit, seconds):
    kept, out = {}, {}
    for key, ident, ts in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        window = [t for t in kept.get(key, []) if t > ts - timedelta(seconds=seconds)]
        out[(key, ident)] = len(window) < limit
        kept[key] = window + [ts] * out[(key, ident)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_admission_with_a_hot_key(spark, seed):
    rnd = random.Random(seed)
    start = datetime(2024, 1, 1)
    # One key holds most rows, with busy stretches, lulls and equal time stamps.
    events = [(1, i, start + timedelta(seconds=rnd.choice([0, 0, 1, 5, 70]) + 3 * i)) for i in range(1500)]
    events += [(k, 10_000 + 100 * k + i, start + timedelta(seconds=rnd.randrange(900))) for k in range(2, 8) for i in range(60)]
    df = spark.createDataFrame(events, "key long, id long, ts timestamp")
    got = {(r.key, r.id): r.admitted for r in W.admit_requests(df, 4, 60).collect()}
    assert got == brute_admission(events, 4, 60)


def test_rate_is_open_on_the_left(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, i, start + timedelta(seconds=s)) for i, s in enumerate([0, 59, 60, 119])],
                               "key long, id long, ts timestamp")
    assert [r.rate for r in W.request_rate(df, 60).orderBy("id").collect()] == [1, 2, 2, 2]


def test_fuzzy_matching_is_greedy(spark):
    gold = spark.createDataFrame([("c", 1, "x", "high", "the worker pays the fee", True), ("c", 2, "x", "low", "", False),
                                  ("c", 3, "x", "high", "never", True)],
                                 "case_id string, pos long, category string, level string, snippet string, required boolean")
    pred = spark.createDataFrame([("c", 1, "x", "high", "the worker pays a fee"), ("c", 2, "x", "low", "other")],
                                 "case_id string, pos long, category string, level string, clause string")
    got = [r.pred_pos for r in E.match_risks(gold, pred).orderBy("pos").collect()]
    assert got == [1, 2, None]
    assert [r.pred_pos for r in E.match_risks(gold, pred, None).orderBy("pos").collect()] == [None, 1, None]


def test_columns(spark):
    boxes = [(1, 1, 0.0, 100.0), (1, 1, 10.0, 190.0), (1, 1, 260.0, 480.0), (1, 1, 520.0, 600.0)]
    df = spark.createDataFrame([(*b, 620.0) for b in boxes], "doc_id long, page long, x0 double, x1 double, page_width double")
    got = [(c.lo, c.hi) for c in L.detect_columns(df, 4).first().columns]
    assert got == [(0.0, 225.0), (225.0, 500.0), (500.0, 620.0)]


def test_columns_are_found_in_tasks_of_bounded_size(spark, monkeypatch):
    boxes = [(d, 10.0 * i, 10.0 * i + 30 * (d % 3), 620.0) for d in range(40) for i in range(10)]
    df = spark.createDataFrame(boxes, "doc_id long, x0 double, x1 double, page_width double").withColumn("page", F.lit(0))
    want = rows(L.detect_columns(df))
    monkeypatch.setattr(L, "ROWS_PER_TASK", 25)
    found = L.detect_columns(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "16), REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1  # 400 boxes, dealt out once
    assert rows(found) == want and len(want) == 40


def test_decoding_files(spark, tmp_path):
    (tmp_path / "zone" / "cat").mkdir(parents=True)
    for name, data in (("a", "﻿plain".encode()), ("b", "劳动合同".encode("gb18030")), ("c", b"ok \xff\xff\xff")):
        (tmp_path / "zone" / "cat" / f"{name}.txt").write_bytes(data)
    df = SF.read_text_corpus(spark, str(tmp_path))
    kept, dropped = SF.labels_from_path(df, {"cat": "pay"})
    got = {r.file_id: (r.text, r.category, r.zone) for r in kept.collect()}
    assert got["a"] == ("plain", "pay", "zone") and got["b"][0] == "劳动合同" and got["c"][0].startswith("ok ")
    assert dropped.count() == 0


def test_validity(spark):
    df = spark.createDataFrame([("a", "2020-01-01", ""), ("b", "2030-01-01", ""), ("c", "bad", None), ("d", None, "2021-01-01")],
                               "law_name string, effective_from string, effective_until string")
    assert [r.law_name for r in M.active_as_of(df, "2024-01-01").orderBy("law_name").collect()] == ["a", "c"]


def test_plans_avoid_cartesian_products_and_cut_early(spark, sf):
    from docreview.plans.registry import PLANS

    plan_of = lambda name: PLANS[name].run(spark, sf)._jdf.queryExecution().executedPlan().toString()
    for name in ("r05_bm25_topk", "r09_hybrid_search", "a05_assemble_reports", "w04a_request_rate", "k03_trace_citations"):
        assert "CartesianProduct" not in plan_of(name) and "NestedLoop" not in plan_of(name)
    assert "WindowGroupLimit" in plan_of("r05_bm25_topk")


def test_filters_reach_the_scan(spark, sf):
    from docreview.operators import analytics as A

    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    df = spark.read.parquet(f"{sf}/orders.parquet")
    kept = A.filter_records(df, {"o_orderstatus": "F"}, "o_orderdate", "1996-01-01", "1996-12-31").select("o_orderkey")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "EqualTo(o_orderstatus,F)" in plan


def test_html_entities_and_unclosed_elements(spark):
    from docreview.sources.html import html_to_text

    raw = ["caf&eacute; &#8217;x &mdash; &copy; &#x1F600; &amp;lt; &nosuch; &#0; a & b &", "<p>seen</p><script>var hidden = 1;", "<style>x</style>kept", None]
    page = spark.createDataFrame([(i, h) for i, h in enumerate(raw)], "page_id int, html string")
    got = {r.page_id: r.content for r in html_to_text(page).collect()}
    assert got[0] == "café ’x — © 😀 &lt; &nosuch; &#0; a & b &" and got[1] == "seen" and got[2] == "kept"


def test_vectors_with_string_ids_nulls_and_many_groups(spark, monkeypatch):
    vectors = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [-1.0, 0.1]), ("d", None), ("e", [0.0, 1.0])],
                                    "doc_id string, embedding array<double>")
    asks = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [-1.0, 0.0]), ("q3", None)], "query_id string, embedding array<double>")
    want = {("q1", "a", 1.0, 1), ("q1", "b", 1.0, 2), ("q2", "e", 0.0, 2), ("q2", "c", 0.995, 1)}
    assert {(r.query_id, r.doc_id, round(r.score, 3), r.rank) for r in R.vector_topk(asks, vectors, 2).collect()} == want
    monkeypatch.setattr(R, "GROUP_FLOATS", 1)  # one query per group, in the same way
    monkeypatch.setattr(R, "TILE_VECTORS", 1)
    assert {(r.query_id, r.doc_id, round(r.score, 3), r.rank) for r in R.vector_topk(asks, vectors, 2).collect()} == want
    assert R.vector_topk(asks.limit(0), vectors, 2).collect() == []


def test_negative_cosines_rank_by_themselves(spark):
    near = [(i, [-1.0, 0.01 * i]) for i in range(50)] + [(100 + i, [-0.01, 1.0 + 0.001 * i]) for i in range(50)]
    vectors = spark.createDataFrame(near, "doc_id long, embedding array<double>")
    ask = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    top = R.vector_topk(ask, vectors, 5).collect()
    assert all(r.doc_id >= 100 and r.score == 0 for r in top)
    assert rows(R.cells_topk(ask, R.build_cells(vectors, 4), 5)) == rows(R.vector_topk(ask, vectors, 5))


def test_cells_can_be_saved(spark, tmp_path):
    rng = np.random.default_rng(6)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)], "doc_id long, embedding array<double>")
    cells = R.build_cells(vectors, 5)
    cells.save(str(tmp_path))
    ask = vectors.limit(3).withColumnRenamed("doc_id", "query_id")
    assert rows(R.ivf_topk(ask, R.Cells.load(spark, str(tmp_path)), 4, 2)) == rows(R.ivf_topk(ask, cells, 4, 2))


def test_search_without_blanks_reads_each_text_once(spark, monkeypatch):
    texts = [(1, "竞业限制的补偿"), (2, "试用期工资"), (3, "工作时间"), (4, "年休假")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index = R.bm25_index(docs, tokenizer=R.Tokenizer(bigrams=True))
    ask = spark.createDataFrame([(1, "竞业限制补偿")], "query_id long, text string")
    plan = R.bm25_topk(ask, index, 2)
    assert [r.doc_id for r in plan.collect()] == [1]
    corpus = docs.withColumn("title", F.lit("")).withColumn("category", F.lit("x"))
    assert [r.doc_id for r in R.hybrid_search(ask, corpus, 1, index).collect()] == [1]
    # The index rests on written postings: no search cuts the texts of the corpus into tokens again.
    assert plan._jdf.queryExecution().toString().count("MapInArrow") == 0


def test_no_exchange_carries_a_text(spark, sf):
    import __spark_entry__ as entry

    for name in ("k04_quality_gate", "f07_review_documents"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        below = [line for line in plan.splitlines() if "Exchange" in line]
        assert below and not any("text#" in line for line in below)


def test_tables_as_folders(spark, sf, tmp_path):
    import __spark_entry__ as entry

    for name in ("documents", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    assert entry.queries()["s12_append_audit"](spark, str(tmp_path)).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_clauses_search_with_both_channels(spark):
    corpus = spark.createDataFrame([(1, "t1", "alpha beta", "x"), (2, "t2", "gamma delta", "x"), (3, "t3", "alpha gamma", "y")],
                                   "doc_id long, title string, text string, category string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "x"), (3, [1.0, 0.1], "y")], "doc_id long, embedding array<double>, category string")
    clauses = spark.createDataFrame([(7, 1, "alpha", "alpha", "x", [0.0, 1.0]), (7, 2, "zeta", "zeta", None, [1.0, 0.1]), (8, 1, "beta", "beta", "y", None)],
                                    "doc_id long, clause_id long, title string, content string, category string, embedding array<double>")
    index = R.bm25_index(corpus.select("doc_id", "text"))
    got = {(r.doc_id, r.clause_id, r.ref_id, r.attempt) for r in R.retrieve_for_clauses(clauses, corpus, index, vectors=vectors, min_hits=1).collect()}
    # Inside x both channels answer the first clause; the second, without a category, asks everywhere by its vector; the
    # third finds no word in y and has no vector, so it asks again in the whole corpus.
    assert {(7, 1, 1, 1), (7, 1, 2, 1), (7, 2, 3, 2), (8, 1, 1, 2)} <= got
    plain = {(r.doc_id, r.ref_id) for r in R.retrieve_for_clauses(clauses.drop("embedding"), corpus, index, min_hits=1).collect()}
    assert plain == {(8, 1)}  # the word of the first clause is in most passages and weighs nothing


def test_index_rows_keep_their_own_terms(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(120)))) for i in range(2500)] + [(2500, None)]
    index = R.bm25_index(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))
    want = {(i, len((text or "").split()), w, (text or "").split().count(w)) for i, text in texts for w in set((text or "").split())}
    assert {tuple(r) for r in index.postings.collect()} == want
    assert index.documents.count() == len(texts)  # rows without a word are counted


def test_terms_are_counted_without_python_and_weighed_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "c")], "doc_id long, text string")
    counted = R.term_counts(docs)
    assert rows(counted) == [(1, 3, ["a", "b"], [1, 2]), (2, 0, [], []), (3, 0, [], []), (4, 1, ["c"], [1])]
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Exchange" not in plan
    index, names, plain = R.bm25_index(docs), [], R.written
    monkeypatch.setattr(R, "written", lambda df, name: names.append(name) or plain(df, name))
    for _ in range(2):
        R.bm25_topk(docs.select(F.col("doc_id").alias("query_id"), "text"), index, 3)
    assert names.count("terms") == 1


def test_long_rows_are_searched_in_runs(spark, monkeypatch):
    batch = pa.record_batch({"words": pa.array([["a"] * 5, None, ["b"], ["c"] * 3, []])})
    monkeypatch.setattr(R, "RUN_WORDS", 4)
    assert [part.num_rows for part in R._runs(batch, "words")] == [1, 4]
    assert pa.Table.from_batches(R._runs(batch, "words")).to_pylist() == batch.to_pylist()


def test_search_shuffles_no_pairs_and_both_directions_agree(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{int(rng.random() ** 2 * 40)}" for _ in range(rng.randrange(1, 30)))
    docs = spark.createDataFrame([(i, text(), f"c{i % 3}") for i in range(200)], "doc_id long, text string, category string")
    asks = spark.createDataFrame([(f"q{i}", text()) for i in range(60)], "query_id string, text string")
    index = R.bm25_index(docs.select("doc_id", "text"))
    want = rows(R._hit_rank(R.bm25_scores(asks, index), 7))  # by a join of all pairs
    assert len(want) == 420

    def unpaired(*_):
        raise AssertionError("pairs were joined")

    plain = R.bm25_scores
    monkeypatch.setattr(R, "bm25_scores", unpaired)
    assert rows(R.bm25_topk(asks, index, 7)) == want
    monkeypatch.setattr(R, "GROUP_FLOATS", 300)  # many groups
    monkeypatch.setattr(R, "TILE_VECTORS", 1)
    assert rows(R.bm25_topk(asks, index, 7)) == want
    found = R._search_queries(asks, index, index.documents, 7).select("query_id", F.posexplode("hits").alias("i", "h"))
    assert rows(found.select("query_id", "h.doc_id", F.round("h.score", 4), F.col("i") + 1)) == want
    inside = R.bm25_topk(asks, index, 7, category="c1", categories=docs)
    monkeypatch.setattr(R, "bm25_scores", plain)
    kept = plain(asks, index).join(docs.filter("category = 'c1'").select("doc_id"), "doc_id", "left_semi")
    assert rows(inside) == rows(R._hit_rank(kept, 7).select("query_id", "doc_id", "score", "rank"))
    monkeypatch.setattr(R, "HELD_ROWS", 10)  # both sides large: joined by term
    assert rows(R.bm25_topk(asks, index, 7)) == want


def test_clause_search_shuffles_no_text_and_no_pairs(spark, sf, monkeypatch):
    from docreview.plans import retrieval as PR
    from docreview.sources.tables import Tables

    t = Tables(spark, sf)
    statutes = PR._statutes(t)
    index = R.bm25_index(statutes.select("doc_id", "text"))
    clauses = PR._clauses(t)
    found = R.retrieve_for_clauses(clauses, statutes, index)
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert below and not any("text#" in line for line in below) and "SortMergeJoin" not in plan
    got = rows(found)
    monkeypatch.setattr(R, "HELD_ROWS", 0)  # the pairs are joined by term
    assert rows(R.retrieve_for_clauses(clauses, statutes, index)) == got


def test_categories_are_searched_once(spark, sf):
    from docreview.plans.registry import PLANS

    # k03 cuts its clauses on both sides of a join; filters and branches over the category repeated the search before.
    plan = PLANS["k03_trace_citations"].run(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("eauelle") <= 2


def test_approximate_search_reads_as_many_cells_as_its_recall_asks(spark):
    rng = np.random.default_rng(8)
    data = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(1500)]  # no clusters: the nearest cells miss much
    vectors = spark.createDataFrame(data, "doc_id long, embedding array<double>")
    asks = spark.createDataFrame(data[:40], "query_id long, embedding array<double>")
    exact = {r[:2] for r in rows(R.vector_topk(asks, vectors, 10))}
    near = {r[:2] for r in rows(R.ivf_topk(asks, R.build_cells(vectors, 30), 10, nprobe=2))}
    assert len(near & exact) >= 0.9 * len(exact)
