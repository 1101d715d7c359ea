"""Mixing, archives and the pipeline."""

import duckdb
import pytest
from helpers import WORD, brute_components, brute_lines, sha
from pyspark.sql import functions as F

import corpus_pipeline
from docreview.llm import mixing, warc
from docreview.llm.common import shared_dir
from docreview.llm.queries import QUERIES


def test_fill_targets():
    assert mixing.fill_targets({"a": 100, "b": 100}, {"a": 1, "b": 3}, 3) == {"a": 50.0, "b": 150.0}
    capped = mixing.fill_targets({"a": 10, "b": 100, "c": 100}, {"a": 8, "b": 1, "c": 1}, 3)
    assert capped == {"a": 30.0, "b": 90.0, "c": 90.0}
    assert mixing.fill_targets({"a": 0}, {"a": 1}, 3) == {"a": 0.0} and mixing.fill_targets({}, {}, 3) == {}


def test_route_overlapping():
    # Pattern 1 serves both sources; source 0 has nothing else, so the flow leaves it the shared words.
    assert mixing.route([100, 100], [[1], [0, 1]], [100, 100], 3) == [100, 100]
    assert mixing.route([100, 10], [[1], [0, 1]], [30, 100], 3) == [100, 30]
    assert mixing.route([50], [[0]], [1000], 3) == [150] and mixing.route([0], [[0]], [10], 3) == [0] and mixing.route([], [], [], 3) == []


def mixed(spark, rows):
    docs = spark.createDataFrame(rows, "row long, sources array<string>, size long, target string, copies string")
    return mixing.mix(docs)


def test_mix_overlapping(spark):
    rows = [(i, ["a"] if i % 3 == 0 else ["b", "a"] if i % 3 == 1 else [None], 10 + i % 7, "x", "y") for i in range(3000)]
    got = mixed(spark, rows).collect()
    assert len(got) == 3000 and all(0 <= r.copies <= 3 and r.taken == r.size * r.copies for r in got)
    total = sum(r[2] for r in rows)
    taken = {k: sum(r.taken for r in got if (r.sources or [None])[-1] == k) for k in (None,)}
    assert abs(taken[None] - total * 3 / 6) < 20  # third in order, weight 3 of 6
    again = {r.row: r.copies for r in mixed(spark, rows[::-1]).collect()}
    assert again == {r.row: r.copies for r in got}


def test_mix_cases(spark):
    assert mixed(spark, []).collect() == []
    got = mixed(spark, [(1, ["a"], 0, "", ""), (1, ["a"], 0, "", ""), (2, None, 5, "", "")]).collect()
    assert len(got) == 3 and sum(r.taken for r in got) == 5
    apart = spark.createDataFrame([(i, [str(i)], 1) for i in range(5)], "row long, sources array<string>, size long")
    assert mixing.mix(apart, max_patterns=1).count() == 5
    with pytest.raises(ValueError):
        mixing.mix(apart.withColumn("sources", F.array(F.lit("hub"), F.col("row").cast("string"))), max_patterns=4)


def test_mix_many_sources(spark, monkeypatch):
    """Ten thousand sources, some in pairs, joined without a broadcast."""
    monkeypatch.setattr(mixing, "SMALL", 100)
    rows = [(i, [f"s{i % 10_000:05}"] if i % 10 else [f"s{i % 10_000:05}", f"s{i % 10_000 + 1:05}"], 20, "", "") for i in range(20_000)]
    got = mixed(spark, rows).collect()
    assert len(got) == 20_000 and all(r.taken == r.size * r.copies and r.copies <= 3 for r in got)
    taken = {}
    for r in got:
        if r.sources[0][-1] not in "01":  # sources that share no set with others
            taken.setdefault(r.sources[0], [0, r.target])[0] += r.taken
    assert len(taken) == 8000 and all(abs(n - target) <= 20 for n, target in taken.values())


def test_overlapping():
    parts = mixing.overlapping([["a"], ["b", "c"], ["c", "d"], [None], ["d"], ["e", None]])
    assert sorted(map(sorted, parts)) == [[0], [1, 2, 4], [3, 5]] and mixing.overlapping([]) == []


def test_mix_query(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_mix_sources"](spark, sf).toPandas()
    docs = duckdb.sql(f"SELECT doc_id, source, text FROM '{sf}/documents.parquet'").fetchall()
    sizes = {d: len(WORD.findall(t or "")) for d, _, t in docs}
    source = {d: s for d, s, _ in docs}
    assert dict(zip(got.doc_id, got["size"])) == sizes
    names = sorted({s for s in source.values()}, key=lambda s: (s is None, s or ""))
    by = {s: sum(n for d, n in sizes.items() if source[d] == s) for s in names}
    targets = mixing.fill_targets(by, {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}, 3)
    for s in names:
        own = got[got.doc_id.map(source) == s]
        assert (own.source_size == by[s]).all() and (own.target - targets[s]).abs().max() < 1e-6
        assert abs(own.taken.sum() - targets[s]) <= own["size"].max() and (own.taken <= 3 * own["size"]).all()


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark):
    big = "<p>é日😀</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n" * 4
    rows = [(5, "http://a/b c\r\nX: y", big), (3, None, big), (9, "u", big + "\r\n"), (1, "u", None), (2, "u", ""), (4, "u", "small"), (6, "u", "small"),
            (7, "u", "y" * 99), (8, "u", "y" * 99), (10, "u", "z" * 100), (11, "u", "z" * 100), (None, "u", "z" * 100), (12, "u", "q" * 3_000_000),
            (13, "u", "rep" * 50), (13, "u", "rep" * 50), (14, "u", "\r\n" * 60), (15, "u", "\n\r" * 60)]
    path = f"{shared_dir(spark)}/warc-test-{id(rows)}"
    warc.write_warc(pages(spark, rows), path)
    records = warc.read_warc(spark, path)
    stored = {(r.page_id, r.record_type): r.payload for r in records.collect()}
    assert stored[3, "response"] == big and stored[5, "revisit"] is None and stored[14, "response"] == "\r\n" * 60
    got = sorted(((r.page_id is None, r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve(records).collect())
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    want = []
    for p, _, h in rows:
        again = h in first and first[h] != p
        want.append(((p is None, p or 0), len((h or "").encode()), sha(h or ""), "revisit" if again else "response", first[h] if again else None))
    assert got == sorted(want)


def test_warc_empty(spark):
    path = f"{shared_dir(spark)}/warc-empty-{id(spark)}"
    warc.write_warc(pages(spark, []), path)
    assert warc.resolve(warc.read_warc(spark, path)).collect() == []


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{shared_dir(spark)}/pipeline-test-{id(docs)}-{i}"
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        held.append((name, docs.collect(), after.collect()))
        docs = after
    by = {name: (a, b) for name, a, b in held}
    before, after = by["quality"]
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    assert good <= {r.doc_id for r in after}
    before, after = by["lines"]
    assert sorted((r.doc_id, r.text) for r in after) == sorted((d, k) for d, _, _, k in brute_lines([(r.doc_id, r.text) for r in before]))
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = by["near_duplicates"]
    roots = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(d for d, (_, root) in roots.items() if root == d)
    before, after = by["mixing"]
    count = {}
    for r in after:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert max(count.values()) <= 3 and set(count) <= {r.doc_id for r in before}
    before, after = by["tokens"]
    assert len(after) == len(before) and all(r.round_trip and r.n_tokens == len(r.ids) for r in after)


def test_pipeline_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "some plain words in a text.", "en", "s", 27), (None, "some plain words in a text.", "en", None, 27), (2, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.round_trip for r in got) and sum(r.doc_id is None and r.n_tokens > 0 for r in got) <= 3
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/e/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").collect() == []
