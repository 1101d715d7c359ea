"""Cross-tokenizer alignment against whole texts through both tokenizers, byte by byte."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, sha

from docreview.llm import alignment

ODD = ["a", "", None, " ", "  ", "a  b", "a \n b", "\n\n x", "é日本語 テキスト", "x▁y z", "<|endoftext|> <s> <0x41>", "trail ", "a  b", "tab\t x",
       "a\x1c b", "a　 b   c", "      ", "don't stop 12 345 ...!!!", "a\x00b c", "aaaa" * 500, "\U0001F600 ok", "a\r\n b", " lead",
       "same text", "same text", "= " * 300 + "=" * 3000, "word " * 2000]


@pytest.fixture(scope="module")
def sides():
    read = lambda name: open(public_tokenizers.path(name), "rb").read()
    return alignment.ByteLevel(read(alignment.BYTE_LEVEL)), alignment.Pieces(read(alignment.PIECES))


def brute(text, a, b):
    """Groups of (ids of A, ids of B) from the tokens of the whole text; none where the bytes differ."""
    ids = [a.tokenizer.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)] if text else [[], []]
    if not text or any(b"".join(s.bytes_of[i] for i in x) != (" " + text).encode() for s, x in zip((a, b), ids)):
        return []
    ends = [np.cumsum([len(s.bytes_of[i]) for i in x]).tolist() for s, x in zip((a, b), ids)]
    groups, at = [], [0, 0]
    for end in sorted(set(ends[0]) & set(ends[1])):
        group = []
        for side in (0, 1):
            upto = ends[side].index(end) + 1
            group.append(ids[side][at[side]:upto])
            at[side] = upto
        groups.append(group)
    return groups


def expected(texts, a, b):
    every = [brute(t, a, b) for t in texts]
    links = [Counter((x, y) for g in groups for x in g[0] for y in g[1]) for groups in every]
    held = Counter(pair for doc in links for pair in doc)
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    for groups, doc in zip(every, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(doc.values()),
               sum(n for p, n in doc.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in doc.items()), sha(text) if text else "")


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block", [1, 4 << 20])
def test_against_whole_texts(spark, sides, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    docs = documents(spark, list(enumerate(ODD))).coalesce(2)
    done = alignment.align(docs)
    assert {"source", "digest"} <= set(done.schema["row"].dataType.names)
    got = {r["row"]["doc_id"]: tuple(r[c] for c in COLUMNS) for r in done.collect()}
    assert got == dict(enumerate(expected(ODD, *sides)))


def test_corpus(spark, sf, sides):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r["row"]["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs.repartition(5)).collect()}
    assert got == dict(zip(texts, expected(list(texts.values()), *sides)))


def test_repeated_and_null_ids(spark, sides):
    rows = [(None, "one two"), (None, "one two"), (3, None), (3, "two")]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in alignment.align(documents(spark, rows, extra=False)).collect())
    assert got == sorted(expected([t for _, t in rows], *sides))


def test_empty(spark):
    assert alignment.align(documents(spark, [])).collect() == []


def test_gustavson():
    rng = np.random.default_rng(3)
    left, right = (rng.integers(0, 3, (7, 5)), rng.integers(0, 3, (5, 6)))
    row, idx = np.nonzero(left)
    ptr = np.concatenate([[0], np.cumsum((right > 0).sum(axis=1))])
    _, cols = np.nonzero(right)
    r, c, v = alignment.gustavson(row, idx, left[row, idx], ptr, cols, right[right > 0], 6)
    out = np.zeros((7, 6), int)
    out[r, c] = v
    assert (out == left @ right).all()


def test_links_share_bytes(sides):
    units = [" running", " naïve", " 日本"]
    done = alignment.Aligned(units, *sides)
    assert done.shared_bytes.sum() == sum(len(u.encode()) for u in units)
    assert done.good.all() and (done.n_links >= done.n_groups).all()
