"""Tokens, fingerprints, languages, quality and chat formatting against brute force, round trips and held-out accuracy."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import documents, sha
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docreview.llm import bpe, chat, fingerprint, langid, quality
from docreview.llm.queries import QUERIES

with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as _file:
    RANKS = bpe.read_ranks(_file.read())
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER, DECODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN), bpe.Decoder(RANKS)
HARD = ["", "a" * 3000, " " * 2000, "ab" * 999, "日本語" * 300, "\n\r\n \t x", "<|endoftext|>", "don't we'll I'M", "é" * 500, "\x1c\x85\xa0　"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_tokens_equal_the_library(text):
    ids = ENCODER.encode(text)
    assert ids.tolist() == ORACLE.encode_ordinary(text)
    assert DECODER.decode(ids) == text


@pytest.mark.parametrize("text", HARD, ids=range(len(HARD)))
def test_hard_texts(text):
    assert ENCODER.encode(text).tolist() == ORACLE.encode_ordinary(text)


def test_tables_may_be_dropped_any_time(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_TRANSITIONS", 20)
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    monkeypatch.setattr(bpe, "LONG_TEXT", 40)
    monkeypatch.setattr(bpe, "STEP", 3)
    small = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for text in ["the quick brown fox jumps over the lazy dog, again and again", *HARD]:
        ids = small.encode(text)
        assert ids.tolist() == ORACLE.encode_ordinary(text) and DECODER.decode(ids) == text


def test_tables_end_with_the_task():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as file:
        data = file.read()
    with pytest.raises(KeyError), bpe._tables():
        bpe._encoder(data, public_tokenizers.PATTERN).encode("words of a text")
        bpe._decoder(data)
        raise KeyError
    assert bpe._encoder.cache_info().currsize == bpe._decoder.cache_info().currsize == 0


def test_compatible_pairs_by_merging():
    def merged(data):
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((RANKS.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [RANKS[p] for p in parts]

    machine, rng = bpe.Transducer(RANKS), random.Random(6)
    tokens = [rng.choice((rng.randrange(300), rng.randrange(3000), rng.randrange(len(RANKS)))) for _ in range(8000)]
    for left, right in zip(tokens, tokens[1:]):
        assert machine.compatible(left, right) == (merged(machine.bytes_of[left] + machine.bytes_of[right]) == [left, right])


def test_lookahead_is_bounded():
    """Tokens leave the transducer while a long piece is still being read."""
    machine = bpe.Transducer(RANKS)
    state, out = 0, []
    for byte in b"abcdefgh" * 200:
        state = machine.move(state, byte)
        if state < 0:
            state, emitted = machine.emitting[~state]
            out += emitted
    assert len(out) > 300 and all(len(p[2]) < 40 for p in machine.states[state])


def test_short_pieces_hold_no_tokens(monkeypatch):
    """States of invented words are plain numbers, fewer than with pending tokens, and give the same ids."""
    rng = random.Random(8)
    words = ["".join(rng.choices(["er", "in", "th", "on", "ción", "ä", "the", "qu", "ver", "ß"], k=rng.randint(3, 6))) for _ in range(4000)]
    short, long = bpe.Transducer(RANKS), bpe.Transducer(RANKS)
    ids = [list(short.tokens(w.encode())) for w in words]
    monkeypatch.setattr(bpe, "LONG_PIECE", 0)
    assert ids == [list(long.tokens(w.encode())) for w in words] == [ORACLE.encode_ordinary(w) for w in words]
    assert not short.moves and all(type(p) is int for places in short.short_states for p in places)
    assert 100 < len(short.short_states) < len(long.states) and 100 < short.short_moves < len(long.moves)
    monkeypatch.setattr(bpe, "LONG_PIECE", 64)
    monkeypatch.setattr(bpe, "MAX_SHORT_TRANSITIONS", 20)
    assert ids == [list(short.tokens(w.encode())) for w in words] and len(short.short_states) < 100


def test_utf8_stream():
    data = "aé日😀z".encode() + b"\xff\xe6\x97" + "é".encode()
    for i, j in itertools.combinations(range(len(data) + 1), 2):
        stream = bpe.Utf8Stream()
        assert stream.feed(data[:i]) + stream.feed(data[i:j]) + stream.feed(data[j:]) + stream.finish() == data.decode("utf-8", "replace")
    stream = bpe.Utf8Stream()
    assert stream.feed("😀".encode()[:3]) == "" and stream.finish() == "�"


def test_encode_and_decode(spark):
    rows = [(1, "hello world"), (1, "hello world"), (None, None), (3, ""), (4, "日本 " * 50_000)]
    got = bpe.decode(bpe.encode(documents(spark, rows))).collect()
    assert sorted((str(r.row.doc_id), r.ids, r.text) for r in got) == sorted((str(d), ORACLE.encode_ordinary(t or ""), t or "") for d, t in rows)
    both = bpe.round_trip(documents(spark, rows)).collect()
    assert sorted(map(str, both)) == sorted(map(str, got)) and bpe.round_trip(documents(spark, [])).collect() == []
    assert got[0].row.row == "row" and bpe.encode(documents(spark, [])).collect() == []


def prints(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in rows.orderBy("i").select(fingerprint.fingerprint(F.col("text"))).collect()]


def test_fingerprint_is_a_multiset_hash(spark):
    a, b, c, d, e = prints(spark, ["one two three four\nfive\nfive", "five\none two three four\nfive", "five\none two three four", "five", None])
    assert a == b and a != c and d != e
    pair = spark.createDataFrame([(c, d, a)], "c array<long>, d array<long>, a array<long>")
    added, removed = pair.select(fingerprint.combine(F.col("c"), F.col("d")), fingerprint.combine(F.col("a"), F.col("d"), -1)).first()
    assert added == a and removed == c


def test_every_word_of_a_line_has_its_own_seed(spark):
    words = [sum(1 << (4 * j) for j in range(8))]  # any line
    row = spark.createDataFrame([(str(words[0]),)], "t string")
    got = row.select(fingerprint.fingerprint(F.col("t"))).first()[0][:fingerprint.EXACT]
    want = row.select(*[F.xxhash64(F.lit(j), "t") for j in range(fingerprint.EXACT)]).first()
    assert got == [w & fingerprint.MASK for w in want] and len(set(got)) == fingerprint.EXACT


def brute_pieces(text):
    lines = [re.findall(r"[^\x20\x09-\x0D]+(?:[\x20\x09\x0B-\x0D]+|$)", x) for x in (text or "").split("\n")]
    return Counter("".join(w[i:i + 3]).rstrip(" \t\x0b\x0c\r") for w in lines for i in range(len(w)))


def test_likeness_by_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(40)]
    texts = {"plain": " ".join(words), "front": " ".join(["new", *words]), "gone": " ".join(words[1:]), "other": " ".join(words[20:] * 2),
             "lines": "\n ".join(words[:20]) + "\n\n" + "  ".join(words[20:]), "short": "a b", "none": "", "long": " x\ty " * 1500}
    got = dict(zip(texts, prints(spark, list(texts.values()))))
    pieces = {k: brute_pieces(t) for k, t in texts.items()}
    assert all(got[k][-1] == sum(pieces[k].values()) for k in texts)
    pairs = list(itertools.product(texts, repeat=2))
    rows = spark.createDataFrame([(i, got[a], got[b]) for i, (a, b) in enumerate(pairs)], "i int, a array<long>, b array<long>")
    near = dict(rows.select("i", fingerprint.likeness(F.col("a"), F.col("b"))).collect())
    for i, (a, b) in enumerate(pairs):
        x, y = pieces[a], pieces[b]
        xy, sq = sum(x[p] * y[p] for p in x), sum(n * n for n in [*x.values(), *y.values()])
        assert abs(near[i] - (xy / (sq - xy) if sq > xy else 1)) < 0.4, (a, b)
    assert near[pairs.index(("plain", "front"))] > 0.8 and near[pairs.index(("plain", "gone"))] > 0.8
    counters = [(w >> (i * fingerprint.COUNTER_BITS)) & ((1 << fingerprint.COUNTER_BITS) - 1)
                for i in range(fingerprint.PER_WORD) for w in got["long"][fingerprint.EXACT:-1]]
    listed = spark.createDataFrame([(p,) for p in pieces["long"].elements()], "p string").select(F.xxhash64("p")).collect()
    assert counters == [sum(h[0] >> bit & 1 for h in listed) for bit in range(fingerprint.LANES)]


def test_likeness_of_long_texts(spark):
    n = 1_200_000  # more than 2^20
    a, b = prints(spark, ["a " * n, "b c d " * 1000 + "a " * n])
    counters = [(w >> (i * fingerprint.COUNTER_BITS)) & ((1 << fingerprint.COUNTER_BITS) - 1)
                for i in range(fingerprint.PER_WORD) for w in a[fingerprint.EXACT:-1]]
    assert a[-1] == n and all(c <= 2 or n - 2 <= c <= n for c in counters) and {c > 2 for c in counters} == {True, False}
    assert spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(fingerprint.likeness(F.col("a"), F.col("b"))).first()[0] > 0.99


def test_edited_texts(spark):
    rows = [(10, "abcdefgh" * 30), (3, "x"), (7, None), (5, "é日" * 50), (20, "first words of another text entirely"), (-4, "word " * 30_000)]
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(documents(spark, rows)).collect()}
    ids = sorted(got)
    texts = {d: t or "" for d, t in rows}
    for at, d in enumerate(ids):
        cut = len(texts[d]) // 4
        edited = texts[d][:len(texts[d]) - cut] + texts[ids[(at + 1) % len(ids)]][:cut]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(texts[d]), sha(edited))
        assert 0 <= got[d].near_next <= 1 and 0 <= got[d].near_edited <= 1
        if edited == texts[d]:
            assert got[d].fingerprint == got[d].edited_fingerprint and got[d].near_edited == 1


def test_edited_texts_odd_ids(spark):
    same = fingerprint.edited_fingerprints(documents(spark, [(1, "only one document")])).collect()
    assert [(r.doc_id, r.near_next) for r in same] == [(1, 1.0)]
    odd = fingerprint.edited_fingerprints(documents(spark, [(1, "a b"), (1, "a b"), (None, "c d"), (2, "e")])).collect()
    assert sorted((str(r.doc_id), r.next_doc_id) for r in odd) == [("1", 2), ("1", 2), ("2", None), ("None", 1)]
    rows = [(1, "one text here"), (1, "other text there"), (None, "first without id"), (None, "second without id"), (3, "x" * 40)]
    odd = fingerprint.edited_fingerprints(documents(spark, rows)).collect()
    edits = {None: {"one text here", "other text there"}, 1: {"x" * 40}, 3: {"first without id", "second without id"}}
    assert sorted((r.doc_id or 0, r.n_chars) for r in odd) == sorted((d or 0, len(t)) for d, t in rows)
    for d, t in rows:
        possible = {sha(t[:len(t) - len(t) // 4] + e[:len(t) // 4]) for e in edits[d]}
        assert len({r.edited_sha256 for r in odd if r.doc_id == d and r.n_chars == len(t)} & possible) == 1
    assert fingerprint.edited_fingerprints(documents(spark, [])).collect() == []


def test_likeness_separates(spark, sf):
    rows = QUERIES["op2_fingerprints"](spark, sf).filter("n_chars > 200").collect()
    assert sum(r.near_edited > r.near_next + 0.1 for r in rows) > 0.97 * len(rows)


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op7_langid"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) > 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def lang_rows():
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    return [(i, make("abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "zz") for i in range(400)]


def test_language_cases(spark):
    train = spark.createDataFrame(lang_rows() + [(500, None, "aa"), (501, "abc", None), (None, "vwx", "zz")], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model.langs == ["aa", "zz"]
    texts = ["abcde badce edcba", "ZYXvw", None, "", "123 !?", "漢字", "a" * 100_000, "zz 12 zz"]
    docs = spark.createDataFrame([((i,), t) for i, t in enumerate(texts)], "`row` struct<score:int>, text string")
    got = {r.row.score: r for r in langid.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 4, 6, 7)] == ["aa", "zz", "und", "und", "und", "aa", "zz"]
    assert got[5].lang_pred in ("aa", "zz") and got[5].rejected and not got[0].rejected and got[2].score == 0.0
    nothing = langid.fit(train.filter("lang IS NULL"))
    assert nothing is None and {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_language_model_keeps_all_ngrams(spark):
    rng = np.random.default_rng(6)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9F00, 260_000)))
    train = spark.createDataFrame([(i, text[at:at + 10_000], "zh") for i, at in enumerate(range(0, len(text), 10_000))],
                                  "doc_id long, text string, lang string")
    kept = train.filter("coalesce(pmod(xxhash64(doc_id), 10) != 0, true)").collect()
    grams = {f"   {r.text} "[i:i + 4] for r in kept for i in range(len(r.text) + 1)}
    model = langid.fit(train)
    assert len(grams) > 200_000 and len(model.levels[3].keys) == len(grams)


def test_language_tables_equal_the_local_model(spark, monkeypatch):
    train = spark.createDataFrame(lang_rows() + [(500, None, "aa"), (501, "abc", None), (None, "vwx", "zz"), (502, "é日 abc", "mm")],
                                  "doc_id long, text string, lang string")
    local, tables = langid.fit(train), langid.fit(train, 0)
    assert isinstance(tables, langid.TableModel) and tables.langs == local.langs
    assert tables.judge.sharpness == local.sharpness and np.allclose(tables.judge.usual, local.usual, rtol=1e-4)
    texts = ["abcde badce edcba", "ZYXvw", None, "", "123 !?", "漢字 日", "a" * 3000, "zz 12 zz", "  x", "ZYXvw", "é"]
    docs = spark.createDataFrame([((i,), t) for i, t in enumerate(texts)] + [((None,), "bad")], "`row` struct<score:int>, text string")
    want = sorted(langid.predict(docs, local).collect(), key=str)
    for reply in (langid.REPLY_BYTES, 7 * 40, 40):  # whole texts, pieces of 7 letters, of one
        monkeypatch.setattr(langid, "REPLY_BYTES", reply)
        got = sorted(langid.predict(docs, tables).collect(), key=str)
        key = lambda r: (str(r.row.score), r.lang_pred, r.rejected)
        assert sorted(map(key, got)) == sorted(map(key, want))
        assert np.allclose([r.score for r in sorted(got, key=key)], [r.score for r in sorted(want, key=key)], atol=1e-4)


def test_language_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers(97, 103, (300, 4)), axis=0)
    levels, unseen = langid.build_levels(grams, rng.integers(0, 5, (len(grams), 2)).astype(float))
    model = langid.Model(["a", "b"], levels, unseen)
    letters = sorted({*grams[:, 3].tolist()})
    for context in ([97, 98, 99], [102, 102, 97], [32, 32, 32]):
        columns = [np.full(len(letters) + 1, c, np.uint32) for c in context] + [np.array([*letters, 5000], np.uint32)]
        assert np.allclose(np.exp(model.log_probabilities(columns)).sum(axis=0), 1, atol=1e-3)


def test_scores_do_not_depend_on_the_batch():
    grams, _ = np.unique(np.array(langid.windows(*langid.letters_of(["abcd efgh", "hgfe"]))).T, axis=0, return_counts=True)
    model = langid.Model(["a"], *langid.build_levels(grams.astype(int), np.ones((len(grams), 1))))
    texts = ["abc def", "", "x", "hgf!!e", "--"]
    together, sizes = model.entropies(texts)
    alone = [model.entropies([t]) for t in texts]
    assert np.allclose(together, np.concatenate([a[0] for a in alone])) and sizes.tolist() == [int(a[1][0]) for a in alone]


def test_chain_marginals_by_enumeration():
    rng = np.random.default_rng(4)
    sizes, k = [3, 1, 5], 4
    first = np.cumsum([0, *sizes[:-1]])
    features = rng.normal(size=(sum(sizes), k))
    chain = quality.Chain(rng.normal(size=k), rng.normal(size=(2, 2)))
    good, joint = chain.marginals(features, first)
    for at, n in zip(first, sizes):
        total, expected, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for path in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(features[at + i] @ chain.weights for i in range(n) if path[i]) + sum(chain.moves[a, b] for a, b in zip(path, path[1:])))
            total += w
            expected += w * np.array(path)
            for i in range(1, n):
                both[i, path[i - 1], path[i]] += w
        assert np.allclose(good[at:at + n], expected / total) and np.allclose(joint[at:at + n], both / total)


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op8_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id")
    rows = found.filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert all(r.predicted == 1 for r in rows if r.quality == 1)


def test_quality_cases(spark):
    good, bad = "A plain sentence of words that says something.\n", "BAD!! $$$ ### !!! %%%\n"
    rows = [(i, good * (1 + i % 5) if i % 2 else bad * (1 + i % 3), i % 2) for i in range(60)]
    chain = quality.fit(spark.createDataFrame(rows + [(70, good, None)], "doc_id long, text string, quality int"))
    texts = [good, bad, None, "", good * 2000, good * 9 + bad, "\n\n"]
    docs = spark.createDataFrame([((i,), t) for i, t in enumerate(texts)], "`row` struct<score:int>, text string")
    got = {r.row.score: r.score for r in quality.score(docs, chain).collect()}
    assert got[0] > 0.7 > got[1] and got[4] > 0.7 and got[2] == got[3] and all(0 <= s <= 1 for s in got.values())
    assert {r.score for r in quality.score(docs, quality.fit(spark.createDataFrame([], "doc_id long, text string, quality int"))).collect()} == {0.5}


def chat_rows(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "pair_id long, turn long, role string, text string, a string")


def test_chat(spark):
    shared = [(1, 0, "system", "Be kind"), (1, 1, "user", "Hi <|im_end|>")]
    chosen = shared + [(1, 2, "assistant", "Hello"), (1, 3, "user", "ok"), (1, 4, "assistant", "Bye"), (2, 0, "user", None), (3, 0, None, "x"), (None, 0, "user", "x"), (4, 0, "user", "only here")]
    rejected = shared + [(1, 2, "assistant", "No"), (2, 0, "user", None), (3, 0, "assistant", "x"), (None, 0, "user", "x")]
    got = {r.pair_id: r for r in chat.format_preferences(chat_rows(spark, chosen), chat_rows(spark, rejected)).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one.n_shared == 2 and one.prompt.startswith("<|im_start|>system\nBe kind<|im_end|>\n") and one.prompt.count("<|im_end|>") == 2
    assert [one.chosen[s.start:s.end] for s in one.chosen_mask] == ["Hello<|im_end|>", "Bye<|im_end|>"]
    assert [one.rejected[s.start:s.end] for s in one.rejected_mask] == ["No<|im_end|>"]
    assert (got[2].n_shared, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (1, "", "", [])
    assert got[3].n_shared == 0 and got[3].prompt == "" and got[3].chosen_mask == [] and len(got[3].rejected_mask) == 1


def test_chat_empty(spark):
    empty = chat_rows(spark, [])
    assert chat.format_preferences(empty, empty).collect() == []


def test_quality_sample_is_thinned_once(spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_TRAINING_DOCS", 100)
    monkeypatch.setattr(quality, "train_chain", lambda texts, labels: len(texts))
    docs = spark.createDataFrame([(i, f"text {i}", i % 2) for i in range(900)], "doc_id long, text string, quality int")
    usable = docs.filter(quality.remainder(F.col("doc_id"), 4) != 2).orderBy("doc_id")
    for n in (99, 100, 101, 104, 210, 310, 600):  # a little above the bound, and with odd divisors
        rows = usable.limit(n)
        chosen = quality.labelled_rows(docs.select("doc_id", "text"), rows.select("doc_id", "quality"))
        assert chosen.count() == quality.fit(chosen) == quality.fit(rows) == min(n, 100)


def test_texts_of_fingerprints_are_shuffled_once(spark):
    """The exchange by id and part serves the rows and their predecessors; no other one hashes a text."""
    docs = documents(spark, [(i, f"line {i} of a text\nand one more") for i in range(40)])
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        plan = fingerprint.edited_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "Exchange hashpartitioning" in plan and "Exchange hashpartitioning(xxhash64(" not in plan
