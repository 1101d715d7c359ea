"""Text preparation and classification. Every operator works on the document rows where they lie, without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreview.functions.scalars import any_of, contained, keyword_pattern, literals

# What counts as a phone number, an id number, an address, a script or a damaged character.
PHONE = r"(?<!\d)1[3-9]\d{9}(?!\d)"
ID_NUMBER = r"(?<!\d)\d{17}[\dXx](?![\dXx])"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CJK = "一-鿿"
LATIN_LETTERS = r"\p{IsLatin}"
BAD_CHARS = "�\x00-\x08\x0b\x0c\x0e-\x1f"


def clean_text(df: DataFrame, fixes: Sequence[tuple[str, str]] = (), text: str = "text") -> DataFrame:
    """Ordered literal fixes, at most one blank line, single blanks, trimmed; with both lengths."""
    value = F.col(text)
    for wrong, right in fixes:
        value = F.replace(value, F.lit(wrong), F.lit(right))
    value = F.regexp_replace(value, r"\n{3,}", "\n\n")
    value = F.regexp_replace(value, r"[ \t]+", " ")
    value = F.regexp_replace(value, r"^\s+|\s+$", "")
    return df.withColumn("cleaned", value).withColumn("original_length", F.length(text).cast("long")).withColumn(
        "cleaned_length", F.length("cleaned").cast("long"))


def mask_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Phone, id number, e-mail -> tags in this order, with the hits of each kind."""
    value = F.col(text)
    out = df
    for kind, pattern in (("phone", PHONE), ("id_number", ID_NUMBER), ("email", EMAIL)):
        out = out.withColumn(f"{kind}_hits", F.regexp_count(value, F.lit(pattern)).cast("long"))
        value = F.regexp_replace(value, pattern, f"<{kind}>")
    return out.withColumn("masked", value)


def text_quality(df: DataFrame, script: str = LATIN_LETTERS, max_chars: int = 100_000, text: str = "text") -> DataFrame:
    """Shares of damaged and of in-script characters over the whole text, its length, and whether it exceeds the limit."""
    n = F.length(text)
    share = lambda cls: F.when(n > 0, F.length(F.regexp_replace(F.col(text), f"[^{cls}]", "")) / n).otherwise(0.0)
    return df.withColumn("n", n.cast("long")).withColumn("bad_ratio", share(BAD_CHARS)).withColumn(
        "script_ratio", share(script)).withColumn("truncated", n > max_chars)


def lexicon_hits(df: DataFrame, lexicon: dict[str, Sequence[str]], text: str = "text", shown: int = 4) -> DataFrame:
    """Per document and word group: the number of words found and the first few of them."""
    low = F.lower(text)
    groups = F.array(*[F.struct(F.lit(name).alias("word_group"), contained(low, words).alias("found"))
                       for name, words in lexicon.items()])
    return df.select("doc_id", F.inline(groups)).select(
        "doc_id", "word_group", F.size("found").cast("long").alias("hits"),
        F.array_join(F.slice("found", 1, shown), ", ").alias("sample"))


def classify_documents(df: DataFrame, lexicon: dict[str, Sequence[str]], script: str = LATIN_LETTERS,
                       clause_pattern: str = r"第[一二三四五六七八九十百]+条", max_chars: int | None = None,
                       min_chars: int = 80, max_bad: float = 0.15, min_script: float = 0.15,
                       forced: bool = False, text: str = "text", ext: str | None = None) -> DataFrame:
    """First-match cascade over quality, word groups and counts -> type, confidence, contract flag, notice, admission.

    Whole texts are read unless `max_chars` is given. `ext` names a column with the file extension.
    """
    trimmed = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    body = F.substring(trimmed, 1, max_chars) if max_chars else trimmed
    work = df.withColumn("_body", body).withColumn("_low", F.lower("_body"))
    work = text_quality(work, script, text="_body")
    for name, words in lexicon.items():
        work = work.withColumn(f"_{name}", F.size(contained(F.col("_low"), words)))
    work = work.withColumn("_clauses", F.regexp_count("_body", F.lit(clause_pattern))
                           + F.regexp_count("_body", F.lit(r"(?m)^\s*\d+(?:\.\d+)+\s"))).withColumn(
        "_urls", F.regexp_count("_low", F.lit(r"https?://")))
    c = {name: F.col(f"_{name}") for name in (*lexicon, "clauses", "urls")}
    cap = lambda value, most: F.least(value, F.lit(most))
    no_party = c["party"] == 0
    work = work.withColumn("score", (2 * cap(c["party"], 3) + cap(c["struct"], 3) + 2 * cap(c["sign"], 2)
                                     + cap(c["oblige"], 3) + cap(c["clauses"], 5)).cast("long"))
    score = F.col("score")
    full = (score >= 8) & (c["party"] > 0)
    partial = (score >= 4) & (c["party"] > 0) & ((c["struct"] > 0) | (c["clauses"] > 0) | (c["sign"] > 0))
    rules = [
        (F.col("n") == 0, "garbage", 0.95, False),
        (F.col("n") < min_chars, "garbage", 0.90, False),
        (F.col("bad_ratio") > max_bad, "garbage", 0.85, False),
        (F.col("script_ratio") < min_script, "foreign_script", 0.75, False),
        ((c["resume"] >= 3) & no_party, "resume", 0.85, False),
        ((c["invoice"] >= 3) & no_party, "invoice", 0.85, False),
        ((c["privacy"] >= 2) & no_party, "privacy_policy", 0.80, False),
        ((c["news"] >= 3) | ((c["news"] >= 2) & (c["urls"] >= 3)), "news_article", 0.80, False),
        ((c["novel"] >= 4) & no_party, "novel", 0.75, False),
        (full & (c["labor"] >= 3), "labor_contract", None, True),
        (full & (c["service"] >= 2), "service_agreement", None, True),
        (full, "other_contract", None, True),
        (partial & (c["labor"] >= 3), "labor_contract", 0.55, True),
        (partial, "other_contract", 0.55, True),
        ((c["noise"] >= 5) | (c["urls"] >= 8), "news_article", 0.70, False),
    ]
    if ext:
        kind = F.lower(F.col(ext))
        rules = [(kind.isin("xlsx", "csv"), "spreadsheet", 0.95, False),
                 (kind == "pptx", "presentation", 0.95, False)] + rules
    scored_conf = F.round(F.least(F.lit(0.98), 0.55 + 0.02 * score), 2)
    doc_type = conf = is_contract = None
    for cond, name, value, contract in rules:
        value = scored_conf if value is None else F.lit(value)
        if doc_type is None:
            doc_type, conf, is_contract = F.when(cond, name), F.when(cond, value), F.when(cond, F.lit(contract))
        else:
            doc_type, conf, is_contract = doc_type.when(cond, name), conf.when(cond, value), is_contract.when(
                cond, F.lit(contract))
    percent = F.round(F.col("confidence") * 100).cast("int").cast("string")
    notice = F.when(F.col("is_contract") & (F.col("confidence") >= 0.8), F.lit(None).cast("string")).when(
        F.col("is_contract"), F.concat(F.lit("partly recognised as "), "doc_type", F.lit(" ("), percent, F.lit("%)"))
    ).otherwise(F.concat(F.lit("recognised as "), "doc_type", F.lit(" ("), percent, F.lit("%)")))
    helpers = [name for name in work.columns if name.startswith("_")]
    return work.withColumn("doc_type", doc_type.otherwise("unknown")).withColumn(
        "confidence", conf.otherwise(0.40)).withColumn("is_contract", is_contract.otherwise(False)).withColumn(
        "notice", notice).withColumn("admitted", F.col("is_contract") | F.lit(forced)).drop(*helpers)


def infer_rule_set(df: DataFrame, markers, default: str, head_chars: int = 200, text: str = "text",
                   requested: str | None = None, known: Sequence[str] = ()) -> DataFrame:
    """Rule set by markers in the head of the text; a known explicit request wins, an unknown one gets the default."""
    head = F.substring(text, 1, head_chars)
    found = F.lit(None).cast("string")
    for name, words in reversed(markers):
        found = F.when(any_of(head, words), F.lit(name)).otherwise(found)
    inferred = F.coalesce(found, F.lit(default))
    if requested:
        asked = F.lower(F.trim(F.coalesce(F.col(requested), F.lit(""))))
        inferred = F.when(asked.isin("", "auto"), inferred).when(asked.isin(list(known)), asked).otherwise(F.lit(default))
    return df.withColumn("rule_set", inferred)


def split_clauses(df: DataFrame, separator: str = "\n\n", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Non-blank paragraphs -> (doc_id, clause_id from 1, title, content), and the columns named in `keep`."""
    parts = F.filter(F.transform(F.split(F.col(text), separator), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    return df.select("doc_id", *keep, F.posexplode(parts).alias("pos", "content")).select(
        "doc_id", *keep, (F.col("pos") + 1).cast("long").alias("clause_id"),
        F.substring(F.substring_index("content", "\n", 1), 1, 50).alias("title"), "content")


def split_sentences(df: DataFrame, pattern: str = r"[。；;！？\n\r]+", min_chars: int = 4, text: str = "text") -> DataFrame:
    return df.select("doc_id", F.posexplode(_sentences(F.col(text), pattern, min_chars)).alias("pos", "sentence")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def _sentences(text: Column, pattern: str, min_chars: int) -> Column:
    return F.filter(F.transform(F.split(text, pattern), lambda s: F.trim(s)), lambda s: F.length(s) >= min_chars)


def extract_trigger_query(df: DataFrame, triggers: Sequence[str], pattern: str = r"[。；;！？\n\r]+", min_chars: int = 4,
                          enough: int = 60, more: int = 4, cut: int = 160, text: str = "text") -> DataFrame:
    """The first sentence with a trigger, extended by following ones while short; else the first two sentences."""
    sents = F.col("_sents")
    start = F.array_position(F.transform(sents, lambda s: any_of(s, triggers)), F.lit(True))
    joined = F.aggregate(
        F.slice(sents, F.greatest(start, F.lit(1)).cast("int"), F.lit(more + 1)),
        F.lit(""), lambda acc, s: F.when(F.length(acc) < enough, F.concat(acc, s)).otherwise(acc))
    query = F.when(start > 0, joined).otherwise(F.array_join(F.slice(sents, 1, 2), ""))
    return df.withColumn("_sents", _sentences(F.col(text), pattern, min_chars)).withColumn(
        "query", F.substring(query, 1, cut)).drop("_sents")


def categorize_clauses(df: DataFrame, keywords, title: str = "title", content: str = "content") -> DataFrame:
    """All categories with a keyword in title or content, in pack order; the first is the primary one."""
    body = F.concat_ws(" ", title, content)
    found = F.filter(F.array(*[F.when(any_of(body, words), F.lit(name)) for name, words in keywords]),
                     lambda c: c.isNotNull())
    # Generated, not projected: the optimiser would repeat the search in every filter and branch that reads a category.
    return df.select("*", F.explode(F.array(found)).alias("categories")).withColumn("primary_category", F.get("categories", F.lit(0)))


def category_of(df: DataFrame, rules, default: str = "general", text: str = "text") -> DataFrame:
    """First rule with any term in the text."""
    value = F.lit(default)
    for name, words in reversed(rules):
        value = F.when(any_of(F.col(text), words), F.lit(name)).otherwise(value)
    return df.withColumn("category", value)


def split_articles(df: DataFrame, pattern: str, expected: int | None = None, text: str = "text") -> DataFrame:
    """Tags dropped, entities decoded, numbered articles cut out -> (doc_id, pos, number, content without blanks).

    `pattern` has two groups: number and content. With `expected` the job fails where a document has another count.
    """
    from docreview.sources.html import decode_entities

    plain = decode_entities(F.regexp_replace(F.col(text), r"<[^>]+>", "\n"))
    squeezed = F.regexp_replace(F.regexp_replace(plain, "[ \\t\\r\\f\\x0b ]+", ""), r"\n+", "\n")
    numbers = F.regexp_extract_all("_plain", F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all("_plain", F.lit(pattern), F.lit(2))
    pairs = F.filter(F.transform(F.arrays_zip(numbers.alias("number"), bodies.alias("body")), lambda p: F.struct(
        p["number"].alias("number"), F.regexp_replace(p["body"], r"\s+", "").alias("content"))),
        lambda p: F.length(p["content"]) > 0)
    work = df.select("doc_id", squeezed.alias("_plain")).select("doc_id", pairs.alias("articles"))
    if expected is not None:
        work = work.filter(F.assert_true(F.size("articles") == expected, F.concat(
            F.lit(f"expected {expected} articles, found "), F.size("articles").cast("string"))).isNull())
    return work.select("doc_id", F.posexplode("articles").alias("pos", "a")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "a.number", "a.content")


def classify_intent(df: DataFrame, intents, text: str = "text") -> DataFrame:
    """Intent with the most keyword hits (ties: pack order), confidence .45 + .2 per hit, `unknown` 0 without a hit."""
    value = F.col(text)

    def hit(word: str) -> Column:
        return F.rlike(value, F.lit(keyword_pattern(word))) if word.isascii() else F.contains(value, F.lit(word))

    counts = F.array(*[F.struct(sum((hit(w).cast("int") for w in words), F.lit(0)).alias("hits"),
                                F.lit(-i).alias("ord"), F.lit(name).alias("intent"))
                       for i, (name, words) in enumerate(intents)])
    best = F.array_max(counts)
    return df.withColumn("_best", best).withColumn(
        "intent", F.when(F.col("_best.hits") > 0, F.col("_best.intent")).otherwise("unknown")).withColumn(
        "confidence", F.when(F.col("_best.hits") > 0, F.round(F.least(F.lit(1.0), 0.45 + 0.2 * F.col("_best.hits")), 2))
        .otherwise(0.0)).withColumn("adopted", F.col("confidence") >= 0.5).drop("_best")


def extract_obligations(df: DataFrame, obligations, date_pattern: str, amount_pattern: str, renewal: str,
                        most: int = 10, text: str = "text") -> DataFrame:
    """First dates and amounts, the labels whose key occurs, and the renewal flag."""
    value = F.col(text)
    labels = F.filter(F.array(*[F.when(F.contains(value, F.lit(k)), F.lit(v)) for k, v in obligations]),
                      lambda x: x.isNotNull())
    return df.withColumn("dates", F.slice(F.regexp_extract_all(value, F.lit(date_pattern), F.lit(0)), 1, most)).withColumn(
        "amounts", F.slice(F.regexp_extract_all(value, F.lit(amount_pattern), F.lit(0)), 1, most)).withColumn(
        "obligations", labels).withColumn("auto_renewal", F.contains(value, F.lit(renewal)))


def _spans(text: str, parting: re.Pattern, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """Trimmed, non-empty stretches of text[start:end] between the matches of `parting`."""
    end = len(text) if end is None else end
    edges = [start, *(x for m in parting.finditer(text, start, end) for x in m.span()), end]
    for a, b in zip(edges[::2], edges[1::2]):
        a += len(text[a:b]) - len(text[a:b].lstrip())
        b = a + len(text[a:b].rstrip())
        if b > a:
            yield a, b


def chunk_documents(df: DataFrame, size: int = 700, overlap: int = 120, title: str | None = None,
                    cut_at: str = r"(?<=[。！？；;])\s*|\n", text: str = "text") -> DataFrame:
    """Paragraph-first greedy chunks -> (doc_id, chunk_id, chunk_index, text, start, end, title).

    Over-long paragraphs are cut at `cut_at`. A new chunk starts with the last `overlap` characters of the one before,
    without leading blanks where more than one piece follows. `start` and `end` are the true offsets of the chunk's own
    pieces (the carried overlap lies before `start`) in the CRLF-normalised, trimmed text. Where a chunk ends depends on
    the one before, so the offsets of the pieces are cut into runs per document, inside Arrow batches.
    """
    if overlap < 0 or size <= overlap:
        raise ValueError("size must exceed overlap, and overlap must not be negative")
    clean = F.regexp_replace(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"^\s+|\s+$", "")
    paragraph, piece = re.compile(r"\n\s*\n+", re.ASCII), re.compile(cut_at, re.ASCII)

    def split(body: str) -> list[tuple[str, int, int]]:
        spans = [s for a, b in _spans(body, paragraph) for s in ([(a, b)] if b - a <= size else _spans(body, piece, a, b))]
        reach = np.cumsum([b - a + 1 for a, b in spans])
        out: list[tuple[str, int, int]] = []
        first = 0
        while first < len(spans):
            tail = out[-1][0][-overlap:] + "\n" if out and overlap else ""
            head = tail + body[slice(*spans[first])]
            # The last piece that still fits, by the running sum of the lengths.
            last = max(first, int(np.searchsorted(reach, size - len(head.lstrip()) + reach[first], "right")) - 1)
            own = [body[a:b] for a, b in spans[first + 1:last + 1]]
            out.append(("\n".join([head.lstrip(), *own]) if own else head, spans[first][0], spans[last][1]))
            first = last + 1
        return out

    def chunks(batches):
        for batch in batches:
            rows = [(doc, i, *chunk, name) for doc, name, whole in zip(batch["doc_id"], batch["title"], batch["clean"])
                    for i, chunk in enumerate(split(whole))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text", "start", "end", "title"])

    cut = df.select("doc_id", (F.col(title) if title else F.lit("")).alias("title"), clean.alias("clean")).filter(F.length("clean") > 0)
    kind = df.schema["doc_id"].dataType.simpleString()
    packed = cut.mapInPandas(chunks, f"doc_id {kind}, chunk_index long, text string, start long, end long, title string")
    return packed.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.lpad(
        F.col("chunk_index").cast("string"), F.greatest(F.lit(4), F.length(F.col("chunk_index").cast("string"))), F.lit("0"))).alias("chunk_id"),
        "chunk_index", "text", "start", "end", "title")
