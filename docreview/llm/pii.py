"""Personal data: high-recall generators, gradient boosted trees over format and context, thresholds calibrated per kind.

Base patterns find emails, addresses, cards and phone numbers; failing ones (checksum, digits, parts) are dropped. Generators
propose further, overlapping spans of looser formats. Every match becomes a vector of small levels. Matches of the base
patterns train the trees: those that hold are positive, those that fail negative. Counts per vector cover the whole corpus
and are all that boosting needs, so the driver sees at most the product of the levels (`MAX_VECTORS`), whatever the input.
A part of the matches, dealt by hash, is held out and sets, per kind, the least score whose share of positives is high enough.

Everything on the table is DataFrame functions. Matches lie between the pieces of a split by the same pattern, which gives their
offsets as a running sum. Patterns use possessive groups, which neither recurse nor backtrack on very long texts.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreview.llm.common import shared_dir, table, whole

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
#: Fixed by the contract, each with the same matches as the plain form. A run of characters is tried once, from its beginning
#: or from the end of the match before.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser formats, all of bounded length: written-out signs, other separators, no country sign.
GENERATORS = {
    "email": r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}\x20?(?:@|[\[(]at[\])])\x20?[\p{L}\p{N}-]{1,63}"
             r"(?:\x20?(?:\.|[\[(]dot[\])])\x20?[\p{L}\p{N}-]{1,63}){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\[(]?(?:\.|dot)[\])]?\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){13,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00)?\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){2,5}(?![0-9])",
}
CONTEXT = {  # words ahead of a span that speak for its kind
    "email": r"mail|contact|write|an:|to:", "ip": r"\bip\b|addr|host|server|login", "card": r"card|visa|credit|pay|karte|tarjeta|carte",
    "phone": r"phone|call|tel|fax|mobile|llam|appel|\bruf",
}
WINDOW = 24
"""Characters ahead of a span that are read as its context."""
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Feature -> number of levels.
LEVELS = {"kind": 4, "digits": 8, "separator": 6, "context": 2, "left": 4, "right": 4, "formed": 2, "first": 5}
MAX_VECTORS = math.prod(LEVELS.values())
"""Vectors that can exist: 61,440 rows of counts on the driver at most; a corpus has a few hundred."""
ROUNDS, DEPTH, RATE, SHRINK = 20, 3, 0.3, 1.0
HELD_OUT = 4
"""One match in HELD_OUT, by the hash of its text, calibrates."""
PRECISION = 0.95


def parts_of(text: Column, kind: int, pattern: str, base: bool) -> Column:
    """array<struct<kind, base, pos, gap, size, hit, before, after>>: the leftmost matches that do not overlap, in order."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(pieces, hits, lambda p, h: F.struct(p.alias("p"), h.alias("h")))
    after = F.slice(pieces, 2, 1 << 30)
    found = F.zip_with(both, after, lambda x, n: F.struct(
        F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.length(x["p"]).cast("long").alias("gap"), F.length(x["h"]).cast("long").alias("size"),
        x["h"].alias("hit"), F.substring(x["p"], -WINDOW, WINDOW).alias("before"), F.substring(n, 1, 1).alias("after")))
    return F.filter(found, lambda x: x["hit"].isNotNull())


def _digits() -> Column:
    return F.regexp_replace("hit", "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 14 to 19 digits pass the checksum."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    worth = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(doubled(d.cast("int"))))
    passes = F.aggregate(worth, F.lit(0), lambda total, d: total + d) % 10 == 0
    return F.when(F.length(digits).between(14, 19), passes).otherwise(F.lit(False))


def _by_kind(values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for i, kind in enumerate(KINDS):
        out = F.when(F.col("kind") == i, values[kind]).otherwise(out)
    return out


def _beside(c: Column) -> Column:
    return F.when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).when((c == "") | c.rlike(r"^\s"), 0).otherwise(3)


def with_features(spans: DataFrame) -> DataFrame:
    """Spans with `holds` (a base match that passes its test) and one small integer per feature of LEVELS."""
    spans = spans.withColumn("_digits", _digits())
    n, dots = F.length("_digits"), F.regexp_replace("hit", r"\x20?[\[(]?(?:\.|dot)[\])]?\x20?", ".")
    luhn = _luhn(F.col("_digits"))
    parts = dots.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    formed = {"email": F.col("hit").rlike(r"(?:\.|dot[\])])\x20?[A-Za-z]{2,24}$"), "ip": parts, "card": luhn,
              "phone": n.between(10, 15) & F.col("hit").rlike(r"[0-9]{3}[^0-9][0-9]{4}$|^\+|^00")}
    holds = {"email": F.lit(True), "ip": parts, "card": luhn, "phone": n.between(10, 15)}
    seps = F.regexp_replace("hit", r"[\p{L}\p{N}]", "")
    context = _by_kind({k: F.lower("before").rlike(p) for k, p in CONTEXT.items()})
    first = F.substring("hit", 1, 1)
    return spans.select(
        "*", (F.col("base") & _by_kind(holds)).alias("holds"),
        F.when(n < 7, 0).when(n < 10, 1).when(n < 12, 2).when(n < 14, 3).when(n < 16, 4).when(n == 16, 5).when(n < 20, 6).otherwise(7).alias("digits"),
        F.when(seps == "", 0).when(seps.rlike(r"^\x20+$"), 1).when(seps.rlike("^-+$"), 2).when(seps.rlike(r"^\.+$"), 3)
        .when(seps.rlike("@"), 4).otherwise(5).alias("separator"),
        context.cast("int").alias("context"), _beside(F.substring("before", -1, 1)).alias("left"), _beside(F.col("after")).alias("right"),
        _by_kind(formed).cast("int").alias("formed"),
        F.when(first == "+", 0).when(first.rlike("[3-6]"), 1).when(first.rlike("[0-9]"), 2).when(first.rlike(r"\p{L}"), 3).otherwise(4).alias("first"),
    ).drop("_digits")


def boost(levels: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[dict]:
    """Trees by Newton steps of the logistic loss over vectors with counts; a split asks whether a feature has one level."""
    names = list(LEVELS)
    tests = [(f, v, levels[:, f] == v) for f, name in enumerate(names) for v in range(LEVELS[name])]
    margin, trees = np.zeros(len(levels)), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> dict:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        gain, pick = 1e-6, None
        for test in tests if depth else []:
            yes = rows & test[2]
            a, b = g[yes].sum(), h[yes].sum()
            new = a * a / (b + SHRINK) + (total_g - a) ** 2 / (total_h - b + SHRINK) - total_g ** 2 / (total_h + SHRINK)
            if new > gain:
                gain, pick = new, test
        if pick is None:
            return {"value": float(RATE * total_g / (total_h + SHRINK)), "rows": rows}
        f, v, mask = pick
        return {"feature": names[f], "level": v, "yes": grow(rows & mask, g, h, depth - 1), "no": grow(rows & ~mask, g, h, depth - 1)}

    def add(tree: dict) -> None:
        if "value" in tree:
            margin[tree.pop("rows")] += tree["value"]
        else:
            add(tree["yes"])
            add(tree["no"])

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        trees.append(grow(np.ones(len(levels), bool), good * (1 - p) - bad * p, (good + bad) * p * (1 - p), DEPTH))
        add(trees[-1])
    return trees


def _tree(tree: dict) -> Column:
    if "value" in tree:
        return F.lit(tree["value"])
    return F.when(F.col(tree["feature"]) == tree["level"], _tree(tree["yes"])).otherwise(_tree(tree["no"]))


def score_of(trees: list[dict]) -> Column:
    """Probability by the trees, to 9 digits."""
    margin = sum((_tree(t) for t in trees), F.lit(0.0))
    return F.round(1 / (1 + F.exp(-margin)), 9)


def thresholds(scored: list[tuple[int, float, int, int]]) -> dict[int, float]:
    """Per kind the least score at which held-out matches (kind, score, positives, negatives) reach PRECISION, counted with one
    more failure; kinds without any such score accept nothing."""
    out = {}
    for kind in range(len(KINDS)):
        good = bad = 0
        for score in sorted({s for k, s, *_ in scored if k == kind}, reverse=True):
            good += sum(p for k, s, p, _ in scored if k == kind and s == score)
            bad += sum(n for k, s, _, n in scored if k == kind and s == score)
            if good / (good + bad + 1) >= PRECISION:
                out[kind] = score
    return out


def fit(spans: DataFrame) -> tuple[list[dict], dict[int, float]]:
    """Trees and thresholds from the base matches of `spans` (with features); ([], {}) where all hold or all fail."""
    counts = spans.filter("base").groupBy(*LEVELS, "held").agg(
        F.sum(F.col("holds").cast("long")).alias("good"), F.sum((~F.col("holds")).cast("long")).alias("bad"))
    rows = sorted(counts.collect())
    train, rest = [r for r in rows if not r.held], [r for r in rows if r.held]
    if not sum(r.good for r in train) or not sum(r.bad for r in train):
        return [], {}
    levels = np.array([[r[c] for c in LEVELS] for r in train])
    trees = boost(levels, np.array([float(r.good) for r in train]), np.array([float(r.bad) for r in train]))

    def margin(tree: dict, row) -> float:
        while "value" not in tree:
            tree = tree["yes" if row[tree["feature"]] == tree["level"] else "no"]
        return tree["value"]

    scores = [round(1 / (1 + math.exp(-sum(margin(t, r) for t in trees))), 9) for r in rest]
    return trees, thresholds([(r.kind, s, r.good, r.bad) for r, s in zip(rest, scores)])


def find_spans(rows: DataFrame) -> DataFrame:
    """(key, base, start, end, holds, held, ...features) of rows(key, parts): offsets are code points, `end` is exclusive; `held`
    marks what calibrates."""
    spans = rows.select("key", F.posexplode("parts").alias("pos", "p")).select("key", "pos", "p.*")
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("key", "kind", "base").orderBy("pos"))
    found = with_features(spans.withColumn("end", upto).withColumn("start", F.col("end") - F.col("size")))
    held = F.pmod(F.xxhash64("hit"), F.lit(HELD_OUT)) == 0
    return found.select("key", "base", "start", "end", "holds", held.alias("held"), *LEVELS)


def accepted(spans: DataFrame, trees: list[dict], least: dict[int, float]) -> DataFrame:
    """Base spans that hold, and generated ones that reach the threshold of their kind and touch no base span; of generated spans
    that overlap in a chain the one with the best score stays (ties: first, then longest, then kind)."""
    base = spans.filter("holds").select("key", "kind", "base", "start", "end", F.lit(1.0).alias("score"))
    if not trees or not least:
        return base
    limit = F.lit(None)
    for kind, t in least.items():
        limit = F.when(F.col("kind") == kind, F.lit(t)).otherwise(limit)
    more = spans.filter(~F.col("base")).withColumn("score", score_of(trees)).filter(F.col("score") >= limit).select(*base.columns)
    both = base.unionByName(more)
    by_start = Window.partitionBy("key").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    from_end = Window.partitionBy("key").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_ends", F.max(F.when(F.col("base"), F.col("end"))).over(by_start))
    both = both.withColumn("_next", F.min(F.when(F.col("base"), F.col("start"))).over(from_end))
    free = ~(F.coalesce(F.col("_ends") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("end"), F.lit(False)))
    more = both.filter(~F.col("base") & free).drop("_ends", "_next")
    order = Window.partitionBy("key").orderBy("start", F.desc("end"), "kind", "score")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    more = more.withColumn("_new", F.coalesce((before <= F.col("start")).cast("int"), F.lit(1)))
    more = more.withColumn("_chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    best = F.max_by(F.struct("kind", "base", "start", "end", "score"), F.struct("score", -F.col("start"), F.col("end"), -F.col("kind")))
    return base.unionByName(more.groupBy("key", "_chain").agg(best.alias("s")).select("key", "s.*"))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `row` (a struct of all other columns, so that no name can clash) and `spans`, an array of
    struct<start, kind, end, base, score> by start and kind, kind being a place in KINDS.

    A null or empty text has an empty array, an empty table no rows; repeated rows and ids are rows of their own. Texts are read
    whole and shuffled nowhere: two tables in the shared folder, of matches and of their features, hold what the rest needs.
    """
    spark = docs.sparkSession
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).cast("int").alias("_none")]
    work = docs.select(F.struct(*others).alias("row"), whole(f"`{text_col}`").alias("text"))
    gates = {"email": F.contains("text", F.lit("@")) | F.lower("text").rlike(r"[\[(]at[\])]")}
    some = F.col("text").rlike("[0-9]")
    none = F.filter(parts_of(F.lit(""), 0, "x", True), lambda x: F.lit(False))
    parts = [F.when(gates.get(k, some), parts_of(F.col("text"), i, found[k], found is BASE)).otherwise(none)
             for found in (BASE, GENERATORS) for i, k in enumerate(KINDS)]
    folder = f"{shared_dir(spark).rstrip('/')}/pii-{uuid.uuid4().hex}"
    work.select(F.monotonically_increasing_id().alias("key"), "row", F.concat(*parts).alias("parts")).write.parquet(f"{folder}/matches")
    rows = spark.read.parquet(f"{folder}/matches")
    find_spans(rows.select("key", "parts")).write.parquet(f"{folder}/features")
    spans = spark.read.parquet(f"{folder}/features")
    kept = accepted(spans, *fit(spans))
    lists = kept.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "base", "score"))).alias("spans"))
    done = rows.select("key", "row").join(lists, "key", "left")
    empty = F.array().cast(lists.schema["spans"].dataType)
    return done.select("row", F.coalesce("spans", empty).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(
            a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.get(names, s["kind"]))).alias("out")))
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))


def written(spans: Column) -> Column:
    """`kind:start:end` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: int) -> Column:
    """Base spans of a kind."""
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def op11_pii(spark, sf_dir):
    done = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [count_of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return done.select("row.doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
