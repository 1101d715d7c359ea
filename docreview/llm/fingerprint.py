"""Homomorphic multiset hash of a document: the sum, modulo powers of two, of wide vectors hashed from its paragraphs.

A paragraph is a line. Its vector has `EXACT` words hashed from the whole line, `LANES` counters of the bits of the hashes
of its pieces and the number of pieces. Every word begins a piece: the word and the two after it, or fewer at the end of
the line, so that a word inserted or deleted changes three pieces at most beside its own. Vectors add word by word modulo 2^60, so the
order of paragraphs does not matter, and a paragraph is inserted or deleted by adding or subtracting its vector. Equality
rests on the whole-line words; the counters, as a random projection of the multiset of pieces, give a likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreview.llm.common import cut, table, whole

BITS = 60
MASK = (1 << BITS) - 1
EXACT = 4
PER_WORD, COUNTER_BITS = 2, 30
"""Counters in a word and their bits. No text of less than 2^31 bytes, the bound of a row, has 2^30 words, so its counters do
not overflow. In sums of more than that a counter carries into the next, which changes no equality, only the likeness."""
WORDS = 30
LANES = PER_WORD * WORDS
PIECE = r"(?=([^\x20\x09-\x0D]++(?:[\x20\x09\x0B-\x0D]++[^\x20\x09-\x0D]++){0,2}+))[^\x20\x09-\x0D]++"
"""Takes one word and looks ahead for its piece, the first group."""
SALTS = 64
"""Parts into which the rows that share an id are dealt."""
BLOCK = 1000
"""Pieces that the first tallies hold: ten words with six counters of 10 bits each."""
TALLIES, TALLY_BITS = 10, 10
TALLY_SPREAD = sum(1 << (i * TALLY_BITS) for i in range(BITS // TALLY_BITS))


def _summed(items: Column, start: Column, step) -> Column:
    """Fold of `items` into an array of words: `step(word, index, item)` modulo 2^60."""
    return F.aggregate(items, start, lambda acc, x: F.transform(acc, lambda a, j: step(a, j, x).bitwiseAND(F.lit(MASK))))


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), n)


def _right(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by)


def fingerprint(text: Column) -> Column:
    """array<long> of EXACT + WORDS + 1 words; null and empty texts have one empty paragraph without pieces.

    The number of the word is hashed before the line, so that every word hashes the line under a seed of its own: lines that
    collide in one word need not collide in the others.
    """
    text = F.coalesce(text, F.lit(""))
    lines = _summed(F.split(text, "\n", -1), _zeros(EXACT), lambda a, j, line: a + F.xxhash64(j, line).bitwiseAND(F.lit(MASK)))
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(1))
    return F.concat(lines, _counted(F.transform(pieces, lambda p: F.xxhash64(p))))


def _let(value: Column, then) -> Column:
    """`then(value)`, with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _counted(hashes: Column) -> Column:
    """The counters of the low 60 bits of the hashes, and the number of hashes.

    Bits are tallied in blocks in narrow counters, ten additions a hash, and the blocks are added up in the wide ones.
    Counter i of word j counts bit j + WORDS * i.
    """
    def tallies(block: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(TALLIES - 1)), lambda j: F.aggregate(
            block, F.lit(0).cast("long"), lambda a, h: a + _right(h, j).bitwiseAND(F.lit(TALLY_SPREAD))))

    def blocks(held: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor(F.size(held) / F.lit(BLOCK)).cast("int"))
        return F.transform(at, lambda i: F.slice(held, i * BLOCK + 1, F.lit(BLOCK)))

    def tally(words: Column, bit: int) -> Column:
        word = F.get(words, F.lit(bit % TALLIES))
        return F.shiftright(word, bit // TALLIES * TALLY_BITS).bitwiseAND(F.lit((1 << TALLY_BITS) - 1))

    def widened(words: Column) -> Column:
        out = []
        for j in range(WORDS):
            counters = [F.shiftleft(tally(words, j + WORDS * i), i * COUNTER_BITS) for i in range(PER_WORD)]
            out.append(sum(counters[1:], counters[0]))
        return F.array(*out)

    def lanes(held: Column) -> Column:
        wide = F.transform(F.transform(blocks(held), tallies), widened)
        return F.concat(_summed_words(wide), F.array(F.size(held).cast("long")))

    return _let(hashes, lanes)


def _summed_words(rows: Column) -> Column:
    """Sum of arrays of WORDS words, modulo 2^60."""
    return F.aggregate(rows, _zeros(WORDS), lambda acc, x: F.zip_with(acc, x, lambda a, b: (a + b).bitwiseAND(F.lit(MASK))))


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """Fingerprint of all paragraphs of both texts (sign 1), or of `left` without those of `right` (sign -1)."""
    return F.zip_with(left, right, lambda a, b: (a + F.lit(sign) * b).bitwiseAND(F.lit(MASK)))


def as_hex(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.lower(F.lpad(F.hex(w), BITS // 4, "0"))), "")


def likeness(left: Column, right: Column) -> Column:
    """0 to 1: estimated Tanimoto likeness of the two multisets of pieces; 1 for equal fingerprints.

    A counter c among n pieces stands for the projection 2c - n. Products of projections estimate inner products with a
    relative error of about 1 / sqrt(LANES).
    """
    low = F.lit((1 << COUNTER_BITS) - 1)

    def projected(words: Column) -> Column:
        counters = F.flatten(F.transform(F.slice(words, EXACT + 1, WORDS), lambda w: F.array(
            *[F.shiftright(w, i * COUNTER_BITS).bitwiseAND(low) for i in range(PER_WORD)])))
        pieces = F.element_at(words, -1).cast("double")
        return F.transform(counters, lambda c: 2 * c.cast("double") - pieces)

    def sums(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: F.struct((a * b).alias("xy"), (a * a + b * b).alias("sq"))),
                           F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("sq")),
                           lambda acc, v: F.struct((acc["xy"] + v["xy"]).alias("xy"), (acc["sq"] + v["sq"]).alias("sq")))

    ratio = F.element_at(F.transform(F.array(sums(projected(left), projected(right))), lambda s: F.when(
        s["sq"] - s["xy"] > 0, s["xy"] / (s["sq"] - s["xy"])).otherwise(F.lit(0.0))), 1)
    return F.when(left == right, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))


def next_ids(ids: DataFrame) -> DataFrame:
    """(key, next_key) for distinct keys: the following key, and the first after the last.

    Keys are dealt out by range; inside a range a window finds the next one, and the first key of the following range,
    one row per range, serves the last.
    """
    spark = ids.sparkSession
    count = ids.count()
    ranges = max(1, min(4096, count // 4096))
    ranged = cut(ids.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()))
    heads = ranged.groupBy("range").agg(F.min("key").alias("head"))
    every = Window.orderBy("range")  # one row per range
    first = F.min("head").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("range", F.coalesce(F.lead("head").over(every), first).alias("following"))
    inside = Window.partitionBy("range").orderBy("key")
    return ranged.join(F.broadcast(heads), "range").select(
        "key", F.coalesce(F.lead("key").over(inside), "following").alias("next_key"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every row, its edited text and the following document, compared by fingerprint.

    `docs(doc_id, text, ...)`; other columns are not read. The edited text replaces the last quarter of the code points by
    the first as many of the next document, which is the one with the next larger doc_id (after the last: the first); a null
    id comes before all others. Rows that share an id all have the same next document, and the one whose text has the
    smallest hash lends its text to those before them. A single id follows itself.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    salt = lambda hashed: F.pmod(hashed, F.lit(SALTS)).alias("salt")
    hashed = F.xxhash64(whole("text"))
    ids = docs.select(key.alias("key"), hashed.alias("print"), F.length(whole("text")).alias("n")).groupBy("key").agg(
        F.min("print").alias("print"), F.max("n").alias("most"))
    links = next_ids(ids.select("key")).join(ids.select("key", "most"), "key").join(
        ids.select(F.col("key").alias("next_key"), F.col("print").alias("next_print")), "next_key")
    # One exchange of the texts serves the rows and, as the next ones, their predecessors; an id with many rows is dealt out.
    rows = docs.select(key.alias("key"), salt(hashed), "doc_id", whole("text").alias("text")).withColumn(
        "fp", fingerprint(F.col("text"))).repartition("key", "salt")
    giver = rows.select(F.col("key").alias("next_key"), "salt", F.col("doc_id").alias("next_doc_id"),
                        F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
    wanted = links.withColumn("salt", salt(F.col("next_print")))
    # An equality of both hashes would become a key of the join, for which all texts would be shuffled once more.
    same = F.xxhash64("next_text").bitwiseXOR(F.col("next_print")) == 0
    lent = giver.join(wanted, ["next_key", "salt"]).filter(same).select(
        "key", "next_doc_id", "next_fp", F.expr("substring(next_text, 1, cast(most div 4 as int))").alias("lent"))
    lent = lent.groupBy("key").agg(F.min(F.struct("next_doc_id", "next_fp", "lent")).alias("next"))
    asked = docs.select(key.alias("key"), salt(hashed)).distinct()
    work = rows.join(asked.join(lent, "key"), ["key", "salt"]).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), substring(next.lent, 1, cast(n_chars div 4 as int)))")
    work = work.withColumn("edited", edited).withColumn("edited_fp", fingerprint(F.col("edited")))
    return work.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
                       likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                       likeness(F.col("fp"), F.col("next.next_fp")).alias("near_next"), F.col("next.next_doc_id").alias("next_doc_id"))


def op2_fingerprints(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents"))
