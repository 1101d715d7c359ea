"""Exact duplicates with two passes over a Bloom filter.

Pass one counts, per slot of the filter, the rows that fall into it and keeps the slots that were hit more than once: a
bitmap per 32,768 slots, built by Spark's bitmap aggregate. Pass two tests every row against the bitmaps. A row whose
slots were not all hit twice has no equal and passes straight through; only the rest is shuffled by the hash of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreview.llm.common import cut, table, whole

PROBES = 2
SLOTS_PER_ROW = 16
MAX_SLOTS = 1 << 27
"""Bound of the filter, 16 MB as bitmaps, which is what is broadcast. Above 8 million rows a fuller filter lets more
unique rows into the shuffle of (hash, id) pairs; the result stays exact."""
SALTS = 64


def _slots(digest: Column, slots: int) -> list[Column]:
    """One slot per probe, each probe in its own part of the filter; counted from 1 as the bitmap functions do."""
    part = slots // PROBES
    return [F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(part)) + F.lit(i * part + 1) for i in range(PROBES)]


def repeated_slots(digests: DataFrame, slots: int) -> DataFrame:
    """(bucket, bits): bitmaps of the slots that more than one row of `digests(digest)` falls into."""
    hits = digests.select(F.explode(F.array(*_slots(F.col("digest"), slots))).alias("slot"))
    twice = hits.groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1")
    return twice.groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))


def with_suspicion(rows: DataFrame, bitmaps: DataFrame, slots: int) -> DataFrame:
    """`rows` with `_suspect`: all slots of the row's digest are marked. The bitmaps have at most `slots` / 8 bytes."""
    suspect = F.lit(True)
    for i, slot in enumerate(_slots(F.col("digest"), slots)):
        rows = rows.withColumn(f"_slot{i}", slot)
        marks = bitmaps.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bits").alias(f"_bits{i}"))
        rows = rows.join(F.broadcast(marks), F.expr(f"bitmap_bucket_number(_slot{i})") == F.col(f"_bucket{i}"), "left")
        position = F.expr(f"bitmap_bit_position(_slot{i})")
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{i}"), (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        marked = F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(1) == 1
        suspect = suspect & F.coalesce(marked, F.lit(False))
    return rows.withColumn("_suspect", suspect)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical; a null text is empty. Of equal texts the row with the largest id stays, a null id
    counting as the smallest, and exactly one of rows that also share the id. An empty table gives no rows; other
    columns, whatever their names, are not read. Hot groups are grouped and joined in 64 salted parts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(whole(text_col).cast("binary"), 256).alias("digest"))
    total = docs.count()
    slots = min(MAX_SLOTS, max(1 << 15, 1 << (SLOTS_PER_ROW * max(1, total) - 1).bit_length()))
    bitmaps = repeated_slots(rows, slots)
    flagged = cut(with_suspicion(rows, bitmaps, slots).select("id", "digest", "_suspect")
                  .withColumn("row", F.monotonically_increasing_id()))
    unique = flagged.filter("NOT _suspect").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    suspects = flagged.filter("_suspect").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    parts = suspects.groupBy("digest", "salt").agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("n"))
    groups = parts.groupBy("digest").agg(F.max("top").alias("top"), F.sum("n").alias("group_size"),
                                         F.collect_list("salt").alias("salts"))
    groups = groups.select("digest", "top", "group_size", F.explode("salts").alias("salt"))
    repeated = suspects.join(groups, ["digest", "salt"]).select(
        "id", F.col("top.id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "digest")
    return unique.unionByName(repeated).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
