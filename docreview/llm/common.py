"""Helpers shared by the operators: the shared checkpoint folder, word patterns, batches of bounded size."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contracts: white space and words are ASCII classes.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20
"""Text handled at a time inside a Python task, so that its memory does not depend on the size of an Arrow batch."""


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a private one only in local mode, where the driver's folder is everybody's."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="llm-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages read files that every executor sees, whoever is lost meanwhile.

    The collection of garbage on the driver lets Spark's cleaner delete the shuffle files of stages cut off, which would
    otherwise pile up over a long chain of steps. They stay as long as anybody holds the plan that was run, so callers pass
    `df` without keeping it, and it is let go here before the collection.
    """
    context = df.sparkSession.sparkContext
    root = shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    out = df.checkpoint(eager=True)
    del df
    context._jvm.System.gc()
    return out


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sends rows to Python workers at most BATCH_ROWS at a time; a smaller number that the session has is left.

    A setting of the session, since Spark has none for one operator: with its default of 10,000 rows a batch of texts or
    shingle sets takes tens of megabytes, several times over, in the executor and in each of its workers.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def whole(text: Column | str) -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most `limit` bytes of text each, or one row where a row is larger."""
    start, held = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def lookup(left: DataFrame, right: DataFrame, key: str, spread_by: str, salts: int = 64) -> DataFrame:
    """`left` with the columns of `right`, which has one row per `key`; null where there is none.

    A key may hold a third of `left`: its rows are dealt into `salts` parts by the hash of `spread_by`, and the one row of
    `right` is repeated once per part that asks for it. No hot key meets in one task, and no pairs arise.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    asked = left.filter(F.col(key).isNotNull()).select(key, "_salt").distinct()
    return left.join(asked.join(right, key), [key, "_salt"], "left").drop("_salt")


def spotted(rows: DataFrame, key: str, wanted: DataFrame, slots: int = 1 << 24) -> DataFrame:
    """The rows with `spotted`: whether their `key` may be in `wanted(key)`. A Bloom filter of fixed size (`slots` / 8 bytes,
    broadcast) spots all members and few others, so that a join behind it need not shuffle the whole table."""
    part = slots // 2
    spots = lambda i: F.pmod(F.xxhash64(F.lit(i), key), F.lit(part)) + F.lit(i * part + 1)
    bitmaps = wanted.select(F.explode(F.array(spots(0), spots(1))).alias("slot")).groupBy(
        F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    seen = F.lit(True)
    for i in range(2):
        at = F.expr(f"bitmap_bit_position(_slot{i})")
        own = bitmaps.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bits").alias(f"_bits{i}"))
        rows = rows.withColumn(f"_slot{i}", spots(i))
        rows = rows.join(F.broadcast(own), F.expr(f"bitmap_bucket_number(_slot{i})") == F.col(f"_bucket{i}"), "left")
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{i}"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        seen = seen & (F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1)
        rows = rows.withColumn(f"_seen{i}", F.coalesce(seen, F.lit(False))).drop(f"_bucket{i}", f"_bits{i}", f"_slot{i}")
        seen = F.col(f"_seen{i}")
    return rows.withColumn("spotted", F.col("_seen1")).drop("_seen0", "_seen1")


def marked(rows: DataFrame, key: str, wanted: DataFrame, slots: int = 1 << 24) -> DataFrame:
    """The rows whose `key` may be in `wanted(key)`; see spotted()."""
    return spotted(rows, key, wanted, slots).filter("spotted").drop("spotted")
