"""Column helpers shared by the operators; all stay on the JVM side."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PACK = 10_000
"""Largest rule pack inlined as literals; bigger tables must come in as DataFrames."""


def literals(values: Sequence[str]) -> Column:
    """A literal string array with a checked size."""
    if len(values) > MAX_PACK:
        raise ValueError(f"{len(values)} literals exceed the inline limit of {MAX_PACK}")
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def contained(text: Column, words: Sequence[str]) -> Column:
    """The words that occur in the text, in pack order."""
    return F.filter(literals(words), lambda w: F.contains(text, w))


def any_of(text: Column, words: Sequence[str]) -> Column:
    cond = F.lit(False)
    for word in words:
        cond = cond | F.contains(text, F.lit(word))
    return cond


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def half_up(value: Column, digits: int = 4) -> Column:
    """Round with decimal ties going up even where the double lies just below the tie."""
    return F.round(value + 1e-9, digits)


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, 0 where the whole is 0."""
    return half_up(F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole), digits)


def occurrences(text: Column, piece: Column) -> Column:
    """Non-overlapping occurrences of a literal piece."""
    return F.when(F.length(piece) > 0,
                  ((F.length(text) - F.length(F.replace(text, piece, F.lit("")))) / F.length(piece)).cast("long")
                  ).otherwise(F.lit(0).cast("long"))


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows per key. Spark cuts each partition to k rows before the shuffle (WindowGroupLimit)."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def ordered_text(parts: Column, sep: str) -> Column:
    """Join the `text` field of collected (pos, text) structs in position order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["text"]), sep)


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once: keeps big expressions small where a branch uses it repeatedly."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(value: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def exact_round(value: Column, digits: int) -> Column:
    """Round the binary value half to even, as Python's round does."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit("")).cast("double")


def numbered(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Dense position of every row of its key, also where one key holds most rows.

    `bucket` must grow with the order (a day, a level). Rows are numbered inside (key, bucket), which spreads a hot key
    over tasks, and shifted by the counts of the earlier buckets, which are few and already aggregated.
    """
    work = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = work.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).withColumn(
        "_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return work.join(counts, [*keys, "_bucket"]).withColumn(
        name, (F.row_number().over(inside) + F.col("_shift")).cast("long")).drop("_bucket", "_shift")


def lookup_number(key: Column, values: dict[str, int]) -> Column:
    """Number of a small literal map, null where the key is unknown."""
    if not values:
        return F.lit(None).cast("int")
    return F.element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), key)


def keyword_pattern(word: str) -> str:
    """ASCII keywords match whole words without regard to case, others anywhere."""
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])"
