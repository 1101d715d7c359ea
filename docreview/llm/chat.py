"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation is rendered once as the
prompt, and both remainders follow as completions whose loss mask covers what the assistant says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreview.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
"""Fixed values of the chat template; both are written with a zero-width space inside where a turn's text holds them."""
TRAINED = "assistant"


def _guarded(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(mark[:2] + "​" + mark[2:]))
    return text


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["head"], t["body"])), "")


def _numbered(turns: DataFrame, side: str) -> DataFrame:
    """One array of turns per pair and side, in order; a conversation is one output row, so it is gathered anyway."""
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("pair_id").agg(F.array_sort(F.collect_list(row)).alias(side))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """`chosen` and `rejected` hold (pair_id, turn, role, text, ...); one row per pair found on both sides.

    Columns: pair_id, n_shared (turns in the prompt), prompt, chosen, rejected (the rendered completions), and the masks
    chosen_mask, rejected_mask: array<struct<start, end>> of code point offsets in the completion that count for the loss,
    the closing mark included. Turns are equal when role and text are; null role and text are empty. Turns are ordered by
    `turn`, a null first, ties by role and text; repeated turns stay. Identical conversations give empty completions.
    A null pair_id is no pair. Other columns are not read.
    """
    pairs = _numbered(chosen.filter("pair_id IS NOT NULL"), "a").join(_numbered(rejected.filter("pair_id IS NOT NULL"), "b"), "pair_id")
    # The prefix ends at the first place where the zipped turns differ or one side ends.
    differ = F.zip_with("a", "b", lambda x, y: ~(x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])))
    pairs = pairs.withColumn("n_shared", F.coalesce(F.array_position(differ, True), F.lit(0)).cast("int"))
    pairs = pairs.withColumn("n_shared", F.when(F.col("n_shared") > 0, F.col("n_shared") - 1).otherwise(F.size("a")))

    def pieces(side: str) -> Column:
        return F.transform(side, lambda t: F.struct(
            F.concat(F.lit(OPEN), _guarded(t["role"]), F.lit("\n")).alias("head"),
            F.concat(_guarded(t["text"]), F.lit(CLOSE + "\n")).alias("body"), (t["role"] == TRAINED).alias("trained")))

    def mask(turns: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(acc, t):
            begin = acc["at"] + F.length(t["head"])
            end = begin + F.length(t["body"])
            span = F.array(F.struct(begin.alias("start"), (end - 1).alias("end")))
            return F.struct(end.alias("at"), F.when(t["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(turns, start, step, lambda acc: acc["spans"])

    pairs = pairs.withColumn("pa", pieces("a")).withColumn("pb", pieces("b"))
    rest = lambda side: F.slice(side, F.col("n_shared") + 1, F.greatest(F.size(side) - F.col("n_shared"), F.lit(0)))
    return pairs.select(
        "pair_id", F.col("n_shared").cast("long").alias("n_shared"),
        _rendered(F.slice("pa", F.lit(1), F.col("n_shared"))).alias("prompt"),
        _rendered(rest("pa")).alias("chosen"), _rendered(rest("pb")).alias("rejected"),
        mask(rest("pa")).alias("chosen_mask"), mask(rest("pb")).alias("rejected_mask"))


def with_other_reply(conversations: DataFrame) -> DataFrame:
    """Rejected sides for a table of conversations: the last turn's text is that of the following conversation's last turn.

    The last turn is the last one in the order of format_preferences(); all others stay, null and repeated turns included.
    The following conversation is the one with the next number, found by an equi join; where there is none, the reply is
    empty. Null conversation numbers give nothing.
    """
    turns = conversations.filter("conv_id IS NOT NULL").select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    last = turns.groupBy("conv_id").agg(F.max("t").alias("z"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("z.text").alias("other"))
    swapped = last.join(other, "conv_id", "left").select(
        F.col("conv_id").alias("pair_id"), "z.turn", "z.role", F.coalesce("other", F.lit("")).alias("text"))
    both = turns.join(last, "conv_id").withColumn("is_last", F.col("t").eqNullSafe(F.col("z")))
    before = both.filter("NOT is_last").select(F.col("conv_id").alias("pair_id"), "t.*")
    # Of rows equal to the last one, one is swapped.
    more = both.filter("is_last").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("z").alias("z")).filter("n > 1").select(
        F.col("conv_id").alias("pair_id"), "z.*", F.explode(F.sequence(F.lit(2).cast("long"), "n"))).drop("col")
    return before.unionByName(more).unionByName(swapped)


def op9_format_preferences(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    pairs = format_preferences(turns.withColumnRenamed("conv_id", "pair_id"), with_other_reply(turns))
    spans = lambda m: F.array_join(F.transform(m, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return pairs.select(F.col("pair_id").alias("conv_id"), "n_shared", "prompt", "chosen", "rejected",
                        spans(F.col("chosen_mask")).alias("chosen_mask"), spans(F.col("rejected_mask")).alias("rejected_mask"))


SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
             count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT * FROM t WHERE k = n),
q AS (SELECT conv_id, turn, role, text FROM t WHERE k < n
      UNION ALL SELECT z.conv_id, z.turn, z.role, coalesce(o.text, '') FROM z LEFT JOIN z o ON o.conv_id = z.conv_id + 1),
r AS (SELECT q.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM q),
s AS (SELECT t.conv_id, coalesce(min(t.k) FILTER (WHERE t.role <> r.role OR t.text <> r.text) - 1, count(*)) AS n_shared
      FROM t JOIN r ON t.conv_id = r.conv_id AND t.k = r.k GROUP BY t.conv_id),
p AS (SELECT conv_id, turn, 'a' AS side, role, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' || chr(10) AS body,
             k FROM t
      UNION ALL SELECT conv_id, turn, 'b', role, '<|im_start|>' || role || chr(10), text || '<|im_end|>' || chr(10),
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) FROM r),
c AS (SELECT p.*, s.n_shared, sum(length(head || body)) OVER (PARTITION BY p.conv_id, side ORDER BY k) AS upto
      FROM p JOIN s USING (conv_id) WHERE k > n_shared)
SELECT s.conv_id, s.n_shared,
  coalesce((SELECT string_agg(head || body, '' ORDER BY k) FROM p WHERE p.conv_id = s.conv_id AND side = 'a' AND k <= s.n_shared), '') AS prompt,
  coalesce((SELECT string_agg(head || body, '' ORDER BY k) FROM c WHERE c.conv_id = s.conv_id AND side = 'a'), '') AS chosen,
  coalesce((SELECT string_agg(head || body, '' ORDER BY k) FROM c WHERE c.conv_id = s.conv_id AND side = 'b'), '') AS rejected,
  coalesce((SELECT string_agg((upto - length(body))::VARCHAR || '-' || (upto - 1)::VARCHAR, ',' ORDER BY k) FROM c
            WHERE c.conv_id = s.conv_id AND side = 'a' AND role = 'assistant'), '') AS chosen_mask,
  coalesce((SELECT string_agg((upto - length(body))::VARCHAR || '-' || (upto - 1)::VARCHAR, ',' ORDER BY k) FROM c
            WHERE c.conv_id = s.conv_id AND side = 'b' AND role = 'assistant'), '') AS rejected_mask
FROM s
"""
