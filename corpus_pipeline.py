"""From raw documents to a mixed, tokenised corpus: five stages over whole tables, each written and read again.

Null texts are empty throughout. Rows that share a doc_id, or have none, are rows of their own in the near-duplicate
stage, where one row of each group stays. The mixing stage repeats a document as often as the mix takes it, so that from
there on a doc_id may occur up to three times.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreview.llm import bpe, line_dedup, minhash, mixing, quality
from docreview.llm.common import WORD, shared_dir, table, whole


def quality_filter(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, trained on the labelled ones among `docs`."""
    chain = quality.fit(quality.labelled_rows(docs, table(spark, sf_dir, "labels")))
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    scored = quality.score(docs.select(others, "text"), chain, keep_text=True)
    kept = scored.filter(F.col("score") >= quality.ACCEPT if chain else F.lit(True))
    return kept.select(*[F.col("text" if c == "text" else f"row.{c}").alias(c) for c in docs.columns])


def line_filter(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has."""
    done = line_dedup.dedup_lines(docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return done.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def near_filter(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of every group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash.one_of_each(docs)


def mix_filter(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    work = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce("doc_id", F.lit(-1)).alias("row"),
                       F.array("source").alias("sources"), F.regexp_count(whole("text"), F.lit(WORD)).cast("long").alias("size"))
    mixed = mixing.mix(work).filter("copies > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")


def tokenise(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding them gives the text again, by its SHA-256."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    work = docs.select("doc_id", "lang", "source", whole("text").alias("text")).withColumn("digest", digest)
    done = bpe.round_trip(work)
    return done.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (digest == F.col("row.digest")).alias("round_trip"))


STAGES = [("quality", quality_filter), ("lines", line_filter), ("near_duplicates", near_filter), ("mixing", mix_filter),
          ("tokens", tokenise)]
ORACLE_SQL = None
"""SQL can express neither the classifier nor the mix; tests hold the stages against brute force."""


def run(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
