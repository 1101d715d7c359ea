"""Reference corpora from several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE = T.StructType([T.StructField(n, T.StringType()) for n in ("law_name", "article", "content")] + [
    T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("category", T.StringType()),
    T.StructField("source", T.StringType())])


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """JSON files that each hold a list of articles, with the file and place as `pos`."""
    return spark.read.schema(ARTICLE).option("multiLine", "true").json(path).withColumn(
        "pos", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))


def load_corpus(primary: list[DataFrame], fallback: list[DataFrame]) -> DataFrame:
    """Primary rows plus the fallback rows of names the primary lacks, one row per (law_name, article).

    Each source has `law_name`, `article`, `pos` and further columns; the first source wins, then the first position.
    The choice is an aggregate, combined before the shuffle, so copies never meet in one task.
    """
    def tagged(sources: list[DataFrame], start: int) -> DataFrame:
        return reduce(DataFrame.unionByName, [df.withColumn("src", F.lit(start + i)) for i, df in enumerate(sources)])

    main = tagged(primary, 0)
    rows = main
    if fallback:
        extra = tagged(fallback, len(primary)).join(main.select("law_name").distinct(), "law_name", "left_anti")
        rows = main.unionByName(extra.select(*main.columns))
    rest = [c for c in rows.columns if c not in ("law_name", "article")]
    return rows.groupBy("law_name", "article").agg(
        F.min_by(F.struct(*rest), F.struct("src", "pos")).alias("r")).select("law_name", "article", "r.*")
