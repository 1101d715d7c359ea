"""Files as rows: text decoding, labels from directory names, and real kinds from leading bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docreview.operators.risk import lookup

# Leading bytes (hex) of the kinds told apart, in order of testing.
MAGIC: tuple[tuple[str, str], ...] = (
    ("255044462D", "pdf"), ("504B0304", "zip"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpg"), ("474946383761", "gif"),
    ("474946383961", "gif"), ("424D", "bmp"),
)
EXPECTED: dict[str, tuple[str, ...]] = {
    "pdf": ("pdf",), "docx": ("zip",), "xlsx": ("zip",), "pptx": ("zip",), "png": ("png",), "jpg": ("jpg",), "jpeg": ("jpg",),
    "gif": ("gif",), "webp": ("webp",), "bmp": ("bmp",), "txt": ("text",), "md": ("text",), "csv": ("text",),
    "html": ("text",), "htm": ("text",), "rtf": ("text", "rtf"),
}


def decode_text(content: Column) -> Column:
    """UTF-8 (with or without a mark), else the GB family, else UTF-8 with replacement characters.

    Valid UTF-8 is decoded on the JVM; only the other files travel to Python, in Arrow batches.
    """
    @F.pandas_udf("string")
    def fallback(data: pd.Series) -> pd.Series:
        def read(raw):
            if raw is None:
                return None
            try:
                return bytes(raw).decode("gb18030")
            except UnicodeDecodeError:
                return bytes(raw).decode("utf-8", errors="replace")
        return data.map(read)

    as_utf8 = content.cast("string")
    fine = F.is_valid_utf8(as_utf8)
    return F.when(fine, F.regexp_replace(as_utf8, "^\\x{feff}", "")).otherwise(fallback(F.when(~fine, content)))


def read_text_corpus(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Whole files below a folder as (path, text)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", decode_text(F.col("content")).alias("text"))


def labels_from_path(df: DataFrame, categories: dict[str, str], path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(labelled files, dropped files per unmapped directory) for paths `.../zone/category/id.ext`."""
    parts = r"([^/]+)/([^/]+)/([^/]+?)(?:\.[^./]*)?$"
    named = df.withColumn("zone", F.regexp_extract(path, parts, 1)).withColumn(
        "directory", F.regexp_extract(path, parts, 2)).withColumn("file_id", F.regexp_extract(path, parts, 3)).withColumn(
        "category", lookup(F.col("directory"), categories, None))
    dropped = named.filter("category is null").groupBy("directory").agg(F.count("*").alias("n_files"))
    return named.filter("category is not null").drop("directory"), dropped


def sniff_files(df: DataFrame, content: str = "content", ext: str = "ext") -> DataFrame:
    """Adds the real `kind` from the leading bytes and a `verdict`: ok, empty, mismatch or unknown_extension.

    Zip containers are not opened: office extensions are accepted when the file is a zip.
    """
    raw = F.col(content)
    head = lambda n: F.hex(F.substring(raw, 1, n))
    kind = F.when(F.length(raw) == 0, "binary")
    for magic, name in MAGIC:
        kind = kind.when(head(len(magic) // 2) == magic, name)
    kind = kind.when((head(4) == "52494646") & (F.hex(F.substring(raw, 9, 4)) == "57454250"), "webp").when(
        head(5) == "7B5C727466", "rtf").when(F.expr(f"contains(substring({content}, 1, 4096), X'00')"), "binary").otherwise("text")
    allowed = F.col(ext).isin(list(EXPECTED))
    fits = F.lit(False)
    for name, kinds in EXPECTED.items():
        fits = fits | ((F.col(ext) == name) & F.col("kind").isin(list(kinds)))
    return df.withColumn("kind", kind).withColumn("verdict", F.when(F.length(raw) == 0, "empty").when(
        ~allowed, "unknown_extension").when(fits, "ok").otherwise("mismatch"))
