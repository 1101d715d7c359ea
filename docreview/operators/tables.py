"""Tables inside page texts: rows, blocks, and tables that continue on the next page.

Windows run inside one page, or over the blocks of one document, which are as many as its text holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreview.functions.scalars import half_up, strip

# Limits of a table block and the weights of the continuation signals.
MIN_ROWS, MIN_COLS, MIN_CONSISTENCY = 2, 2, 0.6
THRESHOLD = 0.55
GAP = "[ \\t　]{2,}|\\t+"


def page_lines(docs: DataFrame, per_page: int = 20, text: str = "text") -> DataFrame:
    """Lines of long texts with a page number: (doc_id, page, line_no, line)."""
    return docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).select(
        "doc_id", F.floor(F.col("pos") / per_page).cast("long").alias("page"), F.col("pos").cast("long").alias("line_no"), "line")


def split_rows(lines: DataFrame) -> DataFrame:
    """Adds `cells` (by pipe, else by wide blanks or tabs) and `is_row` (two cells or more)."""
    body = strip(F.col("line"))
    raw = F.when(F.contains(F.col("line"), F.lit("|")), F.split(body, r"\|")).otherwise(F.split(body, GAP))
    cells = F.filter(F.transform(raw, lambda c: strip(c)), lambda c: c != "")
    return lines.withColumn("cells", cells).withColumn("is_row", F.size("cells") >= MIN_COLS).withColumn(
        "cells", F.when(F.col("is_row"), F.col("cells")).otherwise(F.array().cast("array<string>")))


def _modal(sizes: Column) -> Column:
    """struct(freq, -first index, value) of the most frequent size; the first seen wins ties."""
    return F.array_max(F.transform(F.array_distinct(sizes), lambda v: F.struct(
        F.size(F.filter(sizes, lambda x: x == v)).alias("freq"), (-F.array_position(sizes, v)).alias("late"), v.alias("value"))))


def detect_table_blocks(rows: DataFrame) -> DataFrame:
    """Maximal runs of row lines that form a table, one row per block, numbered inside the page.

    Carries the rows, the title (the nearest non-blank line above, unless it is a row), the modal number of columns,
    the filled cells of the last row, and whether text follows or precedes on the page.
    """
    page = ["doc_id", "page"]
    order = Window.partitionBy(*page).orderBy("line_no")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    line = strip(F.col("line"))
    work = rows.withColumn("_start", (F.col("is_row") & ~F.coalesce(F.lag("is_row").over(order), F.lit(False))).cast("int"))
    work = work.withColumn("_run", F.sum("_start").over(order)).withColumn("_above", F.last(
        F.when(line != "", F.struct(line.alias("t"), F.col("is_row").alias("r"))), ignorenulls=True).over(above))
    runs = work.filter("is_row").groupBy(*page, "_run").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "cells"))).alias("_l"),
        F.min_by("_above", "line_no").alias("_above"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    sizes = F.transform("_l", lambda x: F.size(x["cells"]))
    runs = runs.withColumn("_m", _modal(sizes)).withColumn("rows", F.col("_l.cells")).withColumn("n_rows", F.size("rows"))
    blocks = runs.filter((F.col("n_rows") >= MIN_ROWS) & (F.col("_m.value") >= MIN_COLS)
                         & (F.col("_m.freq") / F.col("n_rows") >= MIN_CONSISTENCY)).select(
        *page, "_run", "first_line", "last_line", F.col("n_rows").cast("long").alias("n_rows"),
        F.col("_m.value").cast("long").alias("n_cols"), half_up(F.col("_m.freq") / F.col("n_rows")).alias("consistency"),
        F.when(F.col("_above.r") == F.lit(False), F.col("_above.t")).otherwise("").alias("title"), "rows")
    # Lines of runs that are no table count as text.
    text = work.filter(line != "").join(blocks.select(*page, "_run", F.lit(True).alias("_in")), [*page, "_run"], "left").filter(
        ~(F.col("is_row") & F.coalesce("_in", F.lit(False)))).groupBy(*page).agg(
        F.min("line_no").alias("_first_text"), F.max("line_no").alias("_last_text"))
    number = Window.partitionBy(*page).orderBy("first_line")
    last_of_page = Window.partitionBy(*page)
    return blocks.join(text, page, "left").withColumn(
        "text_before", F.coalesce(F.col("_first_text") < F.col("first_line"), F.lit(False))).withColumn(
        "text_after", F.coalesce(F.col("_last_text") > F.col("last_line"), F.lit(False))).withColumn(
        "block_no", F.row_number().over(number).cast("long")).withColumn(
        "is_last", F.col("block_no") == F.count("*").over(last_of_page)).withColumn(
        "truncated", F.size(F.element_at("rows", -1)) < F.col("n_cols")).drop("_run", "_first_text", "_last_text")


def table_pages(rows: DataFrame) -> DataFrame:
    """Whether a page has any row line."""
    return rows.groupBy("doc_id", "page").agg(F.bool_or("is_row").alias("has_row"))


def score_table_continuation(blocks: DataFrame, regions: bool = False, titles: bool = True) -> DataFrame:
    """Last table of a page against the first of the next: (doc_id, page, score, header_repeat), guards applied.

    With `regions` the blocks carry box columns (x0, y0, x1, y1, page_width, page_height). `titles` compares the
    titles by their shared letter pairs.
    """
    box = ["x0", "y0", "x1", "y1", "page_width", "page_height"] if regions else []
    keep = ["rows", "n_cols", "title", *box]
    upper = blocks.filter(F.col("is_last") & ~F.col("text_after")).select(
        "doc_id", (F.col("page") + 1).alias("page"), F.col("truncated").alias("truncated"), F.struct(*keep).alias("a"))
    lower = blocks.filter((F.col("block_no") == 1) & ~F.col("text_before")).select("doc_id", "page", F.struct(*keep).alias("b"))
    pair = upper.join(lower, ["doc_id", "page"])
    norm = lambda c: F.array_distinct(F.transform(c, lambda x: F.regexp_replace(x, r"\s+", "")))
    head_a, head_b = norm(F.get("a.rows", F.lit(0))), norm(F.get("b.rows", F.lit(0)))
    jaccard = F.size(F.array_intersect(head_a, head_b)) / F.size(F.array_union(head_a, head_b))
    pair = pair.withColumn("header_similarity", jaccard).withColumn("header_repeat", F.col("header_similarity") >= 0.6)
    apart = F.abs(F.col("a.n_cols") - F.col("b.n_cols"))
    score = F.when(F.col("header_repeat"), 0.5).otherwise(0.0) + F.when(apart == 0, 0.25).when(apart == 1, 0.05).otherwise(
        -0.35) + F.when(F.col("truncated"), 0.3).otherwise(0.0)
    if regions:
        both = F.col("a.x0").isNotNull() & F.col("b.x0").isNotNull()
        edge, tolerance = 0.08, 0.12
        bottom = (F.col("a.page_height") > 0) & (F.col("a.y1") >= F.col("a.page_height") * (1 - edge))
        top = (F.col("b.page_height") > 0) & (F.col("b.y0") <= F.col("b.page_height") * edge)
        slack = F.greatest(F.col("a.x1") - F.col("a.x0"), F.col("b.x1") - F.col("b.x0"), F.lit(0.0)) * tolerance
        aligned = (F.abs(F.col("a.x0") - F.col("b.x0")) <= slack) & (F.abs(F.col("a.x1") - F.col("b.x1")) <= slack)
        inside = (F.col("a.page_height") > 0) & (F.col("b.page_height") > 0) & (
            F.col("a.y1") < F.col("a.page_height") * 0.7) & (F.col("b.y0") > F.col("b.page_height") * 0.2)
        score = score + F.when(both & bottom & top, 0.2 + F.when(aligned, 0.15).otherwise(0.0)).when(
            both & inside, -0.2).otherwise(0.0)
    if titles:
        from docreview.operators.evaluation import letter_pairs, pair_similarity

        pair = pair.withColumn("_alike", pair_similarity(letter_pairs(F.col("a.title")), letter_pairs(F.col("b.title"))))
        score = score + F.when((F.col("a.title") != "") & (F.col("b.title") != ""), F.when(
            F.col("_alike") >= 0.6, 0.15).otherwise(-0.25)).otherwise(0.0)
    return pair.withColumn("score", half_up(score)).select("doc_id", "page", "score", "header_repeat",
                                                           half_up(F.col("header_similarity")).alias("header_similarity"))


def _chained(blocks: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """Blocks with their chain: a block joins the one before it where the link reaches the threshold."""
    linked = links.filter(F.col("score") >= threshold).select(
        "doc_id", "page", F.lit(1).cast("long").alias("block_no"), F.col("header_repeat").alias("_drop"))
    order = Window.partitionBy("doc_id").orderBy("page", "block_no")
    return blocks.join(linked, ["doc_id", "page", "block_no"], "left").withColumn(
        "joined", F.col("_drop").isNotNull()).withColumn("chain", F.sum((~F.col("joined")).cast("int")).over(order)).withColumn(
        "used_rows", F.when(F.coalesce("_drop", F.lit(False)), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).otherwise(
            F.col("rows"))).drop("_drop")


def merge_table_chains(blocks: DataFrame, links: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of the merged tables: (doc_id, root_page, root_line, row_no, cells), padded over pages to the widest row."""
    chains = _chained(blocks, links, threshold)
    per = chains.groupBy("doc_id", "chain").agg(
        F.min_by("page", F.struct("page", "block_no")).alias("root_page"), F.min_by("first_line", F.struct("page", "block_no")).alias("root_line"),
        F.count("*").alias("n_blocks"), F.max(F.array_max(F.transform("used_rows", lambda r: F.size(r)))).alias("widest"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page", "used_rows"))), lambda x: x["used_rows"])).alias("rows"))
    wide = F.greatest(F.coalesce("widest", F.lit(0)), F.lit(MIN_COLS))
    out = per.withColumn("wide", wide).select("doc_id", "root_page", "root_line", "n_blocks", "wide",
                                              F.posexplode("rows").alias("i", "cells"))
    padded = F.when(F.col("n_blocks") > 1, F.concat("cells", F.array_repeat(F.lit(""), F.greatest(
        F.col("wide") - F.size("cells"), F.lit(0))))).otherwise(F.col("cells"))
    return out.select("doc_id", "root_page", "root_line", F.col("i").cast("long").alias("row_no"), padded.alias("cells"),
                      F.col("n_blocks").alias("n_pages"))


def merged_page_lines(rows: DataFrame, blocks: DataFrame, merged: DataFrame) -> DataFrame:
    """Output lines of the pages: text as it was, each table at the place of its first block, rows joined by pipes."""
    spans = blocks.select("doc_id", "page", F.explode(F.sequence("first_line", "last_line")).alias("line_no"))
    text = rows.join(spans, ["doc_id", "page", "line_no"], "left_anti").select(
        "doc_id", "page", "line_no", F.lit(0).cast("long").alias("row_no"), "line")
    tables = merged.select("doc_id", F.col("root_page").alias("page"), F.col("root_line").alias("line_no"), "row_no",
                           F.array_join("cells", " | ").alias("line"))
    return text.unionByName(tables)


def attach_regions(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """The k-th region of a page belongs to its k-th table block; blocks beyond get none."""
    boxes = ["x0", "y0", "x1", "y1", "page_width", "page_height"]
    kth = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "x1")
    numbered = regions.withColumn("block_no", F.row_number().over(kth).cast("long")).select("doc_id", "page", "block_no", *boxes)
    return blocks.join(numbered, ["doc_id", "page", "block_no"], "left")
