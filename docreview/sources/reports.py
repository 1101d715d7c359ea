"""Review results as tables, JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreview.functions.scalars import ordered_text

REPORT = ("struct<contract_id:string,risk_items:array<struct<category:string,level:string,original_clause:string>>,"
          "missing_clauses:array<struct<key:string>>>")


def reports_to_predictions(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Report JSON -> (case_id, pos, category, level, clause) and (case_id, key)."""
    parsed = df.select(F.from_json(payload, REPORT).alias("r")).select("r.*")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    risks = parsed.select(F.col("contract_id").alias("case_id"), F.posexplode("risk_items").alias("i", "x")).select(
        "case_id", F.col("i").cast("long").alias("pos"), blank("x.category").alias("category"), blank("x.level").alias("level"),
        blank("x.original_clause").alias("clause"))
    keys = parsed.select(F.col("contract_id").alias("case_id"), F.explode("missing_clauses").alias("m")).select(
        "case_id", blank("m.key").alias("key"))
    return risks, keys


def review_star(analysis: DataFrame, risks: DataFrame, facts: DataFrame, gaps: DataFrame, order: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The four result tables: the notice prefixed to the summary, children numbered from 0 in their order.

    Children belong to one document's text; their number is bounded by it.
    """
    notice = F.coalesce(F.col("notice"), F.lit(""))
    head = analysis.withColumn("summary", F.when(notice != "", F.concat(F.lit("[notice] "), notice, F.lit("\n\n"), "summary")).otherwise(
        F.col("summary"))).drop("notice")
    out = {"analysis": head}
    for name, df in (("risks", risks), ("facts", facts), ("gaps", gaps)):
        place = Window.partitionBy("doc_id").orderBy(*[F.col(c) for c in order[name]])
        out[name] = df.withColumn("order", (F.row_number().over(place) - 1).cast("long"))
    return out


def write_review_star(star: dict[str, DataFrame], path: str, batch_id: int | str = 0) -> str:
    """Write all four tables below one batch folder, the marker last: readers take only batches with a marker, so a
    failed or repeated batch never shows half a review."""
    root = f"{path}/batch={batch_id}"
    for name, df in star.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    spark = next(iter(star.values())).sparkSession
    spark.range(1).write.mode("overwrite").parquet(f"{root}/complete_marker")
    return root


def read_review_star(spark, path: str, name: str, batch_id: int | str = 0) -> DataFrame:
    root = f"{path}/batch={batch_id}"
    spark.read.parquet(f"{root}/complete_marker").schema  # fails where the batch is not complete
    return spark.read.parquet(f"{root}/{name}")


def _section(df: DataFrame, line: Column, order: list[str], name: str, sep: str = "\n") -> DataFrame:
    """Lines of one section per document; as many as the document has items of the kind."""
    rows = df.select("doc_id", F.struct(F.struct(*order).alias("pos"), line.alias("text")).alias("x"))
    return rows.groupBy("doc_id").agg(ordered_text(F.collect_list("x"), sep).alias(name))


def render_reports(analysis: DataFrame, facts: DataFrame, gaps: DataFrame, risks: DataFrame, notes: DataFrame) -> DataFrame:
    """One Markdown text per document: header, fact table, gaps, ordered risks and notes."""
    dash = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "-").otherwise(F.col(c))
    cell = lambda c: F.replace(dash(c), F.lit("|"), F.lit("\\|"))
    mark = F.when(F.col("status") == "present", "stated").when(F.col("status") == "missing", "missing").when(
        F.col("status") == "contradicted", "contradicted").otherwise("open")
    fact = F.concat(F.lit("| "), F.col("key"), F.lit(" | "), mark, F.lit(" | "), cell("value"), F.lit(" | "),
                    F.substring(cell("evidence"), 1, 60), F.lit(" | "), F.format_number("confidence", 2), F.lit(" |"),
                    F.when(F.coalesce(F.col("contradiction"), F.lit("")) != "", F.concat(
                        F.lit("\n| counter phrase | | "), F.substring("contradiction", 1, 60), F.lit(" | | |"))).otherwise(""))
    gap = F.concat(F.lit("### "), F.col("label"), F.lit(" ("), F.col("level"), F.lit(")\n\n- risk: "), F.col("reason"),
                   F.lit("\n- basis: "), F.col("legal_basis"), F.lit("\n- suggested: "), F.col("suggested_text"), F.lit("\n"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("order"))
    risk = F.concat(F.lit("### "), F.col("nth").cast("string"), F.lit(". "), F.col("title"), F.lit(" ("), F.col("level"),
                    F.lit(", "), F.col("score").cast("string"), F.lit("/100)\n\n- clause: "), dash("original_clause"),
                    F.lit("\n- basis: "), dash("legal_basis"), F.lit("\n- revision: "), dash("suggested_revision"), F.lit("\n"))
    note = F.concat(F.lit("- **"), F.coalesce(F.nullif(F.col("author"), F.lit("")), F.lit("anonymous")), F.lit("**: "), F.col("comment"))
    required = F.count_if("required")
    cover = facts.groupBy("doc_id").agg(F.when(required == 0, F.lit(100)).otherwise(F.bround(
        100 * F.count_if(F.col("required") & (F.col("status") == "present")) / required, 0)).cast("long").alias("coverage"))
    out = analysis.join(cover, "doc_id", "left")
    for part in (_section(facts, fact, ["order"], "fact_lines"), _section(gaps, gap, ["order"], "gap_lines"),
                 _section(risks.withColumn("nth", place), risk, ["order"], "risk_lines"), _section(notes, note, ["created_at", "comment"], "note_lines")):
        out = out.join(part, "doc_id", "left")
    or_else = lambda c, text: F.coalesce(F.col(c), F.lit(text))
    return out.select("doc_id", F.concat_ws(
        "\n", F.lit("# Review report"), F.lit(""), F.concat(F.lit("- document: `"), F.col("doc_id").cast("string"), F.lit("`")),
        F.concat(F.lit("- score: **"), F.col("score").cast("string"), F.lit("/100** ("), F.col("level"), F.lit(")")),
        F.concat(F.lit("- coverage: **"), F.coalesce("coverage", F.lit(100)).cast("string"), F.lit("%**")), F.lit(""),
        F.concat(F.lit("> "), F.col("summary")), F.lit(""), F.lit("## 1 Facts"), F.lit(""),
        F.lit("| fact | status | value | evidence | confidence |"), F.lit("|---|---|---|---|---|"), F.col("fact_lines"), F.lit(""),
        F.lit("## 2 Gaps"), F.lit(""), or_else("gap_lines", "No required clause is missing."), F.lit(""), F.lit("## 3 Risks"), F.lit(""),
        or_else("risk_lines", "No clause risk was found."),
        F.when(F.col("note_lines").isNotNull(), F.concat(F.lit("\n## 4 Notes\n\n"), F.col("note_lines"))), F.lit("---"), F.lit("")).alias("markdown"))
