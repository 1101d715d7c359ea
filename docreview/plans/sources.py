"""Sources and sinks: files, JSON and Markdown are built from the given tables and read back."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from docreview.packs import latin
from docreview.plans import review as PV
from docreview.plans.registry import plan
from docreview.session import checkpoint_root
from docreview.sources import blocks as SB
from docreview.sources import files as SF
from docreview.sources import html as SH
from docreview.sources import reports as SR
from docreview.sources.corpus import load_corpus
from docreview.streaming.audit import append_audit


def _scratch(t, name: str) -> str:
    return f"{checkpoint_root(t.spark)}/docreview-{name}-{uuid.uuid4().hex}"


def _gb_bytes(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.encode("gb18030"))


@plan("s01_decode_text", "SELECT doc_id, length(text) AS n_chars, md5(text) AS text_md5 FROM documents")
def _(t):
    """French texts as GB18030, Spanish ones with a mark, the others as plain UTF-8: all come back as they were."""
    raw = F.when(F.col("lang") == "fr", F.pandas_udf(_gb_bytes, BinaryType())("text")).when(F.col("lang") == "es", F.concat(
        F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return t.documents.select("doc_id", SF.decode_text(raw).alias("text")).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


DIRECTORIES = {f"src{i}": name for i, (name, _) in enumerate(latin.CATEGORY_RULES)}
PATH = "'/corpus/' || lang || '/' || source || '/' || doc_id || '.txt'"


def _paths(t) -> DataFrame:
    return t.documents.select(F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source", F.lit("/"),
                                       F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))


@plan("s02_labels_from_path", f"""
SELECT {PATH} AS path, lang AS zone, doc_id::VARCHAR AS file_id, {PV.map_sql('source', DIRECTORIES, '?')} AS category FROM documents
WHERE source IN ({', '.join(map(latin.quote, DIRECTORIES))})""")
def _(t):
    return SF.labels_from_path(_paths(t), DIRECTORIES)[0].select("path", "zone", "file_id", "category")


@plan("s02_unmapped_directories", f"""
SELECT source AS directory, count(*) AS n_files FROM documents WHERE source NOT IN ({', '.join(map(latin.quote, DIRECTORIES))}) GROUP BY 1""")
def _(t):
    return SF.labels_from_path(_paths(t), DIRECTORIES)[1]


LAWS = "(SELECT p_partkey AS pos, p_brand || ' ' || p_type AS law_name, p_name AS article, p_size, {0} AS src FROM part WHERE {1})"


@plan("s03_load_corpus", f"""
WITH m AS (SELECT * FROM {LAWS.format(0, 'p_size <= 20')} UNION ALL SELECT * FROM {LAWS.format(1, 'p_size BETWEEN 15 AND 28')}),
  x AS (SELECT * FROM {LAWS.format(2, 'p_size > 10')} WHERE law_name NOT IN (SELECT law_name FROM m)),
  a AS (SELECT *, row_number() OVER (PARTITION BY law_name, article ORDER BY src, pos) AS rn FROM (SELECT * FROM m UNION ALL SELECT * FROM x))
SELECT law_name, article, pos, p_size, src FROM a WHERE rn = 1""")
def _(t):
    laws = t.part.select(F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_brand", "p_type").alias("law_name"),
                         F.col("p_name").alias("article"), "p_size")
    return load_corpus([laws.filter("p_size <= 20"), laws.filter("p_size BETWEEN 15 AND 28")], [laws.filter("p_size > 10")])


SP = r"[\s\x{a0}\x{3000}]"


ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"),
            ("&amp;", "&"))
"""Those that occur in the test pages; the others are tested on their own."""


def _skip_sql(column: str) -> str:
    for tag in SH.SKIPPED:
        column = f"regexp_replace({column}, '(?is)<{tag}(?:\\s[^>]*)?>.*?(?:</{tag}\\s*>|$)', chr(2), 'g')"
    return column


def _entities_sql(column: str) -> str:
    for entity, char in ENTITIES:
        column = f"replace({column}, {latin.quote(entity)}, {latin.quote(char)})"
    return column


def _trim_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{SP}+|{SP}+$', '', 'g')"


TITLE = "regexp_extract(b, '(?is)<title[^>]*>(.*?)</title', 1)"


@plan("s04_html_to_text", f"""
WITH a AS (SELECT page_id, {_skip_sql("regexp_replace(html, '(?is)<!--.*?-->', chr(2), 'g')")} AS b FROM pages),
  c AS (SELECT page_id, left({_trim_sql(f"regexp_replace({_entities_sql(TITLE)}, '{SP}+', ' ', 'g')")}, 200) AS title,
    regexp_replace(regexp_replace(regexp_replace(b, '(?is)<title[^>]*>.*?</title\\s*>', chr(2), 'g'),
      '(?i)</?(?:{'|'.join(SH.BLOCKS)})(?:[\\s/][^>]*)?>', chr(1), 'g'), '<[^>]*>', chr(2), 'g') AS b FROM a),
  d AS (SELECT page_id, title, array_to_string(list_filter(list_transform(str_split(b, chr(1)), lambda p: array_to_string(list_filter(
      list_transform(str_split(p, chr(2)), lambda x: {_trim_sql(_entities_sql('x'))}), lambda x: x <> ''), ' ')), lambda p: p <> ''), chr(10)) AS text FROM c)
SELECT page_id, title, CASE WHEN title <> '' THEN title || chr(10) || chr(10) || text ELSE text END AS content FROM d""")
def _(t):
    return SH.html_to_text(t.pages).select("page_id", "title", "content")


@plan("s05_sniff_files", """
WITH k AS (SELECT doc_id, lang, source, CASE WHEN source = 'src1' THEN 'pdf' WHEN source = 'src2' THEN 'zip' WHEN source = 'src3' THEN 'png' WHEN source = 'src4' THEN 'webp'
    WHEN source = 'src5' THEN 'rtf' WHEN source = 'src6' THEN 'binary' WHEN source = 'src7' THEN 'empty' ELSE 'text' END AS real FROM documents),
  e AS (SELECT *, CASE lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'docx' WHEN 'de' THEN 'rtf' ELSE 'exe' END AS ext FROM k)
SELECT doc_id, ext, CASE WHEN real = 'empty' THEN 'binary' ELSE real END AS kind, CASE WHEN real = 'empty' THEN 'empty' WHEN ext = 'exe' THEN 'unknown_extension'
  WHEN (ext = 'pdf' AND real = 'pdf') OR (ext = 'docx' AND real = 'zip') OR (ext = 'rtf' AND real IN ('rtf', 'text')) THEN 'ok' ELSE 'mismatch' END AS verdict FROM e""")
def _(t):
    s, body = F.col("source"), F.encode("text", "UTF-8")
    start = lambda h: F.concat(F.unhex(F.lit(h)), body)
    content = F.when(s == "src1", start("255044462D312E37")).when(s == "src2", start("504B030414")).when(
        s == "src3", start("89504E470D0A1A0A")).when(s == "src4", start("524946460000000057454250")).when(
        s == "src5", start("7B5C72746631")).when(s == "src6", start("7F454C4600")).when(s == "src7", F.unhex(F.lit(""))).otherwise(body)
    lang = F.col("lang")
    ext = F.when(lang == "en", "pdf").when(lang == "fr", "docx").when(lang == "de", "rtf").otherwise("exe")
    return SF.sniff_files(t.documents.select("doc_id", ext.alias("ext"), content.alias("content"))).select("doc_id", "ext", "kind", "verdict")


@plan("s06_normalize_blocks", """
WITH l AS (SELECT doc_id, lang, source, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, pos::BIGINT AS pos, CASE lang WHEN 'en' THEN 'text' WHEN 'fr' THEN 'title' WHEN 'de' THEN 'table' ELSE 'image' END AS type,
  CASE lang WHEN 'de' THEN source || chr(10) || source || ' | ' || lang ELSE line END AS text, pos::INTEGER AS page,
  CASE WHEN lang = 'es' THEN source || '.png' END AS image_path FROM l WHERE lang IN ('de', 'es') OR line <> ''""")
def _(t):
    lang, src = F.col("lang"), F.col("source")
    item = lambda line, i: F.when(lang == "en", F.to_json(F.struct(F.lit("Paragraph").alias("type"), line.alias("content"), i.alias("page_idx")))).when(
        lang == "fr", F.to_json(F.struct(F.lit("title").alias("type"), line.alias("text"), i.alias("page_idx")))).when(
        lang == "de", F.to_json(F.struct(F.lit("table").alias("type"), F.array(src).alias("table_caption"), F.concat(
            F.lit("<table><tr><td>"), src, F.lit("</td><td>"), lang, F.lit("</td></tr><tr></tr></table>")).alias("table_body"), i.alias("page_idx")))).otherwise(
        F.to_json(F.struct(F.lit("figure").alias("type"), F.struct(line.alias("text")).alias("caption"),
                           F.concat(src, F.lit(".png")).alias("image_path"), i.alias("page_idx"))))
    items = F.concat(F.lit("["), F.array_join(F.transform(F.split("text", "\n"), item), ","), F.lit("]"))
    wrapped = F.when(lang == "en", items).when(lang == "fr", F.concat(F.lit('{"data": '), items, F.lit("}"))).otherwise(
        F.concat(F.lit('{"result": {"content_list": '), items, F.lit("}}")))
    return SB.normalize_blocks(t.documents.select("doc_id", wrapped.alias("payload")))


MARKDOWN = "replace(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), ' ti ', chr(10) || '![fig ti](img/ti.png)' || chr(10))"


def _markdown(t) -> DataFrame:
    text = F.replace(F.replace("text", F.lit(".\n"), F.lit(".\n\n")), F.lit(" ti "), F.lit("\n![fig ti](img/ti.png)\n"))
    return t.documents.select("doc_id", text.alias("text"))


@plan("s08_blocks_from_markdown", f"""
WITH l AS (SELECT doc_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line, pos FROM (SELECT doc_id, unnest(str_split({MARKDOWN}, chr(10))) AS line,
     generate_subscripts(str_split({MARKDOWN}, chr(10)), 1) AS pos FROM documents)),
  k AS (SELECT *, regexp_matches(line, '^!\\[[^\\]]*\\]\\(') AS image FROM l),
  g AS (SELECT *, sum((image OR line = '')::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM k),
  b AS (SELECT doc_id, min(pos) AS pos, CASE WHEN bool_or(image) THEN 'image' WHEN bool_or(contains(line, '|')) THEN 'table' ELSE 'text' END AS type,
     CASE WHEN bool_or(image) THEN 'fig ti' ELSE string_agg(line, chr(10) ORDER BY pos) END AS text, CASE WHEN bool_or(image) THEN 'img/ti.png' END AS image_path
     FROM g WHERE line <> '' GROUP BY doc_id, grp, image)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block_no, type, text, image_path FROM b""")
def _(t):
    return SB.blocks_from_markdown(_markdown(t))


@plan("s08_strip_image_refs", f"SELECT doc_id, md5(replace({MARKDOWN}, '![fig ti](img/ti.png)', '[image: fig ti]')) AS text_md5 FROM documents")
def _(t):
    return _markdown(t).select("doc_id", F.md5(SB.strip_image_refs(F.col("text"))).alias("text_md5"))


def _star(t) -> dict[str, DataFrame]:
    risks, _ = PV._risks(t)
    facts = PV.FX.refine_facts(PV._facts(t))
    analysis = t.documents.select("doc_id", F.col("source").alias("summary"), F.when(F.col("lang") == "es", "check").alias("notice"),
                                  F.lit(60).alias("score"), F.lit("medium").alias("level"))
    return SR.review_star(analysis, risks.withColumnRenamed("score", "score"), facts.withColumnRenamed("ord", "rule_no"),
                          PV.gaps(t).withColumnRenamed("ord", "rule_no"),
                          {"risks": ["risk_id"], "facts": ["rule_no"], "gaps": ["rule_no"]})


@plan("s11_write_review_star", f"""
WITH {PV.RISKS}, {PV.FACTS}
SELECT doc_id, CASE WHEN lang = 'es' THEN '[notice] check' || chr(10) || chr(10) || source ELSE source END AS summary,
  (SELECT count(*) FROM risk r WHERE r.doc_id = d.doc_id) AS n_risks, (SELECT count(*) - 1 FROM refined r WHERE r.doc_id = d.doc_id) AS last_fact,
  (SELECT coalesce(sum(rn - 1), 0)::BIGINT FROM (SELECT row_number() OVER () AS rn FROM gap g WHERE g.doc_id = d.doc_id)) AS gap_orders FROM documents d""")
def _(t):
    path = _scratch(t, "star")
    SR.write_review_star(_star(t), path)
    read = lambda name: SR.read_review_star(t.spark, path, name)
    risks = read("risks").groupBy("doc_id").agg(F.count("*").alias("n_risks"))
    facts = read("facts").groupBy("doc_id").agg(F.max("order").alias("last_fact"))
    gaps = read("gaps").groupBy("doc_id").agg(F.sum("order").alias("gap_orders"))
    out = read("analysis").select("doc_id", "summary")
    for part in (risks, facts, gaps):
        out = out.join(part, "doc_id", "left")
    return out.fillna(0, ["n_risks", "gap_orders"])


@plan("s12_append_audit", """
SELECT event_id AS id, event_type AS action, 'user' AS resource_type, user_id AS actor_id, (props->>'$.k')::BIGINT AS k, value FROM events""")
def _(t):
    schema = t.events.schema
    # A pattern, since a stream takes a single file by pattern only; the table may be a file or a folder of files.
    stream = t.spark.readStream.schema(schema).parquet(f"{t.root}/events.parque[t]")
    rows = stream.select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.lit("user").alias("resource_type"),
                         F.col("user_id").cast("string").alias("resource_id"), F.col("user_id").alias("actor_id"), "value",
                         F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("ts").alias("created_at"))
    path = _scratch(t, "audit")
    append_audit(rows, f"{path}/log", f"{path}/checkpoint", ["k", "value"]).awaitTermination()
    details = F.from_json("details_json", "k long, value double")
    return t.spark.read.parquet(f"{path}/log").withColumn("d", details).select("id", "action", "resource_type", "actor_id", "d.k", "d.value")


def _reports(t) -> DataFrame:
    risk = lambda cond, category, level: F.when(cond, F.struct(F.lit(category).alias("category"), F.lit(level).alias("level"),
                                                               F.concat(F.lit("clause of "), F.col("doc_id").cast("string")).alias("original_clause")))
    risks = F.filter(F.array(risk(F.col("toxic") == 1, "toxic", "high"), risk(F.col("quality") == 0, "quality", "low")), lambda x: x.isNotNull())
    keys = F.when(F.col("quality") == 0, F.array(F.struct(F.lit("author").alias("key")), F.struct(F.lit("date").alias("key")))).otherwise(
        F.array().cast("array<struct<key:string>>"))
    return t.labels.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("contract_id"), F.lit("extra").alias("ignored"),
                                              risks.alias("risk_items"), keys.alias("missing_clauses"))).alias("payload"))


@plan("s13_report_risks", """
SELECT doc_id::VARCHAR AS case_id, 0::BIGINT AS pos, 'toxic' AS category, 'high' AS level, 'clause of ' || doc_id AS clause FROM labels WHERE toxic = 1 UNION ALL
SELECT doc_id::VARCHAR, toxic::BIGINT, 'quality', 'low', 'clause of ' || doc_id FROM labels WHERE quality = 0""")
def _(t):
    return SR.reports_to_predictions(_reports(t))[0]


@plan("s13_report_keys", "SELECT doc_id::VARCHAR AS case_id, unnest(['author', 'date']) AS key FROM labels WHERE quality = 0")
def _(t):
    return SR.reports_to_predictions(_reports(t))[1]


@plan("s14_render_reports", f"""
WITH {PV.RISKS}, {PV.FACTS},
  f AS (SELECT doc_id, count(*) + count(*) FILTER (contradiction <> '') AS n FROM refined GROUP BY doc_id),
  g AS (SELECT doc_id, count(*) AS n, sum(length(reason) - length(replace(reason, chr(10), ''))) AS extra FROM gap GROUP BY doc_id),
  r AS (SELECT doc_id, count(*) AS n FROM risk GROUP BY doc_id),
  n AS (SELECT conv_id AS doc_id, count(*) AS n, sum(length(text) - length(replace(text, chr(10), ''))) AS extra FROM conversations GROUP BY 1)
SELECT doc_id, (20 + coalesce(f.n, 0) + CASE WHEN g.n IS NULL THEN 1 ELSE 6 * g.n + g.extra END + CASE WHEN r.n IS NULL THEN 1 ELSE 6 * r.n END
  + CASE WHEN n.n IS NULL THEN 0 ELSE 3 + n.n + n.extra END)::BIGINT AS n_lines FROM documents
  LEFT JOIN f USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)""")
def _(t):
    star = _star(t)
    notes = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("role").alias("author"), F.col("text").alias("comment"),
                                   F.col("turn").alias("created_at"))
    risks = star["risks"].withColumn("suggested_revision", F.lit(""))
    pages = SR.render_reports(star["analysis"].withColumn("summary", F.lit("summary")), star["facts"], star["gaps"], risks, notes)
    return pages.select("doc_id", F.size(F.split("markdown", "\n")).cast("long").alias("n_lines"))
