"""Tables in texts (pages of 4 lines, enumerations as rows) and page geometry (order lines as boxes, orders as text lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreview.operators import layout as L
from docreview.operators import tables as B
from docreview.plans.registry import plan

S = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
TABULAR = "replace(replace(text, ', ', ' | '), ' of ', '  ')"
ROWS = f"""
  ln AS (SELECT doc_id, (pos - 1) // 4 AS page, (pos - 1)::BIGINT AS line_no, line FROM
    (SELECT doc_id, unnest(str_split({TABULAR}, chr(10))) AS line, generate_subscripts(str_split({TABULAR}, chr(10)), 1) AS pos FROM documents)),
  rw AS (SELECT doc_id, page, line_no, line, CASE WHEN len(c) >= 2 THEN c ELSE [] END AS cells, len(c) >= 2 AS is_row FROM
    (SELECT *, list_filter(list_transform(CASE WHEN contains(line, '|') THEN str_split({S.format('line')}, '|')
      ELSE regexp_split_to_array({S.format('line')}, '[ \\t\\x{{3000}}]{{2,}}|\\t+') END, lambda x: {S.format('x')}), lambda x: x <> '') AS c FROM ln))"""
BLOCKS = f"""{ROWS},
  s1 AS (SELECT *, (is_row AND NOT coalesce(lag(is_row) OVER w, false))::INTEGER AS st,
     last_value(CASE WHEN {S.format('line')} <> '' THEN {{'t': {S.format('line')}, 'r': is_row}} END IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
     FROM rw WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)),
  s2 AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS run FROM s1),
  fr AS (SELECT doc_id, page, run, len(cells) AS v, count(*) AS f, min(line_no) AS fl FROM s2 WHERE is_row GROUP BY ALL),
  md AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, run ORDER BY f DESC, fl) AS rn FROM fr) WHERE rn = 1),
  rn AS (SELECT doc_id, page, run, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_rows, list(cells ORDER BY line_no) AS rows,
     arg_min(above, line_no) AS above FROM s2 WHERE is_row GROUP BY ALL),
  bl AS (SELECT rn.*, v AS n_cols, f / n_rows AS cons FROM rn JOIN md USING (doc_id, page, run) WHERE n_rows >= 2 AND v >= 2 AND f / n_rows >= 0.6),
  tx AS (SELECT s2.doc_id, s2.page, min(line_no) AS ft, max(line_no) AS lt FROM s2 LEFT JOIN bl ON bl.doc_id = s2.doc_id AND bl.page = s2.page AND bl.run = s2.run
     WHERE {S.format('line')} <> '' AND NOT (is_row AND bl.run IS NOT NULL) GROUP BY ALL),
  block AS (SELECT bl.doc_id, bl.page, row_number() OVER (PARTITION BY bl.doc_id, bl.page ORDER BY first_line) AS block_no, first_line, last_line, n_rows,
     n_cols, round(cons + 1e-9, 4) AS consistency, CASE WHEN above.r = false THEN above.t ELSE '' END AS title, rows,
     coalesce(ft < first_line, false) AS text_before, coalesce(lt > last_line, false) AS text_after,
     row_number() OVER (PARTITION BY bl.doc_id, bl.page ORDER BY first_line DESC) = 1 AS is_last, len(rows[-1]) < n_cols AS truncated
     FROM bl LEFT JOIN tx ON tx.doc_id = bl.doc_id AND tx.page = bl.page)"""
NORM = "list_distinct(list_transform({}, lambda x: regexp_replace(x, '\\s+', '', 'g')))"
LINKS = f"""{BLOCKS},
  pr AS (SELECT b.doc_id, b.page, a.n_cols AS ac, b.n_cols AS bc, a.truncated AS tr, {NORM.format('a.rows[1]')} AS ha, {NORM.format('b.rows[1]')} AS hb
     FROM block a JOIN block b ON a.doc_id = b.doc_id AND b.page = a.page + 1 WHERE a.is_last AND NOT a.text_after AND b.block_no = 1 AND NOT b.text_before),
  lk AS (SELECT doc_id, page, len(list_intersect(ha, hb)) / len(list_distinct(list_concat(ha, hb))) AS j, ac, bc, tr FROM pr),
  link AS (SELECT doc_id, page, round(CASE WHEN j >= 0.6 THEN 0.5 ELSE 0 END + CASE WHEN ac = bc THEN 0.25 WHEN abs(ac - bc) = 1 THEN 0.05 ELSE -0.35 END
     + CASE WHEN tr THEN 0.3 ELSE 0 END, 4)::DOUBLE AS score, j >= 0.6 AS header_repeat, round(j + 1e-9, 4) AS header_similarity FROM lk)"""
MERGED = f"""{LINKS},
  cn AS (SELECT b.*, l.page IS NOT NULL AS joined, CASE WHEN coalesce(header_repeat, false) THEN list_slice(rows, 2, len(rows)) ELSE rows END AS used,
     sum((l.page IS NULL)::INTEGER) OVER (PARTITION BY b.doc_id ORDER BY b.page, b.block_no) AS chain
     FROM block b LEFT JOIN (SELECT * FROM link WHERE score >= 0.25) l ON l.doc_id = b.doc_id AND l.page = b.page AND b.block_no = 1),
  ch AS (SELECT doc_id, chain, arg_min(page, (page, block_no)) AS root_page, arg_min(first_line, (page, block_no)) AS root_line, count(*) AS n_pages,
     flatten(list(used ORDER BY page, block_no)) AS rows FROM cn GROUP BY ALL),
  wd AS (SELECT *, greatest(2, list_max(list_transform(rows, lambda r: len(r)))) AS wide FROM ch),
  mg AS (SELECT doc_id, root_page, root_line, n_pages, wide, unnest(rows) AS cells, generate_subscripts(rows, 1) - 1 AS row_no FROM wd)"""


def _rows(t) -> DataFrame:
    text = F.replace(F.replace("text", F.lit(", "), F.lit(" | ")), F.lit(" of "), F.lit("  "))
    return B.split_rows(B.page_lines(t.documents.select("doc_id", text.alias("text")), 4))


@plan("b01_split_rows", f"WITH {ROWS} SELECT doc_id, page, line_no, array_to_string(cells, '/') AS cells, is_row FROM rw")
def _(t):
    return _rows(t).select("doc_id", "page", "line_no", F.array_join("cells", "/").alias("cells"), "is_row")


SHOWN = ["doc_id", "page", "block_no", "first_line", "last_line", "n_rows", "n_cols", "consistency", "title", "text_before",
         "text_after", "is_last", "truncated"]


@plan("b02_detect_table_blocks", f"WITH {BLOCKS} SELECT {', '.join(SHOWN)} FROM block")
def _(t):
    return B.detect_table_blocks(_rows(t)).select(*SHOWN)


@plan("b02_table_pages", f"WITH {ROWS} SELECT doc_id, page, bool_or(is_row) AS has_row FROM rw GROUP BY ALL")
def _(t):
    return B.table_pages(_rows(t))


@plan("b03_score_table_continuation", f"WITH {LINKS} SELECT * FROM link")
def _(t):
    return B.score_table_continuation(B.detect_table_blocks(_rows(t)), titles=False)


def _pairs_sql(c: str) -> str:
    return f"list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)))"


TITLED = LINKS.replace("pr AS (SELECT b.doc_id,", f"""pr AS (SELECT CASE WHEN a.title <> '' AND b.title <> '' THEN CASE WHEN
     2 * len(list_intersect({_pairs_sql('a.title')}, {_pairs_sql('b.title')})) / greatest(1, len({_pairs_sql('a.title')}) + len({_pairs_sql('b.title')})) >= 0.6
     THEN 0.15 ELSE -0.25 END ELSE 0 END AS ti, b.doc_id,""").replace("AS j, ac, bc, tr FROM pr", "AS j, ac, bc, tr, ti FROM pr").replace(
    "+ CASE WHEN tr THEN 0.3 ELSE 0 END, 4)", "+ CASE WHEN tr THEN 0.3 ELSE 0 END + ti + 1e-9, 4)")


@plan("b03_score_with_titles", f"WITH {TITLED} SELECT * FROM link")
def _(t):
    return B.score_table_continuation(B.detect_table_blocks(_rows(t)))


def _merged(t):
    rows = _rows(t)
    blocks = B.detect_table_blocks(rows)
    return rows, blocks, B.merge_table_chains(blocks, B.score_table_continuation(blocks, titles=False), 0.25)


@plan("b04_merge_table_chains", f"""WITH {MERGED} SELECT doc_id, root_page, root_line, row_no::BIGINT AS row_no, n_pages,
  array_to_string(CASE WHEN n_pages > 1 THEN list_resize(cells, greatest(wide, len(cells)), '') ELSE cells END, ' | ') AS cells FROM mg""")
def _(t):
    return _merged(t)[2].withColumn("cells", F.array_join("cells", " | "))


@plan("b04_merged_page_lines", f"""WITH {MERGED}
SELECT doc_id, root_page AS page, root_line AS line_no, row_no::BIGINT AS row_no, array_to_string(CASE WHEN n_pages > 1
  THEN list_resize(cells, greatest(wide, len(cells)), '') ELSE cells END, ' | ') AS line FROM mg UNION ALL
SELECT doc_id, page, line_no, 0, line FROM rw WHERE NOT EXISTS (SELECT 1 FROM block b WHERE b.doc_id = rw.doc_id AND b.page = rw.page
  AND rw.line_no BETWEEN b.first_line AND b.last_line)""")
def _(t):
    return B.merged_page_lines(*_merged(t))


WIDTH = 620.0
BOXES = f"""(SELECT l_orderkey AS doc_id, l_suppkey AS page, l_orderkey * 10 + l_linenumber AS block_id, (l_quantity - 1) * 10 AS x0,
  (l_quantity - 1) * 10 + 60 + l_discount * 500 AS x1, l_extendedprice AS y0 FROM lineitem)""".replace("l_suppkey AS page", "0 AS page")


def _boxes(t) -> DataFrame:
    x0 = (F.col("l_quantity") - 1) * 10
    return t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"),
                             (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("block_id"), x0.alias("x0"),
                             (x0 + 60 + F.col("l_discount") * 500).alias("x1"), F.col("l_extendedprice").alias("y0"),
                             F.lit(WIDTH).alias("page_width"))


ONE_CUT = f"""
  bx AS (SELECT * REPLACE (least({WIDTH}, x1) AS x1) FROM {BOXES}),
  rm AS (SELECT doc_id, x0 AS e, coalesce(max(x1) OVER (PARTITION BY doc_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM bx UNION ALL
     SELECT doc_id, {WIDTH}, max(x1) FROM bx GROUP BY doc_id),
  gp AS (SELECT doc_id, s, e, (s + e) / 2 AS mid, e - s AS w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, s) AS rn FROM rm) WHERE rn = 1),
  cl AS (SELECT doc_id, any_value(mid) AS mid, count(*) >= 2 AND any_value(w) / {WIDTH} >= 0.08 AND count(*) FILTER ((b.x0 + b.x1) / 2 <= mid) > 0
     AND count(*) FILTER ((b.x0 + b.x1) / 2 > mid) > 0 AND any_value(mid) >= 0.1 * {WIDTH} AND {WIDTH} - any_value(mid) >= 0.1 * {WIDTH} AS two
     FROM (SELECT doc_id, x0, x1 FROM {BOXES}) b JOIN gp USING (doc_id) GROUP BY doc_id),
  co AS (SELECT doc_id, 0 AS page, 0::BIGINT AS column_no, 0.0::DOUBLE AS lo, CASE WHEN two THEN mid ELSE {WIDTH} END AS hi FROM cl UNION ALL
     SELECT doc_id, 0, 1, mid, {WIDTH} FROM cl WHERE two)"""


@plan("b05_detect_columns_one_cut", f"WITH {ONE_CUT} SELECT doc_id, page, column_no, round(lo, 4) AS lo, round(hi, 4)::DOUBLE AS hi FROM co")
def _(t):
    return L.detect_columns(_boxes(t), 2).select("doc_id", "page", F.posexplode("columns").alias("i", "c")).select(
        "doc_id", "page", F.col("i").cast("long").alias("column_no"), F.round("c.lo", 4).alias("lo"), F.round("c.hi", 4).alias("hi"))


def _level_sql(k: int) -> str:
    """Halves the spans of level k - 1; a node's halves are 2n and 2n + 1."""
    span = "PARTITION BY doc_id, node"
    return f"""
  a{k} AS (SELECT *, greatest(lo, x0) AS l, least(hi, x1) AS r FROM n{k - 1}),
  b{k} AS (SELECT *, greatest(lo, coalesce(max(r) OVER ({span} ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)) AS s,
     greatest(lo, max(r) OVER ({span})) AS z FROM a{k}),
  c{k} AS (SELECT doc_id, node, arg_max((s + e) / 2, (w, -s)) AS mid, max(w) AS w FROM (SELECT doc_id, node, s, l AS e, l - s AS w FROM b{k} UNION ALL
     SELECT doc_id, node, z, hi, hi - z FROM b{k}) GROUP BY doc_id, node),
  d{k} AS (SELECT b{k}.*, mid, ((x0 + x1) / 2 > mid)::INTEGER AS far, w / (hi - lo) >= 0.08 AS wide FROM b{k} JOIN c{k} USING (doc_id, node)),
  e{k} AS (SELECT *, wide AND sum(far) OVER ({span}) BETWEEN 1 AND count(*) OVER ({span}) - 1 AS cut FROM d{k}),
  n{k} AS (SELECT doc_id, x0, x1, CASE WHEN cut THEN 2 * node + far ELSE node END AS node, CASE WHEN cut AND far = 1 THEN mid ELSE lo END AS lo,
     CASE WHEN cut AND far = 0 THEN mid ELSE hi END AS hi FROM e{k})"""


def _fold_sql(k: int) -> str:
    """Columns of the parents of level k; v{k - 1} from v{k}."""
    first, last = 2 ** k, 2 ** (k + 1)
    return f"""
  u{k} AS (SELECT doc_id, node // 2 AS node, min(lo) AS lo, max(hi) AS hi, flatten(list(cols ORDER BY lo)) AS cols FROM v{k} WHERE node >= {first} AND node < {last} GROUP BY ALL),
  w{k} AS (SELECT *, list_filter(cols, lambda c: c.hi - c.lo >= 0.1 * (hi - lo)) AS kept FROM u{k}),
  v{k - 1} AS (SELECT doc_id, node, lo, hi, CASE WHEN len(kept) > 1 THEN kept ELSE [{{'lo': lo, 'hi': hi}}] END AS cols FROM w{k} UNION ALL
     SELECT doc_id, node, lo, hi, cols FROM v{k} WHERE node < {first})"""


FOUR_COLUMNS = f"""
  n0 AS (SELECT doc_id, x0, x1, 1 AS node, 0.0::DOUBLE AS lo, {WIDTH}::DOUBLE AS hi FROM {BOXES}),{_level_sql(1)},{_level_sql(2)},{_level_sql(3)},
  v3 AS (SELECT DISTINCT doc_id, node, lo, hi, [{{'lo': lo, 'hi': hi}}] AS cols FROM n3),{_fold_sql(3)},{_fold_sql(2)},{_fold_sql(1)}"""


@plan("b05_detect_columns", f"""WITH {FOUR_COLUMNS} SELECT doc_id, 0 AS page, (i - 1)::BIGINT AS column_no, round(c.lo, 4) AS lo, round(c.hi, 4) AS hi
FROM (SELECT doc_id, unnest(cols) AS c, generate_subscripts(cols, 1) AS i FROM v0)""")
def _(t):
    return L.detect_columns(_boxes(t)).select("doc_id", "page", F.posexplode("columns").alias("i", "c")).select(
        "doc_id", "page", F.col("i").cast("long").alias("column_no"), F.round("c.lo", 4).alias("lo"), F.round("c.hi", 4).alias("hi"))


@plan("b06_reorder_by_columns", f"""WITH {ONE_CUT},
  ps AS (SELECT b.doc_id, b.page, b.block_id, b.x0, b.y0, arg_min(co.column_no, (NOT ((b.x0 + b.x1) / 2 BETWEEN lo AND hi),
     CASE WHEN (b.x0 + b.x1) / 2 BETWEEN lo AND hi THEN 0 ELSE abs((lo + hi) / 2 - (b.x0 + b.x1) / 2) END, co.column_no)) AS column_no
     FROM {BOXES} b JOIN co USING (doc_id, page) GROUP BY ALL)
SELECT doc_id, page, block_id, column_no, row_number() OVER (PARTITION BY doc_id, page ORDER BY column_no, y0, x0, block_id) AS position FROM ps""")
def _(t):
    boxes = _boxes(t)
    return L.reorder_by_columns(boxes, L.detect_columns(boxes, 2)).select("doc_id", "page", "block_id", "column_no", "position")


WORDS = """(SELECT o_custkey AS doc_id, 0 AS page, 1 AS block_num, 1 AS par_num, o_orderkey AS line_num, l_returnflag AS text, (l_quantity - 1) * 10 AS x0,
  (l_quantity - 1) * 10 + 40 AS x1, date_diff('day', DATE '1990-01-01', o_orderdate) * 2.0 AS y0, date_diff('day', DATE '1990-01-01', o_orderdate) * 2.0 + 12 AS y1
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
REGIONS = f"""
  w AS (SELECT *, lead(x0) OVER (PARTITION BY doc_id, line_num ORDER BY x0, x1) - x1 AS gap FROM {WORDS}),
  l AS (SELECT doc_id, page, line_num, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(gap) AS gap FROM w GROUP BY ALL),
  i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, line_num) AS i FROM l),
  m AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 2, true)::INTEGER AS st FROM i WHERE gap >= 18),
  r AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
  region AS (SELECT doc_id, page, min(x0) AS x0, min(y0)::DOUBLE AS y0, max(x1) AS x1, max(y1)::DOUBLE AS y1, count(*) AS n_rows FROM r
     GROUP BY doc_id, page, run HAVING count(*) >= 3)"""


def _regions(t) -> DataFrame:
    top = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")) * F.lit(2.0)
    words = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"),
        F.col("o_orderkey").alias("line_num"), F.col("l_returnflag").alias("text"), ((F.col("l_quantity") - 1) * 10).alias("left"),
        top.alias("top"), F.lit(40.0).alias("width"), F.lit(12.0).alias("height"), F.lit(600.0).alias("page_width"),
        F.lit(10000.0).alias("page_height"))
    return L.regions_from_words(words)


@plan("b07_regions_from_words", f"WITH {REGIONS} SELECT * FROM region")
def _(t):
    return _regions(t).drop("page_width", "page_height")


@plan("b08_attach_regions", f"""WITH {REGIONS}, {BLOCKS},
  k AS (SELECT doc_id, page, x0, y0, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, x1) AS block_no FROM region)
SELECT b.doc_id, b.page, b.block_no, k.x0, k.y0 FROM block b LEFT JOIN k ON k.doc_id = b.doc_id AND k.page = b.page AND k.block_no = b.block_no""")
def _(t):
    return B.attach_regions(B.detect_table_blocks(_rows(t)), _regions(t).withColumn("page", F.col("page").cast("long"))).select(
        "doc_id", "page", "block_no", "x0", "y0")
