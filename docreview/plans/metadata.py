"""Metadata, validity and corpus maintenance on rows derived from parts, orders, nations and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreview.operators import metadata as M
from docreview.packs import fixed
from docreview.plans.registry import plan

KEYWORDS = (("#25", {"effective_from": "2020-01-01"}), ("Brand#1", {"effective_from": "2014-03-01", "note": "series"}))
DEFAULT = {"effective_from": "1995-01-01", "effective_until": "", "region": "national", "version": "baseline-1.0",
           "source_url": "generic", "checked_at": "", "note": "baseline"}


@plan("m01_attach_metadata", """
WITH base AS (SELECT 'Brand#' || n_nationkey AS law_name, '20' || lpad(n_nationkey::VARCHAR, 2, '0') || '-01-01' AS effective_from,
    'REGION_' || n_regionkey AS region FROM nation WHERE n_nationkey <> 12),
 ovr AS (SELECT 'Brand#' || r_regionkey AS key, 'v' || r_regionkey AS version, NULL AS note FROM region UNION ALL
         SELECT 'Brand#' || (r_regionkey + 2) || '@NORTH', 'north-' || r_regionkey, 'local' FROM region),
 own AS (SELECT p_partkey, p_brand AS law_name, CASE WHEN p_size >= 40 THEN 'own-' || p_size END AS version FROM part),
 j AS (SELECT own.p_partkey, own.law_name, own.version AS own_version, base.law_name AS b, base.effective_from AS bf,
     base.region AS br, coalesce(l.key, p.key) AS k,
     CASE WHEN l.key IS NOT NULL THEN l.version ELSE p.version END AS ov,
     CASE WHEN l.key IS NOT NULL THEN l.note ELSE p.note END AS onote
   FROM own LEFT JOIN base USING (law_name) LEFT JOIN ovr p ON p.key = own.law_name
   LEFT JOIN ovr l ON l.key = own.law_name || '@NORTH')
SELECT p_partkey, law_name,
  CASE WHEN b IS NOT NULL THEN bf WHEN contains(law_name, '#25') THEN '2020-01-01' WHEN contains(law_name, 'Brand#1') THEN '2014-03-01'
       ELSE '1995-01-01' END AS effective_from,
  CASE WHEN b IS NOT NULL THEN br ELSE 'national' END AS region,
  coalesce(ov, own_version, 'baseline-1.0') AS version,
  coalesce(onote, CASE WHEN b IS NULL AND NOT contains(law_name, '#25') AND contains(law_name, 'Brand#1') THEN 'series' ELSE 'baseline' END) AS note
FROM j""")
def _(t):
    base = t.nation.filter("n_nationkey <> 12").select(
        F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("law_name"),
        F.concat(F.lit("20"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit("-01-01")).alias("effective_from"),
        F.concat(F.lit("REGION_"), F.col("n_regionkey").cast("string")).alias("region"))
    key = F.col("r_regionkey")
    overrides = t.region.select(F.concat(F.lit("Brand#"), key.cast("string")).alias("key"), F.concat(
        F.lit("v"), key.cast("string")).alias("version"), F.lit(None).cast("string").alias("note")).unionByName(
        t.region.select(F.concat(F.lit("Brand#"), (key + 2).cast("string"), F.lit("@NORTH")).alias("key"),
                        F.concat(F.lit("north-"), key.cast("string")).alias("version"), F.lit("local").alias("note")))
    laws = t.part.select("p_partkey", F.col("p_brand").alias("law_name"), F.when(
        F.col("p_size") >= 40, F.concat(F.lit("own-"), F.col("p_size").cast("string"))).alias("version"))
    return M.attach_metadata(laws, base, KEYWORDS, overrides, DEFAULT, "NORTH").select(
        "p_partkey", "law_name", "effective_from", "region", "version", "note")


LAWS = """(SELECT o_orderkey AS pos, 'C' || o_custkey AS law_name,
  CASE o_orderstatus WHEN 'P' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS effective_from,
  CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate + INTERVAL 400 DAY, '%Y-%m-%d') ELSE '' END AS effective_until,
  CASE o_orderstatus WHEN 'F' THEN 'https://example.invalid/x' WHEN 'O' THEN 'https://laws.example/' || o_orderkey ELSE '' END AS source_url,
  CASE o_orderpriority WHEN '2-HIGH' THEN '' WHEN '5-LOW' THEN '1998-09-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS checked_at,
  CASE o_orderpriority WHEN '3-MEDIUM' THEN 'still 基线' ELSE NULL END AS note FROM orders)"""


def _laws(t) -> DataFrame:
    status, priority, day = F.col("o_orderstatus"), F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select(
        F.col("o_orderkey").alias("pos"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("law_name"),
        F.when(status == "P", "unknown").otherwise(day).alias("effective_from"),
        F.when(priority == "1-URGENT", F.date_format(F.date_add("o_orderdate", 400), "yyyy-MM-dd")).otherwise("").alias("effective_until"),
        F.when(status == "F", "https://example.invalid/x").when(status == "O", F.concat(
            F.lit("https://laws.example/"), F.col("o_orderkey").cast("string"))).otherwise("").alias("source_url"),
        F.when(priority == "2-HIGH", "").when(priority == "5-LOW", "1998-09-30").otherwise(day).alias("checked_at"),
        F.when(priority == "3-MEDIUM", "still 基线").alias("note"))


ACTIVE = """NOT (coalesce(TRY_CAST(effective_from AS DATE) > {0}, false) OR coalesce(TRY_CAST(nullif(effective_until, '') AS DATE) < {0}, false))"""


@plan("m02_active_as_of", f"""
SELECT pos, law_name, effective_from, effective_until FROM {LAWS} WHERE {ACTIVE.format("DATE '1997-06-01'")}""")
def _(t):
    return M.active_as_of(_laws(t), "1997-06-01").select("pos", "law_name", "effective_from", "effective_until")


@plan("m02_versions_as_of", f"""
SELECT a.c_custkey, l.pos FROM (SELECT c_custkey, 'C' || c_custkey AS law_name, DATE '1995-01-01' + c_nationkey * 60 AS as_of FROM customer) a
JOIN {LAWS} l USING (law_name) WHERE {ACTIVE.format("a.as_of")}""")
def _(t):
    asks = t.customer.select("c_custkey", F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("law_name"),
                             F.date_add(F.lit("1995-01-01").cast("date"), F.col("c_nationkey") * 60).alias("as_of"))
    return M.versions_as_of(asks, _laws(t)).select("c_custkey", "pos")


REGIONS = "(SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN '全国 (all)' WHEN n_regionkey = 1 THEN '' WHEN n_nationkey = 2 THEN 'NATION' ELSE n_name END AS region FROM nation)"


@plan("m03_region_matches", f"""
SELECT n_nationkey, region FROM {REGIONS} WHERE region = '' OR starts_with(region, '全国') OR contains(region, 'NATION_1')
  OR contains('NATION_1', region)""")
def _(t):
    rows = t.nation.select("n_nationkey", F.when(F.col("n_regionkey") == 0, "全国 (all)").when(
        F.col("n_regionkey") == 1, "").when(F.col("n_nationkey") == 2, "NATION").otherwise(F.col("n_name")).alias("region"))
    return M.region_matches(rows, "NATION_1")


ISSUES = f"""
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY law_name ORDER BY pos) AS rn FROM {LAWS}) WHERE rn = 1),
  issue AS (
   SELECT law_name, 'source_not_verified' AS code, '' AS detail FROM f WHERE source_url = '' OR contains(source_url, 'example.invalid') UNION ALL
   SELECT law_name, 'never_checked', '' FROM f WHERE checked_at = '' UNION ALL
   SELECT law_name, 'stale', checked_at FROM f WHERE checked_at <> '' AND DATE '1998-12-01' - checked_at::DATE > 180 UNION ALL
   SELECT law_name, 'invalid_date', '' FROM f WHERE TRY_CAST(effective_from AS DATE) IS NULL UNION ALL
   SELECT law_name, 'not_effective', '' FROM f WHERE NOT ({ACTIVE.format("DATE '1998-12-01'")}) UNION ALL
   SELECT law_name, 'baseline_value', '' FROM f WHERE contains(coalesce(note, ''), '基线'))"""


@plan("m04_verify_issues", f"WITH {ISSUES.replace('checked_at::DATE', 'CAST(checked_at AS DATE)')} SELECT * FROM issue")
def _(t):
    return M.verify_corpus(_laws(t), "1998-12-01")


@plan("m04_verify_summary", f"""WITH {ISSUES},
  b AS (SELECT *, code <> 'baseline_value' AS blocking FROM issue)
SELECT coalesce(code, 'all') AS code, count(*) AS n_issues, count(*) FILTER (blocking) AS n_blocking,
  count(*) FILTER (blocking) = 0 AS ok, (SELECT count(DISTINCT law_name) FROM {LAWS}) AS n_laws
FROM b GROUP BY GROUPING SETS ((code), ())""")
def _(t):
    laws = _laws(t)
    return M.verify_summary(laws, M.verify_corpus(laws, "1998-12-01"))


SNAP = ("version", "note")
OLD = "(SELECT p_partkey AS pos, p_brand || ' ' || p_name AS law_name, 'v' || p_size AS version, p_type AS note FROM part)"
NEW = """(SELECT p_partkey AS pos, p_brand || ' ' || CASE WHEN p_size = 50 THEN 'new ' ELSE '' END || p_name AS law_name,
  CASE WHEN p_size > 45 THEN 'v46' ELSE 'v' || p_size END AS version, nullif(p_type, 'PROMO') AS note FROM part)"""


def _snap_sql(source: str) -> str:
    return f"""(SELECT law_name, coalesce(version, '') AS version, coalesce(note, '') AS note FROM
  (SELECT *, row_number() OVER (PARTITION BY law_name ORDER BY pos DESC) AS rn FROM {source}) WHERE rn = 1)"""


def _snaps(t) -> tuple[DataFrame, DataFrame]:
    name = F.concat_ws(" ", "p_brand", "p_name")
    version = F.concat(F.lit("v"), F.col("p_size").cast("string"))
    old = t.part.select(F.col("p_partkey").alias("pos"), name.alias("law_name"), version.alias("version"),
                        F.col("p_type").alias("note"))
    new = t.part.select(
        F.col("p_partkey").alias("pos"), F.when(F.col("p_size") == 50, F.concat("p_brand", F.lit(" new "), "p_name")).otherwise(
            name).alias("law_name"), F.when(F.col("p_size") > 45, "v46").otherwise(version).alias("version"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("note"))
    return M.metadata_snapshot(old, SNAP), M.metadata_snapshot(new, SNAP)


@plan("m05_metadata_snapshot", f"SELECT * FROM {_snap_sql(NEW)}")
def _(t):
    return _snaps(t)[1]


@plan("m06_snapshot_diff", f"""
WITH o AS {_snap_sql(OLD)}, n AS {_snap_sql(NEW)}
SELECT law_name, 'added' AS change, '' AS field, '' AS old, '' AS new FROM n WHERE law_name NOT IN (SELECT law_name FROM o) UNION ALL
SELECT law_name, 'removed', '', '', '' FROM o WHERE law_name NOT IN (SELECT law_name FROM n) UNION ALL
SELECT law_name, 'changed', 'version', o.version, n.version FROM o JOIN n USING (law_name) WHERE o.version <> n.version UNION ALL
SELECT law_name, 'changed', 'note', o.note, n.note FROM o JOIN n USING (law_name) WHERE o.note <> n.note""")
def _(t):
    return M.snapshot_diff(*_snaps(t), SNAP)


FIXED_ROWS = """(SELECT p_partkey, p_brand AS law_name, p_name AS article, p_type AS category, str_split(p_name, ' ') AS keywords,
  s_suppkey, CASE WHEN s_suppkey IS NOT NULL THEN CASE WHEN s_nationkey > 12 THEN 'PROMO' ELSE 'LARGE' END END AS new_category,
  CASE WHEN s_suppkey IS NOT NULL THEN ['red', 'ring', s_name] END AS extra
  FROM part LEFT JOIN (SELECT s_suppkey, s_nationkey, s_name, 'Brand#' || s_suppkey AS b FROM supplier) ON b = p_brand AND p_name LIKE '%ring')"""


def _corrected(t) -> DataFrame:
    laws = t.part.select("p_partkey", F.col("p_brand").alias("law_name"), F.col("p_name").alias("article"),
                         F.col("p_type").alias("category"), F.split("p_name", " ").alias("keywords"))
    articles = t.part.filter(F.col("p_name").endswith("ring")).select(F.col("p_name").alias("article"), F.col("p_brand").alias("law_name")).distinct()
    fixes = t.supplier.select(
        F.concat(F.lit("Brand#"), F.col("s_suppkey").cast("string")).alias("law_name"),
        F.when(F.col("s_nationkey") > 12, "PROMO").otherwise("LARGE").alias("new_category"),
        F.array(F.lit("red"), F.lit("ring"), F.col("s_name")).alias("extra_keywords")).join(articles, "law_name")
    return M.apply_corrections(laws, fixes)


@plan("m07_apply_corrections", f"""
SELECT p_partkey, law_name, article, coalesce(new_category, category) AS category,
  array_to_string(list_concat(keywords, list_filter(coalesce(extra, []), lambda k: NOT list_contains(keywords, k))), ',') AS keywords,
  coalesce(new_category <> category, false) AS changed FROM {FIXED_ROWS}""")
def _(t):
    return _corrected(t).select("p_partkey", "law_name", "article", "category", F.array_join("keywords", ",").alias("keywords"), "changed")


@plan("m07_correction_changes", f"""
SELECT law_name, article, category AS old_category, new_category FROM {FIXED_ROWS} WHERE new_category <> category""")
def _(t):
    return M.correction_changes(_corrected(t))


@plan("m08_corpus_coverage", """
WITH e AS (SELECT DISTINCT 'size ' || p_size AS category FROM part UNION ALL SELECT 'size 77'),
  c AS (SELECT 'size ' || p_size AS category, count(*) AS n FROM part GROUP BY 1)
SELECT category, coalesce(n, 0) AS n_rows, coalesce(n, 0) >= 5 AS covered FROM e LEFT JOIN c USING (category)""")
def _(t):
    size = F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("category")
    expected = t.part.select(size).distinct().unionByName(t.part.select(F.lit("size 77").alias("category")).distinct())
    return M.corpus_coverage(t.part.select(size), expected, 5)


@plan("m08_unknown_categories", f"""
SELECT p_type AS category, count(*) AS n_rows FROM part WHERE lower(p_type) NOT IN ({', '.join(repr(k) for k in fixed.RISK_WEIGHTS)}, 'small')
GROUP BY 1""")
def _(t):
    known = t.spark.createDataFrame([(k,) for k in (*fixed.RISK_WEIGHTS, "SMALL")], "category string")
    return M.unknown_categories(t.part.select(F.col("p_type").alias("category")), known)
