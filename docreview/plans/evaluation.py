"""Evaluation over labelled documents, and feedback mining over the label table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreview.functions.scalars import top_rows
from docreview.operators import evaluation as E
from docreview.operators import facts as FX
from docreview.operators import retrieval as R
from docreview.packs import fixed, latin
from docreview.plans import retrieval as PR
from docreview.plans import review as PV
from docreview.plans.registry import plan
from docreview.session import cut_lineage

DEPTH = 5


@plan("e01_retrieval_metrics", f"""
WITH vs AS (SELECT i.item_id AS query_id, b.vec_id AS doc_id, {PR.COSINE} AS score
         FROM benchmark i JOIN embeddings a ON a.vec_id = i.item_id, embeddings b WHERE b.vec_id <> i.item_id),
  {PR.cut_sql('vc', 'vs', DEPTH)}, {PR.bm25_sql('documents', PR.ASKS)}, {PR.cut_sql('bc', 'sc', DEPTH)},
  h AS (SELECT 'vector' AS channel, query_id, rank, label FROM vc JOIN embeddings ON vec_id = doc_id UNION ALL
        SELECT 'bm25', query_id, rank, label FROM bc LEFT JOIN embeddings ON vec_id = doc_id),
  gold AS (SELECT item_id AS query_id, label FROM benchmark JOIN embeddings ON vec_id = item_id),
  f AS (SELECT channel, query_id, min(rank) AS first FROM h JOIN gold USING (query_id, label) GROUP BY ALL),
  n AS (SELECT count(*) AS n FROM gold)
SELECT channel, n AS n_queries, n - (SELECT count(DISTINCT query_id) FROM h WHERE h.channel = c.channel) AS n_failed,
  round((SELECT count(*) FROM f WHERE f.channel = c.channel AND first <= 1) / n + 1e-9, 4) AS hit_at_1,
  round((SELECT count(*) FROM f WHERE f.channel = c.channel AND first <= 3) / n + 1e-9, 4) AS hit_at_3,
  round((SELECT count(*) FROM f WHERE f.channel = c.channel AND first <= 5) / n + 1e-9, 4) AS hit_at_5,
  round((SELECT coalesce(sum(1.0::DOUBLE / first), 0) FROM f WHERE f.channel = c.channel) / n + 1e-9, 4) AS mrr_at_5
FROM (VALUES ('vector'), ('bm25')) c(channel), n""")
def _(t):
    asks = PR._hybrid_asks(t).filter(F.col("embedding").isNotNull())
    labels = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("category"))
    # The query's own vector is left out: one more is fetched, then cut again.
    near = R.vector_topk(asks, PR._vectors(t), DEPTH + 1).filter(F.col("query_id") != F.col("doc_id"))
    near = top_rows(near.drop("rank"), ("query_id",), [F.col("score").desc(), F.col("doc_id")], DEPTH, "rank")
    words = R.bm25_topk(PR._asks(t), R.bm25_index(PR._docs(t)), DEPTH)
    hits = cut_lineage(near.select(F.lit("vector").alias("channel"), "query_id", "doc_id", "rank").unionByName(
        words.select(F.lit("bm25").alias("channel"), "query_id", "doc_id", "rank")).join(labels, "doc_id", "left"))  # a document without a vector has no category
    gold = t.benchmark.select(F.col("item_id").alias("query_id")).join(labels.withColumnRenamed("doc_id", "query_id"), "query_id")
    channels = t.spark.createDataFrame([("vector",), ("bm25",)], "channel string")
    return E.retrieval_metrics(hits, gold, channels)


# Golden risks: the first clause of each category of a labelled document. Predictions: every categorised clause but
# the first line, of all documents.
HIGH = ("non_compete", "probation_insurance", "training_bond")
PAIRS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"
DICE = f"""2 * len(list_intersect({PAIRS.format('trim(g.snippet)')}, {PAIRS.format('trim(p.clause)')}))
  / greatest(1, len({PAIRS.format('trim(g.snippet)')}) + len({PAIRS.format('trim(p.clause)')})) >= 0.55"""
GOLD = f"""{PV.CLAUSES},
  cases AS (SELECT doc_id AS case_id, lang AS grp, quality, toxic FROM labels JOIN documents USING (doc_id)),
  gold AS (SELECT doc_id AS case_id, clause_id AS pos, primary_category AS category,
      CASE WHEN primary_category IN {HIGH} THEN 'high' ELSE 'medium' END AS level, left(content, 40) AS snippet, quality = 1 AS required
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, primary_category ORDER BY clause_id) AS rn FROM clause
          WHERE primary_category IS NOT NULL) c JOIN cases ON case_id = doc_id WHERE rn = 1),
  pred AS (SELECT doc_id AS case_id, clause_id AS pos, primary_category AS category,
      CASE WHEN length(content) > 250 THEN 'high' ELSE 'medium' END AS level, content AS clause FROM clause
    WHERE primary_category IS NOT NULL AND clause_id > 1),
  match AS (SELECT g.case_id, g.pos, g.category, g.level, g.required, p.pos AS pred_pos, p.level AS pred_level FROM gold g
    LEFT JOIN (SELECT g.case_id, g.pos AS gpos, p.pos, p.level, row_number() OVER (PARTITION BY g.case_id, g.pos ORDER BY p.pos) AS rn
       FROM gold g JOIN pred p ON g.case_id = p.case_id AND g.category = p.category
         AND (contains(p.clause, trim(g.snippet)) OR contains(trim(g.snippet), p.clause) OR ({DICE}))) p
      ON p.case_id = g.case_id AND p.gpos = g.pos AND rn = 1),
  cm AS (SELECT case_id, grp, count(m.pred_pos) AS tp,
      (SELECT count(*) FROM pred p WHERE p.case_id = c.case_id) - count(m.pred_pos) AS fp,
      count(m.pos) - count(m.pred_pos) AS fn, count(*) FILTER (m.level = pred_level) AS level_matched,
      count(*) FILTER (m.pos IS NOT NULL AND pred_pos IS NULL AND required AND m.level = 'high') AS severe_misses
    FROM cases c LEFT JOIN match m USING (case_id) GROUP BY case_id, grp)"""


def _cases(t) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select(
        F.col("doc_id").alias("case_id"), F.col("lang").alias("grp"), "quality", "toxic")


def _gold(t, clauses: DataFrame | None = None) -> DataFrame:
    c = F.col("primary_category")
    clauses = PV.categorized(t).filter(c.isNotNull()) if clauses is None else clauses
    clauses = clauses.join(_cases(t).withColumnRenamed("case_id", "doc_id"), "doc_id")
    first = top_rows(clauses, ("doc_id", "primary_category"), [F.col("clause_id")], 1)
    return first.select(F.col("doc_id").alias("case_id"), F.col("clause_id").alias("pos"), c.alias("category"),
                        F.when(c.isin(*HIGH), "high").otherwise("medium").alias("level"),
                        F.substring("content", 1, 40).alias("snippet"), (F.col("quality") == 1).alias("required"))


def _pred(t, clauses: DataFrame | None = None) -> DataFrame:
    c = F.col("primary_category")
    clauses = PV.categorized(t) if clauses is None else clauses
    return clauses.filter(c.isNotNull() & (F.col("clause_id") > 1)).select(
        F.col("doc_id").alias("case_id"), F.col("clause_id").alias("pos"), c.alias("category"),
        F.when(F.length("content") > 250, "high").otherwise("medium").alias("level"), F.col("content").alias("clause"))


def _matches(t, min_similarity: float | None = E.SNIPPET_SIMILARITY) -> DataFrame:
    """Clauses of the labelled documents only, cut and categorised once for both sides."""
    c = F.col("primary_category")
    labelled = t.labels.select("doc_id").distinct()
    clauses = cut_lineage(PV.categorized(t, t.documents.join(labelled, "doc_id", "left_semi")).filter(c.isNotNull()).select(
        "doc_id", "clause_id", "primary_category", "content"))
    return E.match_risks(_gold(t, clauses), _pred(t, clauses), min_similarity)


@plan("e02_match_risks", f"WITH {GOLD.replace(f' OR ({DICE})', '')} SELECT * FROM match")
def _(t):
    return _matches(t, None)


@plan("e02_match_risks_fuzzy", f"WITH {GOLD} SELECT * FROM match")
def _(t):
    return _matches(t)


PRF = """round(CASE WHEN {p}tp + {p}fp = 0 THEN 0 ELSE {p}tp / ({p}tp + {p}fp) END + 1e-9, 4) AS {p}precision,
  round(CASE WHEN {p}tp + {p}fn = 0 THEN 0 ELSE {p}tp / ({p}tp + {p}fn) END + 1e-9, 4) AS {p}recall,
  round(CASE WHEN 2 * {p}tp + {p}fp + {p}fn = 0 THEN 0 ELSE 2 * {p}tp / (2 * {p}tp + {p}fp + {p}fn) END + 1e-9, 4) AS {p}f1"""
AGREE = "round(CASE WHEN tp = 0 THEN 0 ELSE level_matched / tp END + 1e-9, 4) AS level_agreement"


def _case_metrics(t) -> DataFrame:
    return E.case_metrics(_cases(t), _matches(t), _pred(t))


@plan("e03_case_metrics", f"WITH {GOLD} SELECT *, {PRF.format(p='')}, {AGREE} FROM cm")
def _(t):
    return _case_metrics(t)


@plan("e03_missed_categories", f"WITH {GOLD} SELECT case_id, category, count(*) AS n_missed FROM match WHERE pred_pos IS NULL GROUP BY ALL")
def _(t):
    return E.missed_categories(_matches(t))


SETS = f"""{PV.FACTS},
  gk AS (SELECT doc_id AS case_id, key FROM gap WHERE doc_id IN (SELECT doc_id FROM labels)),
  pk AS (SELECT doc_id AS case_id, key FROM refined WHERE status = 'missing' AND doc_id IN (SELECT doc_id FROM labels)),
  sm AS (SELECT case_id, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS missing_tp, count(*) FILTER (g IS NULL) AS missing_fp,
      count(*) FILTER (p IS NULL) AS missing_fn FROM (SELECT *, 1 AS g FROM gk) FULL JOIN (SELECT *, 1 AS p FROM pk)
      USING (case_id, key) GROUP BY case_id)"""


def _sets(t) -> DataFrame:
    facts = FX.refine_facts(PV._facts(t)).join(t.labels.select("doc_id"), "doc_id", "left_semi")
    gold = FX.missing_clauses(facts, latin.RULE_SETS, latin.CRITICAL_KEYS).select(F.col("doc_id").alias("case_id"), "key")
    return E.set_metrics(gold, facts.filter("status = 'missing'").select(F.col("doc_id").alias("case_id"), "key"))


@plan("e04_set_metrics", f"WITH {SETS} SELECT *, {PRF.format(p='missing_')} FROM sm")
def _(t):
    return _sets(t)


AGGREGATED = f"""{GOLD}, {SETS},
  am AS (SELECT coalesce(grp, 'all') AS grp, count(*) AS cases, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
     sum(level_matched)::BIGINT AS level_matched, sum(severe_misses)::BIGINT AS severe_misses,
     sum(coalesce(missing_tp, 0))::BIGINT AS missing_tp, sum(coalesce(missing_fp, 0))::BIGINT AS missing_fp,
     sum(coalesce(missing_fn, 0))::BIGINT AS missing_fn FROM cm LEFT JOIN sm USING (case_id) GROUP BY GROUPING SETS ((grp), ())),
  ag AS (SELECT * EXCLUDE (level_matched), {PRF.format(p='')}, {PRF.format(p='missing_')}, {AGREE} FROM am)"""


def _aggregated(t) -> DataFrame:
    return E.aggregate_metrics(_case_metrics(t), _sets(t))


@plan("e05_aggregate_metrics", f"WITH {AGGREGATED} SELECT * FROM ag")
def _(t):
    return _aggregated(t)


@plan("e06_unmatched_predictions", f"WITH {GOLD} SELECT DISTINCT case_id FROM pred WHERE case_id NOT IN (SELECT case_id FROM cases)")
def _(t):
    return E.unmatched_predictions(_pred(t), _cases(t))


def _checks_sql() -> str:
    rows = [f"SELECT '{m}' AS metric, {m}::DOUBLE AS actual, {fixed.GATE_LIMITS[k]}::DOUBLE AS limit_value, '{op}' AS op, {m} {op} {fixed.GATE_LIMITS[k]} AS ok FROM o"
            for m, k, op in E.GATE]
    rows.append("""SELECT 'predicted_cases', (SELECT count(DISTINCT case_id) FROM pred)::DOUBLE, (SELECT count(*) FROM cases)::DOUBLE, '==',
      (SELECT count(DISTINCT case_id) FROM pred) = (SELECT count(*) FROM cases) FROM o""")
    return " UNION ALL ".join(rows)


CHECKS = f"{AGGREGATED}, o AS (SELECT * FROM ag WHERE grp = 'all'), ck AS ({_checks_sql()})"


def _gate(t) -> DataFrame:
    n_pred = _pred(t).agg(F.count_distinct("case_id").alias("n")).scalar()
    n_gold = _cases(t).agg(F.count("*").alias("n")).scalar()
    return E.release_gate(_aggregated(t).filter("grp = 'all'"), n_pred, n_gold)


@plan("e07_release_gate", f"WITH {CHECKS} SELECT * FROM ck")
def _(t):
    return _gate(t)


@plan("e07_gate_passed", f"WITH {CHECKS} SELECT bool_and(ok) AS passed, count(*) FILTER (NOT ok) AS violations FROM ck")
def _(t):
    return E.gate_passed(_gate(t))


@plan("e08_build_goldens", f"""WITH {GOLD}, {PV.FACTS},
  r AS (SELECT case_id, string_agg(pos || ':' || category || ':' || level, ',' ORDER BY pos) AS risks FROM gold GROUP BY case_id),
  g AS (SELECT doc_id AS case_id, string_agg(key, ',' ORDER BY ord) AS missing_clauses FROM gap GROUP BY doc_id)
SELECT case_id, grp, coalesce(risks, '') AS risks, coalesce(missing_clauses, '') AS missing_clauses
FROM cases LEFT JOIN r USING (case_id) LEFT JOIN g USING (case_id)""")
def _(t):
    gaps = PV.gaps(t).withColumnRenamed("doc_id", "case_id")
    built = E.build_goldens(_cases(t), _gold(t), gaps)
    shown = F.array_join(F.transform("risks", lambda r: F.concat_ws(":", r["pos"].cast("string"), r["category"], r["level"])), ",")
    return built.select("case_id", "grp", shown.alias("risks"), F.array_join("missing_clauses", ",").alias("missing_clauses"))


FEEDBACK = """
  fb AS (SELECT CASE WHEN source = 'src5' THEN -doc_id ELSE doc_id END AS risk_item_id, CASE WHEN lang = 'es' THEN '' ELSE source END AS contract_id,
     CASE WHEN toxic = 1 THEN 'false_positive' WHEN quality = 1 THEN 'accepted' ELSE 'ignored' END AS verdict,
     'label ' || quality || toxic AS comment FROM labels JOIN documents USING (doc_id)),
  rk AS (SELECT doc_id AS risk_item_id, CASE WHEN source = 'src3' THEN '' ELSE lang || '-' || source END AS category,
     CASE WHEN n_chars > 2000 THEN 'high' WHEN n_chars > 900 THEN '' ELSE 'medium' END AS level,
     text AS original_clause FROM documents),
  jd AS (SELECT * FROM fb JOIN rk USING (risk_item_id) WHERE verdict <> 'ignored')"""


def _feedback(t) -> tuple[DataFrame, DataFrame]:
    docs = t.documents.select("doc_id", "lang", "source", "n_chars", F.col("text").alias("line"))
    fb = t.labels.join(docs, "doc_id").select(
        F.when(F.col("source") == "src5", -F.col("doc_id")).otherwise(F.col("doc_id")).alias("risk_item_id"),  # no such risk
        F.when(F.col("lang") == "es", "").otherwise(F.col("source")).alias("contract_id"),
        F.when(F.col("toxic") == 1, "false_positive").when(F.col("quality") == 1, "accepted").otherwise("ignored").alias("verdict"),
        F.concat(F.lit("label "), F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("comment"))
    risks = docs.select(
        F.col("doc_id").alias("risk_item_id"), F.when(F.col("source") == "src3", "").otherwise(
            F.concat_ws("-", "lang", "source")).alias("category"),
        F.when(F.col("n_chars") > 2000, "high").when(F.col("n_chars") > 900, "").otherwise("medium").alias("level"),
        F.col("line").alias("original_clause"))
    return fb, risks


@plan("e09_feedback_positives", f"""WITH {FEEDBACK} SELECT contract_id, risk_item_id, category,
  CASE WHEN level = '' THEN 'high' ELSE level END AS level, original_clause AS snippet, true AS required
FROM jd WHERE contract_id <> '' AND verdict = 'accepted'""")
def _(t):
    return E.feedback_to_cases(*_feedback(t))[0]


@plan("e09_feedback_negatives", f"""WITH {FEEDBACK} SELECT contract_id, risk_item_id, category, original_clause AS snippet, comment
FROM jd WHERE contract_id <> '' AND verdict = 'false_positive'""")
def _(t):
    return E.feedback_to_cases(*_feedback(t))[1]


@plan("e09_feedback_case_counts", f"""WITH {FEEDBACK} SELECT count(DISTINCT contract_id) FILTER (verdict = 'accepted') AS positive_cases,
  count(*) FILTER (verdict = 'accepted') AS positive_risks, count(*) FILTER (verdict = 'false_positive') AS negative_cases
FROM jd WHERE contract_id <> ''""")
def _(t):
    return E.feedback_case_counts(*E.feedback_to_cases(*_feedback(t)))


@plan("e10_tuning_suggestions", f"""WITH {FEEDBACK},
  c AS (SELECT * REPLACE (CASE WHEN category = '' THEN 'unknown' ELSE category END AS category) FROM jd),
  s AS (SELECT category, string_agg(left(original_clause, 120), ' / ' ORDER BY risk_item_id) AS sample_clauses FROM
    (SELECT *, row_number() OVER (PARTITION BY category ORDER BY risk_item_id) AS rn FROM c
     WHERE verdict = 'false_positive' AND original_clause <> '') WHERE rn <= 5 GROUP BY category),
  r AS (SELECT category, count(*) AS samples, count(*) FILTER (verdict = 'false_positive') AS false_positives,
     round(count(*) FILTER (verdict = 'false_positive') / count(*) + 1e-9, 4) AS false_positive_rate FROM c GROUP BY category)
SELECT r.*, CASE WHEN false_positive_rate >= 0.5 THEN 'high' ELSE 'medium' END AS priority, sample_clauses
FROM r LEFT JOIN s USING (category) WHERE samples >= 3 AND false_positive_rate >= 0.1""")
def _(t):
    return E.tuning_suggestions(*_feedback(t), threshold=0.1).withColumn("sample_clauses", F.array_join("sample_clauses", " / "))


@plan("e11_feedback_stats", f"""WITH {FEEDBACK} SELECT count(*) AS total, count(*) FILTER (verdict = 'accepted') AS accepted,
  count(*) FILTER (verdict = 'false_positive') AS false_positive, count(*) FILTER (verdict = 'ignored') AS ignored,
  round(count(*) FILTER (verdict = 'accepted') / count(*) + 1e-9, 4) AS adoption_rate,
  round(count(*) FILTER (verdict = 'false_positive') / count(*) + 1e-9, 4) AS false_positive_rate FROM fb""")
def _(t):
    return E.feedback_stats(_feedback(t)[0])
