"""Facts, gaps, risks and rewrites: rules of the Latin pack over whole documents, every line taken as a clause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreview.operators import facts as FX
from docreview.operators import risk as K
from docreview.operators import text as X
from docreview.packs import fixed, latin
from docreview.packs.latin import contains_any_sql, quote
from docreview.plans.registry import plan
from docreview.plans.text import CATEGORIZED, RULE_SET_SQL

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _rx(pattern: str, group: int) -> str:
    return f"nullif(regexp_extract(text, {quote(pattern)}, {group}), '')"


def _first_sql(patterns) -> tuple[str, str]:
    import re

    whole, group = "NULL", "NULL"
    for p in reversed(patterns):
        inner = _rx(p, 1) if re.compile(p).groups else "NULL"
        whole, group = (f"CASE WHEN {_rx(p, 0)} IS NOT NULL THEN {_rx(p, 0)} ELSE {whole} END",
                        f"CASE WHEN {_rx(p, 0)} IS NOT NULL THEN {inner} ELSE {group} END")
    return whole, group


def _rule_rows() -> str:
    parts = []
    for name, rules in latin.RULE_SETS.items():
        for i, r in enumerate(rules):
            whole, group = _first_sql(r["find"])
            counter, _ = _first_sql(latin.CONTRADICTIONS.get(r["fact"], ()))
            parts.append(f"""SELECT doc_id, text, rule_set, {i}::BIGINT AS ord, {quote(r["fact"])} AS key, {r["must"]} AS required,
  {quote(r["gap"]["title"])} AS label, {quote(r["gap"]["law"])} AS basis, {quote(r["gap"]["add"])} AS suggestion, {quote(r["gap"]["why"])} AS reason,
  ({whole})::VARCHAR AS whole, ({group})::VARCHAR AS grp, coalesce(({counter})::VARCHAR, '') AS counter_phrase
  FROM typed WHERE rule_set = {quote(name)}""")
    return " UNION ALL ".join(parts)


FACTS = f"""
  typed AS (SELECT doc_id, text, {RULE_SET_SQL} AS rule_set FROM documents),
  raw AS ({_rule_rows()}),
  ev AS (SELECT *, {STRIP.format('whole')} AS e FROM raw),
  b1 AS (SELECT *, CASE WHEN grp IS NOT NULL THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS b FROM ev),
  b2 AS (SELECT * REPLACE (CASE WHEN length(e) < 8 THEN b * 0.85::DOUBLE WHEN length(e) > 80 THEN b * 0.95::DOUBLE ELSE b END AS b) FROM b1),
  b3 AS (SELECT * REPLACE (CASE WHEN (length(text) - length(replace(text, e, ''))) / length(e) >= 2
             THEN least(0.98::DOUBLE, b + 0.04::DOUBLE) ELSE b END AS b) FROM b2),
  fact AS (SELECT doc_id, rule_set, ord, key, required, label, basis, suggestion, reason, counter_phrase,
    CASE WHEN whole IS NULL THEN '' ELSE left(coalesce({STRIP.format('grp')}, e), 120) END AS value,
    CASE WHEN whole IS NULL THEN '' ELSE left(e, 200) END AS evidence,
    CASE WHEN whole IS NULL THEN 0.0 ELSE printf('%.2f', greatest(0.3, least(0.98, b)))::DOUBLE END AS confidence,
    CASE WHEN whole IS NULL THEN 'missing' ELSE 'present' END AS status,
    CASE WHEN whole IS NULL THEN 'none' WHEN grp IS NOT NULL THEN 'capture' ELSE 'keyword' END AS matched_by,
    CASE WHEN whole IS NULL THEN '' ELSE counter_phrase END AS contradiction FROM b3),
  refined AS (SELECT * REPLACE (
    CASE WHEN contradiction <> '' THEN 'contradicted' ELSE status END AS status,
    CASE WHEN contradiction <> '' THEN 'negation' ELSE matched_by END AS matched_by,
    CASE WHEN contradiction <> '' THEN greatest(confidence, 0.92) ELSE confidence END AS confidence) FROM fact),
  gap AS (SELECT doc_id, rule_set, ord, key, label,
    CASE WHEN status = 'contradicted' OR key IN ('party_a', 'license') THEN 'high' ELSE 'medium' END AS level,
    (CASE WHEN status = 'contradicted' THEN 10 WHEN key IN ('party_a', 'license') THEN 20 ELSE 30 END)::BIGINT AS score,
    CASE WHEN status = 'contradicted' THEN 'Counter phrase found: ' || contradiction || '. ' || reason ELSE reason END AS reason,
    basis AS legal_basis, suggestion AS suggested_text FROM refined WHERE required AND status <> 'present'),
  cover AS (SELECT doc_id, count(*) FILTER (required) AS required, count(*) FILTER (required AND status = 'present') AS present,
    (CASE WHEN count(*) FILTER (required) = 0 THEN 100 ELSE round_even(100.0 * count(*) FILTER (required AND status = 'present')
      / count(*) FILTER (required), 0) END)::BIGINT AS coverage FROM refined GROUP BY doc_id)"""


def _typed(t) -> DataFrame:
    return X.infer_rule_set(t.documents.select("doc_id", "text"), latin.RULE_SET_MARKERS, latin.DEFAULT_RULE_SET)


def _facts(t) -> DataFrame:
    return FX.extract_facts(_typed(t), latin.RULE_SETS, latin.CONTRADICTIONS)


@plan("f01_extract_facts", f"""WITH {FACTS}
SELECT doc_id, rule_set, ord, key, required, value, evidence, status, matched_by FROM fact""")
def _(t):
    return _facts(t).select("doc_id", "rule_set", "ord", "key", "required", "value", "evidence", "status", "matched_by")


@plan("f02_detect_contradictions", f"""WITH {FACTS}
SELECT doc_id, key, contradiction, counter_phrase FROM fact WHERE counter_phrase <> ''""")
def _(t):
    return _facts(t).filter("counter_phrase <> ''").select("doc_id", "key", "contradiction", "counter_phrase")


@plan("f03_fact_confidence", f"WITH {FACTS} SELECT doc_id, key, confidence FROM fact")
def _(t):
    return _facts(t).select("doc_id", "key", "confidence")


@plan("f04_refine_facts", f"WITH {FACTS} SELECT doc_id, key, status, matched_by, confidence, contradiction FROM refined")
def _(t):
    return FX.refine_facts(_facts(t)).select("doc_id", "key", "status", "matched_by", "confidence", "contradiction")


@plan("f05_missing_clauses", f"WITH {FACTS} SELECT * FROM gap")
def gaps(t):
    return FX.missing_clauses(FX.refine_facts(_facts(t)), latin.RULE_SETS, latin.CRITICAL_KEYS)


@plan("f06_coverage_score", f"WITH {FACTS} SELECT * FROM cover")
def coverage(t):
    return FX.coverage_score(FX.refine_facts(_facts(t)))


CLAUSES = f"""
  clause AS (SELECT doc_id, clause_id, left(content, 50) AS title, content, cats, cats[1] AS primary_category FROM {CATEGORIZED})"""


def _weight_sql() -> str:
    return "CASE c " + " ".join(f"WHEN {quote(k)} THEN {v}" for k, v in fixed.RISK_WEIGHTS.items()) + " ELSE 0 END"


SCORES = f"""{CLAUSES},
  scored AS (SELECT doc_id, greatest(0, least(100, 100 + sum(pen)))::BIGINT AS score, sum(len(cats))::BIGINT AS risk_count,
      round(sum(len(cats)) / greatest(count(*), 1) + 1e-9, 2) AS risk_ratio FROM
    (SELECT doc_id, cats, coalesce(list_sum(list_transform(cats, lambda c: {_weight_sql()})), 0) AS pen FROM clause)
    GROUP BY doc_id),
  leveled AS (SELECT *, CASE WHEN score <= 30 THEN 'high' WHEN score <= 50 THEN 'medium' WHEN score <= 70 THEN 'low'
      ELSE 'safe' END AS level FROM scored)"""


def categorized(t, documents: DataFrame | None = None, keep=()) -> DataFrame:
    return X.categorize_clauses(X.split_clauses(t.documents if documents is None else documents, "\n", keep=keep), latin.CATEGORY_RULES)


@plan("f07_review_documents", f"""WITH {FACTS}, {SCORES},
  g AS (SELECT doc_id, count(*) AS n_gaps, min(score) AS worst_gap FROM gap GROUP BY doc_id),
  n AS (SELECT doc_id, any_value(rule_set) AS rule_set, count(*) FILTER (status = 'contradicted') AS n_contradicted
        FROM refined GROUP BY doc_id)
SELECT doc_id, rule_set, coverage, n_contradicted, coalesce(n_gaps, 0) AS n_gaps, worst_gap, score, level, risk_count
FROM n JOIN cover USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN leveled USING (doc_id)""")
def review(t):
    _, _, summary = FX.review_documents(
        t.documents.select("doc_id", "text"), latin.RULE_SETS, latin.RULE_SET_MARKERS, latin.DEFAULT_RULE_SET,
        latin.CONTRADICTIONS, latin.CRITICAL_KEYS)
    return summary.join(K.risk_score(categorized(t)).drop("risk_ratio"), "doc_id", "left")


@plan("k01_risk_score", f"WITH {SCORES} SELECT * FROM leveled")
def _(t):
    return K.risk_score(categorized(t))


@plan("k02_fallback_risks", f"""WITH {CLAUSES}
SELECT doc_id, clause_id, primary_category AS category, 'medium' AS level, 50::BIGINT AS score,
  title || ' - needs attention' AS title, left(content, 200) AS original_clause, true AS degraded
FROM clause WHERE primary_category IS NOT NULL""")
def _(t):
    return K.fallback_risks(categorized(t))


@plan("k02_withheld_reports", f"""WITH {CLAUSES}
SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN
  (SELECT doc_id FROM clause WHERE primary_category IS NOT NULL)""")
def _(t):
    return K.publishable(t.documents.select("doc_id", "n_chars"), K.fallback_risks(categorized(t)).filter("degraded"))


# Risks for tracing: the basis cites in digits, in number words, without an article, or not at all.
RISKS = f"""{CLAUSES},
  risk AS (SELECT c.doc_id, clause_id AS risk_id, primary_category AS category, title,
    CASE WHEN primary_category IN ('non_compete', 'probation_insurance') THEN 'high'
         WHEN primary_category = 'job_description' THEN 'low' ELSE 'medium' END AS level,
    (length(content) - length(replace(content, 'e', '')))::BIGINT AS score,
    CASE WHEN primary_category = 'jurisdiction' THEN content || ' (edited)' WHEN primary_category = 'leave_rights' THEN ''
         ELSE content END AS original_clause,
    CASE WHEN primary_category IN ('obedience_clause', 'non_compete') THEN ' ' WHEN primary_category = 'job_description' THEN '《Work Code》'
         WHEN primary_category = 'training_bond' THEN '《Work Code 2012》第十二条' WHEN primary_category = 'resignation'
         THEN 'see 《Work》第一百零三条' ELSE '《Work Code》第' || length(d.source) || '条' END AS legal_basis
    FROM clause c JOIN documents d USING (doc_id) WHERE primary_category IS NOT NULL),
  ref AS (SELECT doc_id, '《Work Code》' AS law_name, CASE lang WHEN 'en' THEN '第4条' WHEN 'fr' THEN '第十二条'
          WHEN 'de' THEN '第103条' ELSE '第五条' END AS article FROM documents)"""


def _risks(t) -> tuple[DataFrame, DataFrame]:
    c = F.col("primary_category")
    basis = F.when(c.isin("obedience_clause", "non_compete"), " ").when(c == "job_description", "《Work Code》").when(
        c == "training_bond", "《Work Code 2012》第十二条").when(c == "resignation", "see 《Work》第一百零三条").otherwise(
        F.concat(F.lit("《Work Code》第"), F.length("source").cast("string"), F.lit("条")))
    clauses = categorized(t, keep=("source", "text")).filter(c.isNotNull())
    quote = F.when(c == "jurisdiction", F.concat("content", F.lit(" (edited)"))).when(c == "leave_rights", "").otherwise(F.col("content"))
    # The quote is looked up where the clause was cut, so no text has to follow its risks.
    risks = clauses.withColumn("original_clause", quote).withColumn("quoted", K.quoted(F.col("text"))).select(
        "doc_id", F.col("clause_id").alias("risk_id"), c.alias("category"), "title",
        F.when(c.isin("non_compete", "probation_insurance"), "high").when(c == "job_description", "low").otherwise(
            "medium").alias("level"),
        (F.length("content") - F.length(F.replace("content", F.lit("e"), F.lit("")))).cast("long").alias("score"),
        "original_clause", basis.alias("legal_basis"), "quoted")
    lang = F.col("lang")
    refs = t.documents.select("doc_id", F.lit("《Work Code》").alias("law_name"), F.when(lang == "en", "第4条").when(
        lang == "fr", "第十二条").when(lang == "de", "第103条").otherwise("第五条").alias("article"))
    return risks, refs


TRACED = f"""{RISKS},
  known AS (SELECT doc_id, regexp_replace(law_name, '[《》\\s]', '', 'g') AS ref_law, CASE article WHEN '第4条' THEN 4
     WHEN '第十二条' THEN 12 WHEN '第103条' THEN 103 ELSE 5 END AS number FROM ref),
  traced AS (SELECT risk.*, CASE WHEN legal_basis LIKE '%第%' THEN
      (CASE WHEN legal_basis LIKE '%第十二条%' THEN 12 WHEN legal_basis LIKE '%第一百零三条%' THEN 103
            ELSE regexp_extract(legal_basis, '第(\\d+)条', 1)::INTEGER END) = k.number
      AND (contains(k.ref_law, nm) OR contains(nm, k.ref_law)) ELSE false END AS traceable
    FROM (SELECT *, regexp_replace(regexp_extract(legal_basis, '《([^》]+)》', 1), '\\s', '', 'g') AS nm FROM risk) risk
    JOIN known k USING (doc_id)),
  checked AS (SELECT traced.*, original_clause <> '' AND contains(d.text, original_clause) AS quoted,
     trim(legal_basis) <> '' AS has_basis FROM traced JOIN documents d USING (doc_id)),
  issue AS (SELECT doc_id, risk_id, 'quote_not_found' AS code FROM checked WHERE NOT quoted UNION ALL
     SELECT doc_id, risk_id, CASE WHEN has_basis THEN 'not_traceable' ELSE 'no_basis' END FROM checked
     WHERE NOT has_basis OR NOT traceable)"""


@plan("k03_trace_citations", f"WITH {TRACED} SELECT doc_id, risk_id, legal_basis, traceable FROM traced")
def _(t):
    risks, refs = _risks(t)
    return K.trace_citations(risks, refs).select("doc_id", "risk_id", "legal_basis", "traceable")


@plan("k04_quality_issues", f"WITH {TRACED} SELECT * FROM issue")
def _(t):
    risks, refs = _risks(t)
    return K.quality_issues(risks, refs, t.documents)


@plan("k04_quality_gate", f"""WITH {TRACED}
SELECT doc_id, count(code) AS n_issues, greatest(0, 100 - least(60, 15 * count(code)))::BIGINT AS confidence
FROM documents LEFT JOIN issue USING (doc_id) GROUP BY doc_id""")
def _(t):
    risks, refs = _risks(t)
    return K.quality_gate(t.documents, K.quality_issues(risks, refs, t.documents))


REASONS = """
  reason AS (SELECT doc_id, reason, risk_id, check_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, reason
      ORDER BY risk_id, check_no) AS rn FROM (
    SELECT doc_id, risk_id, 1 AS check_no, title || ': quote cannot be located' AS reason FROM checked WHERE NOT quoted UNION ALL
    SELECT doc_id, risk_id, 2, title || ': no legal basis' FROM checked WHERE NOT has_basis UNION ALL
    SELECT doc_id, risk_id, 3, title || ': basis cannot be traced' FROM checked WHERE has_basis AND NOT traceable UNION ALL
    SELECT doc_id, risk_id, 4, title || ': high risk without basis' FROM checked WHERE level = 'high' AND NOT has_basis))
    WHERE rn = 1)"""


@plan("k05_verify_reasons", f"WITH {TRACED}, {REASONS} SELECT * FROM reason")
def _(t):
    risks, refs = _risks(t)
    return K.verify_reasons(risks, refs, t.documents)


@plan("k05_verify_reviews", f"""WITH {TRACED}, {REASONS},
  w AS (SELECT d.doc_id, n_chars < 120 AS skipped, lang = 'es' AS degraded, CASE WHEN source = 'src1' THEN 1 ELSE 0 END AS rounds,
     CASE WHEN lang = 'de' THEN 'high' ELSE 'low' END AS overall_level, (SELECT count(*) FROM reason r WHERE r.doc_id = d.doc_id) AS n
     FROM documents d),
  v AS (SELECT *, CASE WHEN skipped THEN 0 ELSE n + degraded::INTEGER END AS n_reasons FROM w),
  z AS (SELECT *, CASE WHEN skipped THEN 'skip' WHEN n_reasons > 0 AND NOT degraded AND rounds < 1 THEN 'rework'
     ELSE 'approve' END AS verdict FROM v)
SELECT doc_id, verdict, (rounds + (verdict = 'rework')::INTEGER)::BIGINT AS next_round, n_reasons::BIGINT AS n_reasons,
  (CASE WHEN verdict = 'approve' THEN n_reasons ELSE 0 END)::BIGINT AS leftover,
  verdict <> 'rework' AND overall_level = 'high' AS manual_gate FROM z""")
def _(t):
    risks, refs = _risks(t)
    reviews = t.documents.select("doc_id", "n_chars", (F.col("lang") == "es").alias("degraded"), F.when(
        F.col("source") == "src1", 1).otherwise(0).alias("rounds"), F.when(F.col("lang") == "de", "high").otherwise(
        "low").alias("overall_level"))
    return K.verify_reviews(reviews, K.verify_reasons(risks, refs, t.documents))


@plan("k06_order_risks", f"""WITH {RISKS}
SELECT doc_id, risk_id, level, score, row_number() OVER (PARTITION BY doc_id ORDER BY
  CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, score, risk_id) AS position FROM risk""")
def _(t):
    return K.order_risks(_risks(t)[0]).select("doc_id", "risk_id", "level", "score", "position")


def map_sql(column: str, values: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in values.items()) + f" ELSE {quote(default)} END"


@plan("k07_assign_redlines", f"""WITH {RISKS}
SELECT doc_id, risk_id, level <> 'low' AS filled, CASE WHEN level = 'low' THEN 'kept: ' || title ELSE
  {map_sql('category', latin.TEMPLATES, latin.DEFAULT_TEMPLATE)} END AS suggested_revision FROM risk""")
def _(t):
    risks = _risks(t)[0].withColumn("suggested_revision", F.when(F.col("level") == "low", F.concat(
        F.lit("kept: "), "title")).otherwise(""))
    return K.assign_redlines(risks, latin.TEMPLATES, latin.DEFAULT_TEMPLATE).select(
        "doc_id", "risk_id", "filled", "suggested_revision")


REWRITES = f"""{RISKS},
  inp AS (SELECT *, CASE WHEN level = 'low' THEN title ELSE '' END AS sug,
     CASE category WHEN 'salary_deduction' THEN title || ' - as agreed' WHEN 'probation_salary' THEN '{{"a": 1, "b": 2}}'
       WHEN 'probation_insurance' THEN content_ WHEN 'training_bond' THEN '' ELSE '' END AS cand,
     CASE category WHEN 'leave_rights' THEN 'manual' ELSE '' END AS meth FROM
     (SELECT *, original_clause AS content_ FROM risk)),
  pre AS (SELECT *, {STRIP.format('original_clause')} AS o, {STRIP.format('cand')} AS c,
     {map_sql('category', latin.TEMPLATES, latin.DEFAULT_TEMPLATE)} AS tpl,
     meth <> '' OR (sug <> '' AND cand = '') AS keep_ FROM inp),
  act AS (SELECT *, CASE WHEN keep_ THEN 'keep' WHEN length(c) BETWEEN 8 AND 1200 AND c <> o AND NOT starts_with(c, '{{')
     AND NOT contains(c, '```') THEN 'candidate' WHEN regexp_matches(o, {quote(latin.CONFLICT_PATTERN)}) OR length(o) < 12
     THEN 'replace' ELSE 'append' END AS action FROM pre),
  rew AS (SELECT doc_id, risk_id, action, CASE action WHEN 'keep' THEN sug WHEN 'candidate' THEN c WHEN 'replace' THEN tpl
     ELSE regexp_replace(o, '[。；;]+$', '') || '；' || tpl END AS revised,
     CASE action WHEN 'keep' THEN meth WHEN 'candidate' THEN 'llm' ELSE 'rule' END AS method,
     CASE action WHEN 'keep' THEN NULL WHEN 'candidate' THEN 0.9::DOUBLE WHEN 'replace' THEN 0.8::DOUBLE ELSE 0.72::DOUBLE END AS rewrite_confidence
     FROM act)"""


def _rewritten(t) -> DataFrame:
    c = F.col("category")
    risks = _risks(t)[0].withColumn("suggested_revision", F.when(F.col("level") == "low", F.col("title")).otherwise("")).withColumn(
        "candidate", F.when(c == "salary_deduction", F.concat("title", F.lit(" - as agreed"))).when(
            c == "probation_salary", '{"a": 1, "b": 2}').when(c == "probation_insurance", F.col("original_clause")).otherwise(
            "")).withColumn("revision_method", F.when(c == "leave_rights", "manual").otherwise(""))
    return K.rewrite_clauses(risks, latin.TEMPLATES, latin.DEFAULT_TEMPLATE, latin.CONFLICT_PATTERN)


@plan("k08_rewrite_clauses", f"WITH {REWRITES} SELECT * FROM rew")
def _(t):
    return _rewritten(t).select("doc_id", "risk_id", "action", "revised", "method", "rewrite_confidence")


@plan("k08_rewrite_counts", f"WITH {REWRITES} SELECT method, action, count(*) AS n FROM rew GROUP BY ALL")
def _(t):
    return K.rewrite_counts(_rewritten(t))


def _cut_sql(column: str, place: str) -> str:
    parts = f"list_filter(list_transform(str_split(regexp_replace({STRIP.format(column)}, '([.,])', '\\1' || chr(1), 'g'), chr(1)), lambda s: {STRIP.format('s')}), lambda s: length(s) > 0)"
    return f"""(SELECT *, row_number() OVER (PARTITION BY pair_id, sentence ORDER BY {place}) AS nth FROM
    (SELECT pair_id, unnest({parts}) AS sentence, (generate_subscripts({parts}, 1) - 1)::BIGINT AS {place} FROM pair))"""


@plan("k09_sentence_diff", f"""
WITH pair AS (SELECT doc_id AS pair_id, text AS before, replace(replace(text, ' the ', ' a '), ' de la ', ' du ') AS after FROM documents)
SELECT pair_id, sentence, old_pos, new_pos, CASE WHEN new_pos IS NULL THEN 'removed' WHEN old_pos IS NULL THEN 'added'
  ELSE 'kept' END AS change FROM {_cut_sql('before', 'old_pos')} FULL JOIN {_cut_sql('after', 'new_pos')}
  USING (pair_id, sentence, nth)""")
def _(t):
    after = F.replace(F.replace("text", F.lit(" the "), F.lit(" a ")), F.lit(" de la "), F.lit(" du "))
    return K.sentence_diff(t.documents.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("before"),
                                              after.alias("after")), marks=".,")


@plan("k10_attach_tips", f"""WITH {RISKS}
SELECT doc_id, risk_id, CASE WHEN level = 'high' THEN 'own tip' ELSE {map_sql('category', latin.TIPS, latin.DEFAULT_TIP)} END
  AS negotiation_tip FROM risk""")
def _(t):
    risks = _risks(t)[0].withColumn("negotiation_tip", F.when(F.col("level") == "high", "own tip").otherwise(""))
    return K.attach_tips(risks, latin.TIPS, latin.DEFAULT_TIP).select("doc_id", "risk_id", "negotiation_tip")


def _followup_sql() -> str:
    whens = " ".join(f"WHEN {quote(k)} THEN [{', '.join(map(quote, v))}]" for k, v in latin.FOLLOWUPS.items())
    return f"list_transform(cats, lambda c: CASE c {whens} ELSE [] END)"


@plan("k11_suggest_followups", f"""WITH {CLAUSES},
  q AS (SELECT doc_id, clause_id, list_concat(flatten({_followup_sql()}), [{', '.join(map(quote, latin.FALLBACK_FOLLOWUPS))}]) AS qs FROM clause),
  u AS (SELECT doc_id, clause_id, unnest(qs) AS q, generate_subscripts(qs, 1) AS i FROM q),
  f AS (SELECT doc_id, clause_id, q, min(i) AS i FROM u GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, clause_id ORDER BY i) AS rn FROM f)
SELECT doc_id, clause_id, string_agg(q, ' / ' ORDER BY i) AS suggestions FROM r WHERE rn <= 4 GROUP BY doc_id, clause_id""")
def _(t):
    return K.suggest_followups(categorized(t), latin.FOLLOWUPS, latin.FALLBACK_FOLLOWUPS).select(
        "doc_id", "clause_id", F.array_join("suggestions", " / ").alias("suggestions"))
