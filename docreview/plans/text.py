"""Text preparation and classification over the whole `documents` and `conversations` tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docreview.functions.scalars import half_up
from docreview.operators import retrieval as R
from docreview.operators import text as X
from docreview.packs import latin
from docreview.packs.latin import contains_any_sql, hit_count_sql, intent_hits_sql, quote
from docreview.plans.registry import plan

LATIN_SQL = r"[^\p{Latin}]"
SENTENCE = r"[.!?\n\r]+"


def _fix_sql(column: str) -> str:
    for wrong, right in latin.FIXES:
        column = f"replace({column}, {quote(wrong)}, {quote(right)})"
    return column


@plan("t01_clean_text", f"""
SELECT doc_id, original_length, md5(cleaned) AS cleaned_md5, length(cleaned) AS cleaned_length FROM
 (SELECT doc_id, length(text) AS original_length, regexp_replace(regexp_replace(regexp_replace(
    {_fix_sql('text')}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS cleaned
  FROM documents)""")
def _(t):
    return X.clean_text(t.documents, latin.FIXES).select("doc_id", "original_length", F.md5("cleaned").alias("cleaned_md5"),
                                                         "cleaned_length")


# DuckDB has no lookaround: runs of digits (for id numbers with a trailing X) are taken whole and judged by their form.
_RUNS = "array_to_string(list_transform(regexp_extract_all({0}, '{1}'), lambda x: CASE WHEN {2} THEN '{3}' ELSE x END), '')"
_PHONED = _RUNS.format("text", r"\d+|[^\d]+", r"regexp_full_match(x, '1[3-9]\d{9}')", "<phone>")
_NUMBERED = _RUNS.format("p", r"\d[\dxX]*|[^\d]+", r"regexp_full_match(x, '\d{17}[\dxX]')", "<id_number>")


@plan("t02_mask_pii", rf"""
SELECT doc_id, len(list_filter(regexp_extract_all(text, '\d+'), lambda x: regexp_full_match(x, '1[3-9]\d{{9}}'))) AS phone_hits,
  len(list_filter(regexp_extract_all(p, '\d[\dxX]*'), lambda x: regexp_full_match(x, '\d{{17}}[\dxX]'))) AS id_number_hits,
  len(regexp_extract_all(i, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')) AS email_hits,
  md5(regexp_replace(i, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '<email>', 'g')) AS masked_md5
FROM (SELECT *, {_NUMBERED} AS i FROM (SELECT doc_id, text, {_PHONED} AS p FROM documents))""")
def _(t):
    return X.mask_pii(t.documents).select("doc_id", "phone_hits", "id_number_hits", "email_hits", F.md5("masked").alias("masked_md5"))


EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@plan("t02_mask_email", f"""
SELECT doc_id, len(regexp_extract_all(text, '{EMAIL_SQL}')) AS email_hits,
       len(text) - len(regexp_replace(text, '{EMAIL_SQL}', '', 'g')) AS email_chars FROM documents""")
def _(t):
    return X.mask_pii(t.documents).select("doc_id", "email_hits", (
        F.length("text") - F.length(F.regexp_replace("text", X.EMAIL, ""))).cast("long").alias("email_chars"))


@plan("t03_text_quality", f"""
SELECT doc_id, length(text) AS n, length(text) > 100000 AS truncated,
  round(len(regexp_extract_all(text, '[\\x{{fffd}}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) / length(text) + 1e-9, 4) AS bad_ratio,
  round(length(regexp_replace(text, '{LATIN_SQL}', '', 'g')) / length(text) + 1e-9, 4) AS script_ratio FROM documents""")
def _(t):
    return X.text_quality(t.documents).select("doc_id", "n", "truncated", half_up(F.col("bad_ratio")).alias("bad_ratio"),
                                              half_up(F.col("script_ratio")).alias("script_ratio"))


def _group_sql(name: str, words) -> str:
    found = "list_filter([" + ", ".join(quote(w) for w in words) + "], lambda w: contains(lower(text), w))"
    return f"SELECT doc_id, '{name}' AS word_group, len({found}) AS hits, array_to_string(list_slice({found}, 1, 4), ', ') AS sample FROM documents"


@plan("t04_lexicon_hits", " UNION ALL ".join(_group_sql(n, w) for n, w in latin.LEXICON.items()))
def _(t):
    return X.lexicon_hits(t.documents, latin.LEXICON)


CLASSIFY = f"""
WITH b AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents),
 m AS (SELECT doc_id, length(body) AS n,
   len(regexp_extract_all(body, '[\\x{{fffd}}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) / greatest(1, length(body)) AS bad,
   length(regexp_replace(body, '{LATIN_SQL}', '', 'g')) / greatest(1, length(body)) AS script,
   {', '.join(f"{hit_count_sql('lower(body)', words)} AS {name}" for name, words in latin.LEXICON.items())},
   len(regexp_extract_all(body, '\\|')) + len(regexp_extract_all(body, '(?m)^\\s*\\d+(?:\\.\\d+)+\\s')) AS clauses,
   len(regexp_extract_all(lower(body), 'https?://')) AS urls FROM b),
 s AS (SELECT *, 2 * least(party, 3) + least(struct, 3) + 2 * least(sign, 2) + least(oblige, 3) + least(clauses, 5) AS score
       FROM m),
 k AS (SELECT *, score >= 8 AND party > 0 AS full_,
   score >= 4 AND party > 0 AND (struct > 0 OR clauses > 0 OR sign > 0) AS part_ FROM s),
 r AS (SELECT *, CASE WHEN n = 0 THEN 1 WHEN n < 80 THEN 2 WHEN bad > 0.15 THEN 3 WHEN script < 0.15 THEN 4
   WHEN resume >= 3 AND party = 0 THEN 5 WHEN invoice >= 3 AND party = 0 THEN 6 WHEN privacy >= 2 AND party = 0 THEN 7
   WHEN news >= 3 OR (news >= 2 AND urls >= 3) THEN 8 WHEN novel >= 4 AND party = 0 THEN 9
   WHEN full_ AND labor >= 3 THEN 10 WHEN full_ AND service >= 2 THEN 11 WHEN full_ THEN 12
   WHEN part_ AND labor >= 3 THEN 13 WHEN part_ THEN 14 WHEN noise >= 5 OR urls >= 8 THEN 15 ELSE 16 END AS rule FROM k),
 c AS (SELECT doc_id, score, rule,
   ['garbage','garbage','garbage','foreign_script','resume','invoice','privacy_policy','news_article','novel',
    'labor_contract','service_agreement','other_contract','labor_contract','other_contract','news_article','unknown'][rule] AS doc_type,
   CASE WHEN rule BETWEEN 10 AND 12 THEN round(least(0.98, 0.55 + 0.02 * score), 2) ELSE
   [0.95,0.9,0.85,0.75,0.85,0.85,0.8,0.8,0.75,0,0,0,0.55,0.55,0.7,0.4][rule]::DOUBLE END AS confidence,
   rule BETWEEN 10 AND 14 AS is_contract FROM r)
SELECT doc_id, doc_type, score::BIGINT AS score, confidence::DOUBLE AS confidence, is_contract, is_contract AS admitted,
  CASE WHEN is_contract AND confidence >= 0.8 THEN NULL
       ELSE CASE WHEN is_contract THEN 'partly ' ELSE '' END || 'recognised as ' || doc_type || ' (' ||
            round(confidence * 100)::INTEGER || '%)' END AS notice FROM c"""


@plan("t05_classify_documents", CLASSIFY)
def _(t):
    return X.classify_documents(t.documents, latin.LEXICON, clause_pattern=latin.CLAUSE_NUMBER).select(
        "doc_id", "doc_type", "score", "confidence", "is_contract", "admitted", "notice")


RULE_SET_SQL = latin.category_sql("left(text, 200)", latin.RULE_SET_MARKERS, quote(latin.DEFAULT_RULE_SET))


@plan("t08_infer_rule_set", f"SELECT doc_id, {RULE_SET_SQL} AS rule_set FROM documents")
def _(t):
    return X.infer_rule_set(t.documents, latin.RULE_SET_MARKERS, latin.DEFAULT_RULE_SET).select("doc_id", "rule_set")


@plan("t08_requested_rule_set", f"""
SELECT doc_id, CASE WHEN source = 'src1' THEN {RULE_SET_SQL} WHEN source = 'src2' THEN 'licensed'
  ELSE 'general' END AS rule_set FROM documents""")
def _(t):
    asked = t.documents.withColumn("wish", F.when(F.col("source") == "src1", " AUTO ").when(
        F.col("source") == "src2", "Licensed").otherwise("no such set"))
    return X.infer_rule_set(asked, latin.RULE_SET_MARKERS, latin.DEFAULT_RULE_SET, requested="wish",
                            known=tuple(latin.RULE_SETS)).select("doc_id", "rule_set")


LINES = """(SELECT doc_id, unnest(str_split(text, chr(10))) AS line,
                   generate_subscripts(str_split(text, chr(10)), 1) AS pos FROM documents)"""


@plan("t09_split_clauses", f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS clause_id, left(trim(line), 50) AS title,
       trim(line) AS content FROM {LINES} WHERE trim(line) <> ''""")
def _(t):
    return X.split_clauses(t.documents, "\n")


_SQL_TRIM = "regexp_replace({}, '^[\\s]+|[\\s]+$', '', 'g')"
CHUNKS = f"""
WITH RECURSIVE clean AS (SELECT doc_id, source AS title, {_SQL_TRIM.format("regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g')")} AS c FROM documents),
  unit AS (SELECT doc_id, unnest(regexp_split_to_array(c, '\\n\\s*\\n+')) AS u, generate_subscripts(regexp_split_to_array(c, '\\n\\s*\\n+'), 1) AS i FROM clean),
  part AS (SELECT doc_id, i, CASE WHEN length({_SQL_TRIM.format('u')}) <= 700 THEN [{_SQL_TRIM.format('u')}]
     ELSE str_split(regexp_replace(regexp_replace({_SQL_TRIM.format('u')}, '([.!?])\\s+', '\\1' || chr(2), 'g'), '\\n', chr(2), 'g'), chr(2)) END AS ps FROM unit),
  flat AS (SELECT doc_id, i, generate_subscripts(ps, 1) AS j, unnest(ps) AS raw FROM part),
  pc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k, {_SQL_TRIM.format('raw')} AS p FROM flat WHERE {_SQL_TRIM.format('raw')} <> ''),
  st AS (SELECT doc_id, 0::BIGINT AS k, ''::VARCHAR AS buf, 0::BIGINT AS s, 0::BIGINT AS e, NULL::VARCHAR AS done, 0::BIGINT AS ds, 0::BIGINT AS de FROM clean WHERE c <> ''
     UNION ALL SELECT doc_id, k, CASE WHEN buf = '' THEN p WHEN brim THEN right(buf, 120) || chr(10) || p ELSE cand END,
       CASE WHEN buf = '' OR brim THEN here ELSE s END, here + length(p), CASE WHEN brim THEN buf END, s, e FROM
      (SELECT *, buf <> '' AND length(cand) > 700 AS brim FROM
        (SELECT st.doc_id, pc.k, st.buf, st.s, st.e, p, st.e + strpos(substr(c, st.e + 1), p) - 1 AS here,
           CASE WHEN buf = '' THEN p ELSE {_SQL_TRIM.format('buf || chr(10) || p')} END AS cand
         FROM st JOIN pc ON pc.doc_id = st.doc_id AND pc.k = st.k + 1 JOIN clean ON clean.doc_id = st.doc_id))),
  rows AS (SELECT doc_id, k, done AS text, ds AS s, de AS e FROM st WHERE done IS NOT NULL UNION ALL
     SELECT doc_id, k + 1, buf, s, e FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS rn FROM st) WHERE rn = 1)
SELECT doc_id, doc_id || ':' || lpad(ix::VARCHAR, greatest(4, length(ix::VARCHAR))::INTEGER, '0') AS chunk_id, ix AS chunk_index, text, s AS start, e AS "end", title
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ix FROM rows) JOIN clean USING (doc_id)"""


@plan("t10_chunk_documents", CHUNKS)
def _(t):
    return X.chunk_documents(t.documents.select("doc_id", "text", "source"), title="source",
                             cut_at=r"(?<=[.!?])\s+|\n")


SENTENCES = f"""(SELECT doc_id, trim(s) AS sentence, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM
  (SELECT doc_id, unnest(regexp_split_to_array(text, '{SENTENCE}')) AS s,
          generate_subscripts(regexp_split_to_array(text, '{SENTENCE}'), 1) AS i FROM documents)
  WHERE length(trim(s)) >= 4)"""


@plan("t11_split_sentences", f"SELECT doc_id, pos, sentence FROM {SENTENCES}")
def _(t):
    return X.split_sentences(t.documents, SENTENCE)


@plan("t12_extract_trigger_query", f"""
WITH s AS {SENTENCES},
 f AS (SELECT doc_id, min(pos) AS first FROM s WHERE {contains_any_sql('sentence', latin.TRIGGERS)} GROUP BY doc_id),
 w AS (SELECT s.doc_id, s.pos, s.sentence, coalesce(sum(length(sentence)) OVER (PARTITION BY s.doc_id ORDER BY pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s JOIN f USING (doc_id)
       WHERE s.pos BETWEEN first AND first + 4),
 q AS (SELECT doc_id, string_agg(sentence, '' ORDER BY pos) AS query FROM w WHERE before < 60 GROUP BY doc_id),
 z AS (SELECT doc_id, string_agg(sentence, '' ORDER BY pos) AS query FROM s WHERE pos < 2 GROUP BY doc_id)
SELECT d.doc_id, left(coalesce(q.query, z.query, ''), 160) AS query
FROM documents d LEFT JOIN q USING (doc_id) LEFT JOIN z USING (doc_id)""")
def _(t):
    return X.extract_trigger_query(t.documents, latin.TRIGGERS, SENTENCE).select("doc_id", "query")


def matched_sql(column: str) -> str:
    parts = ", ".join(f"CASE WHEN {contains_any_sql(column, words)} THEN {quote(name)} END"
                      for name, words in latin.CATEGORY_RULES)
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


CATEGORIZED = f"""(SELECT doc_id, clause_id, content, {matched_sql("title || ' ' || content")} AS cats FROM
  (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS clause_id, left(trim(line), 50) AS title,
          trim(line) AS content FROM {LINES} WHERE trim(line) <> ''))"""


@plan("t13_categorize_clauses", f"""
SELECT doc_id, clause_id, array_to_string(cats, ',') AS categories, cats[1] AS primary_category FROM {CATEGORIZED}""")
def _(t):
    return X.categorize_clauses(X.split_clauses(t.documents, "\n"), latin.CATEGORY_RULES).select(
        "doc_id", "clause_id", F.array_join("categories", ",").alias("categories"), "primary_category")


@plan("t14_category_of", f"SELECT item_id, {latin.category_sql('text')} AS category FROM benchmark")
def _(t):
    return X.category_of(t.benchmark, latin.CATEGORY_RULES).select("item_id", "category")


@plan("t15_split_articles", """
WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(text, '<[^>]+>', chr(10), 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
    '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&'), '[ \\t\\r\\f\\x0b\\x{a0}]+', '', 'g'), '\\n+', chr(10), 'g') AS plain
  FROM documents),
 a AS (SELECT doc_id, unnest(regexp_extract_all(plain, '(\\d+\\.\\d+)([^0-9]*)', 1)) AS number,
       unnest(regexp_extract_all(plain, '(\\d+\\.\\d+)([^0-9]*)', 2)) AS body,
       generate_subscripts(regexp_extract_all(plain, '(\\d+\\.\\d+)([^0-9]*)', 1), 1) AS i FROM d)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, number,
       regexp_replace(body, '\\s+', '', 'g') AS content FROM a WHERE regexp_replace(body, '\\s+', '', 'g') <> ''""")
def _(t):
    return X.split_articles(t.documents, latin.HEADING_PATTERN)


INTENT_HITS = ", ".join(f"{intent_hits_sql('text', words)} AS {name}" for name, words in latin.INTENTS)
NAMES = [name for name, _ in latin.INTENTS]
INTENT = f"""(SELECT *, greatest({', '.join(NAMES)}) AS m FROM (SELECT conv_id, turn, text, {INTENT_HITS}
  FROM conversations WHERE role = 'user'))"""


@plan("t16_classify_intent", f"""
SELECT conv_id, turn, CASE WHEN m = 0 THEN 'unknown' {' '.join(f"WHEN {n} = m THEN '{n}'" for n in NAMES)} END AS intent,
  CASE WHEN m = 0 THEN 0.0 ELSE round(least(1.0, 0.45 + 0.2 * m), 2) END::DOUBLE AS confidence, m > 0 AS adopted
FROM {INTENT}""")
def _(t):
    users = t.conversations.filter(F.col("role") == "user")
    return X.classify_intent(users, latin.INTENTS).select("conv_id", "turn", "intent", "confidence", "adopted")


@plan("t17_extract_obligations", f"""
SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '{latin.DATE_PATTERN}'), 1, 10), ';') AS dates,
  array_to_string(list_slice(regexp_extract_all(text, '{latin.AMOUNT_PATTERN}'), 1, 10), ';') AS amounts,
  array_to_string(list_filter([{', '.join(f"CASE WHEN contains(text, {quote(k)}) THEN {quote(v)} END" for k, v in latin.OBLIGATIONS)}],
    lambda x: x IS NOT NULL), ';') AS obligations, contains(text, 'icensed') AS auto_renewal FROM documents""")
def _(t):
    found = X.extract_obligations(t.documents, latin.OBLIGATIONS, latin.DATE_PATTERN, latin.AMOUNT_PATTERN, "icensed")
    return found.select("doc_id", *[F.array_join(c, ";").alias(c) for c in ("dates", "amounts", "obligations")],
                        "auto_renewal")


PHRASES = ("of the", "de la", "in the")


@plan("t18_tokenize", f"""
WITH w AS (SELECT doc_id, lower(text) AS low, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS words FROM documents)
SELECT doc_id, len(tok) AS n_tokens, md5(array_to_string(tok, ' ')) AS tokens_md5 FROM (SELECT doc_id,
  list_concat(words, list_filter([{', '.join(quote(p) for p in PHRASES)}], lambda p: contains(low, p)
    AND NOT list_contains(words, p))) AS tok FROM w)""")
def _(t):
    return t.documents.select("doc_id", R.tokens(F.col("text"), PHRASES).alias("tok")).select(
        "doc_id", F.size("tok").cast("long").alias("n_tokens"), F.md5(F.array_join("tok", " ")).alias("tokens_md5"))
