"""Retrieval queries: embeddings are paired with documents on vec_id = doc_id, benchmark passages ask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreview.operators import retrieval as R
from docreview.operators import text as X
from docreview.packs import latin
from docreview.plans.registry import plan
from docreview.session import cut_lineage

TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def bm25_sql(docs: str, asks: str, score: str = "sc") -> str:
    """CTEs ending in `<score>(query_id, doc_id, score)` for relations docs(doc_id, text) and asks(query_id, text)."""
    return f"""
  p AS (SELECT doc_id, term, count(*) AS tf FROM
        (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM {docs}) GROUP BY ALL),
  dl AS (SELECT doc_id, sum(tf)::DOUBLE AS dl FROM p GROUP BY doc_id),
  st AS (SELECT (SELECT count(*) FROM {docs})::DOUBLE AS n,
                (SELECT sum(tf) FROM p)::DOUBLE / (SELECT count(*) FROM {docs}) AS avgdl),
  tm AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM
         (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term), st),
  mi AS (SELECT avg(idf) AS m FROM tm),
  wt AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM tm, mi),
  q AS (SELECT query_id, term, count(*) AS qtf FROM
        (SELECT query_id, unnest({TOK.format('text')}) AS term FROM {asks}) GROUP BY ALL),
  {score} AS (SELECT query_id, doc_id,
         sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
         FROM q JOIN wt USING (term) JOIN p USING (term) JOIN dl USING (doc_id), st
         GROUP BY query_id, doc_id HAVING score > 0)"""


def cut_sql(name: str, source: str, k: int, keys: str = "query_id", clamped: bool = False) -> str:
    score = CLAMPED.format("round(score, 4)") if clamped else "round(score, 4)"
    return f"""
  {name} AS (SELECT query_id, doc_id, {score} AS score, rank FROM
    (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 8) DESC, doc_id) AS rank FROM {source})
    WHERE rank <= {k})"""


COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
CLAMPED = "greatest(0.0, least(1.0, {}))"
"""Applied after the ranking, which goes by the cosine itself."""

CENTROIDS = """
  centroid AS (SELECT label, list(v ORDER BY pos) AS embedding FROM
    (SELECT label, pos, avg(v) AS v FROM
      (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
     GROUP BY label, pos) GROUP BY label)"""


def _vectors(t) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("category"))


def _centroids(t) -> DataFrame:
    """One query per label: the mean of its vectors."""
    flat = t.embeddings.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(
        F.avg(F.col("col").cast("double")).alias("v"))
    return flat.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("pv")).select(
        F.col("label").alias("query_id"), F.col("pv.v").alias("embedding"))


@plan("r01_normalize_vectors", """
SELECT vec_id, pos::INTEGER AS pos, round(v / sqrt(n2), 4) AS value FROM
  (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos,
          list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n2 FROM embeddings)""")
def _(t):
    unit = R.normalize_vectors(t.embeddings.select("vec_id", "embedding"))
    return unit.select("vec_id", F.posexplode("embedding")).select("vec_id", "pos", F.round("col", 4).alias("value"))


CENTROID_TOPK = f"""
WITH {CENTROIDS},
  sc AS (SELECT a.label AS query_id, b.vec_id AS doc_id, {COSINE} AS score FROM centroid a, embeddings b),
  {cut_sql('c', 'sc', 10, clamped=True)}
SELECT query_id, doc_id, score, rank FROM c"""


@plan("r02_vector_topk", CENTROID_TOPK)
def _(t):
    return R.vector_topk(_centroids(t), _vectors(t), 10)


@plan("r02_vector_topk_in_category", f"""
WITH {CENTROIDS},
  sc AS (SELECT a.label AS query_id, b.vec_id AS doc_id, {COSINE} AS score FROM centroid a, embeddings b
         WHERE b.label = 3),
  {cut_sql('c', 'sc', 5, clamped=True)}
SELECT query_id, doc_id, score, rank FROM c""")
def _(t):
    return R.vector_topk(_centroids(t), _vectors(t), 5, category=3)


@plan("r02_vector_topk_by_cells", CENTROID_TOPK)
def _(t):
    return R.cells_topk(_centroids(t), R.build_cells(_vectors(t), nlist=16), 10)


@plan("r03_ivf_full_probe", CENTROID_TOPK)
def _(t):
    return R.ivf_topk(_centroids(t), R.build_cells(_vectors(t), nlist=16), 10, nprobe=16)


OPPOSED = f"""
WITH {CENTROIDS}, q AS (SELECT label, list_transform(embedding, lambda x: -x) AS embedding FROM centroid),
  sc AS (SELECT a.label AS query_id, b.vec_id AS doc_id, {COSINE} AS score FROM q a, embeddings b WHERE b.label <> 3),
  {cut_sql('c', 'sc', 200, clamped=True)}
SELECT query_id, doc_id, score, rank FROM c"""


def _opposed(t) -> DataFrame:
    return _centroids(t).withColumn("embedding", F.transform("embedding", lambda x: -x))


@plan("r02_vector_topk_opposed", OPPOSED)
def _(t):
    return R.vector_topk(_opposed(t), _vectors(t).filter("category <> 3"), 200)


@plan("r02_vector_topk_opposed_by_cells", OPPOSED)
def _(t):
    return R.cells_topk(_opposed(t), R.build_cells(_vectors(t).filter("category <> 3"), nlist=16), 200)


@plan("r03_ivf_topk", "SELECT DISTINCT label AS query_id, true AS enough FROM embeddings")
def _(t):
    """Recall of the approximate search: at least half of the ten nearest for each query, nine tenths on the whole."""
    near = R.ivf_topk(_centroids(t), R.build_cells(_vectors(t)), 10, nprobe=8).select("query_id", "doc_id", F.lit(1).alias("hit"))
    exact = R.vector_topk(_centroids(t), _vectors(t), 10).select("query_id", "doc_id")
    per_query = exact.join(near, ["query_id", "doc_id"], "left").groupBy("query_id").agg(
        F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    overall = per_query.agg(F.avg("recall")).scalar()
    return per_query.select("query_id", ((F.col("recall") >= 0.5) & (overall >= 0.9)).alias("enough"))


def _docs(t) -> DataFrame:
    return t.documents.select("doc_id", "text")


def _asks(t) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


ASKS = "(SELECT item_id AS query_id, text FROM benchmark)"


@plan("r04_bm25_postings", f"""
WITH p AS (SELECT doc_id, term, count(*) AS tf FROM
   (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY ALL)
SELECT doc_id, (sum(tf) OVER (PARTITION BY doc_id))::BIGINT AS dl, term, tf FROM p""")
def _(t):
    return R.bm25_index(_docs(t)).postings


@plan("r04_bm25_terms", f"""
WITH p AS (SELECT DISTINCT doc_id, unnest({TOK.format('text')}) AS term FROM documents)
SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM documents) - count(*) + 0.5) - ln(count(*) + 0.5), 4) AS idf
FROM p GROUP BY term""")
def _(t):
    return R.bm25_index(_docs(t)).terms.withColumn("idf", F.round("idf", 4))


@plan("r04_bm25_stats", f"""
SELECT count(*) AS n_docs, round(avg(len({TOK.format('text')})), 4) AS avgdl FROM documents""")
def _(t):
    return R.bm25_index(_docs(t)).stats.withColumn("avgdl", F.round("avgdl", 4))


@plan("r05_bm25_topk", f"""
WITH {bm25_sql('documents', ASKS)}, {cut_sql('c', 'sc', 5)}
SELECT query_id, doc_id, score, rank FROM c""")
def bm25_top5(t):
    return R.bm25_topk(_asks(t), R.bm25_index(_docs(t)), 5)


PAIRS = """flatten(list_transform(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), lambda w: CASE WHEN length(w) < 2 THEN [w]
  ELSE list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) END))"""


@plan("r05_bm25_topk_bigrams", f"""
WITH {bm25_sql('documents', ASKS).replace(TOK.format('text'), PAIRS.format('text'))}, {cut_sql('c', 'sc', 5)}
SELECT query_id, doc_id, score, rank FROM c""")
def _(t):
    return R.bm25_topk(_asks(t), R.bm25_index(_docs(t), tokenizer=R.Tokenizer(bigrams=True)), 5)


@plan("r05_bm25_topk_in_category", f"""
WITH {bm25_sql('documents', ASKS)},
  f AS (SELECT sc.* FROM sc WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')), {cut_sql('c', 'f', 5)}
SELECT query_id, doc_id, score, rank FROM c""")
def _(t):
    return R.bm25_topk(_asks(t), R.bm25_index(_docs(t)), 5, category="en",
                       categories=t.documents.select("doc_id", F.col("lang").alias("category")))


N = 5
POOL = 15
CHANNELS = f"""
  vs AS (SELECT i.item_id AS query_id, b.vec_id AS doc_id, {COSINE} AS score
         FROM benchmark i JOIN embeddings a ON a.vec_id = i.item_id, embeddings b),
  {cut_sql('vc', 'vs', POOL, clamped=True)},
  {bm25_sql('documents', ASKS)}, {cut_sql('bc', 'sc', POOL)},
  ch AS (SELECT *, 'vector' AS channel, 0 AS priority FROM vc UNION ALL
         SELECT *, 'bm25' AS channel, 1 AS priority FROM bc)"""
FUSED = f"""
  fz AS (SELECT query_id, doc_id, fusion_rrf, channels, pos FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion_rrf, 10) DESC, pri, rnk, doc_id) AS pos
     FROM (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS fusion_rrf,
                  string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels,
                  min(priority) AS pri, arg_min(rank, priority) AS rnk
           FROM ch GROUP BY query_id, doc_id)) WHERE pos <= {POOL})"""
SIMILAR = """
  un AS (SELECT query_id, doc_id, CASE channel WHEN 'vector' THEN 0.65 ELSE 0.35 END AS w,
           greatest(0.0, least(1.0, CASE WHEN mx > 1 THEN score / mx ELSE score END)) AS s FROM
         (SELECT *, max(score) OVER (PARTITION BY query_id, channel) AS mx FROM ch WHERE score > 0)),
  pd AS (SELECT query_id, doc_id, sum(w * s) / sum(w) AS mean, count(*) AS n FROM un GROUP BY query_id, doc_id),
  sm AS (SELECT fz.*, round(greatest(0.0, least(1.0, CASE WHEN n IS NULL THEN 1.0 / (pos + 1)
           WHEN n = 1 THEN mean * 0.85 ELSE mean END)) + 1e-9, 4) AS similarity
         FROM fz LEFT JOIN pd USING (query_id, doc_id))"""


def rerank_sql(candidates: str, k: int, out: str = "rr") -> str:
    """`candidates(query_id, doc_id, pos, similarity, query_text, title, text)` -> the reranked rows."""
    return f"""
  cv AS (SELECT *, len(list_filter(toks, lambda x: contains(lower(title || ' ' || text), x))) / greatest(1, len(toks)) AS coverage,
                len(list_filter(toks, lambda x: contains(lower(title), x))) / greatest(1, len(toks)) AS title_hits FROM
         (SELECT *, list_distinct(list_filter({TOK.format('query_text')}, lambda x: length(x) > 1)) AS toks
          FROM {candidates})),
  rs AS (SELECT *, round(0.75 * rerank_score + 0.25 * similarity + 1e-9, 4) AS final_score FROM
         (SELECT *, round(least(1.0, 0.58 * similarity + 0.30 * coverage + 0.12 * title_hits) + 1e-9, 4) AS rerank_score FROM cv)),
  {out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
             ORDER BY final_score DESC, pos, doc_id) AS final_rank FROM rs)
         WHERE final_rank <= {k} AND final_score >= 0.05)"""


HYBRID = f"""WITH {CHANNELS}, {FUSED}, {SIMILAR},
  cand AS (SELECT sm.*, b.text AS query_text, d.source || ' ' || d.lang AS title, d.text FROM sm
           JOIN benchmark b ON b.item_id = sm.query_id JOIN documents d USING (doc_id)),
  {rerank_sql('cand', N)}"""


def _hybrid_asks(t) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    return _asks(t).join(vectors, "query_id", "left")


def _hybrid_corpus(t) -> DataFrame:
    return t.documents.select("doc_id", F.concat_ws(" ", "source", "lang").alias("title"), "text")


def _channels(t) -> DataFrame:
    asks = _hybrid_asks(t)
    vector = R.tag_channel(R.vector_topk(asks, _vectors(t), POOL), "vector", 0)
    return cut_lineage(vector.unionByName(R.tag_channel(R.bm25_topk(asks, R.bm25_index(_docs(t)), POOL), "bm25", 1)))


@plan("r06_rrf_fuse", f"""WITH {CHANNELS}, {FUSED}
SELECT query_id, doc_id, round(fusion_rrf, 4) AS fusion_rrf, channels, pos FROM fz""")
def _(t):
    return R.rrf_fuse(_channels(t), POOL).withColumn("fusion_rrf", F.round("fusion_rrf", 4))


@plan("r07_fused_similarity", f"""WITH {CHANNELS}, {FUSED}, {SIMILAR}
SELECT query_id, doc_id, channels, pos, similarity FROM sm""")
def _(t):
    channels = _channels(t)
    return R.fused_similarity(channels, R.rrf_fuse(channels, POOL)).drop("fusion_rrf")


@plan("r08_rerank", f"""{HYBRID}
SELECT query_id, doc_id, pos, round(coverage, 4) AS coverage, round(title_hits, 4) AS title_hits, rerank_score,
       final_score, final_rank FROM rr""")
def _(t):
    channels = _channels(t)
    fused = R.fused_similarity(channels, R.rrf_fuse(channels, POOL))
    pool = R.fetch_texts(fused.join(_asks(t).withColumnRenamed("text", "query_text"), "query_id"), _hybrid_corpus(t))
    return R.rerank(pool, N).select("query_id", "doc_id", "pos", F.round("coverage", 4).alias("coverage"),
                                    F.round("title_hits", 4).alias("title_hits"), "rerank_score", "final_score",
                                    "final_rank")


@plan("r09_hybrid_search", f"""{HYBRID}
SELECT query_id, doc_id, channels, similarity, rerank_score, final_score, final_rank FROM rr""")
def hybrid(t):
    found = R.hybrid_search(_hybrid_asks(t), _hybrid_corpus(t), N, R.bm25_index(_docs(t)), _vectors(t))
    return found.select("query_id", "doc_id", "channels", "similarity", "rerank_score", "final_score", "final_rank")


# The passages of `benchmark` as the reference corpus, every line of every document as a clause.
STATUTES = f"""
  statute AS (SELECT item_id AS doc_id, 'passage ' || item_id AS title, text, {latin.category_sql('text')} AS category
              FROM benchmark)"""
CLAUSES = f"""
  clause AS (SELECT doc_id, clause_id, left(content, 50) AS title, content, {latin.category_sql("content")} AS category
    FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS clause_id, trim(line) AS content FROM
      (SELECT doc_id, unnest(str_split(text, chr(10))) AS line,
              generate_subscripts(str_split(text, chr(10)), 1) AS pos FROM documents)
      WHERE trim(line) <> ''))"""


def _statutes(t) -> DataFrame:
    return X.category_of(t.benchmark.select(F.col("item_id").alias("doc_id"), F.concat(
        F.lit("passage "), F.col("item_id").cast("string")).alias("title"), "text"), latin.CATEGORY_RULES)


def _clauses(t) -> DataFrame:
    return X.category_of(X.split_clauses(_docs(t), "\n"), latin.CATEGORY_RULES, text="content")


def attempt_sql(name: str, hits: str) -> str:
    """One clause retrieval pass over `hits(query_id, doc_id, score)` with single-channel similarity."""
    return f"""
  {name}c AS (SELECT query_id, doc_id, round(score, 4) AS score, rank FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM {hits})
    WHERE rank <= 9),
  {name}s AS (SELECT query_id, doc_id, rank AS pos, round(0.85 * greatest(0.0, least(1.0,
      CASE WHEN mx > 1 THEN score / mx ELSE score END)) + 1e-9, 4) AS similarity FROM
      (SELECT *, max(score) OVER (PARTITION BY query_id) AS mx FROM {name}c WHERE score > 0)),
  {name}k AS (SELECT {name}s.*, a.text AS query_text, s.title, s.text FROM {name}s JOIN ask a USING (query_id)
      JOIN statute s USING (doc_id)),
  {rerank_sql(name + 'k', 3, name + 'r').replace('  cv AS', f'  {name}cv AS').replace('FROM cv', f'FROM {name}cv').replace('  rs AS', f'  {name}rs AS').replace('FROM rs', f'FROM {name}rs')}"""


@plan("r10_retrieve_for_clauses", f"""
WITH {STATUTES}, {CLAUSES},
  ask AS (SELECT doc_id || ':' || clause_id AS query_id, doc_id AS d, clause_id AS c,
                 title || ' ' || left(content, 200) AS text, category FROM clause),
  {bm25_sql('statute', 'ask')},
  inside AS (SELECT sc.query_id, sc.doc_id, score FROM sc JOIN ask USING (query_id) JOIN statute s USING (doc_id)
             WHERE ask.category = s.category),
  {attempt_sql('one_', 'inside')},
  thin AS (SELECT query_id FROM ask LEFT JOIN (SELECT query_id, count(*) AS n FROM one_r GROUP BY query_id) USING (query_id)
           WHERE coalesce(n, 0) < 2),
  wide AS (SELECT sc.* FROM sc WHERE query_id IN (SELECT query_id FROM thin)),
  {attempt_sql('two_', 'wide')},
  allr AS (SELECT *, 1 AS attempt FROM one_r UNION ALL SELECT *, 2 AS attempt FROM two_r),
  kept AS (SELECT * FROM (SELECT d AS doc_id, c AS clause_id, allr.doc_id AS ref_id, similarity, final_score, attempt,
             final_rank, row_number() OVER (PARTITION BY d, allr.doc_id ORDER BY c, attempt, final_rank) AS rn
           FROM allr JOIN ask USING (query_id)) WHERE rn = 1)
SELECT doc_id, clause_id, ref_id, similarity, final_score, attempt::INTEGER AS attempt, final_rank,
  row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, clause_id, attempt, final_rank, ref_id) AS position
FROM kept""")
def _(t):
    statutes = _statutes(t)
    index = R.bm25_index(statutes.select("doc_id", "text"))
    return R.retrieve_for_clauses(_clauses(t), statutes, index)


def _question_key():
    return F.concat_ws("/", "conv_id", "turn").alias("query_id")


QUESTIONS = f"""
  question AS (SELECT conv_id || '/' || turn AS query_id, text FROM conversations WHERE role = 'user'
     AND NOT ({latin.intent_is_sql('text', 'chitchat', 0.6)}))"""


@plan("r11_retrieve_for_questions", f"""
WITH {STATUTES}, {QUESTIONS},
  ask AS (SELECT * FROM question),
  {bm25_sql('statute', 'question')},
  {attempt_sql('one_', 'sc').replace('rank <= 9', 'rank <= 12').replace('final_rank <= 3', 'final_rank <= 4')}
SELECT query_id, doc_id AS ref_id, similarity, final_score,
       row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, final_rank) AS position FROM one_r""")
def _(t):
    users = t.conversations.filter(F.col("role") == "user").select(_question_key(), "text")
    statutes = _statutes(t)
    return R.retrieve_for_questions(users, statutes, R.bm25_index(statutes.select("doc_id", "text")),
                                    latin.INTENTS, chitchat="chitchat")


def finger_sql(columns: str, source: str) -> str:
    lane = lambda a: f"sum(('0x' || substr(h, {a}, 15))::BIGINT)::VARCHAR"
    return f"""(SELECT left(h, 2) AS bucket, count(*) AS n_rows, {lane(1)} AS lane1, {lane(16)} AS lane2 FROM
    (SELECT sha256(to_json([{', '.join(f'{c}::VARCHAR' for c in columns.split(', '))}])) AS h FROM {source}) GROUP BY 1)"""


PART_KEYS = ["p_partkey", "p_name", "p_brand", "p_type"]
EDITED = "(SELECT * REPLACE (CASE WHEN p_size > 49 THEN 'Brand#0' ELSE p_brand END AS p_brand) FROM part)"


@plan("r13_corpus_fingerprint", f"SELECT * FROM {finger_sql(', '.join(PART_KEYS), 'part')}")
def _(t):
    return R.corpus_fingerprint(t.part, PART_KEYS)


@plan("r13_index_drift", f"""
SELECT bucket, coalesce(o.n_rows, 0) AS old_rows, coalesce(w.n_rows, 0) AS new_rows
FROM {finger_sql(', '.join(PART_KEYS), 'part')} o FULL JOIN {finger_sql(', '.join(PART_KEYS), EDITED)} w USING (bucket)
WHERE o.n_rows IS DISTINCT FROM w.n_rows OR o.lane1 IS DISTINCT FROM w.lane1 OR o.lane2 IS DISTINCT FROM w.lane2""")
def _(t):
    edited = t.part.withColumn("p_brand", F.when(F.col("p_size") > 49, "Brand#0").otherwise(F.col("p_brand")))
    return R.index_drift(R.corpus_fingerprint(t.part, PART_KEYS), R.corpus_fingerprint(edited, PART_KEYS))
