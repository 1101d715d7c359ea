"""State over the event table: users are keys, event types are kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreview.functions.scalars import numbered
from docreview.operators import retrieval as R
from docreview.operators import state as W
from docreview.packs import latin
from docreview.plans import evaluation as PE
from docreview.plans import retrieval as PR
from docreview.plans import review as PV
from docreview.plans.registry import plan

EV = "(SELECT user_id AS key, event_type AS kind, event_id AS id, ts, value FROM events)"
K = "(props->>'$.k')::BIGINT"


def _events(t) -> DataFrame:
    return t.events.select(F.col("user_id").alias("key"), F.col("event_type").alias("kind"), F.col("event_id").alias("id"), "ts", "value")


@plan("w01_bounded_history", f"""
SELECT key, kind, id, CASE kind WHEN 'signup' THEN NULL ELSE age END AS age FROM (SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY ts DESC, id DESC) AS age FROM {EV})
WHERE (kind = 'view' AND age <= 3) OR (kind = 'click' AND age <= 5) OR kind = 'signup'""")
def _(t):
    return W.bounded_history(_events(t), {"view": 3, "click": 5, "signup": 0}).select("key", "kind", "id", "age")


SEQ = f"""
  s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS seq FROM {EV}),
  c AS (SELECT c_custkey AS key, c_nationkey::BIGINT AS cursor FROM customer),
  m AS (SELECT c.key, cursor, (SELECT count(*) FROM events WHERE user_id = c.key) AS last_seq FROM c)"""


def _replay(t):
    cursors = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("cursor"))
    return W.replay_from_cursor(_events(t), cursors, 40)


@plan("w02_replay_from_cursor", f"WITH {SEQ} SELECT key, id, seq FROM s JOIN m USING (key) WHERE seq > cursor AND seq > last_seq - 40")
def _(t):
    return _replay(t)[0].select("key", "id", "seq")


@plan("w02_lost_events", f"WITH {SEQ} SELECT key, greatest(0, last_seq - 40 - cursor)::BIGINT AS lost FROM m")
def _(t):
    return _replay(t)[1]


@plan("w03_buffer_with_terminals", f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS nth FROM {EV}),
  f AS (SELECT key, min((ts, id)) AS first FROM {EV} GROUP BY key HAVING bool_or(kind = 'purchase')),
  d AS (SELECT key FROM (SELECT key, row_number() OVER (ORDER BY first DESC) AS r FROM f) WHERE r > 100)
SELECT key, kind, id FROM n WHERE (nth <= 20 OR kind = 'purchase') AND key NOT IN (SELECT key FROM d)""")
def _(t):
    return W.buffer_with_terminals(_events(t), ("purchase",), 20, 100).select("key", "kind", "id")


@plan("w04a_request_rate", f"""
SELECT key, id, count(*) OVER (PARTITION BY key ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS rate FROM {EV}""")
def _(t):
    return W.request_rate(_events(t), 86_400).select("key", "id", "rate")


@plan("w04b_admit_requests", f"""
WITH RECURSIVE e AS (SELECT key, id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY key ORDER BY epoch_us(ts), id) AS rn FROM {EV}),
  r AS (SELECT key, id, rn, [us] AS kept, true AS admitted FROM e WHERE rn = 1 UNION ALL
    SELECT key, id, rn, CASE WHEN len(f) < 3 THEN list_append(f, us) ELSE f END, len(f) < 3 FROM
      (SELECT e.key, e.id, e.rn, e.us, list_filter(r.kept, lambda x: x > e.us - 86400000000) AS f FROM r JOIN e ON e.key = r.key AND e.rn = r.rn + 1))
SELECT key, id, admitted FROM r""")
def _(t):
    return W.admit_requests(_events(t), 3, 86_400)


@plan("w05_running_metrics", """
SELECT coalesce(event_type, 'all') AS status, count(*) AS n, round(avg(value) + 1e-9, 2) AS avg_value FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def _(t):
    return W.running_metrics(t.events, "value", "event_type")


LIVE = f"""
  p AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'thread/' || user_id ELSE 'feedback/' || event_type END AS namespace, {K} AS key, value, ts AS updated_at,
     CASE WHEN value < 1 THEN 'delete' ELSE 'put' END AS op FROM events WHERE ts <= TIMESTAMP '2024-01-20'),
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace, key ORDER BY updated_at DESC, value DESC) AS rn FROM p) WHERE rn = 1 AND op = 'put'
     AND epoch_us(TIMESTAMP '2024-01-20') - epoch_us(updated_at) <= 168 * 3600000000),
  n AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY namespace ORDER BY updated_at DESC, key DESC) AS nth FROM l) WHERE nth <= 50),
  live AS (SELECT namespace, key, value, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY starts_with(namespace, 'thread/') ORDER BY updated_at DESC, namespace DESC, key DESC) AS g FROM n)
     WHERE g <= 200 OR NOT starts_with(namespace, 'thread/'))"""


def _puts(t) -> DataFrame:
    kind = F.col("event_type")
    return t.events.select(
        F.when(kind.isin("view", "click"), F.concat(F.lit("thread/"), F.col("user_id").cast("string"))).otherwise(
            F.concat(F.lit("feedback/"), kind)).alias("namespace"), F.get_json_object("props", "$.k").cast("long").alias("key"), "value",
        F.col("ts").alias("updated_at"), F.when(F.col("value") < 1, "delete").otherwise("put").alias("op"))


def _live(t, prefix: str = "") -> DataFrame:
    return W.ttl_store(_puts(t), F.lit("2024-01-20"), 168, 50, 200, prefix)


@plan("w06_ttl_store", f"WITH {LIVE} SELECT * FROM live")
def _(t):
    return _live(t)


@plan("w06_store_counts", f"WITH {LIVE} SELECT count(*) AS items, count(DISTINCT namespace) AS namespaces FROM live WHERE starts_with(namespace, 'feedback/')")
def _(t):
    return W.store_counts(_live(t, "feedback/"))


RUNS = """
  run AS (SELECT doc_id AS thread_id, lang AS user_id, CASE WHEN source = 'src7' THEN 'unknown' ELSE source END AS type, n_chars AS score,
     coalesce(quality, 0)::BIGINT AS rounds, doc_id AS ts FROM documents LEFT JOIN labels USING (doc_id))"""


def _runs(t) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("thread_id"), F.col("lang").alias("user_id"), F.when(F.col("source") == "src7", "unknown").otherwise(
            F.col("source")).alias("type"), F.col("n_chars").alias("score"), F.coalesce("quality", F.lit(0)).cast("long").alias("rounds"),
        F.col("doc_id").alias("ts"))


def _run_risks(t) -> DataFrame:
    return PV.categorized(t).filter("primary_category is not null").select(F.col("doc_id").alias("thread_id"), F.col("primary_category").alias("category"))


SUMMARY = "SELECT type, count(*) AS n_runs, round(avg(score) + 1e-9, 2) AS avg_score, round(avg(rounds) + 1e-9, 2) AS avg_rounds FROM run GROUP BY type"
CATEGORIES = "SELECT type, primary_category AS category, count(*)::BIGINT AS n FROM run JOIN clause ON doc_id = thread_id WHERE primary_category IS NOT NULL GROUP BY ALL"


@plan("w07_experience_summary", f"WITH {RUNS} {SUMMARY}")
def _(t):
    return W.experience_summary(_runs(t))


@plan("w07_experience_categories", f"WITH {RUNS}, {PV.CLAUSES} {CATEGORIES}")
def _(t):
    return W.experience_categories(_runs(t), _run_risks(t))


@plan("w07_last_runs", f"WITH {RUNS} SELECT user_id, arg_max(type, ts) AS type, arg_max(score, ts) AS score FROM run GROUP BY user_id")
def _(t):
    return W.last_runs(_runs(t), "user_id", ["type", "score"])


@plan("w08_recall_hints", f"""
WITH {RUNS}, {PV.CLAUSES}, {PE.FEEDBACK},
  su AS ({SUMMARY}), ca AS ({CATEGORIES}),
  tp AS (SELECT type, string_agg(category || '(' || n || ')', ', ' ORDER BY nth) AS top FROM
    (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, category) AS nth FROM ca) WHERE nth <= 3 GROUP BY type),
  fl AS (SELECT category, row_number() OVER (ORDER BY category) AS r FROM (SELECT category FROM jd GROUP BY category
    HAVING count(*) >= 3 AND count(*) FILTER (verdict = 'false_positive') / count(*) >= 0.3)),
  pf AS (SELECT user_id, arg_max(type, ts) AS last_type FROM run GROUP BY user_id),
  h AS (SELECT doc_id AS request_id, 1 AS o, 0 AS r, 'frequent: ' || top AS hint FROM documents JOIN tp ON type = source JOIN su USING (type) WHERE n_runs >= 2 UNION ALL
    SELECT doc_id, 2, 0, 'mean score ' || format('{{:,.2f}}', avg_score) || ' over ' || n_runs FROM documents JOIN su ON type = source WHERE n_runs >= 2 UNION ALL
    SELECT doc_id, 3, r, 'often wrong: ' || category FROM documents, fl WHERE r <= 20 UNION ALL
    SELECT doc_id, 4, 0, 'last type: ' || last_type FROM documents JOIN pf ON user_id = lang)
SELECT * FROM (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY o, r) - 1 AS pos, hint FROM h) WHERE pos < 8""")
def _(t):
    runs = _runs(t)
    requests = t.documents.select(F.col("doc_id").alias("request_id"), F.col("lang").alias("user_id"), F.col("source").alias("type"))
    feedback, risks = PE._feedback(t)
    return W.recall_hints(requests, W.experience_summary(runs), W.experience_categories(runs, _run_risks(t)),
                          feedback.join(risks, "risk_item_id").select("category", "verdict"), W.last_runs(runs, "user_id", ["type"]))


@plan("w09_reconcile_orphans", """
WITH c AS (SELECT l_orderkey AS id, arg_max(l_linestatus = 'O' OR l_returnflag = 'R', (l_shipdate, l_linestatus = 'O', l_returnflag = 'R')) AS open_ FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, CASE WHEN coalesce(open_, false) THEN 'resume' ELSE 'failed' END AS action,
  epoch_us(TIMESTAMP '1999-01-01') - epoch_us(o_orderdate) > 31536000000000 AS timed_out FROM orders LEFT JOIN c ON id = o_orderkey WHERE o_orderstatus = 'O'""")
def _(t):
    records = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "analyzing").otherwise("completed").alias("status"),
                              F.col("o_orderdate").alias("started_at"))
    checkpoints = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("ts"), (F.col("l_linestatus") == "O").alias("has_next"),
                                    (F.col("l_returnflag") == "R").alias("pending"))
    return W.reconcile_orphans(records, checkpoints, F.lit("1999-01-01"), 31_536_000)


PRUNED = """
  l AS (SELECT user_id AS thread_id, max(ts) AS stamp FROM events GROUP BY 1),
  pruned AS (SELECT thread_id, stamp, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(stamp) > 72 * 3600000000 OR row_number() OVER (ORDER BY stamp DESC, thread_id DESC) > 100)
     AND thread_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150) AS deleted FROM l)"""


def _pruned(t) -> tuple[DataFrame, DataFrame]:
    checkpoints = t.events.select(F.col("user_id").alias("thread_id"), "ts")
    protected = t.events.filter("event_type = 'purchase' and value > 150").select(F.col("user_id").alias("thread_id"))
    return checkpoints, W.prune_checkpoints(checkpoints, protected, F.lit("2024-01-31"), 72, 100)


@plan("w10_prune_checkpoints", f"WITH {PRUNED} SELECT * FROM pruned")
def _(t):
    return _pruned(t)[1]


@plan("w10_prune_counts", f"""WITH {PRUNED} SELECT (SELECT count(*) FROM events) AS scanned, count(*) FILTER (deleted) AS deleted,
  count(*) FILTER (NOT deleted) AS kept FROM pruned""")
def _(t):
    return W.prune_counts(*_pruned(t))


@plan("w11_changed_fields", """
WITH s AS (SELECT o_custkey AS thread_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
  w AS (SELECT *, lag(status) OVER v AS ps, lag(priority) OVER v AS pp FROM s WINDOW v AS (PARTITION BY thread_id ORDER BY step))
SELECT thread_id, step, 'status' AS field, status AS value FROM w WHERE step = 1 OR ps <> status UNION ALL
SELECT thread_id, step, 'priority', priority FROM w WHERE step = 1 OR pp <> priority UNION ALL
SELECT thread_id, step, 'events', step::VARCHAR FROM w""")
def _(t):
    orders = numbered(t.orders.withColumnRenamed("o_custkey", "thread_id"), ["thread_id"], F.year("o_orderdate"),
                      [F.col("o_orderdate"), F.col("o_orderkey")], "step")
    snapshots = orders.select("thread_id", "step", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
                              F.sequence(F.lit(1).cast("long"), F.col("step")).alias("events"))
    return W.changed_fields(snapshots, ["status", "priority"], ["events"])


@plan("w12_dedupe_submissions", "SELECT event_id AS id, ts, user_id FROM events")
def _(t):
    rows = t.events.select(F.col("event_id").alias("id"), "ts", "user_id")
    again = rows.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return W.dedupe_submissions(again.unionByName(rows))


@plan("w14_latest_status", f"""
SELECT key, arg_max(CASE kind WHEN 'purchase' THEN 'completed' ELSE 'failed' END, (ts, id)) AS status, max(ts) AS updated_at FROM {EV}
WHERE kind IN ('purchase', 'error', 'signup') GROUP BY key""")
def _(t):
    return W.latest_status(_events(t), {"purchase": "completed", "error": "failed", "signup": "failed"})


@plan("r12_assemble_context", f"""
WITH {PR.STATUTES}, {PR.QUESTIONS},
  {PR.bm25_sql('statute', 'question')},
  ask AS (SELECT * FROM question),
  {PR.attempt_sql('one_', 'sc').replace('rank <= 9', 'rank <= 12').replace('final_rank <= 3', 'final_rank <= 4')},
  {PV.RISKS.replace('clause AS', 'clause AS', 1)},
  rf AS (SELECT query_id, string_agg('[' || position || '] ' || title, chr(10) ORDER BY position) AS refs FROM
    (SELECT query_id, 'passage ' || doc_id AS title, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, final_rank) AS position FROM one_r) GROUP BY 1),
  top AS (SELECT doc_id, string_agg('- [' || level || '] ' || category, chr(10) ORDER BY risk_id) AS risks FROM
    (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY risk_id) AS nth FROM risk) WHERE nth <= 6 GROUP BY doc_id)
SELECT conv_id || '/' || turn AS query_id, coalesce(refs, '') AS refs, CASE WHEN n_chars IS NULL THEN '' ELSE 'score ' || least(100, n_chars) || '/100' ||
  coalesce(chr(10) || risks, '') END AS report FROM conversations LEFT JOIN rf ON query_id = conv_id || '/' || turn
  LEFT JOIN documents d ON d.doc_id = conv_id LEFT JOIN top ON top.doc_id = conv_id WHERE role = 'user'""")
def _(t):
    users = t.conversations.filter("role = 'user'").select(PR._question_key(), "text", F.col("conv_id").alias("report_id"))
    statutes = PR._statutes(t)
    refs = R.retrieve_for_questions(users.select("query_id", "text"), statutes, R.bm25_index(statutes.select("doc_id", "text")), latin.INTENTS)
    risks = PV._risks(t)[0].withColumnRenamed("doc_id", "report_id").withColumnRenamed("risk_id", "order")
    reports = t.documents.select(F.col("doc_id").alias("report_id"), F.concat(
        F.lit("score "), F.least(F.lit(100), F.col("n_chars")).cast("string"), F.lit("/100")).alias("head"))
    return R.assemble_context(users.select("query_id", "report_id"), refs, statutes.select(F.col("doc_id").alias("ref_id"), "title"), reports, risks)
