"""Application analytics: orders stand for contracts, customers for users, conversations for consult sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreview.operators import analytics as A
from docreview.plans.registry import plan

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'analyzing' ELSE 'pending' END"
SCORE = "least(100, floor(o_totalprice / 5000))::BIGINT"
LEVEL = f"CASE WHEN {SCORE} <= 30 THEN 'high' WHEN {SCORE} <= 50 THEN 'medium' WHEN {SCORE} <= 70 THEN 'low' ELSE 'safe' END"


def _newest():
    return [F.col("o_orderdate").desc(), F.col("o_orderkey")]


def _contracts(t) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.orders.withColumn("status", F.when(s == "F", "completed").when(s == "O", "analyzing").otherwise("pending"))


def _score():
    return F.least(F.lit(100), F.floor(F.col("o_totalprice") / 5000)).cast("long")


def _level(score):
    return F.when(score <= 30, "high").when(score <= 50, "medium").when(score <= 70, "low").otherwise("safe")


FILTERED = """FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'
  AND (contains(lower(o_orderpriority), 'high') OR contains(o_orderkey::VARCHAR, 'high'))"""


@plan("a01_list_records", f"""
SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, (SELECT count(*) {FILTERED}) AS total {FILTERED}
ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""")
def _(t):
    rows, total = A.list_records(
        t.orders.withColumn("key_text", F.col("o_orderkey").cast("string")), _newest(), 3, 20, equals={"o_orderstatus": "F"},
        day_column="o_orderdate", first_day="1996-01-01", last_day="1996-12-31", keyword="HIGH",
        searched=("o_orderpriority", "key_text"))
    return rows.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", total.scalar().alias("total"))


@plan("a02_dashboard_stats", f"""
SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_completed, count(*) FILTER (o_orderstatus = 'O') AS n_analyzing,
  count(*) FILTER (o_orderstatus = 'P') AS n_pending, round((avg({SCORE}) FILTER (o_orderstatus = 'F')) + 1e-9, 1) AS avg_score,
  count(*) FILTER (o_orderstatus = 'F' AND {LEVEL} = 'high') AS n_high FROM orders""")
def _(t):
    done = t.orders.filter("o_orderstatus = 'F'").select(_score().alias("score")).withColumn("level", _level(F.col("score")))
    return A.dashboard_stats(_contracts(t), done, ("completed", "analyzing", "pending"))


@plan("a03_level_counts", """
SELECT l.level, count(o_orderkey) AS n FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('other'), ('none')) l(level)
LEFT JOIN orders ON CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'other' ELSE o_orderpriority END = l.level
GROUP BY l.level""")
def _(t):
    levels = t.spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",), ("other",), ("none",)], "level string")
    return A.level_counts(t.orders.withColumnRenamed("o_orderpriority", "level"), levels,
                          {"4-NOT SPECIFIED": "other", "5-LOW": "other"})


@plan("a04_recent", "SELECT doc_id, left(text, 80) AS preview, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5")
def _(t):
    return A.recent(t.documents, [F.col("n_chars").desc(), F.col("doc_id")]).select("doc_id", "preview", "n_chars")


@plan("a05_assemble_reports", f"""
WITH r AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag || ':' || l_linestatus, ',' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS risks,
    string_agg(l_linenumber || ':' || CASE WHEN l_discount > 0.05 THEN 'missing' ELSE 'present' END, ',' ORDER BY l_linenumber, l_suppkey, CASE WHEN l_discount > 0.05 THEN 'missing' ELSE 'present' END) AS facts,
    string_agg(CASE WHEN l_discount > 0.05 THEN l_suppkey::VARCHAR END, ',' ORDER BY l_linenumber, l_suppkey) AS gaps,
    count(*) FILTER (l_tax > 0.02) AS req, count(*) FILTER (l_tax > 0.02 AND l_discount <= 0.05) AS have FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS contract_id, {SCORE} AS score, c_name, coalesce(risks, '') AS risks, coalesce(facts, '') AS facts, coalesce(gaps, '') AS gaps,
  (CASE WHEN coalesce(req, 0) = 0 THEN 100 ELSE round_even(100.0 * have / req, 0) END)::BIGINT AS coverage
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN r ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def _(t):
    contracts = _contracts(t).select(F.col("o_orderkey").alias("contract_id"), "o_custkey", "status").join(
        t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    analysis = t.orders.select(F.col("o_orderkey").alias("contract_id"), _score().alias("score"))
    lines = t.lineitem.withColumnRenamed("l_orderkey", "contract_id").withColumn("order", F.col("l_linenumber"))
    short = F.col("l_discount") > 0.05
    risks = lines.select("contract_id", "order", F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("level"))
    facts = lines.select("contract_id", "order", F.col("l_suppkey").alias("key"), F.when(short, "missing").otherwise(
        "present").alias("status"), (F.col("l_tax") > 0.02).alias("required"))
    gaps = lines.filter(short).select("contract_id", "order", F.col("l_suppkey").alias("key"))
    out = A.assemble_reports(contracts, analysis, risks, facts, gaps)
    text = lambda c, *fs: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(
        ":", *[x[f].cast("string") for f in fs])), ","), F.lit("")).alias(c)
    return out.select("contract_id", "score", "c_name", text("risks", "order", "category", "level"),
                      text("facts", "order", "status"), text("gaps", "key"), "coverage")


SESSIONS = "(SELECT c_custkey AS session_id, c_nationkey AS user_id, c_name AS title, c_acctbal AS updated_at FROM customer)"


def _sessions(t) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("user_id"),
                             F.col("c_name").alias("title"), F.col("c_acctbal").alias("updated_at"))


def _messages(t) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role",
                                  F.col("text").alias("content"))


@plan("a06_session_list", f"""
SELECT session_id, title, count(conv_id) AS message_count FROM {SESSIONS} LEFT JOIN conversations ON conv_id = session_id
GROUP BY session_id, title, updated_at ORDER BY updated_at DESC, session_id LIMIT 200 OFFSET 200""")
def _(t):
    return A.session_list(_sessions(t), _messages(t), 2, 200).select("session_id", "title", "message_count")


@plan("a07_assign_seq", """
SELECT session_id, event_id, coalesce(m, 0) + row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS seq
FROM (SELECT user_id AS session_id, event_id, ts FROM events) LEFT JOIN
  (SELECT conv_id AS session_id, max(turn) AS m FROM conversations GROUP BY 1) USING (session_id)""")
def _(t):
    new = t.events.select(F.col("user_id").alias("session_id"), "event_id", "ts")
    return A.assign_seq(_messages(t), new, F.to_date("ts"), [F.col("ts"), F.col("event_id")]).select(
        "session_id", "event_id", "seq")


@plan("a07_fill_answers", """
WITH n AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations),
 r AS (SELECT conv_id, turn, 0 AS late, role, text FROM n UNION ALL
       SELECT conv_id, turn, 1, 'assistant', 'no answer yet' FROM n WHERE role = 'user' AND coalesce(nx, '') <> 'assistant')
SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, late) AS position, role, text AS content,
  late = 1 AS placeholder FROM r""")
def _(t):
    return A.fill_answers(_messages(t), "no answer yet")


@plan("a08_delete_sessions", f"""
WITH d AS (SELECT session_id FROM {SESSIONS} WHERE user_id = 3 AND session_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant'))
SELECT 'session' AS kind, count(*) AS n FROM {SESSIONS} WHERE session_id NOT IN (SELECT session_id FROM d) UNION ALL
SELECT 'message', count(*) FROM conversations WHERE conv_id NOT IN (SELECT session_id FROM d)""")
def _(t):
    ids = t.conversations.filter("role = 'assistant'").select(F.col("conv_id").alias("session_id"))
    sessions, messages = A.delete_sessions(_sessions(t), _messages(t), ids, 3)
    count = lambda df, kind: df.select(F.lit(kind).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    return count(sessions, "session").unionByName(count(messages, "message"))


def _tasks(t) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("requester_id"),
                           (F.col("o_custkey") * 2).alias("contract_id"), F.col("o_orderdate").alias("created_at"),
                           F.when(s == "P", "pending").when(s == "F", "approved").otherwise("rejected").alias("status"))


TASKS = """(SELECT o_orderkey AS task_id, o_custkey AS requester_id, o_custkey * 2 AS contract_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status FROM orders)"""


@plan("a09_approval_queue", f"""
SELECT task_id, contract_id, t.status, coalesce(left(c_name || ' of ' || c_mktsegment, 120), 'contract no longer exists') AS contract_preview,
  c_mktsegment AS contract_status, true AS can_decide FROM {TASKS} t LEFT JOIN customer ON c_custkey = contract_id WHERE t.status = 'pending'""")
def _(t):
    contracts = t.customer.select(F.col("c_custkey").alias("contract_id"), F.concat_ws(" of ", "c_name", "c_mktsegment").alias("text"),
                                  F.col("c_mktsegment").alias("status"))
    return A.approval_queue(_tasks(t), contracts, None, "admin", "pending").select(
        "task_id", "contract_id", "status", "contract_preview", "contract_status", "can_decide")


@plan("a09_own_approvals", f"""
SELECT task_id, contract_id, t.status, false AS can_decide FROM {TASKS} t WHERE requester_id = 77""")
def _(t):
    contracts = t.customer.select(F.col("c_custkey").alias("contract_id"), F.col("c_name").alias("text"), F.col("c_mktsegment").alias("status"))
    return A.approval_queue(_tasks(t), contracts, 77, "employee").select("task_id", "contract_id", "status", "can_decide")


DECISIONS = """(SELECT l_orderkey AS task_id, l_suppkey AS reviewer_id, l_shipdate AS decided_at, CASE WHEN l_discount > 0.05 THEN 'approved' ELSE 'rejected' END AS verdict,
  'line ' || l_linenumber AS comment, CASE l_returnflag WHEN 'A' THEN 'admin' WHEN 'R' THEN 'auditor' ELSE 'employee' END AS role FROM lineitem)"""


def _decisions(t) -> DataFrame:
    r = F.col("l_returnflag")
    return t.lineitem.select(
        F.col("l_orderkey").alias("task_id"), F.col("l_suppkey").alias("reviewer_id"), F.col("l_shipdate").alias("decided_at"),
        F.when(F.col("l_discount") > 0.05, "approved").otherwise("rejected").alias("verdict"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("comment"),
        F.when(r == "A", "admin").when(r == "R", "auditor").otherwise("employee").alias("role"))


FIRST = f"""
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY decided_at, reviewer_id, verdict, comment) AS rn
    FROM {DECISIONS} WHERE role <> 'employee') WHERE rn = 1)"""


@plan("a10_decide_approvals", f"""WITH {FIRST}
SELECT t.task_id, CASE WHEN t.status = 'pending' THEN coalesce(f.verdict, 'pending') ELSE t.status END AS status,
  CASE WHEN t.status = 'pending' THEN f.reviewer_id END AS reviewer_id, CASE WHEN t.status = 'pending' THEN f.decided_at END AS decided_at
FROM {TASKS} t LEFT JOIN f USING (task_id)""")
def _(t):
    return A.decide_approvals(_tasks(t), _decisions(t))[0].select("task_id", "status", "reviewer_id", "decided_at")


@plan("a10_rejected_decisions", f"""WITH {FIRST}
SELECT d.task_id, d.reviewer_id, d.comment, d.role FROM {DECISIONS} d LEFT JOIN (SELECT f.* FROM f JOIN {TASKS} t USING (task_id) WHERE t.status = 'pending') e
  ON e.task_id = d.task_id AND e.reviewer_id = d.reviewer_id AND e.decided_at = d.decided_at AND e.verdict = d.verdict AND e.comment = d.comment
WHERE e.task_id IS NULL""")
def _(t):
    return A.decide_approvals(_tasks(t), _decisions(t))[1].select("task_id", "reviewer_id", "comment", "role")


@plan("a11_valid_shares", """
SELECT c_custkey AS share_id FROM customer WHERE c_mktsegment <> 'BUILDING' AND DATE '2020-01-01' + c_nationkey * 10 > DATE '2020-05-01' AND c_acctbal > 0""")
def _(t):
    key = F.concat(F.lit("token-"), F.col("c_custkey").cast("string"))
    shares = t.customer.select(F.col("c_custkey").alias("share_id"), F.sha2(key, 256).alias("token_hash"),
                               (F.col("c_mktsegment") == "BUILDING").alias("revoked"),
                               F.date_add(F.lit("2020-01-01").cast("date"), F.col("c_nationkey") * 10).alias("expires_at"))
    tokens = t.customer.select(F.when(F.col("c_acctbal") > 0, key).otherwise(F.concat(key, F.lit("x"))).alias("token"))
    return A.valid_shares(shares, tokens, F.lit("2020-05-01").cast("date")).select("share_id")


@plan("a12_share_list", """
SELECT o_orderkey AS share_id, o_orderdate AS created_at, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS annotation_count
FROM orders""")
def _(t):
    shares = t.orders.select(F.col("o_orderkey").alias("share_id"), F.col("o_orderdate").alias("created_at"))
    notes = t.lineitem.select(F.col("l_orderkey").alias("share_id"))
    return A.share_list(shares, notes)


@plan("a13_audit_query", "SELECT event_id AS id, ts AS created_at, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 50")
def _(t):
    events = t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "user_id", F.col("event_type").alias("action"))
    return A.audit_query(events, "auditor", "error", 2).select("id", "created_at", "user_id")


VERDICTS = "(SELECT event_id AS id, (props->>'$.k')::BIGINT AS risk_item_id, user_id, event_type AS verdict, value::VARCHAR AS comment, ts FROM events)"


@plan("a14_latest_feedback", f"""
SELECT risk_item_id, user_id, arg_max(verdict, (ts, id)) AS verdict, min(ts) AS created_at, max(ts) AS updated_at, arg_max(id, (ts, id)) AS last_id
FROM {VERDICTS} GROUP BY risk_item_id, user_id""")
def _(t):
    rows = t.events.select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("risk_item_id"), "user_id",
                           F.col("event_id").alias("contract_id"), F.col("event_type").alias("verdict"), F.col("value").alias("comment"), "ts")
    return A.latest_feedback(rows).select("risk_item_id", "user_id", "verdict", "created_at", "updated_at",
                                          F.col("contract_id").alias("last_id"))
