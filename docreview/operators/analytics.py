"""Lists, dashboards, queues and upserts of the application, as joins and aggregations over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreview.functions.scalars import half_up, numbered

PRIVILEGED = ("owner", "admin", "auditor")


def filter_records(df: DataFrame, equals: dict[str, str] | None = None, day_column: str | None = None,
                   first_day: str | None = None, last_day: str | None = None, keyword: str | None = None,
                   searched: Sequence[str] = ()) -> DataFrame:
    """Optional filters: equality, an inclusive range of days, and a keyword in any of several columns.

    The day range is written as a half-open range of the raw column, so that it reaches the scan.
    """
    out = df
    for column, value in (equals or {}).items():
        if value not in (None, ""):
            out = out.filter(F.col(column) == value)
    kind = dict(df.dtypes).get(day_column or "", "timestamp")
    if first_day:
        out = out.filter(F.col(day_column) >= F.lit(first_day).cast(kind))
    if last_day:
        out = out.filter(F.col(day_column) < F.date_add(F.lit(last_day).cast("date"), 1).cast(kind))
    if keyword:
        cond = F.lit(False)
        for column in searched:
            cond = cond | F.contains(F.lower(F.col(column)), F.lit(keyword.lower()))
        out = out.filter(cond)
    return out


def page_of(df: DataFrame, order: Sequence[Column], page: int = 1, size: int = 20) -> DataFrame:
    """One page of a total order; Spark keeps only offset + size rows per task."""
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def list_records(df: DataFrame, order: Sequence[Column], page: int = 1, size: int = 20, **filters) -> tuple[DataFrame, DataFrame]:
    """(page rows, one-row total) of the filtered records."""
    kept = filter_records(df, **filters)
    return page_of(kept, order, page, size), kept.agg(F.count("*").alias("total"))


def dashboard_stats(contracts: DataFrame, analysis: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Totals per status, mean score and high-risk count: one conditional aggregate per table."""
    base = contracts.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses])
    return base.withColumn("avg_score", analysis.agg(half_up(F.coalesce(F.avg("score"), F.lit(0.0)), 1)).scalar()).withColumn(
        "n_high", analysis.agg(F.count_if(F.col("level") == "high")).scalar())


def level_counts(risks: DataFrame, levels: DataFrame, rolled: dict[str, str] | None = None) -> DataFrame:
    """Count per expected level, zero filled; `rolled` renames levels before counting."""
    name = F.col("level")
    for old, new in (rolled or {}).items():
        name = F.when(F.col("level") == old, new).otherwise(name)
    counts = risks.groupBy(name.alias("level")).agg(F.count("*").alias("n"))
    return levels.join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def recent(df: DataFrame, order: Sequence[Column], n: int = 5, text: str = "text", preview: int = 80) -> DataFrame:
    return df.withColumn("preview", F.substring(text, 1, preview)).orderBy(*order).limit(n)


def ordered_children(df: DataFrame, key: str, fields: Sequence[str], name: str) -> DataFrame:
    """One row per parent with its children in order, built before the join so that parents never multiply."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def assemble_reports(contracts: DataFrame, analysis: DataFrame, risks: DataFrame, facts: DataFrame, gaps: DataFrame,
                     completed: str = "completed") -> DataFrame:
    """Completed contracts with their analysis and the ordered lists of one contract each, plus fact coverage."""
    required = F.count_if("required")
    cover = facts.groupBy("contract_id").agg(F.when(required == 0, F.lit(100)).otherwise(F.bround(
        100 * F.count_if(F.col("required") & (F.col("status") == "present")) / required, 0)).cast("long").alias("coverage"))
    out = contracts.filter(F.col("status") == completed).join(analysis, "contract_id")
    for child in (ordered_children(risks, "contract_id", ["order", "category", "level"], "risks"),
                  ordered_children(facts, "contract_id", ["order", "key", "status"], "facts"),
                  ordered_children(gaps, "contract_id", ["order", "key"], "gaps"), cover):
        out = out.join(child, "contract_id", "left")
    return out.withColumn("coverage", F.coalesce("coverage", F.lit(100)).cast("long"))


def session_list(sessions: DataFrame, messages: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """Sessions with their number of messages (0 kept), last active first."""
    counts = messages.groupBy("session_id").agg(F.count("*").alias("message_count"))
    return page_of(sessions.join(counts, "session_id", "left").withColumn(
        "message_count", F.coalesce("message_count", F.lit(0)).cast("long")),
        [F.col("updated_at").desc(), F.col("session_id")], page, size)


def assign_seq(existing: DataFrame, new: DataFrame, bucket: Column, order: Sequence[Column]) -> DataFrame:
    """Numbers for new messages: after the highest one of the session, in arrival order."""
    last = existing.groupBy("session_id").agg(F.max("seq").alias("_last"))
    return numbered(new, ["session_id"], bucket, order, "_nth").join(last, "session_id", "left").withColumn(
        "seq", (F.coalesce("_last", F.lit(0)) + F.col("_nth")).cast("long")).drop("_last", "_nth")


def fill_answers(messages: DataFrame, placeholder: str, question: str = "user", answer: str = "assistant",
                 block: int = 1000) -> DataFrame:
    """Messages in order with one placeholder after every question whose next message is no answer.

    Numbers are dense, so the next message is found by an equi join on (session, seq + 1), which no long session skews.
    """
    following = messages.select("session_id", (F.col("seq") - 1).alias("seq"), F.col("role").alias("_next"))
    open_ = messages.filter(F.col("role") == question).join(following, ["session_id", "seq"], "left").filter(
        F.coalesce(F.col("_next"), F.lit("")) != answer)
    rows = messages.select("session_id", "seq", F.lit(0).alias("_late"), "role", "content").unionByName(open_.select(
        "session_id", "seq", F.lit(1).alias("_late"), F.lit(answer).alias("role"), F.lit(placeholder).alias("content")))
    return numbered(rows, ["session_id"], F.floor(F.col("seq") / block), [F.col("seq"), F.col("_late")], "position").select(
        "session_id", "position", "role", "content", (F.col("_late") == 1).alias("placeholder"))


def delete_sessions(sessions: DataFrame, messages: DataFrame, ids: DataFrame, user) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) without the requested sessions of this user; other users' sessions stay."""
    doomed = sessions.filter(F.col("user_id") == user).join(ids, "session_id", "left_semi").select("session_id")
    return sessions.join(doomed, "session_id", "left_anti"), messages.join(doomed, "session_id", "left_anti")


def approval_queue(tasks: DataFrame, contracts: DataFrame, user, role: str, status: str | None = None,
                   contract: str | None = None, fallback: str = "contract no longer exists", preview: int = 120) -> DataFrame:
    """Tasks with a contract preview; own tasks only unless privileged. Sort with `queue_order` where it is shown."""
    out = tasks
    if status:
        out = out.filter(F.col("status") == status)
    if contract is not None:
        out = out.filter(F.col("contract_id") == contract)
    elif role not in PRIVILEGED:
        out = out.filter(F.col("requester_id") == user)
    info = contracts.select("contract_id", F.substring("text", 1, preview).alias("_text"), F.col("status").alias("contract_status"),
                            F.lit(True).alias("_known"))
    return out.join(info, "contract_id", "left").withColumn(
        "contract_preview", F.when(F.col("_known"), F.coalesce("_text", F.lit(""))).otherwise(
            fallback)).withColumn("can_decide", F.lit(role in PRIVILEGED)).drop("_text", "_known")


def decide_approvals(tasks: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks after the decisions, rejected decisions).

    `decisions(task_id, verdict, comment, reviewer_id, role, decided_at)`. The first privileged decision on a pending
    task takes effect; decisions on other tasks, later ones and those without the role are rejected.
    """
    able = decisions.filter(F.col("role").isin(*PRIVILEGED))
    fields = ["decided_at", "reviewer_id", "verdict", "comment"]
    first = able.groupBy("task_id").agg(F.min(F.struct(*fields)).alias("d"))
    # The task table may already carry decisions; only pending tasks take one.
    pending = F.col("status") == "pending"
    after = tasks.join(first, "task_id", "left").withColumn("_take", pending & F.col("d").isNotNull()).select(
        *[c for c in tasks.columns if c != "status"], F.when(F.col("_take"), F.col("d.verdict")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("_take"), F.col("d.reviewer_id")).alias("reviewer_id"), F.when(F.col("_take"), F.col("d.decided_at")).alias("decided_at"))
    effective = first.join(tasks.filter(pending).select("task_id"), "task_id", "left_semi").select(
        "task_id", *[F.col(f"d.{f}").alias(f) for f in fields])
    rejected = decisions.join(effective, ["task_id", *fields], "left_anti")
    return after, rejected


def valid_shares(shares: DataFrame, tokens: DataFrame, now: Column) -> DataFrame:
    """Tokens that open a share: same hash, not revoked, not expired."""
    return tokens.withColumn("token_hash", F.sha2("token", 256)).join(shares, "token_hash").filter(
        ~F.col("revoked") & (F.col("expires_at") > now))


def share_list(shares: DataFrame, annotations: DataFrame) -> DataFrame:
    """Shares with their number of annotations, counted before the join."""
    counts = annotations.groupBy("share_id").agg(F.count("*").alias("annotation_count"))
    return shares.join(counts, "share_id", "left").withColumn(
        "annotation_count", F.coalesce("annotation_count", F.lit(0)).cast("long"))


def audit_query(events: DataFrame, role: str, action: str | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """Newest audit rows first, for auditor roles only."""
    if role not in PRIVILEGED:
        raise PermissionError("audit rows are shown to auditors only")
    kept = events.filter(F.col("action") == action) if action else events
    return page_of(kept, [F.col("created_at").desc(), F.col("id")], page, size)


def latest_feedback(verdicts: DataFrame) -> DataFrame:
    """Upsert by (risk, user): last verdict and comment, first created time.

    `verdicts(id, risk_item_id, user_id, contract_id, verdict, comment, ts)`; aggregates combine before the shuffle.
    """
    return verdicts.groupBy("risk_item_id", "user_id").agg(
        F.max(F.struct("ts", "id", "contract_id", "verdict", "comment")).alias("last"), F.min("ts").alias("created_at")).select(
        "risk_item_id", "user_id", "last.contract_id", "last.verdict", "last.comment", "created_at",
        F.col("last.ts").alias("updated_at"))
