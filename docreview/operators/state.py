"""Bounded, expiring and replayable state over event tables: the batch form of the streaming operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreview.functions.scalars import half_up, lookup_number, numbered, ratio, top_rows


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def bounded_history(events: DataFrame, limits: dict[str, int], kind: str = "kind", key: str = "key",
                    order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """The last n items of every (key, kind) list; limits of 0 or less keep all. Newest first in `age` (from 1).

    Bounded kinds are cut inside each partition before the shuffle; unlimited ones are not numbered at all.
    """
    bounded = {k: n for k, n in limits.items() if n > 0}
    newest = [F.col(c).desc() for c in order]
    cut = top_rows(events.filter(F.col(kind).isin(list(bounded))), (key, kind), newest, max(bounded.values(), default=1), "age")
    cut = cut.filter(F.col("age") <= lookup_number(F.col(kind), bounded)).withColumn("age", F.col("age").cast("long"))
    rest = [k for k, n in limits.items() if n <= 0]
    if not rest:
        return cut
    return cut.unionByName(events.filter(F.col(kind).isin(rest)).withColumn("age", F.lit(None).cast("long")))


def replay_from_cursor(events: DataFrame, cursors: DataFrame, n: int, key: str = "key",
                       order: Sequence[str] = ("ts", "id")) -> tuple[DataFrame, DataFrame]:
    """(events after each cursor that are still among the last n, lost events per key), by a counter per key."""
    counted = numbered(events, [key], F.to_date(order[0]), [F.col(c) for c in order], "seq")
    last = events.groupBy(key).agg(F.count("*").alias("last_seq"))
    marks = cursors.join(last, key, "left").select(
        key, "cursor", F.coalesce("last_seq", F.lit(0)).cast("long").alias("last_seq"))
    delivered = counted.join(marks, key).filter((F.col("seq") > F.col("cursor")) & (F.col("seq") > F.col("last_seq") - n))
    lost = marks.select(key, F.greatest(F.lit(0), F.col("last_seq") - n - F.col("cursor")).cast("long").alias("lost"))
    return delivered, lost


def buffer_with_terminals(events: DataFrame, terminals: Sequence[str], cap: int = 500, keep: int = 50, key: str = "key",
                          kind: str = "kind", order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """First `cap` events of every key plus all its terminal events; of the finished keys only the newest `keep` stay.

    A key counts by its first event. The head of each key is cut before the shuffle; later terminal events join the
    place of the last buffered one.
    """
    sort = [F.col(c) for c in order]
    head = top_rows(events, (key,), sort, cap, "_nth")
    edge = head.filter(F.col("_nth") == cap).select(key, F.struct(*order).alias("_edge"))
    late = events.filter(F.col(kind).isin(list(terminals))).join(edge, key).filter(F.struct(*order) > F.col("_edge")).drop("_edge")
    kept = head.drop("_nth").unionByName(late)
    ages = events.groupBy(key).agg(F.min(F.struct(*order)).alias("first"), F.bool_or(F.col(kind).isin(list(terminals))).alias("done"))
    finished = ages.filter("done")
    newest = finished.orderBy(F.col("first").desc()).limit(keep).select(key)
    dropped = finished.join(newest, key, "left_anti").select(key)
    return kept.join(dropped, key, "left_anti")


def request_rate(events: DataFrame, seconds: int = 60, key: str = "key", ts: str = "ts") -> DataFrame:
    """Adds `rate`: requests of the key in the last `seconds`, strictly younger than that.

    Every event also visits the next time slice, so a window runs inside (key, slice): long keys spread over tasks.
    """
    width = seconds * 1_000_000
    at = events.withColumn("_us", micros(ts)).withColumn("_own", F.floor(F.col("_us") / width))
    spread = at.withColumn("_slice", F.explode(F.array("_own", F.col("_own") + 1)))
    frame = Window.partitionBy(key, "_slice").orderBy("_us").rangeBetween(-(width - 1), 0)
    return spread.withColumn("rate", F.count("*").over(frame)).filter(F.col("_slice") == F.col("_own")).drop("_us", "_own", "_slice")


def _admit(batches, limit: int, width: int):
    """Sequential admission over rows sorted by (key, run, us, id); the state between batches is `limit` timestamps.

    While the window is full, the fold jumps straight to the first request after the oldest one leaves it.
    """
    current, kept = None, deque()
    for batch in batches:
        key, run, us, seed = (batch[c].to_numpy() for c in ("key", "run", "us", "seed"))
        flags = np.zeros(len(batch), dtype=bool)
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (run[1:] != run[:-1])) + 1
        for start, end in zip([0, *cuts], [*cuts, len(batch)]):
            if start == end:
                continue
            if (key[start], run[start]) != current:
                current, kept = (key[start], run[start]), deque()
            i = start
            while i < end:
                while kept and kept[0] <= us[i] - width:
                    kept.popleft()
                if seed[i] or len(kept) < limit:
                    kept.append(us[i])
                    flags[i] = True
                    i += 1
                else:
                    i = start + int(np.searchsorted(us[start:end], kept[0] + width))
        yield batch.assign(admitted=flags)[["key", "id", "us", "seed", "admitted"]]


def admit_requests(events: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """Sequential admission of `events(key, id, ts)`: rejected requests do not occupy the window.

    Time is cut into slices of the window length. A slice that, with the one before it, holds at most `limit` requests
    admits them all and thereby fixes the state for the next slice. So only runs of busy slices need the fold; each
    starts from the events of the quiet slice before it and is streamed through a task in order, with a state of
    `limit` timestamps. Runs of one key are independent and spread over tasks.
    """
    width = seconds * 1_000_000
    at = events.select("key", "id", micros("ts").alias("us")).withColumn("slice", F.floor(F.col("us") / width))
    sizes = at.groupBy("key", "slice").agg(F.count("*").alias("n"))
    before = sizes.select("key", (F.col("slice") + 1).alias("slice"), F.col("n").alias("n_before"))
    busy = sizes.join(before, ["key", "slice"], "left").filter(
        F.col("n") + F.coalesce("n_before", F.lit(0)) > limit).select("key", "slice", "n_before")
    # Runs of consecutive busy slices, over the few rows of the slice table.
    order = Window.partitionBy("key").orderBy("slice")
    runs = busy.withColumn("run", F.col("slice") - F.row_number().over(order))
    first = runs.groupBy("key", "run").agg(F.min_by("n_before", "slice").alias("n_before"), F.min("slice").alias("slice"))
    seeds = first.filter("n_before is not null").select("key", (F.col("slice") - 1).alias("slice"), "run", F.lit(True).alias("seed"))
    places = runs.select("key", "slice", "run", F.lit(False).alias("seed")).unionByName(seeds)
    kind, key_kind = events.schema["id"].dataType.simpleString(), events.schema["key"].dataType.simpleString()
    folded = at.join(places, ["key", "slice"]).select("key", "run", "us", "id", "seed").repartition("key", "run").sortWithinPartitions(
        "key", "run", "us", "id").mapInPandas(
        lambda batches: _admit(batches, limit, width), f"key {key_kind}, id {kind}, us long, seed boolean, admitted boolean")
    quiet = at.join(busy.select("key", "slice"), ["key", "slice"], "left_anti").select("key", "id", F.lit(True).alias("admitted"))
    return quiet.unionByName(folded.filter(~F.col("seed")).select("key", "id", "admitted"))


def running_metrics(events: DataFrame, value: str = "value", status: str = "status") -> DataFrame:
    """Count and mean per status and overall (`all`), in one pass."""
    return events.groupingSets([[status], []], status).agg(
        F.grouping(status).alias("_all"), F.count("*").alias("n"), half_up(F.avg(value), 2).alias("avg_value")).select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col(status)).alias("status"), "n", "avg_value")


def ttl_store(puts: DataFrame, now: Column, ttl_hours: float = 24, cap: int = 50, thread_cap: int = 500,
              prefix: str = "") -> DataFrame:
    """State of the store at `now`: `puts(namespace, key, value, updated_at, op)` with op put or delete.

    Latest write per (namespace, key); deleted and expired ones drop out; a namespace keeps its newest `cap`; of the
    `thread/` namespaces together the newest `thread_cap` items stay. `prefix` searches below a namespace.
    """
    rows = puts.filter(micros("updated_at") <= F.unix_micros(now.cast("timestamp")))
    if prefix:
        rows = rows.filter(F.col("namespace").startswith(prefix))
    live = rows.groupBy("namespace", "key").agg(F.max(F.struct("updated_at", "value", "op")).alias("r")).select(
        "namespace", "key", "r.*").filter("op = 'put'").drop("op")
    if ttl_hours > 0:
        age = F.unix_micros(now.cast("timestamp")) - micros("updated_at")
        live = live.filter(age <= int(ttl_hours * 3_600_000_000))
    live = top_rows(live, ("namespace",), [F.col("updated_at").desc(), F.col("key").desc()], cap)
    threads = live.filter(F.col("namespace").startswith("thread/"))
    newest = threads.orderBy(F.col("updated_at").desc(), F.col("namespace").desc(), F.col("key").desc()).limit(thread_cap)
    return live.filter(~F.col("namespace").startswith("thread/")).unionByName(newest)


def store_counts(live: DataFrame) -> DataFrame:
    return live.agg(F.count("*").alias("items"), F.count_distinct("namespace").alias("namespaces"))


def experience_summary(runs: DataFrame) -> DataFrame:
    """Runs, mean score and mean rounds per type of `runs(thread_id, user_id, type, score, rounds, ts)`; exact means."""
    return runs.withColumn("type", F.coalesce(F.nullif(F.trim("type"), F.lit("")), F.lit("unknown"))).groupBy("type").agg(
        F.count("*").alias("n_runs"), half_up(F.avg("score"), 2).alias("avg_score"), half_up(F.avg("rounds"), 2).alias("avg_rounds"))


def experience_categories(runs: DataFrame, risks: DataFrame) -> DataFrame:
    """Risks per type and category; risks are counted per run before they meet the runs."""
    counts = risks.groupBy("thread_id", "category").agg(F.count("*").alias("n"))
    return counts.join(runs.select("thread_id", "type"), "thread_id").groupBy("type", "category").agg(F.sum("n").alias("n"))


def last_runs(runs: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The newest run per thread or user."""
    return runs.groupBy(key).agg(F.max(F.struct("ts", *[f for f in fields if f != key])).alias("r")).select(
        key, *[F.col(f"r.{f}") for f in fields if f != key])


def recall_hints(requests: DataFrame, summary: DataFrame, categories: DataFrame, verdicts: DataFrame, profiles: DataFrame,
                 most: int = 8) -> DataFrame:
    """Hints (request_id, pos, hint) for `requests(request_id, user_id, type)`.

    A type seen twice or more gives its top three categories and mean score; categories with three or more verdicts and
    a false-positive share of .3 or more give a warning; the user's last type comes last; at most `most` hints.
    """
    top = top_rows(categories, ("type",), [F.col("n").desc(), F.col("category")], 3, "nth").groupBy("type").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("nth", "category", "n"))),
                    lambda x: F.concat(x["category"], F.lit("("), x["n"].cast("string"), F.lit(")"))), ", ").alias("top"))
    judged = verdicts.filter(F.col("verdict").isin("false_positive", "accepted")).groupBy("category").agg(
        F.count("*").alias("n"), ratio(F.count_if(F.col("verdict") == "false_positive"), F.count("*"), 8).alias("share"))
    # No row shows more than `most` hints, so that many warnings travel as one small array.
    flagged = judged.filter((F.col("n") >= 3) & (F.col("share") >= 0.3)).orderBy("category").limit(most).agg(
        F.sort_array(F.collect_list(F.concat(F.lit("often wrong: "), "category"))).alias("c")).scalar()
    known = F.col("n_runs") >= 2
    user_type = profiles.select("user_id", F.col("type").alias("last_type"))
    hints = F.filter(F.concat(
        F.array(F.when(known & F.col("top").isNotNull(), F.concat(F.lit("frequent: "), F.col("top"))),
                F.when(known, F.concat(F.lit("mean score "), F.format_number("avg_score", 2), F.lit(" over "),
                                       F.col("n_runs").cast("string")))),
        F.col("_warn"), F.array(F.when(F.col("last_type").isNotNull(), F.concat(F.lit("last type: "), F.col("last_type"))))),
        lambda h: h.isNotNull())
    return requests.join(summary, "type", "left").join(top, "type", "left").join(user_type, "user_id", "left").withColumn(
        "_warn", flagged).select("request_id", F.posexplode(F.slice(hints, 1, most)).alias("i", "hint")).select(
        "request_id", F.col("i").cast("long").alias("pos"), "hint")


def reconcile_orphans(records: DataFrame, checkpoints: DataFrame, now: Column, timeout: int = 900) -> DataFrame:
    """Running records after a restart: resume where the newest checkpoint is unfinished or waits, else failed.

    `records(id, status, started_at)`, `checkpoints(id, ts, has_next, pending)`; `timed_out` marks runs beyond the limit.
    """
    last = checkpoints.groupBy("id").agg(F.max(F.struct("ts", "has_next", "pending")).alias("c"))
    open_ = F.coalesce(F.col("c.has_next") | F.col("c.pending"), F.lit(False))
    late = F.unix_micros(now.cast("timestamp")) - micros("started_at") > timeout * 1_000_000
    return records.filter("status = 'analyzing'").join(last, "id", "left").select(
        "id", F.when(open_, "resume").otherwise("failed").alias("action"), late.alias("timed_out"))


def prune_checkpoints(checkpoints: DataFrame, protected: DataFrame, now: Column, ttl_hours: float = 72, cap: int = 500) -> DataFrame:
    """Per thread the newest stamp and whether it is deleted: expired, or not among the newest `cap`, unless protected."""
    latest = checkpoints.filter(F.col("thread_id").isNotNull() & F.col("ts").isNotNull()).groupBy("thread_id").agg(F.max("ts").alias("stamp"))
    newest = latest.orderBy(F.col("stamp").desc(), F.col("thread_id").desc()).limit(cap).select("thread_id", F.lit(True).alias("_new"))
    guard = protected.select("thread_id").distinct().withColumn("_safe", F.lit(True))
    expired = F.unix_micros(now.cast("timestamp")) - micros("stamp") > int(ttl_hours * 3_600_000_000)
    return latest.join(newest, "thread_id", "left").join(guard, "thread_id", "left").select(
        "thread_id", "stamp", ((expired | F.col("_new").isNull()) & F.col("_safe").isNull()).alias("deleted"))


def prune_counts(checkpoints: DataFrame, pruned: DataFrame) -> DataFrame:
    scanned = checkpoints.agg(F.count("*")).scalar()
    return pruned.agg(F.count_if("deleted").alias("deleted"), F.count_if(~F.col("deleted")).alias("kept")).withColumn("scanned", scanned)


def changed_fields(snapshots: DataFrame, scalars: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """Changes between consecutive snapshots (thread_id, step from 1): (thread_id, step, field, value).

    Changed scalars give the new value, append-only lists the added tail. The step before is found by an equi join.
    """
    before = snapshots.select("thread_id", (F.col("step") + 1).alias("step"), F.struct(*scalars, *lists).alias("b"))
    both = snapshots.join(before, ["thread_id", "step"], "left")
    row = lambda f, cond, value: F.when(cond, F.struct(F.lit(f).alias("field"), value.alias("value")))
    rows = [row(f, F.col("b").isNull() | ~F.col(f).eqNullSafe(F.col(f"b.{f}")), F.col(f).cast("string")) for f in scalars]
    for f in lists:
        known = F.coalesce(F.size(F.col(f"b.{f}")), F.lit(0))
        known = F.when(known < 0, 0).otherwise(known)
        tail = F.slice(F.col(f), known + 1, F.greatest(F.size(f) - known, F.lit(0)))
        rows.append(row(f, F.size(f) > known, F.array_join(tail.cast("array<string>"), ",")))
    return both.select("thread_id", "step", F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))


def dedupe_submissions(events: DataFrame, key: str = "id", order: Sequence[str] = ("ts",)) -> DataFrame:
    """The first submission of each id."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def latest_status(events: DataFrame, outcome: dict[str, str], key: str = "key", kind: str = "kind",
                  order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """Status per key from its last terminal event; `outcome` maps terminal kinds to statuses."""
    pairs = F.create_map(*[F.lit(x) for item in outcome.items() for x in item])
    terminal = events.filter(F.col(kind).isin(list(outcome)))
    return terminal.groupBy(key).agg(F.max_by(F.element_at(pairs, F.col(kind)), F.struct(*order)).alias("status"),
                                     F.max("ts").alias("updated_at"))
