"""Mixing overlapping sources to target weights as a min-cost flow.

Documents with the same set of sources form one pattern. Each pattern offers its words once at no cost and again at rising
cost, up to the repetition limit; each source asks for its target. The flow decides how many words every pattern gives;
inside a pattern, documents are taken in the order of a seeded hash until that number is reached.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docreview.llm.common import WORD, cut, table, whole

DIGIT_BITS = 12
HASH_BITS = 60
SMALL = 16384
"""Rows of sources or sets of sources that are broadcast; beyond, they are joined by a shuffle."""


def fill_targets(sizes: dict, weights: dict, cap: float, words: int | None = None) -> dict:
    """Shares by weight of all words, of which `words` are distinct where sources overlap.

    A source's target stops at `cap` times its size; the excess goes to the others.
    """
    left, open_ = float(sum(sizes.values()) if words is None else words), list(sizes)
    targets = {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > cap * sizes[s]]
        if not over:
            return targets | {s: left * weights[s] / total for s in open_}
        for s in over:
            targets[s] = float(cap * sizes[s])
        left -= sum(targets[s] for s in over)
        open_ = [s for s in open_ if s not in targets]
    return targets


def route(capacity: list[int], members: list[list[int]], quotas: list[int], copies: int) -> list[int]:
    """Words taken from each pattern: successive cheapest paths, copy c of a pattern costing c - 1 a word.

    Sources that share patterns compete for the cheap copies; a quota that cannot be met is filled as far as it goes.
    """
    patterns, sources = len(capacity), len(quotas)
    start, end = patterns + sources, patterns + sources + 1
    graph: list[list[list]] = [[] for _ in range(end + 1)]  # [to, room, cost, index of the reverse edge]

    def edge(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, words in enumerate(capacity):
        for c in range(copies):
            edge(start, p, words, c)
        for s in members[p]:
            edge(p, patterns + s, copies * words, 0)
    for s, quota in enumerate(quotas):
        edge(patterns + s, end, quota, 0)
    potential = [0] * (end + 1)
    while True:
        distance, came = [None] * (end + 1), [None] * (end + 1)
        distance[start], heap = 0, [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > distance[a]:
                continue
            for e in graph[a]:
                to = e[0]
                if e[1] > 0 and (distance[to] is None or d + e[2] + potential[a] - potential[to] < distance[to]):
                    distance[to] = d + e[2] + potential[a] - potential[to]
                    came[to] = (a, e)
                    heapq.heappush(heap, (distance[to], to))
        if distance[end] is None:
            break
        for v in range(end + 1):
            potential[v] += distance[end] if distance[v] is None else min(distance[v], distance[end])
        path, node = [], end
        while node != start:
            path.append(came[node][1])
            node = came[node][0]
        room = min(e[1] for e in path)
        for e in path:
            e[1] -= room
            graph[e[0]][e[3]][1] += room
    return [sum(graph[e[0]][e[3]][1] for e in graph[start] if e[0] == p) for p in range(patterns)]


def overlapping(sets: list[list]) -> list[list[int]]:
    """The places of `sets` grouped by the sources they share, directly or over others."""
    parent: dict = {}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for group in sets:
        for s in group:
            parent.setdefault(s, s)
            parent[find(s)] = find(group[0])
    out: dict = {}
    for i, group in enumerate(sets):
        out.setdefault(find(group[0]) if group else (i,), []).append(i)
    return list(out.values())


def mix(docs: DataFrame, weights=(1, 2, 3), copies: int = 3, seed: int = 17, max_patterns: int = 4096) -> DataFrame:
    """`docs(row, sources array<string>, size long, ...)` with `copies`, `taken` (their words) and `target` added.

    `target` is the sum of the targets of the row's sources. `row` must be set; equal rows are interchangeable. A null
    inside `sources` is a source of its own, ordered last; a null array counts as [null]. Sources are ordered by code
    point and weigh `weights` in turn. A row of size 0 gives nothing. Columns of `docs` named like the new ones give way.

    One total per set of sources, and nothing else, goes through the driver. The flow runs apart for sets that share no
    source, so that any number of sources is mixed; more than `max_patterns` sets that hang together are an error.
    """
    spark = docs.sparkSession
    docs = docs.drop("copies", "taken", "target")
    key = F.to_json(F.struct(F.coalesce(F.array_sort(F.array_distinct("sources")), F.array(F.lit(None).cast("string"))).alias("s")),
                    {"ignoreNullFields": "false"})
    work = docs.withColumn("_pattern", key).withColumn(
        "_order", F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), "row"), F.lit(64 - HASH_BITS)))
    totals = work.groupBy("_pattern").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    totals = sorted(totals, key=lambda r: r["_pattern"])
    sets = [json.loads(r["_pattern"]).get("s", [None]) for r in totals]
    sizes: dict = {}
    for r, group in zip(totals, sets):
        for s in group:
            sizes[s] = sizes.get(s, 0) + r["words"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    sizes = {s: sizes[s] for s in names}
    targets = fill_targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(names)}, copies,
                           sum(r["words"] for r in totals))
    flow = [0] * len(totals)
    for part in overlapping(sets):
        if len(part) > max_patterns:
            raise ValueError(f"more than {max_patterns} sets of sources hang together; raise max_patterns")
        own = {s: i for i, s in enumerate(sorted({s for p in part for s in sets[p]}, key=lambda s: (s is None, s or "")))}
        words = route([totals[p]["words"] for p in part], [[own[s] for s in sets[p]] for p in part],
                      [round(targets[s]) for s in own], copies)
        for p, n in zip(part, words):
            flow[p] = n
    plan = []
    for r, group, words in zip(totals, sets, flow):
        full, rest = divmod(words, r["words"]) if r["words"] else (0, 0)
        plan.append((r["_pattern"], full, rest, sum(targets[s] for s in group)))
    few = F.broadcast if len(plan) <= SMALL else lambda df: df
    plan_df = spark.createDataFrame(plan, "_pattern string, _full long, _rest long, target double")
    work = work.join(few(plan_df), "_pattern")

    # The words still to take are located digit by digit in the hash order: a histogram per level, never a sort of all rows.
    rows, depth = max((r["n"] for r in totals), default=0), 0
    cuts = plan_df.select("_pattern", F.lit(0).cast("long").alias("_path"), F.col("_rest").alias("_left"))
    while rows > 1024 and (depth + 1) * DIGIT_BITS <= HASH_BITS:
        depth, rows = depth + 1, rows >> DIGIT_BITS
        prefix = _prefix(depth)
        bins = (work.join(few(cuts), "_pattern").filter(_prefix(depth - 1) == F.col("_path"))
                .groupBy("_pattern", prefix.alias("_bin"), "_left").agg(F.sum("size").alias("_words")))
        before = F.coalesce(F.sum("_words").over(Window.partitionBy("_pattern").orderBy("_bin").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))
        reached = bins.withColumn("_before", before).filter(F.col("_before") <= F.col("_left"))
        found = reached.groupBy("_pattern").agg(F.max_by(F.struct(F.col("_bin").alias("_path"), (F.col("_left") - F.col("_before")).alias("_left")),
                                                         "_bin").alias("c")).select("_pattern", "c._path", "c._left").collect()
        cuts = spark.createDataFrame(found, "_pattern string, _path long, _left long")
    work = work.join(few(cuts), "_pattern")
    at_cut = work.filter(_prefix(depth) == F.col("_path"))
    upto = F.sum("size").over(Window.partitionBy("_pattern").orderBy("_order", "row", "size").rowsBetween(Window.unboundedPreceding, 0))
    at_cut = at_cut.withColumn("_extra", (2 * upto - F.col("size") < 2 * F.col("_left")).cast("long"))
    others = work.filter(_prefix(depth) != F.col("_path")).withColumn("_extra", (_prefix(depth) < F.col("_path")).cast("long"))
    both = others.unionByName(at_cut).withColumn("copies", F.col("_full") + F.col("_extra"))
    return both.withColumn("taken", F.col("size") * F.col("copies")).drop(
        "_pattern", "_order", "_full", "_rest", "_path", "_left", "_extra")


def _prefix(depth: int):
    """The first `depth` digits of the hash order."""
    return F.shiftright("_order", HASH_BITS - depth * DIGIT_BITS) if depth else F.lit(0).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size), size being the number of words; written once, so that texts are read once."""
    return cut(docs.select("doc_id", "source", F.regexp_count(whole("text"), F.lit(WORD)).cast("long").alias("size")))


def op4_mix_sources(spark, sf_dir):
    docs = sized(table(spark, sf_dir, "documents"))
    own = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    mixed = mix(docs.select("doc_id", "source", "size", F.coalesce("doc_id", F.lit(-1)).alias("row"),
                            F.array("source").alias("sources")))
    sources = own.withColumnRenamed("source", "_source")
    sources = F.broadcast(sources) if sources.limit(SMALL + 1).count() <= SMALL else sources
    return mixed.join(sources, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_size", "target", "taken")
