"""Rule-driven facts: every document against every rule of its set, unrolled into one projection (no join, no shuffle)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreview.functions.scalars import clamp, exact_round, let, occurrences, strip

PRESENT, MISSING, CONTRADICTED = "present", "missing", "contradicted"


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """struct(whole, grp) of the first pattern that matches, null where none does; patterns never match nothing."""
    if not patterns:
        return F.lit(None).cast("struct<whole:string,grp:string>")
    none = F.lit(None).cast("string")
    tries = F.array(*[F.struct(
        F.regexp_extract(text, p, 0).alias("whole"),
        (F.nullif(F.regexp_extract(text, p, 1), F.lit("")) if re.compile(p).groups else none).alias("grp")) for p in patterns])
    return F.get(F.filter(tries, lambda m: m["whole"] != ""), F.lit(0))


def fact_confidence(captured: Column, evidence: Column, again: Column) -> Column:
    """Kind of match, length of the evidence, and whether it occurs again in the text."""
    factor = F.when(F.length(evidence) < 8, F.lit(0.85)).when(F.length(evidence) > 80, F.lit(0.95)).otherwise(1.0)
    bonus = F.when(again, F.lit(0.04)).otherwise(0.0)
    return exact_round(clamp(F.when(captured, F.lit(0.9)).otherwise(0.7) * factor + bonus, 0.3, 0.98), 2)


def detect_contradiction(text: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(first_match(text, patterns)["whole"], F.lit(""))


def extract_facts(df: DataFrame, rule_sets: dict[str, Sequence[dict]],
                  contradictions: dict[str, Sequence[str]] | None = None, text: str = "text") -> DataFrame:
    """`df(doc_id, text, rule_set)` -> one row per document and rule of its set.

    A contradicting phrase is reported only for facts that matched; `counter_phrase` shows it in any case.
    """
    contradictions = contradictions or {}
    body = F.col(text)

    def fact(rule: dict, ord_: int) -> Column:
        cut = let(first_match(body, rule["find"]), lambda m: F.struct(
            strip(m["whole"]).alias("found"), strip(m["grp"]).alias("inner")))
        return let(cut, lambda m: F.struct(
            F.lit(ord_).cast("long").alias("ord"), F.lit(rule["fact"]).alias("key"), F.lit(rule["must"]).alias("required"),
            m["found"].alias("found"), m["inner"].alias("inner"), (occurrences(body, m["found"]) > 1).alias("again"),
            detect_contradiction(body, contradictions.get(rule["fact"], ())).alias("counter_phrase")))

    by_set = F.lit(None)
    for name, rules in rule_sets.items():
        facts = F.array(*[fact(r, i) for i, r in enumerate(rules)])
        by_set = F.when(F.col("rule_set") == name, facts).otherwise(by_set)
    # The matches are cut out before the explode, so that no row carries the text along.
    rows = df.select("doc_id", "rule_set", F.inline(by_set))
    matched, captured, found = F.col("found").isNotNull(), F.col("inner").isNotNull(), F.col("found")
    return rows.select(
        "doc_id", "rule_set", "ord", "key", "required",
        F.coalesce(F.substring(F.coalesce("inner", found), 1, 120), F.lit("")).alias("value"),
        F.coalesce(F.substring(found, 1, 200), F.lit("")).alias("evidence"),
        F.when(matched, fact_confidence(captured, found, F.col("again"))).otherwise(0.0).alias("confidence"),
        F.when(matched, PRESENT).otherwise(MISSING).alias("status"),
        F.when(~matched, "none").when(captured, "capture").otherwise("keyword").alias("matched_by"),
        F.when(matched, F.col("counter_phrase")).otherwise("").alias("contradiction"), "counter_phrase")


def refine_facts(facts: DataFrame) -> DataFrame:
    """A present fact with a contradicting phrase becomes contradicted. Missing facts never carry such a phrase."""
    against = F.col("contradiction") != ""
    return facts.withColumns({
        "status": F.when(against, CONTRADICTED).otherwise(F.col("status")),
        "matched_by": F.when(against, "negation").otherwise(F.col("matched_by")),
        "confidence": F.when(against, F.greatest("confidence", F.lit(0.92))).otherwise(F.col("confidence"))})


def missing_clauses(facts: DataFrame, rule_sets: dict[str, Sequence[dict]], critical: Sequence[str],
                    default_reason: str = "The required clause was not found.",
                    default_text: str = "Add this clause.") -> DataFrame:
    """Gaps: required facts that are missing or contradicted, with level, score, reason and suggestion."""
    gap = facts.filter(F.col("required") & F.col("status").isin(MISSING, CONTRADICTED))
    against = F.col("status") == CONTRADICTED
    grave = F.col("key").isin(list(critical))

    def from_rule(field: str, default: str) -> Column:
        value = F.lit(default)
        for name, rules in rule_sets.items():
            for rule in rules:
                value = F.when((F.col("rule_set") == name) & (F.col("key") == rule["fact"]), rule["gap"].get(field) or default
                               ).otherwise(value)
        return value

    reason = from_rule("why", default_reason)
    return gap.select(
        "doc_id", "rule_set", "ord", "key", from_rule("title", "").alias("label"),
        F.when(against | grave, "high").otherwise("medium").alias("level"),
        gap_score(F.col("status"), F.col("key"), critical).alias("score"),
        F.when(against, F.concat(F.lit("Counter phrase found: "), "contradiction", F.lit(". "), reason)).otherwise(
            reason).alias("reason"),
        from_rule("law", "").alias("legal_basis"), from_rule("add", default_text).alias("suggested_text"))


def coverage_score(facts: DataFrame) -> DataFrame:
    """Share of required facts that are present, 0-100, half to even; 100 where nothing is required."""
    required = F.count_if("required")
    present = F.count_if(F.col("required") & (F.col("status") == PRESENT))
    return facts.groupBy("doc_id").agg(required.alias("required"), present.alias("present")).withColumn(
        "coverage", F.when(F.col("required") == 0, F.lit(100)).otherwise(
            F.bround(100 * F.col("present") / F.col("required"), 0)).cast("long"))


def review_summary(facts: DataFrame, critical: Sequence[str]) -> DataFrame:
    """One row per document from one aggregation of its refined facts: rule set, contradictions, coverage, gaps and the worst gap."""
    required, status = F.col("required"), F.col("status")
    needed, present = F.count_if(required), F.count_if(required & (status == PRESENT))
    gap = required & status.isin(MISSING, CONTRADICTED)
    return facts.groupBy("doc_id").agg(
        F.first("rule_set").alias("rule_set"), F.count_if(status == CONTRADICTED).alias("n_contradicted"),
        F.when(needed == 0, F.lit(100)).otherwise(F.bround(100 * present / needed, 0)).cast("long").alias("coverage"),
        F.count_if(gap).alias("n_gaps"), F.min(F.when(gap, gap_score(status, F.col("key"), critical))).alias("worst_gap"))


def gap_score(status: Column, key: Column, critical: Sequence[str]) -> Column:
    return F.when(status == CONTRADICTED, 10).when(key.isin(list(critical)), 20).otherwise(30).cast("long")


def review_documents(df: DataFrame, rule_sets, markers, default_set: str, contradictions, critical,
                     text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, gaps, summary) of whole documents without a model; the summary has one row per document."""
    from docreview.operators.text import infer_rule_set

    typed = infer_rule_set(df, markers, default_set, text=text)
    facts = refine_facts(extract_facts(typed, rule_sets, contradictions, text))
    return facts, missing_clauses(facts, rule_sets, critical), review_summary(facts, critical)
