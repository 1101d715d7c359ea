"""Validity, region and provenance of reference rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("effective_from", "effective_until", "region", "version", "source_url", "checked_at", "note")
# Issue codes that block a release.
BLOCKING = ("source_not_verified", "never_checked", "stale", "not_effective", "invalid_date")
NATIONAL = "全国"


def iso_date(value: Column) -> Column:
    """ISO text to date, null where it is no date."""
    return F.try_to_date(F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value), "yyyy-MM-dd")


def attach_metadata(df: DataFrame, base: DataFrame, keywords: Sequence[tuple[str, dict[str, str]]],
                    overrides: DataFrame, default: dict[str, str], region: str = "",
                    fields: Sequence[str] = FIELDS) -> DataFrame:
    """Fill the metadata of `df(law_name, *fields)`.

    Base values come from `base(law_name, ...)` by exact name, else from the first keyword inside the name, else the
    default. `overrides(key, ...)` replace them: the row for `name@region` hides the one for `name`. An override field
    always wins, otherwise a value already on the row does.
    """
    name = F.col("law_name")

    def wrap(source: DataFrame, key: str, label: str) -> DataFrame:
        present = [f for f in fields if f in source.columns]
        return source.select(F.col(key).alias("_key"), F.struct(*[
            (F.col(f).cast("string") if f in present else F.lit(None).cast("string")).alias(f) for f in fields]).alias(label))

    def join(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
        return left.withColumn("_k", key).join(right, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")

    literal = lambda values: F.struct(*[F.lit(values.get(f)).cast("string").alias(f) for f in fields])
    fallback = literal(default)
    for word, values in reversed(keywords):
        fallback = F.when(F.contains(name, F.lit(word)), literal({**default, **values})).otherwise(fallback)
    out = join(df, wrap(base, "law_name", "_base"), name)
    out = join(out, wrap(overrides, "key", "_plain"), name)
    if region:
        out = join(out, wrap(overrides, "key", "_local"), F.concat(name, F.lit("@" + region)))
        out = out.withColumn("_plain", F.coalesce("_local", "_plain")).drop("_local")
    out = out.withColumn("_fallback", fallback)
    for f in fields:
        own = F.col(f) if f in df.columns else F.lit(None).cast("string")
        meta = F.when(F.col("_base").isNotNull(), F.coalesce(F.col(f"_base.{f}"), F.lit(default.get(f)))).otherwise(
            F.col(f"_fallback.{f}"))
        out = out.withColumn(f, F.coalesce(F.col(f"_plain.{f}"), own, meta))
    return out.drop("_base", "_plain", "_fallback")


def effective(as_of: Column, start: str = "effective_from", until: str = "effective_until") -> Column:
    """Not started later, not ended earlier; missing or unreadable dates count as valid."""
    begin, end = iso_date(F.col(start)), iso_date(F.col(until))
    return ~(F.coalesce(begin > as_of, F.lit(False)) | F.coalesce(end < as_of, F.lit(False)))


def active_as_of(df: DataFrame, as_of: str) -> DataFrame:
    return df.filter(effective(F.lit(as_of).cast("date")))


def versions_as_of(asks: DataFrame, versions: DataFrame) -> DataFrame:
    """As-of join: for `asks(law_name, as_of)` every version of the law valid on that day.

    The name is an equi key, so this is a hash or sort-merge join with the interval as its residual condition.
    """
    return asks.join(versions, "law_name").filter(effective(F.col("as_of")))


def region_matches(df: DataFrame, region: str, column: str = "region", national: str = NATIONAL) -> DataFrame:
    """National rows always apply, others where either name contains the other; a blank request keeps all."""
    if not region:
        return df
    value = F.when(F.coalesce(F.col(column), F.lit("")) == "", F.lit(national)).otherwise(F.col(column))
    return df.filter(value.startswith(national) | F.contains(value, F.lit(region)) | F.contains(F.lit(region), value))


def verify_corpus(df: DataFrame, as_of: str, stale_days: int = 180, generic_url: str = "https://flk.npc.gov.cn/ (",
                  baseline: str = "基线", order: str = "pos") -> DataFrame:
    """Issue rows (law_name, code, detail) over the first row of each name."""
    today = F.lit(as_of).cast("date")
    rest = [c for c in ("source_url", "checked_at", "effective_from", "effective_until", "note") if c in df.columns]
    first = df.groupBy("law_name").agg(F.min_by(F.struct(*rest), order).alias("r")).select("law_name", "r.*")
    url = F.coalesce(F.col("source_url"), F.lit(""))
    checked = iso_date(F.coalesce(F.col("checked_at"), F.lit("")))

    def issue(cond: Column, code: str, detail: Column | None = None) -> Column:
        return F.when(cond, F.struct(F.lit(code).alias("code"), (detail if detail is not None else F.lit("")).alias("detail")))

    issues = F.array(
        issue((url == "") | url.startswith(generic_url) | F.contains(url, F.lit("example.invalid")), "source_not_verified"),
        issue(checked.isNull(), "never_checked"),
        issue(F.datediff(today, checked) > stale_days, "stale", F.date_format(checked, "yyyy-MM-dd")),
        issue(iso_date(F.coalesce(F.col("effective_from"), F.lit(""))).isNull(), "invalid_date"),
        issue(~effective(today), "not_effective"),
        issue(F.contains(F.coalesce(F.col("note"), F.lit("")), F.lit(baseline)), "baseline_value"))
    return first.select("law_name", F.inline(F.filter(issues, lambda i: i.isNotNull())))


def verify_summary(df: DataFrame, issues: DataFrame) -> DataFrame:
    """Counts per code with the blocking flag, and one row `all` with the totals; `ok` where nothing blocks."""
    flagged = issues.withColumn("blocking", F.col("code").isin(*BLOCKING))
    totals = flagged.groupingSets([["code"], []], "code").agg(
        F.count("*").alias("n_issues"), F.count_if("blocking").alias("n_blocking"), F.grouping("code").alias("_all"))
    n_laws = df.agg(F.count_distinct("law_name").alias("n")).scalar()
    return totals.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("code")).alias("code"), "n_issues",
                         "n_blocking", (F.col("n_blocking") == 0).alias("ok"), n_laws.alias("n_laws"))


def metadata_snapshot(df: DataFrame, fields: Sequence[str] = FIELDS, order: str = "pos") -> DataFrame:
    """Last row of each non-blank name, fields as text, null as blank."""
    values = F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields])
    return df.filter(F.coalesce(F.col("law_name"), F.lit("")) != "").groupBy("law_name").agg(
        F.max_by(values, order).alias("v")).select("law_name", "v.*")


def snapshot_diff(old: DataFrame, new: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Names added and removed, and one row per changed field."""
    pack = lambda df, side: df.select("law_name", F.struct(*[
        F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields]).alias(side))
    both = pack(old, "o").join(pack(new, "n"), "law_name", "full")
    row = lambda change, field, before, after: F.struct(
        F.lit(change).alias("change"), F.lit(field).alias("field"), before.alias("old"), after.alias("new"))
    blank = F.lit("")
    changed = F.filter(F.array(*[F.when(F.col(f"o.{f}") != F.col(f"n.{f}"),
                                        row("changed", f, F.col(f"o.{f}"), F.col(f"n.{f}"))) for f in fields]),
                       lambda r: r.isNotNull())
    rows = F.when(F.col("o").isNull(), F.array(row("added", "", blank, blank))).when(
        F.col("n").isNull(), F.array(row("removed", "", blank, blank))).otherwise(changed)
    return both.select("law_name", F.inline(rows))


def apply_corrections(df: DataFrame, fixes: DataFrame) -> DataFrame:
    """Category replaced and missing keywords appended by (law_name, article); `changed` marks a new category.

    Applying the same `fixes(law_name, article, new_category, extra_keywords)` again changes nothing.
    """
    out = df.join(fixes, ["law_name", "article"], "left")
    hit = F.col("new_category").isNotNull()
    known = F.coalesce("keywords", F.array().cast("array<string>"))
    extra = F.filter(F.coalesce("extra_keywords", F.array().cast("array<string>")), lambda k: ~F.array_contains(known, k))
    return out.withColumn("old_category", F.col("category")).withColumn(
        "changed", hit & ~F.col("category").eqNullSafe(F.col("new_category"))).withColumn(
        "category", F.coalesce("new_category", "category")).withColumn(
        "keywords", F.concat(known, F.array_distinct(extra))).drop("new_category", "extra_keywords")


def correction_changes(corrected: DataFrame) -> DataFrame:
    """Dry-run list of category changes."""
    return corrected.filter("changed").select("law_name", "article", "old_category", F.col("category").alias("new_category"))


def corpus_coverage(df: DataFrame, categories: DataFrame, minimum: int = 1) -> DataFrame:
    """Rows per expected category, zero filled, and whether the minimum is reached."""
    counts = df.groupBy("category").agg(F.count("*").alias("n"))
    return categories.select("category").join(counts, "category", "left").select(
        "category", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows")).withColumn(
        "covered", F.col("n_rows") >= minimum)


def unknown_categories(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Categories in the corpus that nobody expects."""
    return df.groupBy("category").agg(F.count("*").alias("n_rows")).join(categories.select("category"), "category", "left_anti")
