"""Catalogue of runnable queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from docreview.sources.tables import Tables


@dataclass(frozen=True)
class Plan:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None):
    """Register a query; `sql` is the equivalent statement, None where SQL cannot say it."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in PLANS:
            raise ValueError(f"duplicate plan {name}")
        PLANS[name] = Plan(name, build, sql.strip() if sql else None)
        return build

    return wrap
