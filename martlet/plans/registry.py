"""Registry of queries: a name, the survey rows it covers, a Spark plan and, where SQL can say it, SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from martlet.plans.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.plan(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register a plan under its function name."""

    def register(plan: Callable[[Tables], DataFrame]):
        if plan.__name__ in QUERIES:
            raise ValueError(f"query {plan.__name__} is registered twice")
        QUERIES[plan.__name__] = Query(plan.__name__, tuple(covers.split()), plan, sql)
        return plan

    return register


def with_(body: str, *tables: str) -> str:
    """SQL with common table expressions in front."""
    return f"WITH {', '.join(tables)} {body}"
