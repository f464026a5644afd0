"""All registered queries of the library, and their SQL.

A query applies an operator to the adapted tables. Its SQL is written apart, in
the form a relational database would use (keep-first by DISTINCT ON, filters in
aggregates, correlated NOT EXISTS), so that the two don't share mistakes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.plans.adapters import Adapted, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, arrays as joined text: results compare alike in any engine."""
    out = []
    for field in df.schema:
        kind = field.dataType.typeName()
        c = F.col(f"`{field.name}`")
        out.append((c.cast("long") if kind in ("integer", "short", "byte") else F.array_join(c, "|") if kind == "array" else c).alias(field.name))
    return df.select(*out)


def register(name: str, make: Callable[[Adapted], DataFrame], sql: str | None = None, **views: str) -> None:
    """Adds a query of the adapted tables, and its SQL if SQL can express it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(make(Adapted(spark, sf_dir)))

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        SQL[name] = duck(sql, **views)


from lakemill.plans import claim_queries, enrichment_queries, identity_queries, report_queries, serving_queries, source_queries, text_queries, view_queries  # noqa: E402

for module in (view_queries, identity_queries, claim_queries, enrichment_queries, report_queries, serving_queries, source_queries, text_queries):
    module.add(register)
