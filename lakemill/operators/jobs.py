"""Runs over several tables: a whole snapshot in the order of its keys, and a batch of stages in a fixed order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.operators import store
from lakemill.operators.claims import sensitive_public_count
from lakemill.operators.privacy import promotion
from lakemill.sources.snapshots import Store

#: Tables in the order in which they may be written: parents before children, with their upsert keys.
SNAPSHOT = [
    ("parties", ["external_id"]), ("companies", ["unified_business_no"]), ("regions", ["slug"]), ("elections", ["id"]), ("races", ["id"]), ("people", ["external_id"]), ("candidates", ["id"]), ("source_people", ["id"]),
    ("person_identity_matches", ["source_person_id", "person_id"]), ("person_claims", ["claim_key"]), ("legal_record_leads", ["id"]),
]


def write_snapshot(spark: SparkSession, folder: str, fresh: dict[str, DataFrame], run: str) -> DataFrame:
    """Upserts the tables that were delivered, parents first, and gives the run's log.

    All are published by one commit: readers see the whole delivery or nothing
    of it, and after a failure the snapshot before is still the newest.
    """
    change, written = Store(spark, folder).change(), {}
    for name, keys in SNAPSHOT:
        if name not in fresh:
            continue
        try:
            change.read(name)
        except KeyError:
            change.create(name, fresh[name], keys)
        else:
            change.merge(name, fresh[name])
        written[name] = fresh[name]
    change.commit()
    return store.run_log(spark, run, written)


#: Tables of promotion and their keys.
PROMOTED = {"people": ["id"], "companies": ["id"], "source_documents": ["id"], "person_company_relations": ["id"], "relation_candidates": ["id"]}


def promote_in_store(spark: SparkSession, folder: str, at: str) -> int:
    """Promotes all candidates of a store that may be promoted and publishes the five tables at once; gives the version.

    The store has all tables of ``PROMOTED`` with their keys. A second run adds nothing.
    """
    change = Store(spark, folder).change()
    rows = promotion(*(change.read(n) for n in ("relation_candidates", "people", "companies", "source_documents", "person_company_relations")), at=at)
    for name in PROMOTED:
        if not rows[name].isEmpty():
            change.merge(name, rows[name])
    return change.commit()


def write_report(df: DataFrame, path: str, *order: str) -> None:
    """A report as sorted JSON lines."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def run_batch(tables: dict[str, DataFrame], stages: list[tuple[str, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]]) -> dict[str, DataFrame]:
    """Stages in order, each on what the one before left. Raises if public claims of sensitive types have become more."""
    before = sensitive_public_count(tables["person_claims"]).first()["n"]
    for _, stage in stages:
        tables = {**tables, **stage(tables)}
    after = sensitive_public_count(tables["person_claims"]).first()["n"]
    if after > before:
        raise RuntimeError(f"sensitive claims became public: {before} before, {after} after")
    return tables


def lookup(view: DataFrame, **keys: object) -> DataFrame:
    """Rows of a view with these values, for point and key look-ups; a value of None asks for null."""
    for column, value in keys.items():
        view = view.where(F.col(column).isNull() if value is None else F.col(column) == value)
    return view


def rest_filter(view: DataFrame, filters: dict[str, str], order: str = "", limit: int | None = None) -> DataFrame:
    """Filters in the short form of the read API: eq., in.(…), gte., not.eq., is.null; order as column.desc."""
    for column, text in filters.items():
        c = F.col(column)
        op, _, value = text.partition(".")
        if op == "not":
            op, _, value = value.partition(".")
            view = view.where(c.isNotNull() if value == "null" else c != value)
        elif op == "in":
            view = view.where(c.isin(*value.strip("()").split(",")))
        elif op == "is":
            view = view.where(c.isNull() if value == "null" else c == (value == "true"))
        elif op in ("eq", "gte"):
            view = view.where(c == value if op == "eq" else c >= value)
        else:
            raise ValueError(f"unknown filter: {text}")
    if order:
        column, _, way = order.partition(".")
        view = view.orderBy(F.desc(column) if way == "desc" else F.col(column))
    return view if limit is None else view.limit(limit)
