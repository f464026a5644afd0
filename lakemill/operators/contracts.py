"""Constraints of the data model as predicates and checks that give violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Enumerations of the data model.
ENUMS = {
    "relation_type": ("director", "supervisor", "manager", "representative", "shareholder", "founder", "advisor", "donor", "family", "other"),
    "review_status": ("pending", "verified", "rejected", "archived", "needs_more_evidence"),
    "visibility": ("public", "review_only", "private"),
    "match_status": ("auto_matched", "probable_match", "possible_match", "unmatched", "rejected"),
    "merge_status": ("suggested", "verified", "rejected", "archived"),
    "confidence_level": ("A", "B", "C", "D"),
}


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of rows that break a rule; a rule that can't be told of null isn't broken."""
    broken = F.array_compact(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def in_enum(column: str, enum: str) -> Column:
    return F.col(column).isin(*ENUMS[enum])


def in_range(column: str, low: float = 0, high: float = 100) -> Column:
    return F.col(column).between(low, high)


def missing_parents(child: DataFrame, key: str, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows whose foreign key is told and has no parent."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias("pk_")), F.col(fk) == F.col("pk_"), "left_anti").select(F.col(key).cast("string").alias("key"), F.col(fk).cast("string").alias("missing"))


def repeated_keys(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys that stand more than once among the rows that the (partial) unique constraint covers."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")




def policies() -> dict[str, Column]:
    """Read gates and importer guards by name."""
    return {
        "read_public": F.col("is_public"),
        "read_relations": (F.col("verification_status") == "verified") & F.col("is_public"),
        "read_claims": (F.col("review_status") == "verified") & (F.col("visibility") == "public") & F.col("is_public"),
        "import_candidates": (F.col("review_status") == "pending") & ~F.col("is_public"),
        "import_claims": F.col("review_status").isin("pending", "needs_more_evidence") & (F.col("visibility") == "review_only") & ~F.col("is_public"),
    }


def clone_races(races: DataFrame, elections: DataFrame, last_cycle: str, planned: str) -> DataFrame:
    """Race shells of a planned election: last cycle's local races with new ids, no candidates yet."""
    target = elections.where(F.col("id") == planned).select(F.col("id").alias("new_election"), F.col("voting_date").alias("new_date"))  # one row
    rows = races.where(F.col("election_id") == last_cycle).join(F.broadcast(target))
    return rows.select(F.concat(F.lit("planned:"), "id").alias("id"), F.col("new_election").alias("election_id"), "region_id", "race_type", "title", F.col("new_date").alias("voting_date"), F.lit("announced").alias("status"))
