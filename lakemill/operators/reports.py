"""Reports on data quality and progress, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.functions import text as T

UNSORTED = "未分類"
FIELDS = ("gender", "party", "position", "district", "election_year", "education", "experience", "primary_photo_url")
#: Words of a position and its priority as a target.
TARGET_RANK = [(("總統",), 0), (("立法委員",), 1), (("縣長", "市長"), 2), (("議員",), 3)]


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Counts by value, most first; null and empty count as unsorted."""
    key = F.coalesce(F.nullif(column, F.lit("")), F.lit(UNSORTED)).alias("key")
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")


def status_counts(claims: DataFrame) -> DataFrame:
    """Counts by review status, visibility and publicity together."""
    key = F.concat_ws("/", "review_status", "visibility", F.when(F.col("is_public"), "public").otherwise("private")).alias("key")
    return claims.groupBy(key).agg(F.count("*").alias("n"))


def covered(claims: DataFrame, *types: str) -> DataFrame:
    """For each person, whether public claims of these types with a value exist."""
    rows = claims.where(F.col("claim_type").isin(*types))
    return rows.groupBy(F.col("person_id").alias("c_id")).agg(*(F.max((F.col("claim_type") == t) & ~T.is_blank("claim_value")).alias(f"has_{t}") for t in types))


def missing_fields(people: DataFrame, claims: DataFrame) -> DataFrame:
    """How many people lack each field; education and experience may come from claims."""
    rows = people.join(covered(claims, "education", "experience"), F.col("person_id") == F.col("c_id"), "left")

    def lacks(c: str) -> Column:
        blank = T.is_blank(c)
        if c == "gender":
            return blank | (F.col(c) == "unknown")
        return blank & ~F.coalesce(f"has_{c}", F.lit(False)) if c in ("education", "experience") else blank

    counts = rows.agg(*(F.count(F.when(lacks(c), 1)).alias(c) for c in FIELDS))
    return counts.select(F.expr(f"stack({len(FIELDS)}, {', '.join(f'{c!r}, {c}' for c in FIELDS)}) AS (field, n)"))


def external_ids(claims: DataFrame) -> DataFrame:
    """(person_id, external_id): the ids of public claims in canonical form."""
    ids = F.explode(F.array(T.external_id("claim_value"), T.external_id(F.concat(F.lit("wikidata:"), F.get_json_object("claim_json", "$.wikidataQid")))))
    return claims.where(F.col("claim_type") == "external_id").select("person_id", ids.alias("external_id")).where("external_id IS NOT NULL AND external_id <> ''").distinct()


def shared_external_ids(claims: DataFrame) -> DataFrame:
    """External ids that more than one person has."""
    grouped = external_ids(claims).groupBy("external_id").agg(F.array_sort(F.collect_set("person_id")).alias("people"))
    return grouped.where(F.size("people") > 1).select("external_id", F.size("people").alias("n_people"), F.array_join("people", ",").alias("people"))


def duplicate_names(people: DataFrame) -> DataFrame:
    """Names of more than one record, with what the records tell."""
    sets = [F.array_join(F.array_sort(F.collect_set(F.when(~T.is_blank(c), F.col(c)))), ",").alias(n) for c, n in (("party", "parties"), ("district", "districts"), ("position", "positions"))]
    return people.groupBy(T.report_name("name").alias("normalized_name")).agg(F.count("*").alias("n"), *sets).where("n > 1 AND normalized_name <> ''")


def candidates_without_person(candidates: DataFrame, people: DataFrame) -> DataFrame:
    return candidates.join(people.select("person_id"), "person_id", "left_anti").select("candidate_id", "person_id")


def party_mismatches(candidates: DataFrame, people: DataFrame) -> DataFrame:
    """Candidacies for another party than the person's; no nomination by a party is no mismatch."""
    p = people.select(F.col("person_id").alias("p_id"), F.col("party").alias("person_party_"))
    rows = candidates.join(p, F.col("person_id") == F.col("p_id"))
    odd = ~T.is_blank("party") & ~T.is_blank("person_party_") & (F.col("party") != F.col("person_party_")) & (F.col("party") != "無黨籍及未經政黨推薦")
    return rows.where(odd).select("candidate_id", "person_id", F.col("person_party_").alias("person_party"), F.col("party").alias("candidate_party"))


def coverage(people: DataFrame, claims: DataFrame) -> DataFrame:
    """Progress: of all people, how many have each core signal, in per cent."""
    rows = people.join(covered_any(claims), F.col("person_id") == F.col("c_id"), "left")

    def has(t: str) -> Column:
        return F.coalesce(f"any_{t}", F.lit(False))

    tests = {
        "gender": F.coalesce((F.col("gender") != "") & (F.col("gender") != "unknown"), F.lit(False)), "external_id": has("external_id"), "birth_date": has("birth_date"),
        "education": F.coalesce(F.col("education") != "", F.lit(False)) | has("education"), "experience": F.coalesce(F.col("experience") != "", F.lit(False)) | has("experience"),
    }
    counts = rows.agg(F.count("*").alias("total"), *(F.count(F.when(c, 1)).alias(k) for k, c in tests.items()))
    rows = counts.select("total", F.expr(f"stack({len(tests)}, {', '.join(f'{k!r}, {k}' for k in tests)}) AS (metric, current)"))
    return rows.select("metric", "current", "total", F.when(F.col("total") > 0, F.round(100 * F.col("current") / F.col("total"))).otherwise(F.lit(0.0)).cast("long").alias("percent"))


def covered_any(claims: DataFrame) -> DataFrame:
    types = ("external_id", "birth_date", "education", "experience")
    return claims.groupBy(F.col("person_id").alias("c_id")).agg(*(F.max(F.col("claim_type") == t).alias(f"any_{t}") for t in types))


def missing_signals(people: DataFrame, claims: DataFrame) -> DataFrame:
    """People with the signals they lack, in a fixed order."""
    rows = people.join(covered_any(claims), F.col("person_id") == F.col("c_id"), "left")
    lacks = {t: ~F.coalesce(f"any_{t}", F.lit(False)) for t in ("birth_date", "external_id", "education", "experience")}
    lacks |= {t: lacks[t] & T.is_blank(t) for t in ("education", "experience")}
    return rows.withColumn("missing", F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in lacks.items())))).drop("c_id", *(f"any_{t}" for t in lacks))


def enrichment_targets(people: DataFrame, claims: DataFrame, most: int = 200) -> DataFrame:
    """Whom to look up first: by office, then by how much is missing, then by name."""
    rows = missing_signals(people, claims).where(F.arrays_overlap("missing", F.array(F.lit("birth_date"), F.lit("education"), F.lit("experience"))))
    rank = T.first_of([(T.has_any(T.text("position"), words), n) for words, n in TARGET_RANK], 4)
    ordered = rows.orderBy(rank, F.desc(F.size("missing")), "name", "person_id").limit(most)
    return ordered.select("person_id", "name", F.array_join("missing", ",").alias("missing"))


def missing_external_id_kinds(people: DataFrame, claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Public people without a public external id, by why: none at all, one that isn't public, one of a merged duplicate, unknown."""
    ids = claims.where(F.col("claim_type") == "external_id")
    public = (F.col("review_status") == "verified") & (F.col("visibility") == "public") & F.col("is_public")
    own = ids.groupBy(F.col("person_id").alias("o_id")).agg(F.max(public).alias("any_public"), F.max(~public).alias("any_hidden"))
    merged = decisions.where(F.col("status") == "verified").select("duplicate_person_id", F.col("canonical_person_id").alias("m_id"))
    others = merged.join(ids, F.col("duplicate_person_id") == F.col("person_id")).select("m_id").distinct().withColumn("on_duplicate", F.lit(True))
    rows = people.join(own, F.col("person_id") == F.col("o_id"), "left").join(others, F.col("person_id") == F.col("m_id"), "left").where(~F.coalesce("any_public", F.lit(False)))
    kind = T.first_of(
        [
            (F.col("o_id").isNull() & F.col("m_id").isNull(), "A_no_external_id_claim"), (F.coalesce("any_hidden", F.lit(False)), "B_external_id_claim_not_public"),
            (F.col("m_id").isNotNull(), "C_external_id_on_merged_duplicate"),
        ],
        "D_unknown_pipeline_gap",
    )
    return rows.select("person_id", kind.alias("category"))


def identity_gaps(features: DataFrame, groups: DataFrame) -> DataFrame:
    """Same-name groups that can't be told apart yet, with the stable signals their records lack and a priority."""
    open_ = groups.where(F.col("top_recommendation").isin("same_name_only", "manual_review"))
    lacks = F.array_compact(F.array(F.when(F.size("external_ids") == 0, "external_id"), F.when(F.size("birth_dates") == 0, "birth_date")))
    lacking = features.select(F.col("n_name").alias("g_name"), lacks.alias("lacks"))
    by_name = lacking.groupBy("g_name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lacks")))).alias("signals")).where(F.size("signals") > 0)
    rows = open_.join(by_name, F.col("normalized_name") == F.col("g_name"))
    priority = T.first_of([(F.col("top_recommendation") == "manual_review", "high"), (F.array_contains("signals", "birth_date"), "medium")], "low")
    return rows.select("normalized_name", "record_count", "top_recommendation", F.array_join("signals", ",").alias("missing_signals"), priority.alias("priority"))


def gap_histogram(gaps: DataFrame) -> DataFrame:
    """How many groups have each priority and lack each signal."""
    signals = F.transform(F.split("missing_signals", ","), lambda s: F.concat(F.lit("signal:"), s))
    keys = F.concat(F.array(F.concat(F.lit("priority:"), "priority")), signals)
    return gaps.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def claim_estimate(records: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """How many claims the records would make: told fields that aren't unknown."""
    told = sum((F.when(~T.is_blank(c) & (F.col(c).cast("string") != "unknown"), 1).otherwise(0) for c in fields), F.lit(0))
    return records.agg(F.coalesce(F.sum(told), F.lit(0)).alias("n"))


def count_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts by key before and after a batch, and the difference."""
    a, b = before.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n_before")), after.groupBy(F.col(key).alias("b_key")).agg(F.count("*").alias("n_after"))
    rows = a.join(b, F.col("key").eqNullSafe(F.col("b_key")), "full")
    first, second = F.coalesce("n_before", F.lit(0)), F.coalesce("n_after", F.lit(0))
    return rows.select(F.coalesce("key", "b_key").alias("key"), first.alias("n_before"), second.alias("n_after"), (second - first).alias("change"))
