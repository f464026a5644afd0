"""Queries of reports on quality and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemill.operators import reports as R
from lakemill.operators import views as V
from lakemill.operators.identity import person_duplicate_review_queue
from lakemill.plans.identity_queries import QUEUE_VIEWS
from lakemill.plans.view_queries import ALL

_HAS = "EXISTS (SELECT 1 FROM public_claims_ c WHERE c.person_id = p.person_id AND c.claim_type = '{0}')"
_HAS_VALUE = "EXISTS (SELECT 1 FROM public_claims_ c WHERE c.person_id = p.person_id AND c.claim_type = '{0}' AND trim(coalesce(c.claim_value, '')) <> '')"


def _blank(c: str) -> str:
    return f"trim(coalesce(CAST({c} AS VARCHAR), '')) = ''"


MISSING = f"""
SELECT field, count(*) FILTER (lacks) AS n FROM (
  SELECT unnest(['gender', 'party', 'position', 'district', 'election_year', 'education', 'experience', 'primary_photo_url']) AS field,
         unnest([{_blank("gender")} OR gender = 'unknown', {_blank("party")}, {_blank("position")}, {_blank("district")}, {_blank("election_year")}, {_blank("education")} AND NOT {_HAS_VALUE.format("education")},
                 {_blank("experience")} AND NOT {_HAS_VALUE.format("experience")}, {_blank("primary_photo_url")}]) AS lacks FROM public_people_ p) x GROUP BY field"""

COVERAGE = f"""
SELECT metric, count(*) FILTER (has) AS current, count(*) AS total, CAST(round(100.0 * count(*) FILTER (has) / count(*)) AS BIGINT) AS percent FROM (
  SELECT unnest(['gender', 'external_id', 'birth_date', 'education', 'experience']) AS metric,
         unnest([coalesce(gender <> '' AND gender <> 'unknown', false), {_HAS.format("external_id")}, {_HAS.format("birth_date")}, coalesce(education <> '', false) OR {_HAS.format("education")}, coalesce(experience <> '', false) OR {_HAS.format("experience")}]) AS has
  FROM public_people_ p) x GROUP BY metric"""

TARGETS = f"""
SELECT person_id, name, missing FROM (SELECT person_id, name, position, array_to_string(m, ',') AS missing, len(m) AS k FROM (
  SELECT p.*, list_filter([CASE WHEN NOT {_HAS.format("birth_date")} THEN 'birth_date' END, CASE WHEN NOT {_HAS.format("external_id")} THEN 'external_id' END, CASE WHEN {_blank("education")} AND NOT {_HAS.format("education")} THEN 'education' END,
         CASE WHEN {_blank("experience")} AND NOT {_HAS.format("experience")} THEN 'experience' END], lambda x: x IS NOT NULL) AS m FROM public_people_ p) a WHERE list_has_any(m, ['birth_date', 'education', 'experience'])) b
ORDER BY CASE WHEN position LIKE '%總統%' THEN 0 WHEN position LIKE '%立法委員%' THEN 1 WHEN position LIKE '%縣長%' OR position LIKE '%市長%' THEN 2 WHEN position LIKE '%議員%' THEN 3 ELSE 4 END, k DESC, name, person_id LIMIT 200"""

EXTERNAL = r"""
SELECT DISTINCT person_id, external_id FROM (
  SELECT person_id, CASE WHEN regexp_matches(trim(claim_value), '(?i)^wikidata:Q\d+$') THEN 'wikidata:' || upper(substr(trim(claim_value), 10)) ELSE lower(trim(claim_value)) END AS external_id FROM public_claims_ WHERE claim_type = 'external_id' AND claim_value IS NOT NULL
  UNION ALL SELECT person_id, CASE WHEN regexp_matches(q, '(?i)^Q\d+$') THEN 'wikidata:' || upper(q) ELSE lower('wikidata:' || q) END FROM (SELECT person_id, json_extract_string(claim_json, '$.wikidataQid') AS q FROM public_claims_ WHERE claim_type = 'external_id') x WHERE q IS NOT NULL) y WHERE external_id <> ''"""

_REPORT_NAME = r"lower(regexp_replace(replace(regexp_extract(regexp_replace(coalesce(name, ''), '^[^\x{3400}-\x{9fff}A-Za-z]+', ''), '^[\x{3400}-\x{9fff}A-Za-z·．・\s]+'), '臺', '台'), '[‧·．・･•\s\x{00A0}\x{3000}]+', '', 'g'))"


def _set(c: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL AND trim({c}) <> '')), ','), '')"


def people(t):
    return V.public_people(t)


def claims(t):
    return V.public_person_claims(t)


def fresh_batch(t):
    return t["person_claims"].where(F.col("review_status") != "rejected")


def add(register) -> None:
    register("a06_pending_claims_by_type", lambda t: R.count_by(V.person_claim_review_queue(t), "claim_type"), """
        SELECT coalesce(nullif(claim_type, ''), '未分類') AS key, count(*) AS n FROM person_claims WHERE review_status IN ('pending', 'needs_more_evidence') GROUP BY 1""")
    register("a07_claim_status_counts", lambda t: R.status_counts(t["person_claims"]), "SELECT review_status || '/' || visibility || '/' || CASE WHEN is_public THEN 'public' ELSE 'private' END AS key, count(*) AS n FROM person_claims GROUP BY 1")
    register("a05_distinct_claimants", lambda t: claims(t).groupBy("claim_type").agg(F.countDistinct("person_id").alias("n")), "SELECT claim_type, count(DISTINCT person_id) AS n FROM public_claims_ GROUP BY 1", **ALL)
    register("a09_shared_external_ids", lambda t: R.shared_external_ids(claims(t)), "SELECT external_id, count(*) AS n_people, string_agg(person_id, ',' ORDER BY person_id) AS people FROM external GROUP BY 1 HAVING count(*) > 1", **(ALL | {"external": EXTERNAL}))
    register("a10_missing_fields", lambda t: R.missing_fields(people(t), claims(t)), MISSING, **ALL)
    register("a11_r34_coverage", lambda t: R.coverage(people(t), claims(t)), COVERAGE, **ALL)
    register("o09_duplicate_names", lambda t: R.duplicate_names(people(t)), f"""
        SELECT {_REPORT_NAME} AS normalized_name, count(*) AS n, {_set("party")} AS parties, {_set("district")} AS districts, {_set("position")} AS positions FROM public_people_ GROUP BY 1 HAVING count(*) > 1 AND {_REPORT_NAME} <> ''""", **ALL)
    register("p12_candidates_without_person", lambda t: R.candidates_without_person(t["candidates"].select(F.col("id").alias("candidate_id"), "person_id"), people(t)), "SELECT id AS candidate_id, person_id FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM public_people_ p WHERE p.person_id = c.person_id)", **ALL)
    register("p12_party_mismatches", lambda t: R.party_mismatches(V.public_candidates(t), people(t)), """
        SELECT c.candidate_id, c.person_id, p.party AS person_party, c.party AS candidate_party FROM public_candidates_ c JOIN public_people_ p ON p.person_id = c.person_id
        WHERE trim(coalesce(c.party, '')) <> '' AND trim(coalesce(p.party, '')) <> '' AND c.party <> p.party AND c.party <> '無黨籍及未經政黨推薦'""", **ALL)
    register("r18_missing_external_ids", lambda t: R.missing_external_id_kinds(people(t), t["person_claims"], t["person_merge_decisions"]), """
        SELECT person_id, CASE WHEN own = 0 AND dup = 0 THEN 'A_no_external_id_claim' WHEN hidden > 0 THEN 'B_external_id_claim_not_public' WHEN dup > 0 THEN 'C_external_id_on_merged_duplicate' ELSE 'D_unknown_pipeline_gap' END AS category
        FROM (SELECT p.person_id, (SELECT count(*) FROM person_claims c WHERE c.claim_type = 'external_id' AND c.person_id = p.person_id) AS own,
                     (SELECT count(*) FROM person_claims c WHERE c.claim_type = 'external_id' AND c.person_id = p.person_id AND c.review_status = 'verified' AND c.visibility = 'public' AND c.is_public) AS pub,
                     (SELECT count(*) FROM person_claims c WHERE c.claim_type = 'external_id' AND c.person_id = p.person_id AND NOT (c.review_status = 'verified' AND c.visibility = 'public' AND c.is_public)) AS hidden,
                     (SELECT count(*) FROM person_merge_decisions d JOIN person_claims c ON c.person_id = d.duplicate_person_id AND c.claim_type = 'external_id' WHERE d.status = 'verified' AND d.canonical_person_id = p.person_id) AS dup
              FROM public_people_ p) x WHERE pub = 0""", **ALL)
    register("r19_o07_enrichment_targets", lambda t: R.enrichment_targets(people(t), claims(t)), TARGETS, **ALL)
    register("a22_queue_counts", lambda t: R.count_by(person_duplicate_review_queue(t), "confidence_level"), "SELECT confidence_level AS key, count(*) AS n FROM dup_queue GROUP BY 1", **QUEUE_VIEWS)
    register("a22_decision_counts", lambda t: R.count_by(t["person_merge_decisions"], "status"), "SELECT status AS key, count(*) AS n FROM person_merge_decisions GROUP BY 1")
    register("a23_claim_estimate", lambda t: R.claim_estimate(t["people"], ("name", "alias", "gender", "party", "position", "district", "education", "experience", "external_id")), f"""
        SELECT CAST(sum({" + ".join(f"CASE WHEN {_blank(c)} OR {c} = 'unknown' THEN 0 ELSE 1 END" for c in ("name", "alias", "gender", "party", "position", "district", "education", "experience", "external_id"))}) AS BIGINT) AS n FROM people""")
    register("a24_batch_counts", lambda t: R.count_changes(t["person_claims"], fresh_batch(t), "source_name"), """
        SELECT source_name AS key, count(*) AS n_before, count(*) FILTER (review_status <> 'rejected') AS n_after, count(*) FILTER (review_status <> 'rejected') - count(*) AS change FROM person_claims GROUP BY 1""")
    register("a02_birth_dates", lambda t: t["person_claims"].where((F.col("claim_type") == "birth_date") & V.published()).groupBy("person_id").agg(F.min("claim_value").alias("first"), F.max("claim_value").alias("last")), """
        SELECT person_id, min(claim_value) AS first, max(claim_value) AS last FROM person_claims WHERE claim_type = 'birth_date' AND review_status = 'verified' AND visibility = 'public' AND is_public GROUP BY 1""")
    register("a18_row_counts", lambda t: t["people"].agg(F.count("*").alias("people"), F.count(F.when(F.col("is_public"), 1)).alias("public_people"), F.count("alias").alias("aliases")), "SELECT count(*) AS people, count(*) FILTER (is_public) AS public_people, count(alias) AS aliases FROM people")
    register("j19_review_display_names", lambda t: t["person_claims"].join(t["source_people"].select(F.col("id").alias("s_id"), "raw_name"), F.col("source_person_id") == F.col("s_id"), "left").join(people(t).select(F.col("person_id").alias("p_id"), F.col("name").alias("p_name")), F.col("person_id") == F.col("p_id"), "left").select(F.col("id").alias("claim_id"), F.coalesce("p_name", "raw_name", F.get_json_object("claim_json", "$.wikidataQid"), F.lit("未分類")).alias("display_name")), """
        SELECT c.id AS claim_id, coalesce(p.name, s.raw_name, json_extract_string(c.claim_json, '$.wikidataQid'), '未分類') AS display_name FROM person_claims c LEFT JOIN source_people s ON s.id = c.source_person_id LEFT JOIN public_people_ p ON p.person_id = c.person_id""", **ALL)
    register("p15_review_queue_filter", lambda t: V.person_claim_review_queue(t).where(F.lower(F.concat_ws(" ", "claim_type", "claim_value", "raw_name", "source_name", "person_id")).contains("click 1")).select("claim_id"), """
        SELECT c.id AS claim_id FROM person_claims c LEFT JOIN source_people s ON s.id = c.source_person_id WHERE c.review_status IN ('pending', 'needs_more_evidence')
        AND contains(lower(concat_ws(' ', c.claim_type, c.claim_value, s.raw_name, c.source_name, c.person_id)), 'click 1')""")
