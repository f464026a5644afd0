"""Queries of enrichment and reviewers' decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemill.functions import text as T
from lakemill.operators import enrichment as E
from lakemill.operators import views as V
from lakemill.plans.claim_queries import _QID, _SCORE, ENTITY
from lakemill.plans.identity_queries import _IDENT
from lakemill.plans.view_queries import ALL

DELIVERED = f"""
SELECT id AS claim_id, CASE WHEN updated_at % 3 = 0 THEN person_id END AS person_id, CASE WHEN updated_at % 3 = 1 THEN 'cec-' || CAST(updated_at % 400 AS VARCHAR) END AS person_external_id,
       CASE WHEN updated_at % 2 = 0 THEN 'redwidgeteconomy' END AS normalized_name, CASE WHEN updated_at % 5 = 0 THEN 'wikidata-person-enrichment' WHEN updated_at % 5 = 1 THEN 'taipei-profile' ELSE 'cec-candidate-profile' END AS source_id,
       claim_type, claim_value, claim_json, confidence_level, review_status, visibility FROM person_claims"""
REJECTED = f"SELECT DISTINCT person_id, {_QID.format('claim_json')} AS qid FROM person_claims WHERE review_status = 'rejected' AND person_id IS NOT NULL AND {_QID.format('claim_json')} IS NOT NULL"


def delivered(t):
    n = F.col("updated_at")
    return t["person_claims"].select(
        F.col("id").alias("claim_id"), F.when(n % 3 == 0, F.col("person_id")).alias("person_id"), F.when(n % 3 == 1, F.concat(F.lit("cec-"), (n % 400).cast("string"))).alias("person_external_id"),
        F.when(n % 2 == 0, "redwidgeteconomy").alias("normalized_name"), T.first_of([(n % 5 == 0, "wikidata-person-enrichment"), (n % 5 == 1, "taipei-profile")], "cec-candidate-profile").alias("source_id"),
        "claim_type", "claim_value", "claim_json", "confidence_level", "review_status", "visibility",
    )


def rejected(t):
    return t["person_claims"].where((F.col("review_status") == "rejected") & F.col("person_id").isNotNull()).select("person_id", T.qid_of("claim_json").alias("qid")).where("qid IS NOT NULL").distinct()


_KIND = "CASE WHEN contains(source_id, 'cec') THEN 'official_election' WHEN contains(source_id, 'wikidata') THEN 'wikidata' ELSE 'other' END"
_MATCHED = "coalesce(json_extract_string(claim_json, '$.identityMatch.status') = 'matched', false)"
CLAIMS = f"""
SELECT claim_id, pid AS person_id, claim_type, claim_value, CAST(s AS BIGINT) AS review_score, CASE WHEN no THEN 'rejected' WHEN pub THEN 'verified' ELSE 'pending' END AS review_status, CASE WHEN no THEN 'private' WHEN pub THEN 'public' ELSE 'review_only' END AS visibility, pub AND NOT no AS is_public
FROM (SELECT *, coalesce(visibility = 'public' AND review_status = 'verified' AND s >= 90 AND claim_type NOT IN ('legal_case', 'family_relation'), false) AS pub, EXISTS (SELECT 1 FROM rejected r WHERE r.person_id = pid AND r.qid = q) AS no
  FROM (SELECT *, {_SCORE} AS s FROM (SELECT d.*, true AS matched, {_KIND} LIKE 'official%' AS off, {_QID.format("claim_json")} AS q,
      coalesce((SELECT p.id FROM people p WHERE p.id = d.person_id), (SELECT min(p.id) FROM people p WHERE p.external_id = d.person_external_id), CASE WHEN {_MATCHED} THEN (SELECT min(p.id) FROM people p WHERE {_IDENT.format("p.name")} = d.normalized_name) END) AS pid
    FROM delivered d WHERE source_id <> 'wikidata-person-enrichment' OR {_MATCHED}) a WHERE pid IS NOT NULL) b) c"""

DECISIONS = f"SELECT id AS claim_id, CASE WHEN updated_at % 2 = 0 THEN 'approve' ELSE 'reject' END AS decision FROM person_claims WHERE review_status = 'pending' AND updated_at % 4 < 2 AND claim_type IN ('external_id', 'gender')"
CASCADE = f"""
SELECT claim_id, CASE WHEN d = 'reject' THEN 'rejected' ELSE 'verified' END AS review_status, CASE WHEN d = 'reject' THEN 'private' ELSE 'public' END AS visibility, d <> 'reject' AS is_public FROM (SELECT claim_id, max(decision) AS d FROM (
  SELECT claim_id, decision FROM decisions_
  UNION ALL SELECT c.id, x.decision FROM (SELECT *, {_QID.format("claim_json")} AS q FROM person_claims) c JOIN (SELECT p.*, {_QID.format("claim_json")} AS q, e.decision FROM person_claims p JOIN decisions_ e ON e.claim_id = p.id) x ON x.person_id = c.person_id AND x.q = c.q
  WHERE x.source_name = '{ENTITY}' AND c.source_name = '{ENTITY}' AND c.review_status IN ('pending', 'needs_more_evidence')
    AND (x.decision = 'reject' OR (x.claim_type = 'external_id' AND c.claim_type IN ('external_id', 'gender', 'birth_date', 'education', 'experience', 'position', 'office', 'district', 'party')))) u GROUP BY 1) v"""


def decisions(t):
    n = F.col("updated_at")
    rows = t["person_claims"].where((F.col("review_status") == "pending") & (n % 4 < 2) & F.col("claim_type").isin("external_id", "gender"))
    return rows.select(F.col("id").alias("claim_id"), F.when(n % 2 == 0, "approve").otherwise("reject").alias("decision"))


def _over(a: str, b: str) -> str:
    x, y = _IDENT.format(a), _IDENT.format(b)
    return f"({x} <> '' AND {y} <> '' AND (contains({x}, {y}) OR contains({y}, {x})))"


def _profiles(points: str, margin: int, same: int, different: int) -> str:
    told = "s.gender IS NOT NULL AND s.gender <> 'unknown'"
    return f"""
SELECT row_id, person_id, score FROM (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM (
  SELECT s.id AS row_id, p.person_id, CAST(50 + CASE WHEN {told} AND s.gender = p.gender THEN {same} WHEN {told} AND p.gender IS NOT NULL AND p.gender <> 'unknown' THEN {different} ELSE 0 END + {points} AS BIGINT) AS score
  FROM source_people s JOIN public_people_ p ON {_IDENT.format("s.raw_name")} = {_IDENT.format("p.name")}) x WINDOW w AS (PARTITION BY row_id ORDER BY score DESC, person_id)) y
WHERE rn = 1 AND score >= 75 AND (nxt IS NULL OR score - nxt >= {margin})"""


def _points(*pairs: tuple[str, int]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in pairs)


LEGISLATORS = _profiles(_points((_over("s.party", "p.party"), 15), (_over("s.district", "p.district"), 15), ("contains(coalesce(p.position, ''), '立法委員')", 10)), 15, 20, -30)
CITY = _profiles(
    _points(
        (_over("s.party", "p.party"), 10), (_over("s.position", "p.position"), 15), (_over("s.district", "p.district"), 15), ("s.source_type = 'other' AND contains(coalesce(p.position, ''), '議員')", 10),
        ("s.source_type <> 'other' AND contains(coalesce(s.position, ''), '市長') AND contains(coalesce(p.position, ''), '市長')", 10),
    ),
    10, 15, -50,
)


def sources(t):
    kind = F.when(F.col("source_type") == "other", "council").otherwise("government")
    return t["source_people"].select(F.col("id").alias("row_id"), F.col("raw_name").alias("name"), "gender", "party", "position", "district", F.col("district").alias("area"), kind.alias("kind"))


def add(register) -> None:
    register("r06_j12_enrichment_claims", lambda t: E.enrichment_claims(delivered(t), t["people"], rejected(t)), CLAIMS, delivered=DELIVERED, rejected=REJECTED)
    register("r09_reject_known_entities", lambda t: E.reject_known_entities(t["person_claims"], rejected(t)), f"""
        SELECT id AS claim_id, 'rejected' AS review_status, 'private' AS visibility, false AS is_public FROM person_claims c WHERE review_status IN ('pending', 'needs_more_evidence')
        AND EXISTS (SELECT 1 FROM rejected r WHERE r.person_id = c.person_id AND r.qid = {_QID.format("c.claim_json")})""", rejected=REJECTED)
    register("r23_decision_cascade", lambda t: E.decision_cascade(t["person_claims"], decisions(t)), CASCADE, decisions_=DECISIONS)
    register("r20_legislator_matches", lambda t: E.legislator_matches(sources(t), V.public_people(t)), LEGISLATORS, **ALL)
    register("r20_city_profile_matches", lambda t: E.city_profile_matches(sources(t), V.public_people(t)), CITY, **ALL)
