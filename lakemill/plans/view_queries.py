"""Queries of the publication views and queues.

The SQL is written from what the views mean, apart from the operators: gates are
tables of their own, the newest row comes from an aggregate over ordered
structs, counts from grouped tables.
"""

from __future__ import annotations

from lakemill.operators import views as V

OPEN = ", ".join(f"'{x}'" for x in V.OPEN_RACES)
REVIEWABLE, OPEN_MATCHES = (", ".join(f"'{x}'" for x in names) for names in (V.REVIEWABLE, V.OPEN_MATCHES))
TOLD_PHOTO = ", ".join(V.PHOTO_COLUMNS)

CANONICAL = """
SELECT id AS person_id, coalesce((SELECT max(canonical_person_id) FROM person_merge_decisions x WHERE x.duplicate_person_id = people.id AND x.status = 'verified'), id) AS canonical_person_id FROM people"""
SEEN = "SELECT * FROM people WHERE is_public"
PHOTOS = f"""
SELECT person_id, id AS media_id, url AS photo_url, {TOLD_PHOTO} FROM person_media
WHERE is_primary AND is_public AND verification_status = 'verified' AND license_type <> 'unknown' AND person_id IN (SELECT id FROM people WHERE is_public)"""

_FOLDED = ("alias", "party", "position", "election_year", "district", "education", "experience")
_NEWEST = ", ".join(f"arg_max({c}, (updated_at IS NULL, coalesce(updated_at, 0), id)) FILTER ({c} IS NOT NULL) AS n_{c}" for c in _FOLDED)
PEOPLE = f"""
SELECT id AS person_id, name, {", ".join(f"{'CAST(' if c == 'election_year' else ''}coalesce({c}, n_{c}){' AS BIGINT)' if c == 'election_year' else ''} AS {c}" for c in _FOLDED)},
       CASE WHEN gender IS NOT NULL AND gender <> 'unknown' THEN gender ELSE coalesce(n_gender, gender) END AS gender, newest AS updated_at,
       photos.photo_url AS primary_photo_url, photos.thumbnail_url AS primary_photo_thumbnail_url, {", ".join(f"photos.{c} AS photo_{c}" for c in V.PHOTO_COLUMNS[1:])}
FROM (SELECT * FROM seen JOIN (
        SELECT canonical_person_id, {_NEWEST}, arg_max(gender, (updated_at IS NULL, coalesce(updated_at, 0), id)) FILTER (gender <> 'unknown') AS n_gender, max(updated_at) AS newest
        FROM (SELECT canonical_person_id, seen.* FROM seen JOIN canonical ON person_id = id) rows_of GROUP BY 1) folds ON canonical_person_id = id) one
LEFT JOIN photos ON photos.person_id = one.id"""

CLAIMS = """
WITH shown AS (SELECT person_id AS own_id, canonical_person_id FROM canonical WHERE canonical_person_id IN (SELECT id FROM seen))
SELECT id AS claim_id, canonical_person_id AS person_id, claim_type, claim_value, claim_json, confidence_level, CAST(review_score AS BIGINT) AS review_score, source_name, source_url, updated_at
FROM person_claims, shown WHERE own_id = person_id AND is_public AND visibility = 'public' AND review_status = 'verified'"""

CANDIDATES = """
WITH numbered AS (SELECT candidates.*, canonical_person_id AS who, coalesce(candidate_no, '') AS ballot, (updated_at IS NULL, coalesce(updated_at, 0), candidates.id) AS age FROM candidates JOIN canonical USING (person_id)),
held AS (SELECT r.id, r.title, r.election_id, e.name AS election_name, r.region_id, (SELECT name FROM regions WHERE id = r.region_id) AS region_name
         FROM races r, elections e WHERE e.id = r.election_id AND r.is_public AND e.is_public AND coalesce((SELECT is_public FROM regions WHERE id = r.region_id), r.region_id IS NULL))
SELECT n.id AS candidate_id, who AS person_id, seen.name AS person_name, seen.party AS person_party, seen.position AS person_position, race_id, held.title AS race_title, held.election_id, held.election_name, held.region_id, held.region_name,
       n.party, candidate_no, registration_status, n.source_name, n.source_url, photos.photo_url AS primary_photo_url, photos.thumbnail_url AS primary_photo_thumbnail_url, photos.attribution AS photo_attribution,
       photos.license_type AS photo_license_type
FROM numbered n JOIN held ON held.id = race_id JOIN seen ON seen.id = who LEFT JOIN photos ON photos.person_id = who
WHERE n.is_public AND age = (SELECT max(age) FROM numbered m WHERE m.who = n.who AND m.race_id = n.race_id AND m.ballot = n.ballot)"""

RACES = """
SELECT races.id AS race_id, election_id, elections.name AS election_name, place.id AS region_id, place.name AS region_name, place.slug AS region_slug, race_type, title, races.voting_date, races.status, races.source_name, races.source_url
FROM (SELECT * FROM races WHERE is_public AND (region_id IS NULL OR region_id IN (SELECT id FROM regions WHERE is_public))) races
JOIN elections ON elections.id = election_id LEFT JOIN regions place ON place.id = region_id WHERE elections.is_public"""
REGIONS = "SELECT id AS region_id, name, slug, region_type, parent_region_id, official_code, map_code, CAST(display_order AS BIGINT) AS display_order FROM regions WHERE is_public"
ELECTIONS = "SELECT id AS election_id, name, CAST(year AS BIGINT) AS year, election_type, voting_date, status, source_name, source_url FROM elections WHERE is_public"
PARTIES = f"SELECT id AS party_id, {', '.join(V.PARTY_COLUMNS)} FROM parties WHERE is_public"
COMPANIES = "SELECT id AS company_id, unified_business_no, name, representative_name, status, capital, address_region, updated_at FROM companies WHERE is_public"
FINANCE = f"""
SELECT party_id, (SELECT name FROM parties WHERE id = party_id) AS party_name, CAST(report_year AS BIGINT) AS report_year, {", ".join(V.FINANCE_COLUMNS)}
FROM party_finance_summaries WHERE is_public AND party_id IN (SELECT id FROM parties WHERE is_public)"""
CONTRIBUTIONS = """
SELECT party_id, company_id, firms.name AS company_name, CAST(report_year AS BIGINT) AS report_year, amount_total, donation_count, confidence_level, source_name, source_url, reviewed_at
FROM party_company_contribution_summaries sums JOIN (SELECT id, name FROM companies WHERE is_public) firms ON firms.id = company_id WHERE sums.is_public AND party_id IN (SELECT id FROM parties WHERE is_public)"""

BASE = {"canonical": CANONICAL, "seen": SEEN, "photos": PHOTOS}
#: Named views for other queries' SQL.
ALL = BASE | {
    "public_people_": PEOPLE, "public_claims_": CLAIMS, "public_candidates_": CANDIDATES, "public_races_": RACES, "public_regions_": REGIONS, "public_elections_": ELECTIONS, "public_parties_": PARTIES,
    "public_companies_": COMPANIES, "public_finance_": FINANCE, "public_contributions_": CONTRIBUTIONS,
}

RELATIONS = """
WITH proof AS (SELECT id AS source_document_id, source_name, source_url FROM source_documents WHERE is_public),
firms AS (SELECT id AS company_id, name AS company_name, unified_business_no FROM companies WHERE is_public),
kept AS (SELECT * FROM person_company_relations WHERE is_public AND verification_status = 'verified')
SELECT kept.id AS relation_id, canonical_person_id AS person_id, seen.name AS person_name, seen.party AS person_party, seen.position AS person_position, seen.district AS person_district, company_id, company_name, unified_business_no,
       relation_type, confidence_level, evidence_text, source_document_id, source_name, source_url, verification_status, created_at AS relation_created_at, kept.updated_at AS relation_updated_at
FROM kept JOIN firms USING (company_id) JOIN canonical USING (person_id) JOIN seen ON seen.id = canonical_person_id LEFT JOIN proof ON source_document_id = evidence_source_id"""

SUMMARY = f"""
WITH going AS (SELECT region_id, id AS race, voting_date, title, election_id FROM races WHERE is_public AND status IN ({OPEN})),
named AS (SELECT going.*, (SELECT name FROM elections WHERE is_public AND id = election_id) AS called, (SELECT id FROM elections WHERE is_public AND id = election_id) AS known FROM going),
soonest AS (SELECT region_id, count(*) AS upcoming, min((voting_date IS NULL, coalesce(voting_date, ''), called IS NULL, coalesce(called, ''), title IS NULL, coalesce(title, ''), race)) AS first_of_all FROM named GROUP BY region_id)
SELECT regions.id AS region_id, regions.name AS region_name, slug AS region_slug, region_type, known AS next_election_id, called AS next_election_name, voting_date AS next_voting_date, coalesce(upcoming, 0) AS upcoming_race_count
FROM regions LEFT JOIN soonest ON soonest.region_id = regions.id
LEFT JOIN named ON named.region_id = regions.id AND (voting_date IS NULL, coalesce(voting_date, ''), called IS NULL, coalesce(called, ''), title IS NULL, coalesce(title, ''), race) = first_of_all
WHERE is_public"""

IDENTITY_SOURCES = """
SELECT shown.id AS identity_source_id, canonical_person_id AS person_id, seen.name AS person_name, source_type, source_name, source_url, raw_name, normalized_name, shown.party, shown.position, shown.district,
       CAST(shown.election_year AS BIGINT) AS election_year, confidence_suggestion, shown.updated_at, match_status, CAST(score AS BIGINT) AS match_score
FROM (SELECT * FROM source_people WHERE is_public) shown JOIN (SELECT source_person_id, person_id, match_status, score FROM person_identity_matches WHERE match_status = 'auto_matched') sure ON source_person_id = shown.id
JOIN canonical USING (person_id) JOIN seen ON seen.id = canonical_person_id"""

CLAIM_QUEUE = f"""
SELECT id AS claim_id, person_id, source_person_id, (SELECT raw_name FROM source_people s WHERE s.id = source_person_id) AS raw_name, (SELECT normalized_name FROM source_people s WHERE s.id = source_person_id) AS normalized_name, claim_type, claim_value,
       claim_json, confidence_level, CAST(review_score AS BIGINT) AS review_score, review_status, visibility, source_name, source_url, scoring_version, scoring_reasons, updated_at
FROM person_claims WHERE review_status IN ({REVIEWABLE})"""

PROBABLE = """
WITH theirs AS (SELECT id AS source_person_id, source_person_key, raw_name, party AS source_party, position AS source_position, district AS source_district, CAST(election_year AS BIGINT) AS election_year FROM source_people),
ours AS (SELECT id AS person_id, name AS person_name, party AS person_party, position AS person_position, district AS person_district FROM people)
SELECT id AS match_id, source_person_id, source_person_key, raw_name, source_party, source_position, source_district, election_year, person_id, person_name, person_party, person_position, person_district, CAST(score AS BIGINT) AS score,
       match_method, match_reason, evidence_json, updated_at
FROM person_identity_matches JOIN theirs USING (source_person_id) JOIN ours USING (person_id) WHERE match_status = 'probable_match'"""

UNMATCHED = f"""
WITH tried AS (SELECT source_person_id AS tried_id, bool_or(match_status = 'auto_matched') AS sure, max(score) AS best, min(CASE WHEN match_status IN ({OPEN_MATCHES}) THEN match_status END) AS open_status FROM person_identity_matches GROUP BY 1)
SELECT id AS source_person_id, source_person_key, source_type, source_name, source_url, raw_name, normalized_name, party, position, district, CAST(election_year AS BIGINT) AS election_year, confidence_suggestion, updated_at,
       CASE WHEN best IS NULL THEN 0 ELSE CAST(best AS BIGINT) END AS best_match_score, CASE WHEN open_status IS NULL THEN 'unmatched' ELSE open_status END AS review_status
FROM source_people LEFT JOIN tried ON tried_id = id WHERE sure IS NOT TRUE"""

LEGAL = f"""
WITH ours AS (SELECT id AS person_id, name AS person_name, party AS person_party, position AS person_position, district AS person_district FROM people)
SELECT id AS lead_id, {", ".join("CAST(match_score AS BIGINT) AS match_score" if c == "match_score" else c for c in V.LEAD_COLUMNS)}, matched_person_id AS person_id, person_name, person_party, person_position, person_district
FROM legal_record_leads LEFT JOIN ours ON ours.person_id = matched_person_id WHERE is_public IS FALSE AND review_status IN ({REVIEWABLE})"""


def add(register) -> None:
    register("v01_public_people", V.public_people, PEOPLE, **BASE)
    register("v02_public_companies", V.public_companies, COMPANIES)
    register("v03_public_relation_details", V.public_relation_details, RELATIONS, **BASE)
    register("v04_public_regions", V.public_regions, REGIONS)
    register("v05_public_elections", V.public_elections, ELECTIONS)
    register("v06_public_races", V.public_races, RACES)
    register("v07_public_candidates", V.public_candidates, CANDIDATES, **BASE)
    register("v08_public_region_election_summary", V.public_region_election_summary, SUMMARY)
    register("v09_public_home_election_ticker", V.public_home_election_ticker, """
        SELECT election_id, name AS election_name, voting_date, election_type, status, source_name, source_url FROM public_elections_ WHERE voting_date <> '' AND status IN ('active', 'announced', 'upcoming')""", public_elections_=ELECTIONS)
    register("v10_public_person_primary_photos", V.public_person_primary_photos, PHOTOS)
    register("v11_public_parties", V.public_parties, PARTIES)
    register("v12_public_party_finance_summaries", V.public_party_finance_summaries, FINANCE)
    register("v13_public_party_company_contributions", V.public_party_company_contribution_summaries, CONTRIBUTIONS)
    register("v14_public_person_claims", V.public_person_claims, CLAIMS, **BASE)
    register("v15_public_person_identity_sources", V.public_person_identity_sources, IDENTITY_SOURCES, **BASE)
    register("v16_person_canonical_map", V.person_canonical_map, CANONICAL)
    register("v18_person_claim_review_queue", V.person_claim_review_queue, CLAIM_QUEUE)
    register("v19_identity_probable_match_queue", V.identity_probable_match_queue, PROBABLE)
    register("v20_identity_unmatched_source_people", V.identity_unmatched_source_people, UNMATCHED)
    register("v21_legal_record_review_queue", V.legal_record_review_queue, LEGAL)
