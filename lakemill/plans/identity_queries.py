"""Queries of entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemill.operators import identity as I
from lakemill.operators import people as P
from lakemill.operators import reports as R
from lakemill.operators import views as V
from lakemill.plans.view_queries import ALL
from lakemill.session import checkpoint

_NORM = r"lower(regexp_replace(replace({0}, '臺', '台'), '\s+', '', 'g'))"

BASE = rf"""
SELECT p.id, p.name, p.party, p.position, p.district, p.gender, b.birth_date, {_NORM.format("p.name")} AS nn, {_NORM.format("coalesce(nullif(p.party, ''), '未知政黨')")} AS np,
       {_NORM.format("coalesce(nullif(p.district, ''), '未知選區')")} AS nd,
       CASE WHEN p.position IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN p.district IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN p.gender IS NOT NULL AND p.gender <> 'unknown' THEN 1 ELSE 0 END
       + CASE WHEN p.education IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN p.experience IS NOT NULL THEN 1 ELSE 0 END AS profile_score
FROM people p LEFT JOIN (
  SELECT person_id, min(nullif(trim(coalesce(claim_value, json_extract_string(claim_json, '$.value'))), '')) AS birth_date FROM person_claims
  WHERE claim_type = 'birth_date' AND review_status = 'verified' AND visibility = 'public' AND is_public GROUP BY person_id) b ON b.person_id = p.id
WHERE p.is_public"""

#: A pair in either order.
_PAIR = "least({0}, {1}) || '|' || greatest({0}, {1})"
QUEUE = f"""
WITH named AS (
  SELECT a.id AS one, b.id AS two, a.nn, a.np, a.nd, a.gender, a.birth_date, coalesce(a.np = b.np, false) AS party_too, coalesce(a.nd = b.nd, false) AS place_too,
         coalesce(a.birth_date = b.birth_date AND nullif(a.gender, 'unknown') = b.gender, false) AS born, coalesce(nullif(a.gender, 'unknown') <> nullif(b.gender, 'unknown'), false) AS clash
  FROM base a, base b WHERE a.nn = b.nn AND a.id < b.id),
linked AS (SELECT a.person_id AS one, b.person_id AS two, min(CAST(json_object('externalId', x) AS VARCHAR)) AS proof FROM ids a JOIN ids b USING (x) WHERE a.person_id < b.person_id GROUP BY ALL),
found AS (
  SELECT one, two, CASE WHEN proof IS NOT NULL THEN ('A', 100, '{I.SHARED_ID}', proof)
                        WHEN born THEN ('B', 85, '{I.SAME_BIRTH}', CAST(json_object('normalizedName', nn, 'gender', gender, 'birthDate', birth_date, 'note', '{I.BIRTH_NOTE}') AS VARCHAR))
                        ELSE ('D', 55, '{I.CONTEXT}', CAST(json_object('normalizedName', nn, 'normalizedParty', CASE WHEN party_too THEN np END, 'normalizedDistrict', CASE WHEN place_too THEN nd END, 'note', '{I.CONTEXT_NOTE}') AS VARCHAR)) END AS why
  FROM linked FULL JOIN named USING (one, two) WHERE proof IS NOT NULL OR born OR ((party_too OR place_too) AND NOT clash)),
sided AS (SELECT why, CASE WHEN b.profile_score > a.profile_score THEN a ELSE b END AS dup, CASE WHEN b.profile_score > a.profile_score THEN b ELSE a END AS can FROM found JOIN base a ON a.id = one JOIN base b ON b.id = two)
SELECT {", ".join(f"{side}.{c} AS {name}_person_{c}" for side, name in (("dup", "duplicate"), ("can", "canonical")) for c in ("id", "name", "party", "position", "district"))},
       why[3] AS reason, why[1] AS confidence_level, CAST(why[2] AS BIGINT) AS score, why[4] AS evidence_json
FROM sided
WHERE dup.id NOT IN (SELECT duplicate_person_id FROM person_merge_decisions WHERE status = 'verified')
  AND {_PAIR.format("dup.id", "can.id")} NOT IN (SELECT {_PAIR.format("duplicate_person_id", "canonical_person_id")} FROM person_merge_decisions WHERE status IN ({", ".join(f"'{x}'" for x in I.TERMINAL)}))"""

IDS = """SELECT DISTINCT person_id, lower(claim_value) AS x FROM person_claims
WHERE claim_type = 'external_id' AND review_status = 'verified' AND visibility = 'public' AND is_public AND claim_value IS NOT NULL AND person_id IS NOT NULL"""

QUEUE_VIEWS = {"ids": IDS, "base": BASE, "dup_queue": QUEUE}

_IDENT = r"lower(regexp_replace(replace(coalesce({0}, ''), '臺', '台'), '[‧·．・･•\s\x{{00A0}}\x{{3000}}]+', '', 'g'))"
_ROLE = """CASE WHEN coalesce({0}, '') LIKE '%副總統%' THEN 'vice_president' WHEN coalesce({0}, '') LIKE '%總統%' THEN 'president' WHEN {0} LIKE '%立法委員%' OR {0} LIKE '%立委%' THEN 'legislator' WHEN {0} LIKE '%議員%' THEN 'councilor'
 WHEN {0} LIKE '%副市長%' OR {0} LIKE '%副縣長%' OR {0} LIKE '%副縣市長%' THEN 'local_deputy' WHEN {0} LIKE '%市長%' OR {0} LIKE '%縣長%' THEN 'local_chief'
 WHEN {0} LIKE '%主席%' OR {0} LIKE '%秘書長%' THEN 'party_officer' WHEN {0} LIKE '%候選人%' THEN 'candidate' ELSE 'other' END"""

MATCHES = f"""
SELECT source_person_id, person_id, match_status, score FROM (
  SELECT *, row_number() OVER (PARTITION BY source_person_id ORDER BY score DESC, person_id) AS rn FROM (
    SELECT s.id AS source_person_id, p.id AS person_id, 'probable_match' AS match_status,
           CAST(70 + CASE WHEN pm THEN 10 ELSE 0 END + CASE WHEN rm THEN 10 ELSE 0 END + CASE WHEN dm THEN 5 ELSE 0 END AS BIGINT) AS score, pm OR rm OR dm AS ok
    FROM (SELECT s.id, p.id AS pid, {_IDENT.format("s.party")} <> '' AND {_IDENT.format("s.party")} = {_IDENT.format("p.party")} AS pm,
                 ({_ROLE.format("s.position")}) <> 'other' AND ({_ROLE.format("s.position")}) = ({_ROLE.format("p.position")}) AS rm,
                 {_IDENT.format("s.district")} <> '' AND contains({_IDENT.format("p.district")}, left({_IDENT.format("s.district")}, 3)) AS dm
          FROM source_people s JOIN people p ON {_IDENT.format("s.raw_name")} = {_IDENT.format("p.name")} AND p.gender = coalesce(s.gender, 'unknown') AND coalesce(s.gender, 'unknown') <> 'unknown') x
    JOIN source_people s ON s.id = x.id JOIN people p ON p.id = x.pid) scored
  WHERE ok AND score >= 75) best WHERE rn = 1"""

FEATURES = r"""
SELECT p.person_id, p.name, p.gender, p.party, p.position, p.district,
       regexp_replace(CASE WHEN regexp_extract(p.name, '^[\x{3400}-\x{9fff}]+') <> '' THEN regexp_extract(p.name, '^[\x{3400}-\x{9fff}]+') ELSE coalesce(p.name, '') END, '\s+', '', 'g') AS nn,
       coalesce(i.a, []) AS ids, coalesce(b.a, []) AS births, coalesce(c.a, []) AS regions
FROM public_people_ p
LEFT JOIN (SELECT person_id, list_sort(list(DISTINCT x)) AS a FROM (
    SELECT person_id, CASE WHEN regexp_matches(trim(claim_value), '(?i)^wikidata:Q\d+$') THEN 'wikidata:' || upper(substr(trim(claim_value), 10)) ELSE lower(trim(claim_value)) END AS x FROM public_claims_ WHERE claim_type = 'external_id' AND claim_value IS NOT NULL
    UNION SELECT person_id, 'wikidata:' || upper(json_extract_string(claim_json, '$.wikidataQid')) FROM public_claims_ WHERE claim_type = 'external_id' AND json_extract_string(claim_json, '$.wikidataQid') IS NOT NULL) WHERE x <> '' GROUP BY 1) i ON i.person_id = p.person_id
LEFT JOIN (SELECT person_id, list_sort(list(DISTINCT trim(claim_value))) AS a FROM public_claims_ WHERE claim_type = 'birth_date' AND trim(coalesce(claim_value, '')) <> '' GROUP BY 1) b ON b.person_id = p.person_id
LEFT JOIN (SELECT person_id, list_sort(list(DISTINCT region_name)) AS a FROM public_candidates_ WHERE region_name IS NOT NULL GROUP BY 1) c ON c.person_id = p.person_id"""

PAIRS = """
SELECT l_person_id, r_person_id, normalized_name, CAST(least(100, greatest(0, s)) AS BIGINT) AS score,
       CASE WHEN gc OR bc THEN 'do_not_merge_likely' WHEN si THEN 'merge_candidate' WHEN sb AND sg THEN 'manual_review_birthdate_match' WHEN least(100, greatest(0, s)) >= 50 THEN 'manual_review' ELSE 'same_name_only' END AS recommendation
FROM (SELECT *, 10 + CASE WHEN si THEN 90 ELSE 0 END - CASE WHEN gc THEN 40 ELSE 0 END + CASE WHEN sg THEN 25 ELSE 0 END - CASE WHEN bc THEN 50 ELSE 0 END + CASE WHEN sb THEN 45 ELSE 0 END
             + CASE WHEN sr THEN 5 ELSE 0 END + CASE WHEN sd THEN 5 ELSE 0 END + CASE WHEN sp THEN 5 ELSE 0 END + CASE WHEN sy THEN 5 ELSE 0 END AS s
      FROM (SELECT l.person_id AS l_person_id, r.person_id AS r_person_id, l.nn AS normalized_name, list_has_any(l.ids, r.ids) AS si, list_has_any(l.births, r.births) AS sb, list_has_any(l.regions, r.regions) AS sr,
                   len(l.births) > 0 AND len(r.births) > 0 AND NOT list_has_any(l.births, r.births) AS bc,
                   coalesce(l.gender <> '' AND r.gender <> '' AND l.gender <> 'unknown' AND r.gender <> 'unknown' AND l.gender <> r.gender, false) AS gc,
                   coalesce(l.gender <> '' AND l.gender <> 'unknown' AND l.gender = r.gender, false) AS sg,
                   coalesce(l.district <> '' AND l.district = r.district, false) AS sd, coalesce(l.position <> '' AND l.position = r.position, false) AS sp, coalesce(l.party <> '' AND l.party = r.party, false) AS sy
            FROM features l JOIN features r ON l.nn = r.nn AND l.person_id < r.person_id) x) y"""

_RANK = "CASE recommendation WHEN 'merge_candidate' THEN 0 WHEN 'manual_review_birthdate_match' THEN 1 WHEN 'manual_review' THEN 2 WHEN 'same_name_only' THEN 3 ELSE 4 END"
GROUPS = f"""
SELECT f.nn AS normalized_name, count(*) AS record_count, coalesce(array_to_string(list_sort(list(DISTINCT nullif(trim(f.party), ''))), '|'), '') AS parties, coalesce(array_to_string(list_sort(list(DISTINCT nullif(trim(f.gender), ''))), '|'), '') AS genders,
       coalesce(array_to_string(list_sort(list(DISTINCT nullif(trim(f.district), ''))), '|'), '') AS districts, any_value(t.top_score) AS top_score, any_value(t.top_recommendation) AS top_recommendation
FROM features f JOIN (SELECT normalized_name, max(score) AS top_score, arg_min(recommendation, {_RANK}) AS top_recommendation FROM pairs GROUP BY 1) t ON t.normalized_name = f.nn
WHERE f.nn <> '' GROUP BY f.nn HAVING count(*) > 1"""

GAPS = """
SELECT g.normalized_name, g.record_count, g.top_recommendation, m.sig AS missing_signals, CASE WHEN g.top_recommendation = 'manual_review' THEN 'high' WHEN m.sig LIKE '%birth_date%' THEN 'medium' ELSE 'low' END AS priority
FROM groups_ g JOIN (SELECT nn, CASE WHEN bool_or(len(births) = 0) AND bool_or(len(ids) = 0) THEN 'birth_date,external_id' WHEN bool_or(len(births) = 0) THEN 'birth_date' WHEN bool_or(len(ids) = 0) THEN 'external_id' END AS sig FROM features GROUP BY nn) m ON m.nn = g.normalized_name
WHERE g.top_recommendation IN ('same_name_only', 'manual_review') AND m.sig IS NOT NULL"""

#: How many pairs of each name have which score and advice: links and pairs must agree in this.
CLASS_ROWS = "SELECT normalized_name, score, recommendation, count(*) AS pairs FROM pairs GROUP BY ALL"

FEATURE_VIEWS = ALL | {"features": FEATURES, "pairs": PAIRS, "groups_": GROUPS, "gaps": GAPS}

LEADS = f"""
SELECT l.id AS lead_id, CASE WHEN b.s > 0 THEN b.pid END AS person_id, CAST(coalesce(b.s, 0) AS BIGINT) AS match_score, CASE WHEN b.s >= 75 THEN 'probable_match' WHEN b.s >= 50 THEN 'possible_match' ELSE 'unmatched' END AS match_status,
       'pending' AS review_status, false AS is_public
FROM legal_record_leads l LEFT JOIN (
  SELECT lid, pid, s FROM (SELECT lid, pid, s, row_number() OVER (PARTITION BY lid ORDER BY s DESC, pid) AS rn FROM (
    SELECT l.id AS lid, p.id AS pid, least(89, greatest(0, 25 + CASE WHEN l.source_type IN ('court_document', 'judicial_api', 'government_open_data') THEN 15 ELSE 0 END + CASE WHEN l.target_person_id = p.id THEN 5 ELSE 0 END
      + CASE WHEN {_IDENT.format("p.district")} <> '' AND contains({_IDENT.format("l.title || ' ' || l.summary")}, left({_IDENT.format("p.district")}, 3)) THEN 10 ELSE 0 END
      + CASE WHEN {_IDENT.format("p.party")} <> '' AND contains({_IDENT.format("l.title || ' ' || l.summary")}, {_IDENT.format("p.party")}) THEN 5 ELSE 0 END
      + CASE WHEN {_IDENT.format("p.position")} <> '' AND contains({_IDENT.format("l.title || ' ' || l.summary")}, left({_IDENT.format("p.position")}, 4)) THEN 5 ELSE 0 END)) AS s
    FROM legal_record_leads l JOIN people p ON l.normalized_name <> '' AND l.normalized_name = {_IDENT.format("p.name")}) a) b0 WHERE rn = 1) b ON b.lid = l.id"""

OFFICIAL = f"""
SELECT row_id, candidate_id, score FROM (
  SELECT row_id, candidate_id, score, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM (
    SELECT l.row_id, c.candidate_id, CAST(50 + CASE WHEN l.cand_no <> '' AND l.cand_no = c.candidate_no THEN 20 ELSE 0 END + CASE WHEN ov(l.party, coalesce(c.party, c.person_party)) THEN 15 ELSE 0 END
           + CASE WHEN ov(l.race_title, c.race_title) THEN 20 ELSE 0 END + CASE WHEN ov(l.election_name, c.election_name) THEN 10 WHEN c.election_name <> '' THEN -40 ELSE 0 END AS BIGINT) AS score
    FROM official l JOIN public_candidates_ c ON {_IDENT.format("l.name")} = {_IDENT.format("c.person_name")}) x
  WINDOW w AS (PARTITION BY row_id ORDER BY score DESC, candidate_id)) y
WHERE rn = 1 AND score >= 75 AND (nxt IS NULL OR score - nxt >= 15)"""


def _overlap(sql: str) -> str:
    import re

    def both(m: re.Match) -> str:
        a, b = _IDENT.format(m[1]), _IDENT.format(m[2])
        return f"({a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a})))"

    return re.sub(r"ov\(([\w.]+), (coalesce\([\w., ]+\)|[\w.]+)\)", both, sql)


OFFICIAL_ROWS = """SELECT id AS row_id, raw_name AS name, CAST(election_year % 3 AS VARCHAR) AS cand_no, party, 'NATION_' || CAST(election_year % 25 AS VARCHAR) AS race_title, 'Election ' || CAST(1995 + election_year % 7 AS VARCHAR) AS election_name FROM source_people"""


def features(t):
    return I.identity_features(V.public_people(t), V.public_person_claims(t), V.public_candidates(t))


def class_rows(t):
    return I.class_links(I.identity_classes(features(t))[0]).groupBy("normalized_name", "score", "recommendation").agg(F.sum("pairs").alias("pairs"))


def groups(t):
    return I.duplicate_groups(checkpoint(features(t)))


def official_rows(t):
    return t["source_people"].select(
        F.col("id").alias("row_id"), F.col("raw_name").alias("name"), (F.col("election_year") % 3).cast("string").alias("cand_no"), "party", F.concat(F.lit("NATION_"), (F.col("election_year") % 25).cast("string")).alias("race_title"),
        F.concat(F.lit("Election "), (1995 + F.col("election_year") % 7).cast("string")).alias("election_name"),
    )


def gaps(t):
    f = checkpoint(features(t))
    return R.identity_gaps(f, I.duplicate_groups(f))


def person_items(t):
    regions = P.stage_regions(V.public_regions(t))
    return P.person_list(V.public_people(t), V.public_candidates(t), regions, V.public_person_claims(t))


def add(register) -> None:
    register("v17_person_duplicate_review_queue", I.person_duplicate_review_queue, QUEUE, ids=IDS, base=BASE)
    register("k13_auto_merges", lambda t: I.auto_merges(I.person_duplicate_review_queue(t), t["person_merge_decisions"]), """
        SELECT duplicate_person_id, best.c AS canonical_person_id, 'A' AS confidence_level, best.r AS reason, best.e AS evidence_json, 'verified' AS status
        FROM (SELECT duplicate_person_id, min(struct_pack(s := -score, c := canonical_person_id, r := reason, e := evidence_json)) AS best FROM dup_queue WHERE confidence_level = 'A' GROUP BY 1) tops
        WHERE """ + f"{_PAIR.format('duplicate_person_id', 'best.c')} NOT IN (SELECT {_PAIR.format('duplicate_person_id', 'canonical_person_id')} FROM person_merge_decisions)", **QUEUE_VIEWS)
    register("r15_merge_decisions_to_apply", lambda t: I.merge_decisions_to_apply(I.person_duplicate_review_queue(t), t["person_merge_decisions"]), """
        SELECT duplicate_person_id, canonical_person_id, confidence_level, reason, 'verified' AS status FROM dup_queue
        WHERE confidence_level = 'A' AND duplicate_person_id NOT IN (SELECT duplicate_person_id FROM person_merge_decisions WHERE status IN ('suggested', 'verified'))""", **QUEUE_VIEWS)
    register("r03_probable_identity_matches", lambda t: I.probable_identity_matches(t["source_people"], t["people"]), MATCHES)
    register("r04_exact_identity_matches", lambda t: I.exact_identity_matches(t["source_people"], t["people"]), """
        SELECT s.id AS source_person_id, p.id AS person_id, 'auto_matched' AS match_status, CAST(100 AS BIGINT) AS score FROM source_people s JOIN people p ON p.external_id = s.external_record_id""")
    register("r05_legal_lead_matches", lambda t: I.legal_lead_matches(t["legal_record_leads"], t["people"]), LEADS)
    register("r16_same_name_pairs", lambda t: I.same_name_pairs(features(t)), PAIRS, **FEATURE_VIEWS)
    register("r16_class_links", class_rows, CLASS_ROWS, **FEATURE_VIEWS)
    register("a08_duplicate_groups", groups, GROUPS, **FEATURE_VIEWS)
    register("r17_identity_gaps", gaps, GAPS, **FEATURE_VIEWS)
    register("a15_gap_histogram", lambda t: R.gap_histogram(gaps(t)), """
        SELECT key, count(*) AS n FROM (SELECT 'priority:' || priority AS key FROM gaps UNION ALL SELECT 'signal:' || unnest(string_split(missing_signals, ',')) FROM gaps) x GROUP BY key""", **FEATURE_VIEWS)
    register("r20_official_candidate_matches", lambda t: I.official_candidate_matches(official_rows(t), V.public_candidates(t)), _overlap(OFFICIAL), **(ALL | {"official": OFFICIAL_ROWS}))
