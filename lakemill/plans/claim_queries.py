"""Queries of claims and their review, of upserts and of the importer."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemill.functions import text as T
from lakemill.operators import claims as C
from lakemill.operators import contracts, privacy, store
from lakemill.operators import views as V
from lakemill.plans.view_queries import ALL
from lakemill.session import scratch
from lakemill.sources.snapshots import Store

ENTITY = C.ENTITY_SOURCE
_QID = r"CASE WHEN regexp_matches(json_extract_string({0}, '$.wikidataQid'), '(?i)^Q\d+$') THEN upper(json_extract_string({0}, '$.wikidataQid')) END"

FIELDS = {"name": "name", "alias": "alias", "gender": "gender", "party": "party", "position": "position", "district": "district", "education": "education", "experience": "experience", "external_id": "external_id"}
RECORDS = """SELECT *, CASE WHEN updated_at % 4 = 0 THEN 'official_election' WHEN updated_at % 4 = 1 THEN 'wikidata' WHEN updated_at % 4 = 2 THEN 'government_open_data' ELSE 'other' END AS source_type,
 CASE WHEN updated_at % 4 IN (0, 2) THEN 'A' WHEN updated_at % 4 = 1 THEN 'C' ELSE 'D' END AS confidence_level, external_id IS NOT NULL AS matched FROM people"""


def records(t):
    n = F.col("updated_at") % 4
    kind = T.first_of([(n == 0, "official_election"), (n == 1, "wikidata"), (n == 2, "government_open_data")], "other")
    return t["people"].withColumns({"source_type": kind, "confidence_level": T.first_of([(n.isin(0, 2), "A"), (n == 1, "C")], "D"), "matched": F.col("external_id").isNotNull()})


_SCORE = """least(100, greatest(0, CASE confidence_level WHEN 'A' THEN 45 WHEN 'B' THEN 35 WHEN 'C' THEN 20 ELSE 10 END + CASE WHEN off THEN 25 ELSE 0 END + CASE WHEN matched THEN 15 ELSE 0 END
 + CASE WHEN claim_type IN ('name', 'gender', 'party', 'position', 'district', 'external_id') THEN 10 ELSE 0 END + CASE WHEN claim_type IN ('education', 'experience') AND off THEN 10 ELSE 0 END
 - CASE WHEN claim_type IN ('legal_case', 'family_relation') THEN 25 ELSE 0 END))"""
_REASONS = """array_to_string(list_filter([CASE WHEN confidence_level IN ('A', 'B', 'C') THEN confidence_level || '-level source' ELSE 'D-level source' END, CASE WHEN off THEN 'official structured source' END, CASE WHEN matched THEN 'linked to canonical person' END,
 CASE WHEN claim_type IN ('name', 'gender', 'party', 'position', 'district', 'external_id') THEN 'low-ambiguity identity field' END, CASE WHEN claim_type IN ('education', 'experience') AND off THEN 'official public profile field' END,
 CASE WHEN claim_type IN ('legal_case', 'family_relation') THEN 'sensitive claim requires stronger evidence' END], lambda x: x IS NOT NULL), '|')"""
_OFFICIAL = "(source_type LIKE 'official%' OR source_type = 'government_open_data')"

EXPLODED = f"""
SELECT claim_key, claim_type, claim_value, CAST(review_score AS BIGINT) AS review_score, scoring_reasons, CASE WHEN ok THEN 'verified' ELSE 'pending' END AS review_status, CASE WHEN ok THEN 'public' ELSE 'review_only' END AS visibility, ok AS is_public
FROM (SELECT *, matched AND review_score >= 90 AS ok FROM (SELECT id || ':' || claim_type AS claim_key, claim_type, claim_value, {_SCORE} AS review_score, {_REASONS} AS scoring_reasons, matched
  FROM (SELECT r.*, u.claim_type, trim(u.v) AS claim_value, {_OFFICIAL} AS off FROM records r, LATERAL (VALUES {", ".join(f"('{k}', r.{v})" for k, v in FIELDS.items())}) u(claim_type, v)) a
  WHERE claim_value IS NOT NULL AND claim_value NOT IN ('', 'unknown')) b) c"""

ELIGIBLE = f"""
WITH vk AS (SELECT DISTINCT person_id || ':' || q AS k FROM (
    SELECT person_id, upper(nullif(regexp_extract(coalesce(claim_value, ''), '(?i)^wikidata:(Q\\d+)$', 1), '')) AS q FROM person_claims WHERE claim_type = 'external_id' AND source_name = '{ENTITY}' AND review_status = 'verified' AND visibility = 'public' AND is_public
    UNION SELECT person_id, {_QID.format("claim_json")} FROM person_claims WHERE claim_type = 'external_id' AND source_name = '{ENTITY}' AND review_status = 'verified' AND visibility = 'public' AND is_public) WHERE q IS NOT NULL AND person_id IS NOT NULL),
fk AS (SELECT person_id || ':education' AS k FROM public_people_ WHERE trim(coalesce(education, '')) <> '' UNION SELECT person_id || ':experience' FROM public_people_ WHERE trim(coalesce(experience, '')) <> ''),
ok AS (SELECT DISTINCT person_id || ':' || claim_type AS k FROM person_claims WHERE review_status = 'verified' AND visibility = 'public' AND is_public AND source_name <> '{ENTITY}' AND claim_type IN ('education', 'experience'))
SELECT claim_id, claim_type, reason IN ('non-wikidata-non-sensitive', 'wikidata-verified-external-id-unlocked', 'wikidata-identity-match-auto-unlocked') AS eligible, reason FROM (
SELECT id AS claim_id, claim_type, CASE
  WHEN claim_type IN ('legal_case', 'family_relation') THEN 'blocked-sensitive-claim-type'
  WHEN coalesce(review_score, 0) < 20 THEN 'below-min-score'
  WHEN source_name <> '{ENTITY}' THEN 'non-wikidata-non-sensitive'
  WHEN claim_type NOT IN ('external_id', 'gender', 'birth_date', 'education', 'experience', 'position', 'office', 'district', 'party') THEN 'wikidata-claim-type-not-auto-unlocked'
  WHEN claim_type IN ('education', 'experience') AND EXISTS (SELECT 1 FROM fk WHERE k = person_id || ':' || claim_type) THEN 'wikidata-fallback-skipped-public-field-exists'
  WHEN claim_type IN ('education', 'experience') AND EXISTS (SELECT 1 FROM ok WHERE k = person_id || ':' || claim_type) THEN 'wikidata-fallback-skipped-primary-claim-exists'
  WHEN person_id IS NULL OR {_QID.format("claim_json")} IS NULL THEN 'wikidata-missing-person-or-qid'
  WHEN EXISTS (SELECT 1 FROM vk WHERE k = person_id || ':' || {_QID.format("claim_json")}) THEN 'wikidata-verified-external-id-unlocked'
  WHEN json_extract_string(claim_json, '$.identityMatch.status') = 'matched' THEN 'wikidata-identity-match-auto-unlocked'
  ELSE 'wikidata-external-id-not-verified' END AS reason
FROM person_claims WHERE review_status IN ('pending', 'needs_more_evidence')) v"""


def eligible(t):
    return C.eligibility(t["person_claims"], V.public_people(t), 20)


#: Reasons that earlier runs left.
_TOLD_REASONS = """CASE CAST(review_score AS INT) % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[{"version":"v2"}]' WHEN 2 THEN 'none' END"""


def scored(t):
    return t["person_claims"].withColumn("scoring_reasons", F.expr(_TOLD_REASONS))


def fresh_claims(t):
    """Claims as a second ingest brings them: all pending, ids of external kind verified A."""
    rows = t["person_claims"]
    again = (F.col("claim_type") == "external_id") & (F.col("confidence_level") == "A")
    return rows.withColumns({"review_status": F.when(again, "verified").otherwise("pending"), "visibility": F.when(again, "public").otherwise("review_only"), "is_public": again})


_ENT = f"CASE WHEN person_id IS NOT NULL AND ({_QID.format('claim_json')}) IS NOT NULL THEN person_id || ':' || ({_QID.format('claim_json')}) END"
_STM = f"CASE WHEN person_id IS NOT NULL AND ({_QID.format('claim_json')}) IS NOT NULL THEN person_id || ':' || ({_QID.format('claim_json')}) || ':' || claim_type || ':' || coalesce(claim_value, '') END"
STICKY = f"""
WITH term AS (SELECT *, {_ENT} AS ent, {_STM} AS stm FROM person_claims WHERE review_status IN ('verified', 'rejected', 'archived')),
s1 AS (SELECT DISTINCT ON (claim_key) claim_key, review_status, visibility, is_public FROM term ORDER BY claim_key, updated_at DESC, id DESC),
s2 AS (SELECT DISTINCT ON (ent) ent, review_status, visibility, is_public FROM term WHERE ent IS NOT NULL AND review_status = 'rejected' ORDER BY ent, updated_at DESC, id DESC),
s3 AS (SELECT DISTINCT ON (stm) stm, review_status, visibility, is_public FROM term WHERE stm IS NOT NULL ORDER BY stm, updated_at DESC, id DESC),
f AS (SELECT *, claim_type = 'external_id' AND confidence_level = 'A' AS again, {_ENT} AS ent, {_STM} AS stm FROM person_claims),
j AS (SELECT f.id, f.again, coalesce(s1.review_status, s2.review_status, s3.review_status) AS rs, CASE WHEN s1.review_status IS NOT NULL THEN s1.visibility WHEN s2.review_status IS NOT NULL THEN s2.visibility ELSE s3.visibility END AS vi,
             CASE WHEN s1.review_status IS NOT NULL THEN s1.is_public WHEN s2.review_status IS NOT NULL THEN s2.is_public ELSE s3.is_public END AS ip
      FROM f LEFT JOIN s1 ON s1.claim_key = f.claim_key LEFT JOIN s2 ON s2.ent = f.ent LEFT JOIN s3 ON s3.stm = f.stm)
SELECT id, CASE WHEN keep THEN rs WHEN again THEN 'verified' ELSE 'pending' END AS review_status, CASE WHEN keep THEN vi WHEN again THEN 'public' ELSE 'review_only' END AS visibility, CASE WHEN keep THEN ip ELSE again END AS is_public
FROM (SELECT *, rs IS NOT NULL AND NOT (again AND rs = 'archived') AS keep FROM j) k"""

_RISK = """list_filter([CASE WHEN regexp_matches(c, '\\b[A-Z][12]\\d{8}\\b') THEN 'national_id' END, CASE WHEN regexp_matches(c, '\\b09\\d{8}\\b') THEN 'mobile_phone' END, CASE WHEN regexp_matches(c, '\\b0\\d{1,2}-?\\d{6,8}\\b') THEN 'landline_phone' END,
 CASE WHEN regexp_matches(c, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b') THEN 'email' END, CASE WHEN regexp_matches(c, '\\b(19|20)\\d{2}[-/]\\d{1,2}[-/]\\d{1,2}\\b') THEN 'birthday' END,
 CASE WHEN regexp_matches(c, '\\b.+(?:縣|市).+(?:區|鄉|鎮|市).+(?:路|街|大道).+(?:號)\\b') THEN 'full_address' END, CASE WHEN contains(c, '未成年子女') THEN 'minor_child_reference' END], lambda x: x IS NOT NULL)"""
_COMBINED = "coalesce(person_name, '') || ' ' || coalesce(company_name, '') || ' ' || coalesce(evidence_text, '') || ' ' || coalesce(source_name, '') || ' ' || coalesce(source_url, '')"
SCANNED = f"SELECT *, {_RISK} AS risk FROM (SELECT *, {_COMBINED} AS c FROM changes) z"
RELATION_TYPES = ", ".join(f"'{r}'" for r in contracts.ENUMS["relation_type"])


def _blank(c: str) -> str:
    return f"trim(coalesce({c}, '')) = ''"


ITEM_ERRORS = f"""
SELECT position, array_to_string(list_transform(list_filter([
  CASE WHEN action NOT IN ('create_raw_source_record', 'create_relation_candidate', 'create_company_candidate', 'create_person_candidate') THEN 'action not allowed: ' || action END,
  CASE WHEN action = 'create_relation_candidate' AND {_blank("person_name")} THEN 'personName is required for create_relation_candidate.' END, CASE WHEN action = 'create_person_candidate' AND {_blank("person_name")} THEN 'personName is required for create_person_candidate.' END,
  CASE WHEN action IN ('create_relation_candidate', 'create_company_candidate') AND {_blank("company_name")} THEN 'companyName is required.' END, CASE WHEN {_blank("evidence_text")} THEN 'evidenceText is required.' END,
  CASE WHEN {_blank("source_name")} AND {_blank("source_url")} THEN 'sourceName or sourceUrl is required.' END, CASE WHEN {_blank("source_type")} THEN 'sourceType is required.' END,
  CASE WHEN confidence_suggestion NOT IN ('A', 'B', 'C', 'D') THEN 'confidenceSuggestion must be A/B/C/D: ' || confidence_suggestion END, CASE WHEN review_status <> 'pending' THEN 'reviewStatus must be pending.' END,
  CASE WHEN is_public THEN 'isPublic must be false.' END, CASE WHEN guessed_relation_type <> '' AND guessed_relation_type NOT IN ({RELATION_TYPES}) THEN 'guessedRelationType is not in whitelist: ' || guessed_relation_type END,
  CASE WHEN NOT regexp_matches(unified_business_no, '^\\d{{8}}$') THEN 'unifiedBusinessNo must be 8 digits.' END, CASE WHEN len(risk) > 0 THEN 'sensitive data detected (' || array_to_string(risk, ', ') || ')' END], lambda x: x IS NOT NULL),
  lambda x: 'changes[' || CAST(position AS VARCHAR) || ']: ' || x), '|') AS errors FROM scanned"""

PROMOTION = f"""
SELECT id, array_to_string(list_filter([CASE WHEN {_blank("person_name")} THEN 'person_name cannot be blank' END, CASE WHEN {_blank("company_name")} THEN 'company_name cannot be blank' END, CASE WHEN review_status <> 'pending' THEN 'candidate review_status must be pending' END,
  CASE WHEN guessed_relation_type NOT IN ({RELATION_TYPES}) THEN 'guessed_relation_type is not in allowlist' END, CASE WHEN confidence_suggestion = 'D' THEN 'confidence_suggestion D cannot be promoted' WHEN confidence_suggestion NOT IN ('A', 'B', 'C') THEN 'confidence_suggestion must be A, B, or C' END,
  CASE WHEN {_blank("evidence_text")} THEN 'evidence_text cannot be blank' END, CASE WHEN {_blank("source_url")} AND source_record_id IS NULL THEN 'source_url or source_record_id is required' END,
  CASE WHEN len(risk) > 0 THEN 'privacy risk detected: ' || array_to_string(risk, ', ') END], lambda x: x IS NOT NULL), '|') AS errors FROM scanned"""


#: Candidates that share business numbers, names and raw records with each other and with what is there.
_NUMBER = "CASE WHEN position % 3 = 0 THEN lpad(CAST(position % 30 AS STRING), 8, '1') WHEN position % 7 = 0 THEN ' ' END"
_COMPANY = "CASE WHEN position % 4 = 1 THEN 'Supplier#' || lpad(CAST(position % 20 AS STRING), 9, '0') ELSE 'Company ' || CAST(position % 12 AS STRING) END"
_RAW = "CASE WHEN position % 5 <> 0 THEN 'raw-' || CAST(position % 25 AS STRING) END"
OFFER = {"company_name": f"CASE WHEN company_name IS NOT NULL THEN {_COMPANY} END", "unified_business_no": _NUMBER, "source_record_id": _RAW, "review_note": "CASE WHEN position % 4 = 2 THEN 'seen' END", "review_status": "CASE WHEN position % 16 = 0 THEN 'verified' ELSE 'pending' END", "guessed_relation_type": "CASE WHEN position % 8 = 0 THEN 'friend' ELSE 'donor' END", "confidence_suggestion": "CASE position % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'D' ELSE 'A' END"}
_RAW_OF = "'raw-' || regexp_extract(source_url, '[0-9]+$', 0)"
PROMOTED_AT = "2024-05-06T07:08:09Z"


def promoted(t):
    offers = t["changes"].withColumns({c: F.expr(x) for c, x in OFFER.items()})
    documents = t["source_documents"].withColumn("raw_record_id", F.expr(_RAW_OF))
    return privacy.promotion(offers, t["people"], t["companies"], documents, t["person_company_relations"], PROMOTED_AT)


def promotion_rows(t):
    """All rows that promotion adds and changes, in one table."""
    found = promoted(t)
    parts = {
        "people": ("name",), "companies": ("name", "unified_business_no", "source_url"), "source_documents": ("source_type", "source_name", "source_url", "raw_record_id"),
        "person_company_relations": ("person_id", "company_id", "relation_type", "evidence_source_id", "confidence_level"), "relation_candidates": ("review_status", "review_note"),
    }
    rows = [found[k].select(F.lit(k).alias("table_name"), "id", F.concat_ws("|", *(F.coalesce(c, F.lit("-")) for c in columns)).alias("told")) for k, columns in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).unionByName(rows[4])


OFFERED = f"SELECT * REPLACE ({', '.join(f'{x} AS {c}' for c, x in OFFER.items() if c != 'review_note')}), {OFFER['review_note']} AS review_note FROM changes"
#: One candidate after the other: the company each takes, and the list of those made so far.
WALKED = """
WITH RECURSIVE queue AS (
  SELECT row_number() OVER (ORDER BY o.id) AS k, o.*, nullif(trim(o.unified_business_no), '') AS no,
         (SELECT min(id) FROM companies c WHERE c.unified_business_no = nullif(trim(o.unified_business_no), '')) AS by_no, (SELECT min(id) FROM companies c WHERE c.name = o.company_name) AS by_name
  FROM offered o JOIN offer_errors e ON e.id = o.id WHERE e.errors = ''),
steps AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id VARCHAR, name VARCHAR, no VARCHAR)[]) AS made, CAST(NULL AS VARCHAR) AS company_id, false AS company_new
  UNION ALL
  SELECT k, CASE WHEN taken IS NULL THEN list_append(made, {'id': fresh, 'name': company_name, 'no': no}) ELSE made END, coalesce(taken, fresh), taken IS NULL
  FROM (SELECT q.k, s.made, q.company_name, q.no, 'company-' || left(sha1(q.company_name), 12) AS fresh,
               coalesce(q.by_no, list_filter(s.made, lambda m: m.no = q.no)[1].id, q.by_name, list_filter(s.made, lambda m: m.name = q.company_name)[1].id) AS taken
        FROM steps s JOIN queue q ON q.k = s.k + 1) x)
SELECT q.*, company_id, company_new,
       coalesce((SELECT min(id) FROM people p WHERE p.name = q.person_name), 'person-' || left(sha1(q.person_name), 12)) AS person_id,
       NOT EXISTS (SELECT 1 FROM people p WHERE p.name = q.person_name) AND row_number() OVER (PARTITION BY person_name ORDER BY k) = 1 AS person_new,
       d.id AS old_document, coalesce(d.id, 'document-' || left(sha1(coalesce(q.source_record_id, q.id)), 12)) AS document_id
FROM queue q JOIN steps USING (k) LEFT JOIN (SELECT min(id) AS id, RAW_OF AS raw FROM source_documents WHERE is_public GROUP BY ALL) d ON d.raw = q.source_record_id""".replace("RAW_OF", _RAW_OF)
RELATED = """
SELECT w.*, r.id AS old_relation, coalesce(r.id, 'relation-' || left(sha1(w.person_id || '|' || w.company_id || '|' || w.guessed_relation_type || '|' || w.document_id), 12)) AS relation_id,
       row_number() OVER (PARTITION BY w.person_id, w.company_id, w.guessed_relation_type, w.document_id ORDER BY w.k) AS nth, row_number() OVER (PARTITION BY w.document_id ORDER BY w.k) AS nth_document
FROM walked w LEFT JOIN (SELECT min(id) AS id, person_id, company_id, relation_type, evidence_source_id FROM person_company_relations GROUP BY ALL) r
  ON r.person_id = w.person_id AND r.company_id = w.company_id AND r.relation_type = w.guessed_relation_type AND r.evidence_source_id = w.document_id"""
PROMOTED_ROWS = f"""
SELECT 'people' AS table_name, person_id AS id, person_name AS told FROM related WHERE person_new
UNION ALL SELECT 'companies', company_id, company_name || '|' || coalesce(no, '-') || '|' || coalesce(nullif(trim(source_url), ''), '-') FROM related WHERE company_new
UNION ALL SELECT 'source_documents', document_id, coalesce(nullif(trim(source_type), ''), 'manual_review') || '|' || coalesce(nullif(trim(source_name), ''), '-') || '|' || coalesce(nullif(trim(source_url), ''), '-') || '|' || coalesce(source_record_id, '-')
  FROM related WHERE old_document IS NULL AND nth_document = 1
UNION ALL SELECT 'person_company_relations', relation_id, concat_ws('|', person_id, company_id, guessed_relation_type, document_id, confidence_suggestion) FROM related WHERE old_relation IS NULL AND nth = 1
UNION ALL SELECT 'relation_candidates', id, 'verified|' || CASE WHEN coalesce(review_note, '') = '' THEN '' ELSE review_note || chr(10) END || 'promoted_at={PROMOTED_AT}; relation_id=' || relation_id FROM related"""
PROMOTED_RELATIONS = """
SELECT relation_id AS id, person_id, company_id, guessed_relation_type AS relation_type, document_id AS evidence_source_id, confidence_suggestion AS confidence_level, 'verified' AS verification_status FROM related WHERE old_relation IS NULL AND nth = 1"""


def new_companies(t):
    """A second delivery of companies: half of those there are under another name, and as many new ones."""
    c = t["companies"]
    changed = c.where(F.col("status") == "active").select("id", F.concat(F.lit("New "), "name").alias("name"), F.lit("renamed").alias("status"))
    return changed.unionByName(c.select(F.concat(F.lit("new-"), "id").alias("id"), "name", F.lit("new").alias("status")))


def in_store(t, name: str, act):
    """A table as it is after a change of a store that has been made of it."""
    kept = Store(t.spark, scratch(t.spark))
    made = kept.change()
    made.create(name, t[name], ["id"], 8)
    made.commit()
    change = kept.change()
    act(change)
    change.commit()
    return kept.read(name)


def add(register) -> None:
    claims = lambda t: t["person_claims"]
    register("r01_r02_exploded_claims", lambda t: C.explode_claims(records(t), "id", FIELDS, F.col("matched")), EXPLODED, records=RECORDS)
    register("r10_review_eligibility", eligible, ELIGIBLE, **ALL)
    register("a17_eligibility_histogram", lambda t: eligible(t).groupBy("reason").agg(F.count("*").alias("n")), "SELECT reason, count(*) AS n FROM eligible_ GROUP BY reason", **(ALL | {"eligible_": ELIGIBLE}))
    register("r11_after_auto_review", lambda t: C.approve_eligible(scored(t), eligible(t), reviewed_at=PROMOTED_AT).select("id", "review_status", "visibility", "is_public", "scoring_version", "scoring_reasons", "auto_reviewed_at"), f"""
        SELECT c.id, CASE WHEN e.eligible THEN 'verified' ELSE c.review_status END AS review_status, CASE WHEN e.eligible THEN 'public' ELSE c.visibility END AS visibility, coalesce(e.eligible, false) OR c.is_public AS is_public,
               CASE WHEN e.eligible THEN 'auto-review' ELSE c.scoring_version END AS scoring_version, CASE WHEN e.eligible THEN '{PROMOTED_AT}' END AS auto_reviewed_at,
               CASE WHEN e.eligible THEN CASE WHEN told IN ('[]', 'none') OR told IS NULL THEN '[' ELSE left(told, length(told) - 1) || ',' END || '{{"version":"auto-review","reason":"{C.AUTO_REASON}","reviewedAt":"{PROMOTED_AT}"}}]' ELSE told END AS scoring_reasons
        FROM (SELECT * EXCLUDE (scoring_reasons), {_TOLD_REASONS} AS told FROM person_claims) c LEFT JOIN eligible_ e ON e.claim_id = c.id""", **(ALL | {"eligible_": ELIGIBLE}))
    register("a19_sensitive_guard", lambda t: C.sensitive_public_count(claims(t)).unionByName(C.sensitive_public_count(C.approve_eligible(claims(t), eligible(t)))), """
        SELECT count(*) AS n FROM person_claims WHERE claim_type IN ('legal_case', 'family_relation') AND is_public
        UNION ALL SELECT count(*) FROM person_claims WHERE claim_type IN ('legal_case', 'family_relation') AND is_public""")
    register("r07_sticky_review_state", lambda t: C.keep_review_state(fresh_claims(t), claims(t)).select("id", "review_status", "visibility", "is_public"), STICKY)
    register("r08_spread_terminal_states", lambda t: C.spread_terminal_states(claims(t)), f"""
        SELECT p.id AS claim_id, s.review_status, s.visibility FROM (SELECT *, {_STM} AS k FROM person_claims) p
        JOIN (SELECT DISTINCT ON (k) * FROM (SELECT *, {_STM} AS k FROM person_claims) z WHERE k IS NOT NULL AND review_status IN ('verified', 'rejected', 'archived') ORDER BY k, id) s ON s.k = p.k
        WHERE p.review_status IN ('pending', 'needs_more_evidence')""")
    register("r12_missing_match_changes", lambda t: C.missing_match_changes(claims(t)), f"""
        SELECT claim_id, action, CASE action WHEN 'reject' THEN 'rejected' WHEN 'approve' THEN 'verified' ELSE 'needs_more_evidence' END AS review_status, CASE action WHEN 'reject' THEN 'private' WHEN 'approve' THEN 'public' ELSE 'review_only' END AS visibility, action = 'approve' AS is_public
        FROM (SELECT id AS claim_id, CASE WHEN review_status IN ('pending', 'needs_more_evidence') AND d IN ('reject', 'approve') THEN d WHEN review_status = 'pending' AND d IS NULL THEN 'hold' END AS action
              FROM (SELECT *, json_extract_string(claim_json, '$.reviewDecision.decision') AS d FROM person_claims) x WHERE source_name = '{ENTITY}' AND json_extract_string(claim_json, '$.identityMatch.status') IS NULL) y WHERE action IS NOT NULL""")
    register("r13_merged_claims_to_archive", lambda t: C.merged_claims_to_archive(claims(t), t["person_merge_decisions"]), """
        SELECT c.id AS claim_id, d.canonical_person_id, max(v.id) AS canonical_claim_id FROM person_claims c JOIN person_merge_decisions d ON d.status = 'verified' AND d.duplicate_person_id = c.person_id
        JOIN person_claims v ON v.review_status = 'verified' AND v.visibility = 'public' AND v.is_public AND v.person_id = d.canonical_person_id AND v.claim_type = c.claim_type AND coalesce(v.claim_value, '') = coalesce(c.claim_value, '') AND coalesce(v.source_name, '') = coalesce(c.source_name, '')
        WHERE c.review_status IN ('pending', 'needs_more_evidence') GROUP BY c.id, d.canonical_person_id""")
    register("r14_official_ids_to_promote", lambda t: C.official_ids_to_promote(claims(t)), """
        SELECT id AS claim_id, claim_value, source_name FROM person_claims WHERE claim_type = 'external_id' AND ((source_name LIKE '%中央選舉委員會%' AND claim_value LIKE 'cec-%') OR (source_name LIKE '%立法院開放資料%' AND claim_value LIKE 'ly-legislator-%'))
        AND NOT (review_status = 'verified' AND visibility = 'public' AND is_public)""")
    register("w06_visible_profile_claims", lambda t: C.visible_profile_claims(V.public_person_claims(t)), """
        SELECT person_id, rank, claim_id, claim_type, claim_value FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY review_score DESC, claim_type, claim_id) AS rank
          FROM (SELECT DISTINCT ON (person_id, claim_type, claim_value) * FROM public_claims_ WHERE claim_type NOT IN ('name', 'external_id', 'education', 'experience', 'platform', 'finance_summary', 'legal_case', 'family_relation')
                ORDER BY person_id, claim_type, claim_value, review_score DESC, claim_id) a) b WHERE rank <= 12""", **ALL)
    register("k04_malformed_claim_keys", lambda t: C.malformed_keys(claims(t)), "SELECT id AS claim_id, 'archived' AS review_status FROM person_claims WHERE length(claim_key) - length(replace(claim_key, ':', '')) >= 3")
    register("k06_delete_source_only_claims", lambda t: in_store(t, "person_claims", lambda c: c.delete("person_claims", C.of_source_only((ENTITY, "other")))).groupBy("source_name").agg(F.count("*").alias("n")), f"""
        SELECT source_name, count(*) AS n FROM person_claims WHERE NOT (person_id IS NULL AND source_name IN ('{ENTITY}', 'other')) GROUP BY source_name""")
    register("k01_upsert_companies", lambda t: in_store(t, "companies", lambda c: c.merge("companies", new_companies(t))).select("id", "name", "status", "address_region"), """
        SELECT id, CASE WHEN status = 'active' THEN 'New ' || name ELSE name END AS name, CASE WHEN status = 'active' THEN 'renamed' ELSE status END AS status, address_region FROM companies
        UNION ALL SELECT 'new-' || id, name, 'new', NULL FROM companies""")
    register("k03_k05_patch_races", lambda t: in_store(t, "races", lambda c: c.patch("races", F.col("title").startswith("NATION_1") & (F.col("status") == "draft"), status="announced", voting_date=F.coalesce("voting_date", F.lit("2026-11-28")))).select("id", "status", "voting_date"), """
        SELECT id, CASE WHEN title LIKE 'NATION\\_1%' ESCAPE '\\' AND status = 'draft' THEN 'announced' ELSE status END AS status, CASE WHEN title LIKE 'NATION\\_1%' ESCAPE '\\' AND status = 'draft' THEN coalesce(voting_date, '2026-11-28') ELSE voting_date END AS voting_date FROM races""")
    register("k02_r36_planned_races", lambda t: contracts.clone_races(t["races"], t["elections"], "e1999", "e2001"), """
        SELECT 'planned:' || r.id AS id, e.id AS election_id, r.region_id, r.race_type, r.title, e.voting_date, 'announced' AS status FROM races r CROSS JOIN (SELECT * FROM elections WHERE id = 'e2001') e WHERE r.election_id = 'e1999'""")
    register("k07_region_parents", lambda t: t["regions"].alias("a").join(t["regions"].select(F.col("id").alias("p_id"), F.col("slug").alias("parent_slug")), F.col("parent_region_id") == F.col("p_id"), "left").select("id", "parent_slug"), """
        SELECT a.id, b.slug AS parent_slug FROM regions a LEFT JOIN regions b ON b.id = a.parent_region_id""")
    register("k09_run_log", lambda t: store.run_log(t.spark, "run", {"people": t["people"], "candidates": t["candidates"], "companies": t["companies"]}), """
        SELECT 'run' AS run, 'people' AS "table", count(*) AS rows FROM people UNION ALL SELECT 'run', 'candidates', count(*) FROM candidates UNION ALL SELECT 'run', 'companies', count(*) FROM companies""")
    register("r24_privacy_scan", lambda t: t["changes"].select("position", privacy.risks(privacy.combined("person_name", "company_name", "evidence_text", "source_name", "source_url")).alias("rules")), "SELECT position, array_to_string(risk, '|') AS rules FROM scanned", scanned=SCANNED)
    register("r25_r27_change_set_errors", lambda t: privacy.item_errors(t["changes"]), ITEM_ERRORS, scanned=SCANNED)
    register("r26_promotion_errors", lambda t: privacy.promotion_errors(t["changes"]), PROMOTION, scanned=SCANNED)
    register("k10_staged_candidates", lambda t: privacy.staged(t["changes"]).drop("evidence_text"), """
        SELECT 'raw-' || left(sha1(coalesce(c.source_name, '') || '|' || coalesce(c.source_url, '') || '|' || c.evidence_text), 12) AS source_record_id,
               'candidate-' || left(sha1(coalesce(c.person_name, '') || '|' || coalesce(c.company_name, '') || '|' || coalesce(c.guessed_relation_type, '') || '|' || c.evidence_text), 12) AS candidate_id,
               c.person_name, c.company_name, c.guessed_relation_type, 'pending' AS review_status, false AS is_public
        FROM changes c JOIN item_errors e ON e.position = c.position WHERE e.errors = ''""", scanned=SCANNED, item_errors=ITEM_ERRORS)
    promotion = {"scanned_offers": SCANNED.replace("FROM changes", "FROM offered"), "offer_errors": PROMOTION.replace("FROM scanned", "FROM scanned_offers"), "offered": OFFERED, "walked": WALKED, "related": RELATED}
    register("k11_promotion_rows", promotion_rows, PROMOTED_ROWS, **promotion)
    register("k11_promoted_relations", lambda t: promoted(t)["person_company_relations"].select("id", "person_id", "company_id", "relation_type", "evidence_source_id", "confidence_level", "verification_status"), PROMOTED_RELATIONS, **promotion)
    register("r28_missing_parents", lambda t: contracts.missing_parents(t["candidates"], "id", "person_id", t["people"], "id").unionByName(contracts.missing_parents(t["races"], "id", "region_id", t["regions"], "id")).unionByName(contracts.missing_parents(t["person_claims"], "id", "source_person_id", t["source_people"].where("is_public"), "id")), """
        SELECT id AS key, person_id AS missing FROM candidates c WHERE person_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM people p WHERE p.id = c.person_id)
        UNION ALL SELECT id, region_id FROM races r WHERE region_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM regions g WHERE g.id = r.region_id)
        UNION ALL SELECT id, source_person_id FROM person_claims c WHERE source_person_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM source_people s WHERE s.is_public AND s.id = c.source_person_id)""")
    register("contract_violations", lambda t: contracts.violations(t["person_claims"], "id", {"review_status": contracts.in_enum("review_status", "review_status"), "score": contracts.in_range("review_score", 0, 95), "public": ~F.col("is_public") | (F.col("visibility") == "public")}), """
        SELECT id AS key, rule FROM (SELECT id, unnest([CASE WHEN review_status NOT IN ('pending', 'verified', 'rejected', 'archived', 'needs_more_evidence') THEN 'review_status' END, CASE WHEN review_score NOT BETWEEN 0 AND 95 THEN 'score' END,
          CASE WHEN is_public AND visibility <> 'public' THEN 'public' END]) AS rule FROM person_claims) x WHERE rule IS NOT NULL""")
    register("contract_one_primary_photo", lambda t: contracts.repeated_keys(t["person_media"].select(F.substring("person_id", 1, 7).alias("person_prefix"), "is_primary", "is_public"), ["person_prefix"], F.col("is_primary") & F.col("is_public")), """
        SELECT substr(person_id, 1, 7) AS person_prefix, count(*) AS n FROM person_media WHERE is_primary AND is_public GROUP BY 1 HAVING count(*) > 1""")
    register("p16_row_policies", lambda t: t["person_claims"].agg(*(F.count(F.when(contracts.policies()[p], 1)).alias(p) for p in ("read_public", "read_claims", "import_claims"))), """
        SELECT count(*) FILTER (is_public) AS read_public, count(*) FILTER (review_status = 'verified' AND visibility = 'public' AND is_public) AS read_claims,
               count(*) FILTER (review_status IN ('pending', 'needs_more_evidence') AND visibility = 'review_only' AND NOT is_public) AS import_claims FROM person_claims""")
