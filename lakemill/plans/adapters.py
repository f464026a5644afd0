"""The data model's tables made from the driver's tables, each by one SELECT that Spark and DuckDB both read.

Keys, nulls, states and times follow from key arithmetic, so that every rule
meets its cases: private rows, missing values, conflicting genders, merges.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "pages")


def _key(prefix: str, expression: str) -> str:
    return f"'{prefix}' || lpad(CAST({expression} AS STRING), 8, '0')"


POSITIONS = ["立法委員", "臺北市議員", "高雄市市長", "副市長", "總統候選人", "副總統", "環保局局長", "黨主席"]
_POSITION = "CASE {0} % 10 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(POSITIONS)) + " WHEN 8 THEN 'clerk' ELSE NULL END"
_GENDER = "CASE {0} % 5 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'unknown' WHEN 3 THEN 'male' ELSE NULL END"
_NAME = "CASE {0} % 7 WHEN 1 THEN upper(p_name || ' ' || p_type) WHEN 2 THEN p_name || '  ' || p_type WHEN 3 THEN p_name || '·' || p_type ELSE p_name || ' ' || p_type END"
_CLAIM_TYPES = "CASE event_id % 11 WHEN 0 THEN 'external_id' WHEN 1 THEN 'birth_date' WHEN 2 THEN 'gender' WHEN 3 THEN 'education' WHEN 4 THEN 'experience' WHEN 5 THEN 'party' WHEN 6 THEN 'legal_case' WHEN 7 THEN 'family_relation' WHEN 8 THEN 'alias' WHEN 9 THEN 'finance_summary' ELSE 'platform' END"
_PERSON_OF_EVENT = "(event_id * 31 + user_id) % 180"

TABLES = {
    "people": f"""
        SELECT {_key("p", "p_partkey")} AS id, {_NAME.format("p_partkey")} AS name, CASE WHEN p_partkey % 6 = 0 THEN 'alias ' || p_type END AS alias,
               CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS party, {_POSITION.format("p_partkey")} AS position, CAST(2010 + p_partkey % 14 AS INT) AS election_year,
               CASE WHEN p_partkey % 11 <> 0 THEN 'NATION_' || CAST(p_size % 25 AS STRING) END AS district, {_GENDER.format("p_partkey")} AS gender,
               CASE WHEN p_partkey % 4 = 0 THEN 'school ' || p_brand END AS education, CASE WHEN p_partkey % 3 = 0 THEN 'office ' || p_type END AS experience,
               CASE WHEN p_partkey % 8 = 0 THEN 'cec-' || CAST(p_partkey AS STRING) END AS external_id, p_partkey % 10 <> 9 AS is_public, CAST(p_partkey * 7919 % 100003 AS BIGINT) AS updated_at
        FROM {{part}}""",
    "person_claims": f"""
        SELECT {_key("c", "event_id")} AS id, 'src:' || CAST(event_id % 97 AS STRING) || ':' || event_type || CASE WHEN event_id % 23 = 0 THEN ':old:key' ELSE '' END AS claim_key,
               CASE WHEN event_id % 19 <> 0 THEN {_key("p", _PERSON_OF_EVENT)} END AS person_id, {_key("s", "event_id % 120")} AS source_person_id, {_CLAIM_TYPES} AS claim_type,
               CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'wikidata:q' || CAST(event_id % 70 AS STRING) ELSE 'cec-' || CAST(event_id % 90 AS STRING) END
                    WHEN event_id % 11 = 1 THEN '19' || CAST(50 + event_id % 3 AS STRING) || '-01-02' WHEN event_id % 11 = 2 THEN CASE WHEN event_id % 2 = 0 THEN '女' ELSE 'male' END
                    ELSE ' ' || event_type || ' ' || CAST(event_id % 7 AS STRING) END AS claim_value,
               CASE WHEN event_id % 3 = 0 THEN '{{{{"wikidataQid":"Q' || CAST({_PERSON_OF_EVENT} % 70 AS STRING) || '","identityMatch":{{{{"status":"matched"}}}}}}}}'
                    WHEN event_id % 7 = 0 THEN '{{{{"wikidataQid":"Q' || CAST({_PERSON_OF_EVENT} % 70 AS STRING) || '","reviewDecision":{{{{"decision":"' || CASE WHEN event_id % 2 = 0 THEN 'approve' ELSE 'reject' END || '"}}}}}}}}'
                    ELSE props END AS claim_json,
               CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS confidence_level, CAST(event_id % 101 AS INT) AS review_score,
               CASE event_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'needs_more_evidence' WHEN 2 THEN 'rejected' WHEN 3 THEN 'archived' ELSE 'verified' END AS review_status,
               CASE event_id % 9 WHEN 0 THEN 'private' WHEN 1 THEN 'review_only' ELSE 'public' END AS visibility, event_id % 12 <> 5 AS is_public,
               CASE event_id % 5 WHEN 0 THEN 'Wikidata 人物補充資料' WHEN 1 THEN '中央選舉委員會' WHEN 2 THEN '立法院開放資料' WHEN 3 THEN 'Wikidata 人物補充資料' ELSE 'other' END AS source_name,
               CASE WHEN event_id % 6 <> 0 THEN 'https://c.example/' || CAST(event_id AS STRING) END AS source_url, CASE WHEN event_id % 8 <> 0 THEN 'v' || CAST(event_id % 3 AS STRING) END AS scoring_version, 'base:' || CAST(event_id % 45 AS STRING) AS scoring_reasons,
               CAST(event_id AS BIGINT) AS updated_at
        FROM {{events}}""",
    "person_merge_decisions": f"""
        SELECT {_key("p", "p_partkey")} AS duplicate_person_id, {_key("p", "CASE WHEN p_partkey % 34 = 0 THEN p_partkey + 2 ELSE p_partkey + 1 END")} AS canonical_person_id,
               CASE WHEN p_partkey % 17 <> 0 THEN 'draft' WHEN p_partkey % 5 = 1 THEN 'rejected' WHEN p_partkey % 5 = 2 THEN 'suggested' WHEN p_partkey % 5 = 3 THEN 'archived' ELSE 'verified' END AS status,
               CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'D' END AS confidence_level
        FROM {{part}}""",
    "source_people": f"""
        SELECT {_key("s", "c_custkey")} AS id, CASE c_custkey % 4 WHEN 0 THEN 'official_election' WHEN 1 THEN 'wikidata' WHEN 2 THEN 'government_open_data' ELSE 'other' END AS source_type,
               {_NAME.format("(p_partkey + 3)")} AS raw_name, {_GENDER.format("p_partkey")} AS gender, CASE WHEN c_custkey % 6 <> 0 THEN p_brand END AS party, {_POSITION.format("p_partkey")} AS position,
               'NATION_' || CAST(p_size % 25 AS STRING) AS district, CAST(2000 + c_custkey % 20 AS INT) AS election_year, CASE WHEN c_custkey % 2 = 0 THEN 'cec-' || CAST(p_partkey AS STRING) END AS external_record_id,
               CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'C' ELSE 'D' END AS confidence_level, c_custkey % 10 <> 3 AS is_public,
               'key:' || CAST(c_custkey AS STRING) AS source_person_key, 'List ' || CAST(c_nationkey AS STRING) AS source_name, CASE WHEN c_custkey % 5 <> 0 THEN 'https://l.example/' || CAST(c_custkey AS STRING) END AS source_url,
               lower(replace(p_name || p_type, ' ', '')) AS normalized_name, CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'C' ELSE 'D' END AS confidence_suggestion, CAST(c_custkey * 13 % 1009 AS BIGINT) AS updated_at
        FROM {{customer}} JOIN {{part}} ON p_partkey = c_custkey""",
    "person_identity_matches": f"""
        SELECT {_key("m", "o_orderkey")} AS id, {_key("s", "o_custkey")} AS source_person_id, {_key("p", "(o_custkey * 3 + o_orderkey) % 2000")} AS person_id,
               CASE o_orderkey % 9 WHEN 0 THEN 'auto_matched' WHEN 1 THEN 'possible_match' WHEN 2 THEN 'rejected' ELSE 'probable_match' END AS match_status, CAST(o_orderkey % 96 AS INT) AS score,
               CASE o_orderkey % 3 WHEN 0 THEN 'external_id' ELSE 'name' END AS match_method, 'because ' || CAST(o_orderkey % 5 AS STRING) AS match_reason, CASE WHEN o_orderkey % 4 <> 0 THEN '[' || CAST(o_orderkey % 7 AS STRING) || ']' END AS evidence_json,
               CAST(o_orderkey AS BIGINT) AS updated_at
        FROM {{orders}}""",
    "regions": f"""
        SELECT 'region-r' || CAST(r_regionkey AS STRING) AS id, r_name AS name, lower(r_name) AS slug, 'country' AS region_type, CAST(NULL AS STRING) AS parent_region_id, CAST(r_regionkey AS INT) AS display_order, true AS is_public,
               CAST(r_regionkey AS STRING) AS official_code, CAST(NULL AS STRING) AS map_code
        FROM {{region}}
        UNION ALL
        SELECT 'region-n' || CAST(n_nationkey AS STRING), n_name, 'n-' || CAST(n_nationkey AS STRING), 'county_city', 'region-r' || CAST(n_regionkey AS STRING),
               CASE WHEN n_nationkey % 6 <> 0 THEN CAST(100 + n_nationkey AS INT) END, n_nationkey % 8 <> 7, CASE WHEN n_nationkey % 3 <> 0 THEN 'o' || CAST(n_nationkey AS STRING) END, 'TW' || CAST(n_nationkey AS STRING)
        FROM {{nation}}""",
    "elections": """
        SELECT 'e' || CAST(y AS STRING) AS id, 'Election ' || CAST(y AS STRING) AS name, CAST(y AS INT) AS year, CASE y % 3 WHEN 0 THEN 'presidential' WHEN 1 THEN 'local' ELSE 'legislative' END AS election_type,
               CASE WHEN y % 4 <> 0 THEN CAST(y AS STRING) || '-11-2' || CAST(y % 10 AS STRING) END AS voting_date, CASE y % 4 WHEN 1 THEN 'announced' WHEN 2 THEN 'upcoming' WHEN 3 THEN 'completed' ELSE 'active' END AS status, y % 5 <> 4 AS is_public,
               'Commission' AS source_name, CASE WHEN y % 3 <> 0 THEN 'https://e.example/' || CAST(y AS STRING) END AS source_url
        FROM (SELECT DISTINCT year(o_orderdate) AS y FROM {orders}) years""",
    "races": """
        SELECT 'race-' || CAST(y AS STRING) || '-' || CAST(n_nationkey AS STRING) AS id, 'e' || CAST(y AS STRING) AS election_id, CASE WHEN n_nationkey % 9 <> 4 THEN 'region-n' || CAST(n_nationkey AS STRING) END AS region_id,
               CASE n_nationkey % 6 WHEN 0 THEN 'president' WHEN 1 THEN 'legislator' WHEN 2 THEN 'city_councilor' WHEN 3 THEN 'county_mayor' WHEN 4 THEN 'village_chief' ELSE 'referendum' END AS race_type,
               n_name || CASE n_nationkey % 3 WHEN 0 THEN '第 ' || CAST(n_nationkey AS STRING) || ' 選舉區' WHEN 1 THEN '議員' ELSE ' race' END AS title,
               CASE WHEN (y + n_nationkey) % 7 <> 0 THEN CAST(y AS STRING) || '-11-' || lpad(CAST(1 + (n_nationkey * 7 + y) % 28 AS STRING), 2, '0') END AS voting_date,
               CASE (y * 3 + n_nationkey) % 7 WHEN 0 THEN 'announced' WHEN 1 THEN 'upcoming' WHEN 2 THEN 'registration_open' WHEN 3 THEN 'completed' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'voting' ELSE 'draft' END AS status,
               (y + n_nationkey) % 11 <> 3 AS is_public, 'Commission ' || CAST(y AS STRING) AS source_name, CASE WHEN n_nationkey % 4 <> 0 THEN 'https://r.example/' || CAST(n_nationkey AS STRING) END AS source_url
        FROM (SELECT DISTINCT year(o_orderdate) AS y FROM {orders}) years CROSS JOIN {nation}""",
    "candidates": f"""
        SELECT {_key("k", "o_orderkey")} AS id, {_key("p", "o_custkey")} AS person_id, 'race-' || CAST(year(o_orderdate) AS STRING) || '-' || CAST(o_custkey % 25 AS STRING) AS race_id,
               CASE WHEN o_orderkey % 4 <> 3 THEN 'Brand#' || CAST(1 + o_orderkey % 25 AS STRING) END AS party, CASE WHEN o_orderkey % 6 <> 1 THEN CAST(o_orderkey % 3 AS STRING) END AS candidate_no,
               CASE o_orderkey % 6 WHEN 0 THEN 'elected' WHEN 1 THEN 'not_elected' WHEN 2 THEN 'registered' WHEN 3 THEN 'withdrawn' WHEN 4 THEN 'pending' ELSE 'unknown' END AS registration_status,
               o_orderkey % 7 <> 6 AS is_public, CAST(o_orderkey * 31 % 100003 AS BIGINT) AS updated_at, 'Ballot ' || CAST(o_orderkey % 9 AS STRING) AS source_name,
               CASE WHEN o_orderkey % 5 <> 0 THEN 'https://k.example/' || CAST(o_orderkey AS STRING) END AS source_url
        FROM {{orders}}""",
    "companies": f"""
        SELECT {_key("f", "s_suppkey")} AS id, lpad(CAST(s_suppkey AS STRING), 8, '1') AS unified_business_no, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'Rep ' || CAST(s_nationkey AS STRING) END AS representative_name,
               CASE WHEN s_suppkey % 4 = 0 THEN 'closed' ELSE 'active' END AS status, 'NATION_' || CAST(s_nationkey AS STRING) AS address_region, s_suppkey % 9 <> 8 AS is_public,
               CAST(s_suppkey * 1000 AS BIGINT) AS capital, CAST(s_suppkey * 17 % 1009 AS BIGINT) AS updated_at
        FROM {{supplier}}""",
    "person_company_relations": f"""
        SELECT {_key("x", "l_orderkey * 10 + l_linenumber")} AS id, {_key("p", "l_partkey")} AS person_id, {_key("f", "l_suppkey")} AS company_id,
               CASE l_linenumber % 4 WHEN 0 THEN 'director' WHEN 1 THEN 'supervisor' WHEN 2 THEN 'manager' ELSE 'donor' END AS relation_type,
               CASE l_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS confidence_level, {_key("d", "l_suppkey")} AS evidence_source_id,
               CASE WHEN l_orderkey % 3 = 0 THEN 'pending' ELSE 'verified' END AS verification_status, l_orderkey % 8 <> 5 AS is_public,
               CASE WHEN l_linenumber % 3 <> 0 THEN 'line ' || CAST(l_linenumber AS STRING) END AS evidence_text, CAST(l_orderkey AS BIGINT) AS created_at, CAST(l_orderkey + l_linenumber AS BIGINT) AS updated_at
        FROM {{lineitem}}""",
    "source_documents": f"""
        SELECT {_key("d", "s_suppkey")} AS id, 'Registry ' || CAST(s_nationkey AS STRING) AS source_name, s_suppkey % 4 <> 1 AS is_public, 'https://d.example/' || CAST(s_suppkey AS STRING) AS source_url FROM {{supplier}}""",
    "person_media": f"""
        SELECT {_key("i", "p_partkey")} AS id, {_key("p", "p_partkey")} AS person_id, 'https://media.example/' || CAST(p_partkey AS STRING) AS url, CASE p_partkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'cc_by' ELSE 'public_domain' END AS license_type,
               CASE WHEN p_partkey % 5 = 0 THEN 'pending' ELSE 'verified' END AS verification_status, p_partkey % 6 IN (1, 3) AS is_primary, p_partkey % 7 <> 1 AS is_public,
               CASE WHEN p_partkey % 3 = 0 THEN 'https://t.example/' || CAST(p_partkey AS STRING) END AS thumbnail_url, 'Archive ' || CAST(p_partkey % 11 AS STRING) AS source_name, 'https://a.example/' || CAST(p_partkey AS STRING) AS source_url,
               CASE WHEN p_partkey % 4 = 1 THEN 'https://cc.example' END AS license_url, CASE WHEN p_partkey % 5 <> 2 THEN 'by ' || p_brand END AS attribution
        FROM {{part}}""",
    "parties": """
        SELECT 'party-' || CAST(n_nationkey AS STRING) AS id, 'Brand#' || CAST(1 + n_nationkey AS STRING) AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'B' || CAST(1 + n_nationkey AS STRING) END AS short_name,
               'brand-' || CAST(n_nationkey AS STRING) AS slug, 'unknown' AS theme_key, CASE WHEN n_nationkey % 6 = 5 THEN 'dissolved' ELSE 'active' END AS status, 'x' || CAST(n_nationkey AS STRING) AS external_id, n_nationkey % 12 <> 11 AS is_public,
               'https://p' || CAST(n_nationkey AS STRING) || '.example' AS official_site_url, CASE WHEN n_nationkey % 3 <> 0 THEN 'Chair ' || n_name END AS chairperson_name, CAST(100 + n_nationkey AS STRING) AS registry_no,
               CASE WHEN n_nationkey % 4 <> 0 THEN '民國' || CAST(70 + n_nationkey AS STRING) || '年1月2日' END AS founded_date_text, '民國' || CAST(71 + n_nationkey AS STRING) || '年3月4日' AS filed_date_text,
               n_name || ' street 1' AS headquarters_address, CASE WHEN n_nationkey % 5 <> 0 THEN '02-' || CAST(n_nationkey AS STRING) END AS contact_phone, 'Registry' AS source_name, 'https://m.example' AS source_url, CAST(n_nationkey AS BIGINT) AS updated_at
        FROM {nation}""",
    "party_finance_summaries": """
        SELECT 'party-' || CAST(c_nationkey AS STRING) AS party_id, CAST(year(o_orderdate) AS INT) AS report_year, round(sum(o_totalprice), 2) AS income_total,
               round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS expense_total, round(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END), 2) AS balance_amount,
               round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS business_donation_total, true AS is_public,
               round(sum(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE 0 END), 2) AS individual_donation_total, round(sum(CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice ELSE 0 END), 2) AS civil_group_donation_total,
               round(sum(CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice ELSE 0 END), 2) AS anonymous_donation_total, CAST(0 AS DOUBLE) AS other_income_total, 'Accounts' AS source_name, 'https://f.example' AS source_url, CAST(max(o_orderkey) AS BIGINT) AS updated_at
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate)""",
    "party_company_contribution_summaries": f"""
        SELECT 'party-' || CAST(l_partkey % 25 AS STRING) AS party_id, {_key("f", "l_suppkey")} AS company_id, CAST(year(l_shipdate) AS INT) AS report_year, round(sum(l_extendedprice), 2) AS amount_total,
               CAST(count(*) AS BIGINT) AS donation_count, 'A' AS confidence_level, true AS is_public, 'Accounts' AS source_name, 'https://f.example/' || CAST(l_suppkey AS STRING) AS source_url, CAST(max(l_orderkey) AS BIGINT) AS reviewed_at
        FROM {{lineitem}} WHERE l_returnflag = 'R' GROUP BY l_partkey % 25, l_suppkey, year(l_shipdate)""",
    "income": """
        SELECT CASE WHEN l_returnflag = 'N' THEN '個人捐贈收入' ELSE '營利事業捐贈收入' END AS account, CASE WHEN l_linenumber % 5 = 0 THEN 'A1' ELSE lpad(CAST(l_suppkey AS STRING), 4, '2') || '-' || '0001' END AS business_no,
               'Brand#' || CAST(1 + l_partkey % 30 AS STRING) AS party, CASE WHEN l_suppkey % 10 = 0 THEN ' ' ELSE 'Company ' || CAST(l_suppkey AS STRING) END AS donor,
               CASE WHEN l_linenumber % 2 = 0 THEN CAST(year(l_shipdate) AS STRING) ELSE CAST(year(l_shipdate) - 1911 AS STRING) || '年' END AS year,
               CASE WHEN l_linenumber = 3 THEN '' ELSE CAST(CAST(l_quantity AS INT) AS STRING) || ',' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0') || '元' END AS amount
        FROM {lineitem}""",
    "legal_record_leads": f"""
        SELECT {_key("l", "c_custkey")} AS id, CASE c_custkey % 3 WHEN 0 THEN 'court_document' WHEN 1 THEN 'news' ELSE 'judicial_api' END AS source_type, 'case ' || p_brand AS title,
               'about NATION_' || CAST(p_size % 25 AS STRING) || ' and ' || CASE WHEN c_custkey % 2 = 0 THEN p_brand ELSE 'nobody' END AS summary, p_name || ' ' || p_type AS raw_name, lower(replace(p_name || p_type, ' ', '')) AS normalized_name,
               CASE WHEN c_custkey % 2 = 0 THEN {_key("p", "p_partkey")} END AS target_person_id, CASE WHEN c_custkey % 4 <> 0 THEN {_key("p", "p_partkey")} END AS matched_person_id, CAST(c_custkey % 90 AS INT) AS match_score,
               'possible_match' AS match_status, CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'needs_more_evidence' ELSE 'archived' END AS review_status, c_custkey % 13 = 0 AS is_public, CAST(c_custkey AS BIGINT) AS updated_at,
               'lead:' || CAST(c_custkey AS STRING) AS lead_key, 'Court list' AS source_name, CASE WHEN c_custkey % 3 <> 0 THEN 'https://j.example/' || CAST(c_custkey AS STRING) END AS source_url, 'TPD' AS court_name, CAST(100 + c_custkey % 14 AS STRING) AS case_year,
               '訴' AS case_code, CAST(c_custkey AS STRING) AS case_number, CASE WHEN c_custkey % 5 <> 0 THEN '2021-0' || CAST(1 + c_custkey % 9 AS STRING) || '-11' END AS judgment_date, CASE c_custkey % 2 WHEN 0 THEN 'civil' ELSE 'criminal' END AS case_type,
               CASE WHEN c_custkey % 4 = 1 THEN 'reason ' || p_brand END AS reason, CASE c_custkey % 3 WHEN 0 THEN 'B' ELSE 'D' END AS confidence_level, CASE WHEN c_custkey % 7 = 0 THEN 'look again' END AS review_note
        FROM {{customer}} JOIN {{part}} ON p_partkey = c_custkey""",
    "changes": """
        SELECT doc_id AS position, CASE doc_id % 6 WHEN 0 THEN 'create_relation_candidate' WHEN 1 THEN 'create_company_candidate' WHEN 2 THEN 'create_person_candidate' WHEN 3 THEN 'set_public_true' ELSE 'create_raw_source_record' END AS action,
               CASE WHEN doc_id % 4 <> 0 THEN 'Person ' || CAST(doc_id % 50 AS STRING) END AS person_name, CASE WHEN doc_id % 5 <> 0 THEN 'Company ' || CAST(doc_id % 40 AS STRING) END AS company_name, text AS evidence_text,
               CASE WHEN doc_id % 7 <> 0 THEN source END AS source_name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'https://s.example/' || CAST(doc_id AS STRING) END AS source_url, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE 'registry' END AS source_type,
               CASE doc_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'E' ELSE 'A' END AS confidence_suggestion, CASE WHEN doc_id % 8 = 0 THEN 'verified' ELSE 'pending' END AS review_status,
               doc_id % 10 = 7 AS is_public, CASE doc_id % 4 WHEN 0 THEN 'director' WHEN 1 THEN 'friend' WHEN 2 THEN '' ELSE 'donor' END AS guessed_relation_type,
               CASE WHEN doc_id % 5 = 0 THEN '123' ELSE '12345678' END AS unified_business_no, 'row-' || CAST(doc_id AS STRING) AS id, CASE WHEN doc_id % 2 = 0 THEN 'raw-' || CAST(doc_id AS STRING) END AS source_record_id
        FROM {documents}""",
    "archive_cells": """
        SELECT p_partkey AS n, CAST(2010 + p_partkey % 14 AS STRING) || '年' || CASE p_partkey % 4 WHEN 0 THEN '/總統/' WHEN 1 THEN '/區域立委/' WHEN 2 THEN '/C1/' ELSE '/T1/' END AS folder, CASE WHEN p_partkey % 3 = 0 THEN '10' ELSE '63' END AS county,
               CASE WHEN p_partkey % 3 = 0 THEN '002' ELSE '000' END AS sub, lpad(CAST(1 + p_partkey % 5 AS STRING), 2, '0') AS district, CAST(1 + p_partkey % 9 AS STRING) AS number, p_name AS name, CAST(1 + p_partkey % 3 AS STRING) AS party_code,
               CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '2' ELSE '1' END AS gender, CASE WHEN p_partkey % 7 = 0 THEN '*' ELSE '' END AS elected, CASE WHEN p_partkey % 11 = 0 THEN 'Y' ELSE '' END AS vice
        FROM {part}""",
    "officials": """
        SELECT c_custkey AS n, CASE WHEN c_custkey % 3 = 0 THEN '是' ELSE '否' END AS leaveFlag, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '11' END AS term, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'Al ' || c_mktsegment ELSE ' ' END AS ename,
               CASE c_custkey % 3 WHEN 1 THEN '女' ELSE '男' END AS sex, c_mktsegment AS partyGroup, 'NATION_' || CAST(c_nationkey AS STRING) AS areaName, 'd' || CAST(c_custkey % 9 AS STRING) AS onboardDate,
               CASE WHEN c_custkey % 2 = 0 THEN 'http://p.example/' || lpad(CAST(c_custkey AS STRING), 5, '0') || '.jpg' ELSE '' END AS picUrl, CASE WHEN c_custkey % 7 = 0 THEN 'law' ELSE '' END AS degree, ' served ' AS experience
        FROM {customer}""",
    "delivered_json": """
        SELECT c_custkey AS n, c_name AS name, c_mktsegment AS label, '[{{"date":"d","list":["TPD,' || CAST(100 + c_custkey % 14 AS STRING) || ',訴,' || CAST(c_custkey % 500 AS STRING) || ',20210' || CAST(1 + c_custkey % 9 AS STRING) || '11","A,1,b,2,3"]}}]' AS changes,
               '{{"groups":[{{"name":"' || c_mktsegment || '","candidates":[{{"no":' || CAST(c_custkey AS STRING) || '}},{{"no":' || CAST(c_custkey + 1 AS STRING) || '}}]}},{{"name":"none","candidates":[]}}]}}' AS nested,
               CASE c_custkey % 9 WHEN 8 THEN '["' || c_name || '",{{"id":"' || CAST(c_custkey AS STRING) || '","name":" ' || c_name || ' "}}]'
                    ELSE 'var x = {{"' || CASE c_custkey % 9 WHEN 0 THEN 'targets' WHEN 1 THEN 'people' WHEN 2 THEN 'records' WHEN 3 THEN 'items' WHEN 4 THEN 'data' WHEN 5 THEN 'results' WHEN 6 THEN 'rows' ELSE 'other' END
                         || '":[{{"personId":"' || CAST(c_custkey AS STRING) || '","name":"' || c_name || '"}},"' || c_mktsegment || '"]}};' END AS wrapped
        FROM {customer}""",
    "shapes": """
        SELECT 'n' || CAST(n_nationkey AS STRING) AS feature, CAST(n_nationkey AS INT) AS n, CASE WHEN n_nationkey % 2 = 0 THEN
                 '{{"type":"Polygon","coordinates":[[[' || CAST(n_nationkey AS STRING) || ',0],[' || CAST(n_nationkey + 2 AS STRING) || ',1],[' || CAST(n_nationkey AS STRING) || ',3.256]]]}}'
               ELSE '{{"type":"MultiPolygon","coordinates":[[[[' || CAST(n_nationkey AS STRING) || ',5],[6,6]]],[[[-7,7],[' || CAST(n_nationkey AS STRING) || ',9.5]]]]}}' END AS geometry
        FROM {nation}""",
    "entity_targets": f"""
        SELECT {_key("p", "p_partkey")} AS target_id, {_NAME.format("p_partkey")} AS name, {_GENDER.format("p_partkey")} AS gender, {_POSITION.format("p_partkey")} AS position, CASE WHEN p_partkey % 4 = 0 THEN 'school ' || p_brand END AS education,
               CASE WHEN p_partkey % 3 = 0 THEN 'office ' || p_type END AS experience, 'NATION_' || CAST(p_size % 25 AS STRING) AS district, p_brand AS party
        FROM {{part}}""",
    "entities": f"""
        SELECT {_key("p", "p_partkey")} AS target_id, 'Q' || CAST(p_partkey AS STRING) AS qid, CASE WHEN p_partkey % 5 = 0 THEN 'nobody' ELSE p_name || ' ' || p_type END AS label, CASE p_partkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END AS gender,
               CASE p_partkey % 4 WHEN 0 THEN 'a painter' WHEN 1 THEN 'politician of ' || p_brand ELSE 'mayor of NATION_' || CAST(p_size % 25 AS STRING) END AS description, CASE WHEN p_partkey % 2 = 0 THEN 'school ' || p_brand ELSE 'other school' END AS school,
               'office ' || p_type AS post, CASE WHEN p_partkey % 6 = 0 THEN '1960-01-02' END AS birth_date, CASE WHEN p_partkey % 8 = 0 THEN 'spouse' END AS relation
        FROM {{part}}""",
    "names": "SELECT item_id AS name_id, text AS name FROM {benchmark}",
    "scraped": "SELECT page_id, url, html FROM {pages}",
    "texts": "SELECT doc_id, text FROM {documents}",
}


def _used(sql: str, known: tuple[str, ...] | dict) -> list[str]:
    return [n for n in known if re.search(rf"\{{{n}\}}", sql)]


class Adapted(dict):
    """Tables by name, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        sql = TABLES[name]
        raw = {n: self.spark.read.parquet(f"{self.sf_dir}/{n}.parquet") for n in _used(sql, RAW)}
        self[name] = self.spark.sql(sql, **raw)
        return self[name]


@lru_cache(maxsize=None)
def duck_table(name: str) -> str:
    sql = TABLES[name]
    return sql.format(**{n: n for n in _used(sql, RAW)})


def duck(sql: str, **views: str) -> str:
    """DuckDB SQL with the adapted tables (and named views over them) that it names, as common table expressions."""
    need: list[str] = []

    def visit(text: str) -> None:
        for n in [*TABLES, *views]:
            if re.search(rf"\b{n}\b", text) and n not in need:
                if n in views and text is not views[n]:
                    visit(views[n])
                need.append(n) if n not in need else None

    visit(sql)
    parts = [f"{n} AS ({views[n] if n in views else duck_table(n)})" for n in need]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
