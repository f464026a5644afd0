"""Queries of scalar rules over whole tables, and of readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemill.functions import text as T
from lakemill.sources import files

_IDENT = r"lower(regexp_replace(replace(coalesce({0}, ''), '臺', '台'), '[‧·．・･•\s\x{{00A0}}\x{{3000}}]+', '', 'g'))"
_DECODED = "replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"
_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace({_DECODED}, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p>\s*<p[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')"


def add(register) -> None:
    register("f01_f05_names", lambda t: t["people"].select("id", T.identity_text("name").alias("identity"), T.sql_name("name").alias("queue"), T.person_name("name").alias("cased"), T.list_name("name").alias("listed"), T.report_name("name").alias("reported")), rf"""
        SELECT id, {_IDENT.format("name")} AS identity, lower(regexp_replace(replace(name, '臺', '台'), '\s+', '', 'g')) AS queue, regexp_replace(replace(name, '臺', '台'), '[‧·．・･•\s]+', '', 'g') AS cased, regexp_replace(name, '\s+', '', 'g') AS listed,
               lower(regexp_replace(regexp_extract(name, '^[\x{{3400}}-\x{{9fff}}A-Za-z·．・\s]+'), '[‧·．・･•\s]+', '', 'g')) AS reported FROM people""")
    register("f07_f11_income_values", lambda t: t["income"].groupBy(T.gregorian_year("year").alias("y"), T.amount("amount").alias("a"), T.business_number("business_no").alias("b")).agg(F.count("*").alias("n")), r"""
        SELECT CAST(CASE WHEN g < 1911 THEN g + 1911 ELSE g END AS BIGINT) AS y, coalesce(TRY_CAST(regexp_extract(replace(amount, ',', ''), '^\d+') AS DOUBLE), 0) AS a, CASE WHEN length(regexp_replace(business_no, '\D', '', 'g')) = 8 THEN regexp_replace(business_no, '\D', '', 'g') END AS b, count(*) AS n
        FROM (SELECT *, CAST(regexp_extract(year, '^\d+') AS INT) AS g FROM income) x GROUP BY 1, 2, 3""")
    register("f13_hash_ids", lambda t: t["people"].select("id", T.hash_id("name", "party", "alias").alias("hash")), "SELECT id, left(sha1(name || '|' || coalesce(party, '') || '|' || coalesce(alias, '')), 12) AS hash FROM people")
    register("f17_roles", lambda t: t["people"].select("id", T.role_of("position").alias("role")), """
        SELECT id, CASE WHEN contains(p, '副總統') THEN 'vice_president' WHEN contains(p, '總統') THEN 'president' WHEN contains(p, '立法委員') OR contains(p, '立委') THEN 'legislator' WHEN contains(p, '議員') THEN 'councilor'
               WHEN contains(p, '副市長') OR contains(p, '副縣長') OR contains(p, '副縣市長') THEN 'local_deputy' WHEN contains(p, '市長') OR contains(p, '縣長') THEN 'local_chief' WHEN contains(p, '主席') OR contains(p, '秘書長') THEN 'party_officer'
               WHEN contains(p, '候選人') THEN 'candidate' ELSE 'other' END AS role FROM (SELECT id, coalesce(position, '') AS p FROM people) x""")
    register("f15_f16_sources", lambda t: t["person_claims"].select("id", T.source_type("claim_value").alias("kind"), T.source_confidence("claim_value").alias("level")), """
        SELECT id, kind, CASE WHEN kind LIKE 'official%' OR kind = 'government_open_data' THEN 'A' WHEN kind = 'wikidata' THEN 'C' ELSE 'D' END AS level FROM (SELECT id, CASE WHEN contains(claim_value, 'cec') THEN 'official_election' WHEN contains(claim_value, 'ly') THEN 'official_officeholder'
          WHEN contains(claim_value, 'cy') OR contains(claim_value, 'political-finance') THEN 'official_party_finance' WHEN contains(claim_value, 'wikidata') THEN 'wikidata' WHEN contains(claim_value, 'moi') THEN 'government_open_data' ELSE 'other' END AS kind FROM person_claims) x""")
    register("f21_f22_ids", lambda t: t["person_claims"].where(F.col("claim_value").isNotNull()).select("id", T.external_id("claim_value").alias("external_id"), T.qid_of("claim_json").alias("qid")), r"""
        SELECT id, CASE WHEN regexp_matches(trim(claim_value), '(?i)^wikidata:Q\d+$') THEN 'wikidata:' || upper(substr(trim(claim_value), 10)) ELSE lower(trim(claim_value)) END AS external_id,
               CASE WHEN regexp_matches(json_extract_string(claim_json, '$.wikidataQid'), '(?i)^Q\d+$') THEN upper(json_extract_string(claim_json, '$.wikidataQid')) END AS qid FROM person_claims WHERE claim_value IS NOT NULL""")
    register("f23_clean_html", lambda t: t["scraped"].select("page_id", F.sha1(F.regexp_replace(T.clean_html("html"), r"\s+", "")).alias("digest")), rf"SELECT page_id, sha1(regexp_replace({_CLEAN}, '[\s\x{{00A0}}\x{{3000}}]+', '', 'g')) AS digest FROM scraped")
    register("f25_f28_texts", lambda t: t["texts"].select("doc_id", T.evidence_summary("text").alias("summary"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines")), """
        SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) <= 120 THEN trim(coalesce(text, '')) ELSE left(trim(text), 120) || '...' END AS summary, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS lines FROM texts""")
    register("f29_f30_json", lambda t: t["person_claims"].select("id", F.get_json_object("claim_json", "$.identityMatch.status").alias("status"), F.greatest("review_score", F.lit(50)).alias("high"), F.nullif("confidence_level", F.lit("D")).alias("level")), """
        SELECT id, json_extract_string(claim_json, '$.identityMatch.status') AS status, CAST(greatest(review_score, 50) AS BIGINT) AS high, nullif(confidence_level, 'D') AS level FROM person_claims""")
    register("f32_surnames", lambda t: t["people"].groupBy(T.surname("name").alias("surname"), T.surname_strokes("name").alias("strokes")).agg(F.count("*").alias("n")), "SELECT left(name, 1) AS surname, CAST(2147483647 AS BIGINT) AS strokes, count(*) AS n FROM people GROUP BY 1")
    register("s16_scraped_pages", lambda t: t["scraped"].select("page_id", files.html_title().alias("title"), F.size(files.links()).alias("links")), r"""
        SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"')) AS BIGINT) AS links FROM scraped""")
