"""Queries of what pages ask for."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemill.functions import text as T
from lakemill.operators import people as P
from lakemill.operators import serving as S
from lakemill.operators import stored_reads as R
from lakemill.operators import views as V
from lakemill.plans.identity_queries import person_items
from lakemill.plans.view_queries import ALL
from lakemill.session import scratch

SEARCH = """
SELECT type_rank, type, id, title FROM (
  SELECT CAST(0 AS BIGINT) AS type_rank, 'party' AS type, party_id AS id, name AS title FROM public_parties_ WHERE contains(lower(name), '{0}') OR contains(lower(short_name), '{0}')
  UNION ALL SELECT 1, 'election', election_id, name FROM public_elections_ WHERE contains(lower(name), '{0}') OR contains(lower(election_type), '{0}') OR contains(lower(status), '{0}')
  UNION ALL SELECT 2, 'region', region_id, name FROM public_regions_ WHERE contains(lower(name), '{0}') OR contains(lower(slug), '{0}')
  UNION ALL SELECT 3, 'person', person_id, name FROM public_people_ WHERE contains(lower(name), '{0}') OR contains(lower(alias), '{0}') OR contains(lower(party), '{0}') OR contains(lower(position), '{0}') OR contains(lower(district), '{0}')
  UNION ALL SELECT 4, 'company', company_id, name FROM public_companies_ WHERE contains(lower(name), '{0}') OR contains(lower(unified_business_no), '{0}') OR contains(lower(representative_name), '{0}') OR contains(lower(address_region), '{0}')) x
ORDER BY type_rank, id LIMIT 12"""

CLOSURE = """
WITH RECURSIVE below AS (SELECT region_id, 0 AS level FROM public_regions_ WHERE region_id = 'region-r2' UNION ALL SELECT g.region_id, b.level + 1 FROM public_regions_ g JOIN below b ON g.parent_region_id = b.region_id)
SELECT region_id, CAST(level AS BIGINT) AS level FROM below"""

_CANDIDATE_ROLES = [("local_deputy", ("副市長", "副縣長", "副縣市長")), ("local_chief", ("市長", "縣長")), ("agency_head", ("局長", "處長", "主任委員")), ("party_officer", ("黨主席", "主席", "秘書長")), ("candidate", ("候選人",))]


def _like(c: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_LABEL = "CASE WHEN trim(coalesce({0}, '')) = '' THEN '未知政黨' WHEN trim({0}) = '臺灣民眾黨' THEN '台灣民眾黨' WHEN trim({0}) = '臺灣基進' THEN '台灣基進' ELSE trim({0}) END"

ITEMS = f"""
SELECT person_id, name, party, position, district, gender, education, experience, role,
       CASE WHEN (elected AND role <> 'candidate') OR (role <> 'other' AND NOT cand_text) THEN 'current' WHEN active THEN 'candidate' WHEN candidate_count > 0 THEN 'former' WHEN cand_text THEN 'candidate' ELSE 'other' END AS status,
       region_id, region_name, candidate_count, external_ids FROM (
 SELECT *, CASE WHEN {_like("pt", ("副總統",))} THEN 'vice_president' WHEN {_like("pt", ("總統",))} THEN 'president' WHEN {_like("bt", ("立法委員", "立委"))} THEN 'legislator' WHEN {_like("bt", ("議員",))} THEN 'councilor'
        {" ".join(f"WHEN {_like('bt', words)} THEN '{role}'" for role, words in _CANDIDATE_ROLES)} ELSE 'other' END AS role, contains(coalesce(position, ''), '候選人') AS cand_text
 FROM (SELECT p.person_id, p.name, p.party, p.position, p.district, CASE WHEN p.gender <> 'unknown' THEN p.gender ELSE coalesce(g.v, p.gender) END AS gender,
              CASE WHEN trim(coalesce(p.education, '')) <> '' THEN p.education ELSE ed.v END AS education, CASE WHEN trim(coalesce(p.experience, '')) <> '' THEN p.experience ELSE ex.v END AS experience,
              coalesce(k.elected, false) AS elected, coalesce(k.active, false) AS active, coalesce(k.n, 0) AS candidate_count, concat_ws(' ', p.position, k.positions) AS pt, concat_ws(' ', p.position, k.positions, coalesce(k.races, '')) AS bt,
              r.region_id, coalesce(r.name, p.district, k.first_region) AS region_name, coalesce(i.ids, '') AS external_ids
       FROM public_people_ p
       LEFT JOIN (SELECT person_id, count(*) AS n, bool_or(registration_status = 'elected') AS elected, bool_or(registration_status IN ('pending', 'registered', 'qualified')) AS active,
                         array_to_string(list_sort(list(DISTINCT person_position) FILTER (person_position IS NOT NULL)), ' ') AS positions, array_to_string(list_sort(list(DISTINCT race_title)), ' ') AS races, min(region_name) AS first_region
                  FROM public_candidates_ GROUP BY 1) k ON k.person_id = p.person_id
       LEFT JOIN (SELECT person_id, CASE WHEN v IN ('female', 'f') OR contains(v, '女') THEN 'female' WHEN v IN ('male', 'm') OR contains(v, '男') THEN 'male' WHEN v = 'unknown' THEN 'unknown' END AS v FROM (
                    SELECT DISTINCT ON (person_id) person_id, lower(trim(claim_value)) AS v FROM public_claims_ WHERE claim_type = 'gender' AND trim(coalesce(claim_value, '')) <> '' ORDER BY person_id, review_score DESC, claim_id) a) g ON g.person_id = p.person_id
       LEFT JOIN (SELECT person_id, string_agg(v, '；' ORDER BY o, c) AS v FROM (SELECT DISTINCT ON (person_id, trim(claim_value)) person_id, trim(claim_value) AS v, -review_score AS o, claim_id AS c FROM public_claims_ WHERE claim_type = 'education' AND trim(coalesce(claim_value, '')) <> '' ORDER BY person_id, trim(claim_value), review_score DESC, claim_id) a GROUP BY 1) ed ON ed.person_id = p.person_id
       LEFT JOIN (SELECT person_id, string_agg(v, '；' ORDER BY o, c) AS v FROM (SELECT DISTINCT ON (person_id, trim(claim_value)) person_id, trim(claim_value) AS v, -review_score AS o, claim_id AS c FROM public_claims_ WHERE claim_type = 'experience' AND trim(coalesce(claim_value, '')) <> '' ORDER BY person_id, trim(claim_value), review_score DESC, claim_id) a GROUP BY 1) ex ON ex.person_id = p.person_id
       LEFT JOIN (SELECT DISTINCT ON (t.person_id) t.person_id, s.region_id, s.name FROM (SELECT person_id, district AS x FROM public_people_ WHERE district IS NOT NULL UNION SELECT person_id, region_name FROM public_candidates_ WHERE region_name IS NOT NULL) t
                  JOIN (SELECT *, row_number() OVER (ORDER BY coalesce(display_order, 2147483647), region_id) AS place FROM public_regions_) s ON t.x = s.region_id OR t.x = s.slug OR contains(t.x, s.name) ORDER BY t.person_id, s.place) r ON r.person_id = p.person_id
       LEFT JOIN (SELECT person_id, array_to_string(list_sort(list(DISTINCT x)), '|') AS ids FROM (SELECT person_id, trim(claim_value) AS x FROM public_claims_ WHERE claim_type = 'external_id' AND claim_value IS NOT NULL
                    UNION SELECT person_id, 'wikidata:' || json_extract_string(claim_json, '$.wikidataQid') FROM public_claims_ WHERE claim_type = 'external_id' AND json_extract_string(claim_json, '$.wikidataQid') IS NOT NULL) a WHERE x <> '' GROUP BY 1) i ON i.person_id = p.person_id) b) c"""

ITEM_VIEWS = ALL | {"items": ITEMS}
_STATUS = "CASE status WHEN 'current' THEN 0 WHEN 'candidate' THEN 1 WHEN 'former' THEN 2 ELSE 3 END"
_ROLES = "CASE role " + " ".join(f"WHEN '{r}' THEN {n}" for r, n in T.ROLE_RANK.items()) + " END"
_STROKES = "CASE " + " ".join(f"WHEN left(name, 1) IN ({', '.join(repr(c) for c in chars)}) THEN {n}" for n, chars in T.SURNAME_STROKES.items()) + " ELSE 2147483647 END"

_FIRST = "(x.status_rank, x.role_rank, -(x.told + x.n)) < (old.status_rank, old.role_rank, -(old.told + old.n))"
_EITHER = ", ".join(f"{c} := CASE WHEN {_FIRST} THEN x.{c} ELSE old.{c} END" for c in ("person_id", "name_key"))
_RANKS = ", ".join(f"{c} := CASE WHEN {_FIRST} THEN x.{c} ELSE old.{c} END" for c in ("status_rank", "role_rank", "told"))
#: The fold as a recursion over the list: kept holds what the items before have come to.
FOLDED = rf"""
SELECT k.person_id, array_to_string(k.merged, '|') AS merged_person_ids, k.n AS merged_candidate_count FROM (SELECT unnest(kept) AS k FROM (
  WITH RECURSIVE rows_ AS (
    SELECT row_number() OVER (ORDER BY person_id) AS place, struct_pack(person_id := person_id, name_key := 'name-party|' || regexp_replace(name, '\s+', '', 'g') || '|' || {_LABEL.format("party")},
           ids := CASE WHEN external_ids = '' THEN CAST([] AS VARCHAR[]) ELSE list_transform(string_split(external_ids, '|'), lambda e: CASE WHEN regexp_matches(e, '(?i)^wikidata:Q\d+$') THEN 'external:wikidata:' || upper(substr(e, 10)) ELSE 'external:' || lower(e) END) END,
           merged := [person_id], n := CAST(candidate_count AS BIGINT), status_rank := {_STATUS}, role_rank := {_ROLES},
           told := CAST(coalesce(position <> '', false) AS INT) + CAST(coalesce(district <> '', false) AS INT) + CAST(coalesce(education <> '', false) AS INT) + CAST(coalesce(experience <> '', false) AS INT) + CAST(coalesce(gender <> 'unknown', false) AS INT)) AS item
    FROM items),
  folds (one, place, kept) USING KEY (one) AS (
    SELECT 1, CAST(0 AS BIGINT), list_filter([item], lambda x: false) FROM rows_ WHERE place = 1
    UNION
    SELECT 1, rows_.place, list_append(list_filter(kept, lambda o: NOT list_has_any(list_append(o.ids, o.name_key), list_append(item.ids, item.name_key))),
      list_reduce(list_sort(list_transform(list_filter(kept, lambda o: list_has_any(list_append(o.ids, o.name_key), list_append(item.ids, item.name_key))),
                                           lambda o: struct_pack(turn := list_min(list_transform(list_append(o.ids, o.name_key), lambda y: coalesce(list_position(list_prepend(item.name_key, item.ids), y), 2147483647))), o := o))
                  , 'ASC').list_transform(lambda z: z.o), lambda x, old: struct_pack({_EITHER}, ids := list_sort(list_distinct(list_concat(x.ids, old.ids))),
                  merged := CASE WHEN {_FIRST} THEN list_concat(x.merged, old.merged) ELSE list_concat(old.merged, x.merged) END, n := x.n + old.n, {_RANKS}), item))
    FROM folds JOIN rows_ ON rows_.place = folds.place + 1)
  SELECT kept FROM folds) y) z"""

INCOME = r"""
SELECT p.external_id AS party_id, company_no, CAST(y AS BIGINT) AS report_year, round(sum(a), 2) AS amount_total, count(*) AS donation_count
FROM (SELECT account, CASE WHEN length(regexp_replace(business_no, '\D', '', 'g')) = 8 THEN regexp_replace(business_no, '\D', '', 'g') END AS company_no, party, donor,
             CASE WHEN CAST(regexp_extract(year, '^\d+') AS INT) < 1911 THEN CAST(regexp_extract(year, '^\d+') AS INT) + 1911 ELSE CAST(regexp_extract(year, '^\d+') AS INT) END AS y,
             coalesce(TRY_CAST(regexp_extract(replace(amount, ',', ''), '^\d+') AS DOUBLE), 0) AS a FROM income) x JOIN parties p ON p.name = x.party
WHERE account = '營利事業捐贈收入' AND company_no IS NOT NULL AND trim(donor) <> '' AND a > 0 GROUP BY 1, 2, 3"""


def items(t):
    return person_items(t)


def searched(t, query: str = "brand#12"):
    return S.search(query, V.public_parties(t), V.public_elections(t), V.public_regions(t), V.public_people(t), V.public_companies(t))


def stored_page(t):
    """The seventh page of a stored list."""
    folder = scratch(t.spark)
    R.write_pages(items(t).select("person_id", "name", "role", "status"), folder, block=100)
    return R.read_page(t.spark, folder, 7, "person_id string, name string, role string, status string", block=100).select("person_id", "place")


def indexed_names(t):
    """People whose name without spaces contains a query, from postings of names."""
    folder = scratch(t.spark)
    R.write_index(items(t).select("person_id", "name"), folder, [F.lower(F.regexp_replace("name", f"[{T.SPACES}]+", ""))])
    return R.find(t.spark, folder, "redw", "person_id string, name string").select("person_id")


#: Of each kind what is searched.
_KINDS = {
    "party": ("public_parties", "party_id", ("name", "short_name")), "region": ("public_regions", "region_id", ("name", "slug")),
    "person": ("public_people", "person_id", ("name", "alias", "party", "position", "district")), "company": ("public_companies", "company_id", ("name", "unified_business_no", "representative_name", "address_region")),
}
ANY_FIELD = " UNION ALL ".join(f"SELECT '{kind}' AS type, {key} AS id, concat_ws(chr(10), {', '.join(fields)}) AS told FROM {view}_" for kind, (view, key, fields) in _KINDS.items())


def indexed_search(t):
    """Parties, regions, people and companies with a query in any of their fields, from postings of all of them."""
    folder, rows = scratch(t.spark), None
    for kind, (view, key, fields) in _KINDS.items():
        own = getattr(V, view)(t).select(F.lit(kind).alias("type"), F.col(key).alias("id"), F.array(*(F.lower(c) for c in fields)).alias("told"))
        rows = own if rows is None else rows.unionByName(own)
    R.write_index(rows.select("type", "id", "told"), folder, [F.get("told", i) for i in range(5)])
    return R.find(t.spark, folder, "brand#1", "type string, id string, told array<string>").select("type", "id")


def add(register) -> None:
    register("u02_search", searched, SEARCH.format("brand#12"), **ALL)
    register("u07_search_groups", lambda t: S.search_groups(searched(t, "nation_1")), "SELECT type_rank, type, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM found GROUP BY 1, 2", **(ALL | {"found": SEARCH.format("nation_1")}))
    register("j16_region_closure", lambda t: S.region_closure(V.public_regions(t), "region-r2"), CLOSURE.replace("WITH RECURSIVE below AS (", "SELECT region_id, CAST(level AS BIGINT) AS level FROM (WITH RECURSIVE below AS (").replace("SELECT region_id, CAST(level AS BIGINT) AS level FROM below", "SELECT * FROM below) z"), **ALL)
    register("j22_region_aliases", lambda t: S.region_aliases(V.public_regions(t)), """
        SELECT DISTINCT alias, region_id FROM (SELECT region_id AS alias, region_id FROM public_regions_ UNION SELECT regexp_replace(region_id, '^region-', ''), region_id FROM public_regions_ UNION SELECT slug, region_id FROM public_regions_ WHERE slug IS NOT NULL) x""", **ALL)
    register("j21_stage_regions", lambda t: P.stage_regions(V.public_regions(t)).select("region_id", "parent_slug", "place"), """
        SELECT a.region_id, b.slug AS parent_slug, row_number() OVER (ORDER BY coalesce(a.display_order, 2147483647), a.region_id) AS place FROM public_regions_ a LEFT JOIN public_regions_ b ON b.region_id = a.parent_region_id""", **ALL)
    register("r35_p09_related_races", lambda t: S.related_races(V.public_races(t), V.public_regions(t), "region-r2").select("race_id"), """
        SELECT race_id FROM public_races_ WHERE race_type IN ('president', 'vice_president', 'party_list_legislator', 'referendum') OR region_name IN ('全國', '臺灣', '台灣')
          OR region_id IN (SELECT region_id FROM public_regions_ WHERE parent_region_id = 'region-r2' OR region_id = 'region-r2')""", **ALL)
    register("p08_o06_race_order", lambda t: S.race_order(V.public_races(t)).select("race_id", "open", "district_no"), r"""
        SELECT race_id, CAST(CASE WHEN status IN ('completed', 'cancelled') THEN 0 ELSE 1 END AS BIGINT) AS open, CAST(coalesce(TRY_CAST(regexp_extract(title, '第\s*(\d+)\s*選舉區', 1) AS BIGINT), 2147483647) AS BIGINT) AS district_no FROM public_races_""", **ALL)
    register("o08_race_groups", lambda t: S.race_groups(V.public_races(t)), """
        SELECT kind, election_name, voting_date, count(*) AS n, string_agg(race_id, ',' ORDER BY race_id) AS races, count(*) FILTER (status NOT IN ('completed', 'cancelled')) AS n_open
        FROM (SELECT *, CASE WHEN race_type = 'village_chief' OR contains(title, '里長') OR contains(title, '村長') THEN 'village' WHEN race_type IN ('city_councilor', 'county_councilor') OR contains(title, '議員') THEN 'councilor'
                             WHEN race_type = 'legislator' AND (contains(title, '第') OR contains(title, '選舉區')) THEN 'legislator' END AS kind FROM public_races_) x WHERE kind IS NOT NULL GROUP BY 1, 2, 3""", **ALL)
    register("f35_race_categories", lambda t: V.public_races(t).groupBy(T.race_category("race_type").alias("category")).agg(F.count("*").alias("n")), """
        SELECT CASE WHEN race_type IN ('president', 'vice_president') THEN 'presidential' WHEN race_type IN ('municipality_mayor', 'county_mayor', 'township_mayor') THEN 'chief'
                    WHEN race_type IN ('legislator', 'party_list_legislator', 'city_councilor', 'county_councilor', 'township_representative') THEN 'representative' ELSE 'basic' END AS category, count(*) AS n FROM public_races_ GROUP BY 1""", **ALL)
    register("a14_p10_race_candidates", lambda t: S.race_candidate_counts(V.public_races(t), V.public_candidates(t)), """
        SELECT r.race_id, count(c.candidate_id) AS n FROM public_races_ r LEFT JOIN public_candidates_ c ON c.race_id = r.race_id AND c.registration_status NOT IN ('disqualified', 'withdrawn', 'unknown') GROUP BY 1""", **ALL)
    register("a01_contributions", lambda t: S.contributions(t["income"], t["parties"], "營利事業捐贈收入"), INCOME)
    register("w05_latest_finance", lambda t: S.latest_finance(V.public_party_finance_summaries(t)).select("party_id", "report_year", "income_total"), "SELECT DISTINCT ON (party_id) party_id, report_year, income_total FROM public_finance_ ORDER BY party_id, report_year DESC", **ALL)
    register("a13_party_figures", lambda t: S.party_figures(V.public_party_finance_summaries(t), V.public_party_company_contribution_summaries(t), V.public_parties(t)), """
        SELECT round(sum(income_total), 2) AS income, round(sum(business_donation_total), 2) AS donations, (SELECT count(*) FROM public_contributions_) AS contributions FROM (SELECT DISTINCT ON (party_id) * FROM public_finance_ ORDER BY party_id, report_year DESC) x""", **ALL)
    register("p11_party_people", lambda t: S.party_people(V.public_people(t), V.public_parties(t)), """
        SELECT q.party_id, count(*) AS n FROM public_people_ p JOIN public_parties_ q ON p.party <> '' AND (contains(p.party, q.name) OR contains(q.name, p.party) OR contains(p.party, q.short_name) OR contains(q.short_name, p.party))
        WHERE trim(coalesce(p.position, '')) <> '' AND NOT contains(p.position, '候選人') GROUP BY 1""", **ALL)
    register("j14_text_mentions", lambda t: S.mentions(t["texts"], t["names"]), "SELECT d.doc_id, n.name_id FROM texts d JOIN names n ON contains(d.text, n.name)")
    register("u03_merged_by_key", lambda t: S.merged_by_key([t["parties"].select("id", "name"), t["parties"].where(F.col("is_public")).select("id", F.upper("name").alias("name"))], "id"), "SELECT id, CASE WHEN is_public THEN upper(name) ELSE name END AS name FROM parties")
    register("o11_default_region", lambda t: S.default_region(V.public_regions(t)).select("region_id"), "SELECT region_id FROM public_regions_ ORDER BY CASE WHEN slug = '63000' OR name = '臺北市' THEN 0 WHEN region_type = 'county_city' THEN 1 ELSE 2 END, display_order ASC NULLS LAST, region_id LIMIT 1", **ALL)
    register("r31_j13_person_list", items, ITEMS, **ALL)
    register("r29_fold_duplicates", lambda t: P.fold_duplicates(person_items(t)), FOLDED, **ITEM_VIEWS)
    register("r30_backfilled_people", lambda t: P.backfilled(V.public_people(t), V.public_person_claims(t)).select("person_id", "gender", "education", "experience"), "SELECT person_id, gender, education, experience FROM items", **ITEM_VIEWS)
    register("o04_person_order", lambda t: P.numbered(items(t)).select("person_id", "place"), f"SELECT person_id, row_number() OVER (ORDER BY {_STATUS}, {_ROLES}, {_STROKES}, name, person_id) AS place FROM items", **ITEM_VIEWS)
    register("o03_stored_page", stored_page, f"SELECT person_id, place FROM (SELECT person_id, row_number() OVER (ORDER BY {_STATUS}, {_ROLES}, {_STROKES}, name, person_id) AS place FROM items) x WHERE place BETWEEN 121 AND 140", **ITEM_VIEWS)
    register("p07_indexed_names", indexed_names, "SELECT person_id FROM items WHERE contains(lower(regexp_replace(name, '\\s+', '', 'g')), 'redw')", **ITEM_VIEWS)
    register("u02_indexed_search", indexed_search, f"SELECT type, id FROM ({ANY_FIELD}) x WHERE contains(lower(told), 'brand#1')", **ALL)
    register("o03_person_page", lambda t: P.page(items(t), 3).select("person_id", "place"), f"SELECT person_id, place FROM (SELECT person_id, row_number() OVER (ORDER BY {_STATUS}, {_ROLES}, {_STROKES}, name, person_id) AS place FROM items) x WHERE place BETWEEN 41 AND 60", **ITEM_VIEWS)
    register("p06_p07_people_filter", lambda t: P.filtered(items(t), query="Red W", status="current").select("person_id"), f"""
        SELECT person_id FROM items WHERE contains(lower(regexp_replace(name, '\\s+', '', 'g')), 'redw') AND status = 'current'""", **ITEM_VIEWS)
    register("o05_party_options", lambda t: P.party_options(V.public_people(t)), f"SELECT DISTINCT {_LABEL.format('party')} AS party, CAST(CASE {_LABEL.format('party')} WHEN '無黨籍' THEN 100 WHEN '未知政黨' THEN 99 ELSE 50 END AS BIGINT) AS rank FROM public_people_", **ALL)
    register("r32_local_offices", lambda t: P.local_offices(items(t)), f"""
        SELECT region_id, (arg_min(person_id, lpad(CAST({_STROKES} AS VARCHAR), 12, '0') || name || person_id) FILTER (role = 'local_chief')) AS chief_id, count(*) FILTER (role = 'local_deputy') AS deputies, count(*) FILTER (role = 'agency_head') AS agency_heads,
               count(*) FILTER (role = 'councilor') AS councilors, concat_ws(',', CASE WHEN count(*) FILTER (role = 'local_chief') = 0 THEN 'chief' END, CASE WHEN count(*) FILTER (role = 'local_deputy') = 0 THEN 'deputies' END,
               CASE WHEN count(*) FILTER (role = 'agency_head') = 0 THEN 'agency_heads' END, CASE WHEN count(*) FILTER (role = 'councilor') = 0 THEN 'councilors' END) AS todo
        FROM items WHERE status = 'current' AND region_id IS NOT NULL GROUP BY 1""", **ITEM_VIEWS)
    register("a12_councilor_parties", lambda t: P.councilor_parties(items(t)), f"SELECT region_id, {_LABEL.format('party')} AS party, count(*) AS n FROM items WHERE status = 'current' AND role = 'councilor' AND region_id IS NOT NULL GROUP BY 1, 2", **ITEM_VIEWS)
    register("r33_profiles", lambda t: P.profiles(items(t), V.public_person_claims(t)), """
        SELECT person_id, CASE WHEN trim(coalesce(experience, '')) <> '' THEN 'available' ELSE 'todo' END AS experience_status, CASE WHEN EXISTS (SELECT 1 FROM public_claims_ c WHERE c.person_id = i.person_id AND claim_type = 'finance_summary') THEN 'summary_only' ELSE 'todo' END AS contribution_status,
               CASE WHEN EXISTS (SELECT 1 FROM public_claims_ c WHERE c.person_id = i.person_id AND claim_type = 'platform') THEN 'available' ELSE 'todo' END AS platform_status, CASE WHEN EXISTS (SELECT 1 FROM public_claims_ c WHERE c.person_id = i.person_id AND claim_type = 'legal_case') THEN 'review_required' ELSE 'todo' END AS legal_record_status,
               CASE WHEN EXISTS (SELECT 1 FROM public_claims_ c WHERE c.person_id = i.person_id AND claim_type = 'family_relation') THEN 'review_required' ELSE 'todo' END AS family_relation_status FROM items i""", **ITEM_VIEWS)
