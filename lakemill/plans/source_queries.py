"""Queries of readers, registries, entity matches, jobs and parsers.

Where an operator reads files, the query makes them first from the adapted
tables: as files in the shared folder, or as (path, content) rows, which is what
Spark's reader of binary files gives.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.functions import text as T
from lakemill.operators import enrichment as E
from lakemill.operators import jobs, store
from lakemill.operators import serving as S
from lakemill.operators import views as V
from lakemill.plans.view_queries import ALL
from lakemill.session import scratch
from lakemill.sources import files, registries
from lakemill.sources.snapshots import Store

#: Rows of an archive that a query makes.
ARCHIVE_ROWS = 5000
#: The party file of the archives that a query makes.
PARTY_FILE = "'1,臺灣民眾黨\n'2,x\n"


def delimited(t) -> DataFrame:
    """People as a file with semicolons, quotes and blanks, read again."""
    path = scratch(t.spark)
    rows = t["people"].select("id", F.concat(F.lit('"'), "name", F.lit('" ; ')).alias("name"), F.concat(F.lit("  "), "district").alias("district"), "party")
    rows.write.option("header", "true").option("sep", ";").option("quote", '"').option("escape", '"').csv(path)
    return files.read_delimited(t.spark, path)


#: Lines of a file that a query makes.
FILE_LINES = 2000


def big5_lines(t) -> DataFrame:
    """Positions in Big5 files and districts in UTF-8 ones, some thousand lines each, decoded line by line."""
    def encoded(parts):
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "content": [x.encode("big5" if p.startswith("positions") else "utf-8") for p, x in zip(part["path"], part["text"], strict=True)]})

    def dealt(column: str, name: str) -> DataFrame:
        lines = t["people"].where(F.col(column).isNotNull()).select("id", F.col(column).alias("line"))
        shards = F.lit(max(1, lines.count() // FILE_LINES))
        return lines.select(F.concat(F.lit(f"{name}-"), F.pmod(F.xxhash64("id"), shards).cast("string")).alias("path"), "line")

    files_ = dealt("position", "positions").unionByName(dealt("district", "districts"))
    written = files_.groupBy("path").agg(F.array_join(F.collect_list("line"), "\n").alias("text")).mapInPandas(encoded, "path string, content binary")
    lines = files.decoded_texts(written).select(F.substring_index("path", "-", 1).alias("path"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("path", "line").agg(F.count("*").alias("n"))


def archives(t) -> DataFrame:
    """(path, content): election archives, each with a candidate and a party file."""
    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            folder = rows["folder"].iloc[0]
            lines = ["'" + ",'".join([r.county, r.sub, r.district, "", "", r.number, r.name, r.party_code, r.gender, "", "", "", "", "", r.elected, r.vice]) for r in rows.itertuples(index=False)]
            z.writestr(f"{folder}elcand.csv", "\n".join(lines))
            z.writestr(f"{folder}elpaty.csv", PARTY_FILE)
            z.writestr("readme.txt", "none")
        return pd.DataFrame({"path": [f"{folder}{rows['bucket'].iloc[0]}.zip"], "content": [out.getvalue()]})

    cells = t["archive_cells"]
    buckets = max(1, cells.count() // ARCHIVE_ROWS)
    return cells.withColumn("bucket", F.pmod(F.xxhash64("n"), F.lit(buckets))).groupBy("folder", "bucket").applyInPandas(packed, "path string, content binary")


_HISTORIC = """
SELECT 'cec-historical:' || left(sha1(folder || 'elcand.csv|' || number || '|' || name || '|' || county || '|' || sub || '|' || district || '|' || vice), 12) AS source_person_key, name AS raw_name,
       CASE gender WHEN '1' THEN 'male' WHEN '2' THEN 'female' ELSE 'unknown' END AS gender, CASE party_code WHEN '1' THEN '台灣民眾黨' WHEN '2' THEN 'x' ELSE '' END AS party, position,
       CASE WHEN contains(position, '副總統') THEN 'vice_president' WHEN contains(position, '總統') THEN 'president' WHEN contains(position, '立法委員') THEN 'legislator' WHEN contains(position, '議員') THEN 'councilor' WHEN contains(position, '候選人') THEN 'candidate' ELSE 'other' END AS role,
       CASE k WHEN 0 THEN '全國' WHEN 1 THEN place || '第' || CAST(CAST(district AS INT) AS VARCHAR) || '選舉區' WHEN 2 THEN place ELSE place || '第' || CAST(CAST(district AS INT) AS VARCHAR) || '選舉區議員' END AS district, CAST(left(folder, 4) AS BIGINT) AS election_year,
       CASE k WHEN 0 THEN 'president' WHEN 1 THEN 'legislator-district' WHEN 2 THEN 'local-mayor' ELSE 'local-councilor-regional' END AS kind, elected = '*' AS elected, 'A' AS confidence_suggestion
FROM (SELECT *, CASE k WHEN 2 THEN place || '首長' || CASE WHEN elected = '*' THEN '' ELSE '候選人' END WHEN 3 THEN place || '議員' || CASE WHEN elected = '*' THEN '' ELSE '候選人' END
                       ELSE left(folder, 4) || '年' || CASE WHEN k = 1 THEN '立法委員' WHEN vice = 'Y' THEN '副總統' ELSE '總統' END || CASE WHEN elected = '*' THEN '當選人' ELSE '候選人' END END AS position
      FROM (SELECT *, n % 4 AS k, CASE county WHEN '10' THEN '宜蘭縣' ELSE '臺北市' END AS place FROM archive_cells) a) b"""


def entity_rows(t) -> DataFrame:
    e = t["entities"]
    return e.select(
        "target_id", "qid", F.array("label").alias("names"), "gender", "birth_date", "description", F.array("school").alias("education"), F.array("post", "post").alias("positions"), F.array(F.lit("clerk")).alias("occupations"),
        F.when(F.col("relation").isNotNull(), F.array(F.struct("relation", F.col("label").alias("label")))).otherwise(F.array().cast("array<struct<relation:string,label:string>>")).alias("relatives"),
    )


_NAME_KEY = r"regexp_replace(replace({0}, '臺', '台'), '[‧·．・･•\s]+', '', 'g')"
_HINT = r"len(list_filter(list_distinct(regexp_split_to_array(lower({0}), '[\s,;；、，。・()（）/|]+')), lambda x: length(x) >= 2 AND contains(lower({1}), x))) > 0"
_MATCHES = rf"""
WITH both_ AS (SELECT t.*, e.qid, e.label, e.gender AS e_gender, e.description, e.school, e.post FROM entity_targets t JOIN entities e USING (target_id)),
told AS (SELECT *, {_NAME_KEY.format("label")} = {_NAME_KEY.format("name")} AS named, coalesce(gender, 'unknown') NOT IN ('unknown') AND gender = e_gender AS alike, regexp_matches(description, '(?i)politician|mayor') AS office,
                CASE WHEN {_HINT.format("coalesce(position, '')", "description || ' ' || post || ' ' || post || ' clerk ' || school")} THEN 10 ELSE 0 END + CASE WHEN {_HINT.format("coalesce(education, '')", "school")} THEN 10 ELSE 0 END
                + CASE WHEN {_HINT.format("coalesce(experience, '')", "post || ' ' || post || ' clerk'")} THEN 10 ELSE 0 END + CASE WHEN {_HINT.format("district || ' ' || party", "description")} THEN 5 ELSE 0 END AS more FROM both_)
SELECT target_id, qid, named AND alike AND office AND more > 0 AS matched, CAST(CASE WHEN NOT named THEN 0 WHEN NOT (alike AND office) THEN CASE WHEN alike THEN 75 ELSE 50 END ELSE least(100, 75 + more) END AS BIGINT) AS score FROM told"""

_MADE = """
SELECT target_id, qid, 'external_id' AS claim_type, 'wikidata:' || qid AS claim_value FROM entities UNION ALL SELECT target_id, qid, 'gender', gender FROM entities WHERE gender <> 'unknown'
UNION ALL SELECT target_id, qid, 'birth_date', birth_date FROM entities WHERE birth_date IS NOT NULL UNION ALL SELECT target_id, qid, 'education', school FROM entities
UNION ALL SELECT target_id, qid, 'experience', post || '；clerk' FROM entities UNION ALL SELECT target_id, qid, 'family_relation', relation || '：' || label FROM entities WHERE relation IS NOT NULL"""


def snapshot(t) -> DataFrame:
    """Elections and regions written twice, the second time with new names and rows; what the tables then hold, and the log of the second run."""
    folder = scratch(t.spark)
    elections, regions = t["elections"], t["regions"]
    jobs.write_snapshot(t.spark, folder, {"regions": regions.where("parent_region_id IS NULL"), "elections": elections.where("year % 2 = 0")}, "first")
    log = jobs.write_snapshot(t.spark, folder, {"elections": elections.withColumn("name", F.concat("name", F.lit(" new"))), "regions": regions}, "second")
    kept = Store(t.spark, folder)
    held = kept.read("elections").select(F.lit("elections").alias("table"), "id", "name").unionByName(kept.read("regions").select(F.lit("regions").alias("table"), "id", "name"))
    return held.join(log.select("table", "rows"), "table")


def report(t) -> DataFrame:
    """Claims by type and state as sorted lines of JSON, read again."""
    path = scratch(t.spark)
    jobs.write_report(t["person_claims"].groupBy("claim_type", "review_status").count(), path, "claim_type", "review_status")
    return t.spark.read.schema("claim_type string, review_status string, count long").json(path)


def batch(t) -> DataFrame:
    """Two stages in order: open claims of level A are approved, then approved legal cases are archived."""
    def approve(tables):
        open_ = F.col("review_status").isin(*V.REVIEWABLE) & (F.col("confidence_level") == "A")
        return {"person_claims": store.patched(tables["person_claims"], open_, review_status="verified")}

    def archive(tables):
        return {"person_claims": store.patched(tables["person_claims"], (F.col("claim_type") == "legal_case") & (F.col("review_status") == "verified"), review_status="archived", is_public=False)}

    return jobs.run_batch({"person_claims": t["person_claims"]}, [("approve", approve), ("archive", archive)])["person_claims"].select("id", "review_status", "is_public")


def optional_json(t) -> DataFrame:
    """People from a folder of JSON documents, some thousand people each, that is there, and from one that isn't."""
    path, schema = scratch(t.spark), "id string, name string"
    shards = F.lit(max(1, t["people"].count() // FILE_LINES))
    documents = t["people"].groupBy(F.pmod(F.xxhash64("id"), shards).alias("shard")).agg(F.to_json(F.collect_list(F.struct("id", "name"))).alias("value"))
    documents.repartition("shard").write.partitionBy("shard").text(path)
    return files.read_json_or(t.spark, path, schema).select("id", "name").unionByName(files.read_json_or(t.spark, f"{path}-none", schema))


def allowed(t) -> DataFrame:
    """Views by name: how many rows a reader gets; a name that isn't a public view raises and gives none."""
    out = None
    for name in ("public_regions", "public_elections", "person_claim_review_queue", "people"):
        try:
            rows = V.public_view(name, t).agg(F.count("*").alias("n"))
        except KeyError:
            rows = t["regions"].agg(F.lit(-1).cast("long").alias("n"))
        rows = rows.select(F.lit(name).alias("view"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def shown_pages(t) -> DataFrame:
    """Page numbers beside every page of every region's candidates, ten to a page."""
    lists = t["candidates"].groupBy("race_id").agg(F.ceil(F.count("*") / 10).cast("long").alias("pages"))
    each = lists.select("race_id", "pages", F.explode(F.sequence(F.lit(1), "pages")).alias("shown_at"))
    return each.select("race_id", "shown_at", F.explode(S.page_window(F.col("pages"), F.col("shown_at"), 3)).alias("page"))


def number() -> Column:
    """The number in a person's id."""
    return F.substring("id", 2, 8).cast("int")


def add(register) -> None:
    register("s01_s02_delimited", delimited, """SELECT id, '"' || name || '" ;' AS name, district, party FROM people""")
    register("s03_big5_texts", big5_lines, "SELECT 'positions' AS path, position AS line, count(*) AS n FROM people WHERE position IS NOT NULL GROUP BY ALL UNION ALL SELECT 'districts', district, count(*) FROM people WHERE district IS NOT NULL GROUP BY ALL")
    register("s04_archive_rows", lambda t: files.named_cells(files.zipped_rows(archives(t)), ["county", "sub", "district"]).groupBy("entry", "county", "sub").agg(F.count("district").alias("n")).where("entry LIKE '%elcand.csv'"), """
        SELECT folder || 'elcand.csv' AS entry, '''' || county AS county, '''' || sub AS sub, count(*) AS n FROM archive_cells GROUP BY ALL""")
    register("s10_s11_f19_historic_candidates", lambda t: registries.historic_candidates(files.zipped_rows(archives(t))), _HISTORIC)
    register("f20_cell_texts", lambda t: t["archive_cells"].select("n", T.strip_apostrophes(F.concat(F.lit("''"), "county", F.lit("'"), "sub")).alias("cell")), "SELECT n, county || '''' || sub AS cell FROM archive_cells")
    register("s05_picked_fields", lambda t: t["people"].select("id", T.pick("alias", "party", "name").alias("picked")), "SELECT id, CASE WHEN trim(coalesce(alias, '')) <> '' THEN trim(alias) WHEN trim(coalesce(party, '')) <> '' THEN trim(party) ELSE trim(name) END AS picked FROM people")
    register("s06_embedded_json", lambda t: t["delivered_json"].select("n", files.json_inside("wrapped").alias("inside")), """
        SELECT n, CASE WHEN n % 9 = 8 THEN substr(wrapped, instr(wrapped, '{'), length(wrapped) - instr(wrapped, '{')) ELSE substr(wrapped, 9, length(wrapped) - 9) END AS inside FROM delivered_json""")
    register("s07_seed_rows", lambda t: t["delivered_json"].select("n", F.sha2("nested", 256).alias("digest"), F.from_json("nested", "groups array<struct<name: string, candidates: array<struct<no: long>>>>").alias("seed")).select("n", "digest", F.inline("seed.groups")).select("n", "digest", "name", F.size("candidates").alias("many")), """
        SELECT n, sha256(nested) AS digest, label AS name, CAST(2 AS BIGINT) AS many FROM delivered_json UNION ALL SELECT n, sha256(nested), 'none', 0 FROM delivered_json""")
    register("s08_optional_json", optional_json, "SELECT id, name FROM people")
    register("s09_whole_scan", lambda t: t["person_claims"].groupBy("claim_type").agg(F.count("*").alias("n"), F.max("updated_at").alias("last")), "SELECT claim_type, count(*) AS n, max(updated_at) AS last FROM person_claims GROUP BY claim_type")
    register("s12_party_registry", lambda t: registries.party_registry(t["people"].select(F.substring("id", 2, 8).cast("long").alias("line"), F.col("party").alias("政黨名稱"), F.col("name").alias("chair")), ["Brand#11", "Brand#32", "Brand#55", "none"]).select("name_", "line", "chair", "external_id", "status"), """
        SELECT party AS name_, CAST(substr(id, 2) AS BIGINT) AS line, name AS chair, 'moi-party-' || left(sha1(party), 12) AS external_id, 'active' AS status FROM people
        WHERE id IN (SELECT min(id) FROM people WHERE party IN ('Brand#11', 'Brand#32', 'Brand#55') GROUP BY party)""")
    register("s13_f31_officeholders", lambda t: registries.officeholders(t["officials"]), """
        SELECT 'ly-legislator-11-' || CASE WHEN picUrl <> '' THEN lpad(CAST(n AS VARCHAR), 5, '0') ELSE left(sha1(name || '|' || partyGroup || '|' || areaName || '|' || onboardDate), 12) END AS external_id, name, nullif(trim(ename), '') AS alias,
               CASE sex WHEN '女' THEN 'female' ELSE 'male' END AS gender, partyGroup AS party, '第11屆立法委員' AS position, areaName AS district, nullif(degree, '') AS education, 'served' AS experience
        FROM officials WHERE leaveFlag = '否'""")
    register("s15_nested_candidates", lambda t: files.nested_candidates(t["delivered_json"].select(F.col("nested").alias("text")), "groups array<struct<name: string, candidates: array<struct<no: long>>>>"), """
        SELECT label AS group_name, CAST(n AS BIGINT) AS no FROM delivered_json UNION ALL SELECT label, CAST(n + 1 AS BIGINT) FROM delivered_json""")
    register("s19_f27_changed_documents", lambda t: registries.changed_documents(t["delivered_json"].select(F.col("changes").alias("text"))), """
        SELECT jid, split_part(jid, ',', 1) AS court, split_part(jid, ',', 2) AS year, split_part(jid, ',', 3) AS code, split_part(jid, ',', 4) AS number, split_part(jid, ',', 5) AS date
        FROM (SELECT DISTINCT 'TPD,' || CAST(100 + n % 14 AS VARCHAR) || ',訴,' || CAST(n % 500 AS VARCHAR) || ',20210' || CAST(1 + n % 9 AS VARCHAR) || '11' AS jid FROM delivered_json UNION SELECT 'A,1,b,2,3' FROM delivered_json) x""")
    register("s22_target_lists", lambda t: files.targets(t["delivered_json"].select(F.when(F.col("n") % 9 == 8, F.col("wrapped")).otherwise(files.json_inside("wrapped")).alias("text"))), """
        SELECT DISTINCT CASE WHEN p = 0 THEN CAST(n AS VARCHAR) END AS person_id, CASE WHEN p = 0 OR n % 9 = 8 THEN name ELSE label END AS name FROM delivered_json, (SELECT unnest([0, 1]) AS p) two WHERE n % 9 <> 7""")
    register("s21_a20_map_bounds", lambda t: files.bounds(files.rings(t["shapes"])), """
        SELECT feature, CAST(CASE WHEN n % 2 = 0 THEN n ELSE -7 END AS DOUBLE) AS min_x, CAST(CASE WHEN n % 2 = 0 THEN n + 2 ELSE greatest(6, n) END AS DOUBLE) AS max_x, CAST(CASE WHEN n % 2 = 0 THEN 0 ELSE 5 END AS DOUBLE) AS min_y,
               CAST(CASE WHEN n % 2 = 0 THEN 3.256 ELSE 9.5 END AS DOUBLE) AS max_y FROM shapes""")
    register("f33_map_paths", lambda t: files.svg_path(files.rings(t["shapes"])), """
        SELECT feature, CASE WHEN n % 2 = 0 THEN 'M' || n || '.0 0.0 L' || (n + 2) || '.0 1.0 L' || n || '.0 3.26 Z' ELSE 'M' || n || '.0 5.0 L6.0 6.0 Z M-7.0 7.0 L' || n || '.0 9.5 Z' END AS path FROM shapes""")
    register("k08_snapshot", snapshot, """
        SELECT 'elections' AS "table", id, name || ' new' AS name, (SELECT count(*) FROM elections) AS "rows" FROM elections UNION ALL SELECT 'regions', id, name, (SELECT count(*) FROM regions) FROM regions""")
    register("k12_json_report", report, "SELECT claim_type, review_status, count(*) AS count FROM person_claims GROUP BY ALL")
    register("k14_batch", batch, """
        SELECT id, CASE WHEN a = 'verified' AND claim_type = 'legal_case' THEN 'archived' ELSE a END AS review_status, CASE WHEN a = 'verified' AND claim_type = 'legal_case' THEN false ELSE is_public END AS is_public
        FROM (SELECT *, CASE WHEN confidence_level = 'A' AND review_status IN ('pending', 'needs_more_evidence') THEN 'verified' ELSE review_status END AS a FROM person_claims) x""")
    register("p05_short_filters", lambda t: jobs.rest_filter(t["person_claims"], {"claim_type": "in.(alias,gender,party)", "review_score": "gte.90", "visibility": "not.eq.private", "person_id": "not.is.null", "scoring_version": "is.null", "is_public": "is.true"}, "updated_at.desc").select("id", "claim_type", "review_score"), """
        SELECT id, claim_type, CAST(review_score AS BIGINT) AS review_score FROM person_claims WHERE claim_type IN ('alias', 'gender', 'party') AND review_score >= 90 AND visibility <> 'private' AND person_id IS NOT NULL AND scoring_version IS NULL AND is_public""")
    register("p13_allowed_views", allowed, """
        SELECT 'public_regions' AS view, (SELECT count(*) FROM public_regions_) AS n UNION ALL SELECT 'public_elections', (SELECT count(*) FROM public_elections_) UNION ALL SELECT 'person_claim_review_queue', -1 UNION ALL SELECT 'people', -1""", **ALL)
    register("p14_key_lookups", lambda t: jobs.lookup(V.public_regions(t), slug="n-3").select(F.col("region_id").alias("id"), "name").unionByName(jobs.lookup(V.public_races(t), election_id="e1995", region_id=None).select(F.col("race_id").alias("id"), F.col("title").alias("name"))).unionByName(
        jobs.lookup(V.public_people(t), person_id="p00000042").select(F.col("person_id").alias("id"), "name")), """
        SELECT region_id AS id, name FROM public_regions_ WHERE slug = 'n-3' UNION ALL SELECT race_id, title FROM public_races_ WHERE election_id = 'e1995' AND region_id IS NULL UNION ALL SELECT person_id, name FROM public_people_ WHERE person_id = 'p00000042'""", **ALL)
    register("o10_page_numbers", shown_pages, """
        SELECT race_id, shown_at, unnest(range(first, first + shown)) AS page FROM (
          SELECT *, greatest(1, least(shown_at - shown // 2, pages - shown + 1)) AS first FROM (
            SELECT race_id, pages, least(3, pages) AS shown, unnest(range(1, pages + 1)) AS shown_at FROM (SELECT race_id, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM candidates GROUP BY 1) a) b) c""")
    register("f08_years_of_paths", lambda t: t["people"].select("id", T.year_from_path(F.concat(F.when(F.substring("id", 9, 1) == "1", F.lit("x/")).otherwise(""), F.when(F.substring("id", 9, 1) < "4", F.col("election_year").cast("string")).otherwise((F.col("election_year") - 1911).cast("string")), F.lit("年/t/a.csv"))).alias("year")), """
        SELECT id, CAST(election_year AS BIGINT) AS year FROM people""")
    register("f09_roc_dates", lambda t: t["people"].select("id", T.roc_date(F.concat((F.col("election_year") - 1911).cast("string"), F.lpad((number() % 15).cast("string"), 2, "0"), F.lpad((number() % 33).cast("string"), 2, "0"))).alias("compact"), T.roc_date_words(F.concat(F.lit("生於民國 "), (F.col("election_year") - 1911).cast("string"), F.lit("年"), (number() % 12 + 1).cast("string"), F.lit("月"), (number() % 28 + 1).cast("string"), F.lit("日"))).alias("words")), """
        SELECT id, CASE WHEN k % 15 BETWEEN 1 AND 12 AND k % 33 BETWEEN 1 AND 31 THEN CAST(election_year AS VARCHAR) || '-' || lpad(CAST(k % 15 AS VARCHAR), 2, '0') || '-' || lpad(CAST(k % 33 AS VARCHAR), 2, '0') END AS compact,
               CAST(election_year AS VARCHAR) || '-' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') AS words FROM (SELECT *, CAST(substr(id, 2) AS INT) AS k FROM people) x""")
    register("f24_districts", lambda t: t["people"].select("id", T.numeral_district(F.concat(F.lit("第"), F.substring(F.lit("一二三四五六七八九十百千"), number() % 12 + 1, F.lit(1)), F.lit("選區"))).alias("district"), T.district_number(F.concat(F.lit("臺北市第 "), (number() % 40).cast("string"), F.when(number() % 3 == 0, " 選舉區").otherwise("區"))).alias("number")), """
        SELECT id, CASE WHEN k % 12 < 10 THEN CAST(k % 12 + 1 AS BIGINT) END AS district, CAST(CASE WHEN k % 3 = 0 THEN k % 40 ELSE 2147483647 END AS BIGINT) AS number FROM (SELECT id, CAST(substr(id, 2) AS INT) AS k FROM people) x""")
    register("f26_hints", lambda t: t["people"].select("id", F.array_join(T.tokens(F.concat_ws("、", "name", "party", "district", F.lit("a"))), "|").alias("tokens"), E.hinted([T.text("party"), T.text("education")], F.concat_ws(" ", "name", "education")).alias("hit")), r"""
        SELECT id, array_to_string(list_filter([x FOR x, i IN parts IF list_position(parts, x) = i], lambda x: length(x) >= 2), '|') AS tokens,
               len(list_filter(regexp_split_to_array(lower(coalesce(party, '') || ' ' || coalesce(education, '')), '[\s,;；、，。・()（）/|]+'), lambda x: length(x) >= 2 AND contains(lower(concat_ws(' ', name, education)), x))) > 0 AS hit
        FROM (SELECT *, regexp_split_to_array(lower(concat_ws('、', name, party, district, 'a')), '[\s,;；、，。・()（）/|]+') AS parts FROM people) x""")
    register("f34_address_regions", lambda t: t["companies"].select("id", T.address_region(F.concat(F.lit("*"), "address_region", F.lit("**"))).alias("region"), T.address_region(F.lit("***")).alias("none")), "SELECT id, left(address_region, 3) AS region, CAST(NULL AS VARCHAR) AS none FROM companies")
    register("r21_entity_matches", lambda t: E.entity_matches(t["entity_targets"], entity_rows(t)), _MATCHES)
    register("r22_entity_claims", lambda t: E.entity_claims(entity_rows(t)), _MADE)
