"""Official registries: rows of their files as people, candidates and parties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.functions import text as T

#: Counties by their key in election files.
COUNTIES = {
    "01000": "臺北市", "02000": "新北市", "03000": "臺中市", "04000": "臺南市", "05000": "高雄市", "06000": "桃園市", "07000": "基隆市", "09007": "連江縣", "09020": "金門縣", "10002": "宜蘭縣", "10004": "新竹縣", "10005": "苗栗縣",
    "10007": "彰化縣", "10008": "南投縣", "10009": "雲林縣", "10010": "嘉義縣", "10013": "屏東縣", "10014": "臺東縣", "10015": "花蓮縣", "10016": "澎湖縣", "10017": "基隆市", "10018": "新竹市", "10020": "嘉義市", "63000": "臺北市",
    "64000": "高雄市", "65000": "新北市", "66000": "臺中市", "67000": "臺南市", "68000": "桃園市",
}
#: Parts of an archive path, in the order in which they are tried, with kind and district label.
KINDS = [
    ("/總統/", "president", "全國"), ("/區域立委/", "legislator-district", None), ("/平地立委/", "legislator-plain-indigenous", "平地原住民"), ("/山地立委/", "legislator-mountain-indigenous", "山地原住民"), ("/C1/", "local-mayor", None),
    ("/T1/", "local-councilor-regional", None), ("/T2/", "local-councilor-plain-indigenous", "平地原住民"), ("/T3/", "local-councilor-mountain-indigenous", "山地原住民"),
]
#: Paths that are left out, as newer sources have them.
LEFT_OUT = ("不分區政黨", "2024總統立委", "2022-111年地方公職人員選舉")
#: Columns of a candidate file by place.
CELLS = {"county": 0, "sub": 1, "district": 2, "number": 5, "name": 6, "party_code": 7, "gender": 8, "incumbent": 13, "elected": 14, "vice": 15}


def cell(i: int) -> Column:
    return F.trim(F.regexp_replace(F.trim(T.text(F.get("cells", i))), "^'+", ""))


def county_key(county: Column, sub: Column) -> Column:
    """Two districts of the old counties have keys of their own; all else is a county as a whole."""
    return F.concat(county, F.when(county.isin("09", "10"), sub).otherwise("000"))


def entry_kind(entry: str = "entry") -> tuple[Column, Column]:
    """Kind and district label of a candidate file by its path; null for files that aren't taken."""
    e = F.col(entry)
    taken = e.endswith("/elcand.csv") & ~T.has_any(e, LEFT_OUT) & (T.year_from_path(entry) >= 1989)
    kind = T.first_of([(taken & e.contains(part), k) for part, k, _ in KINDS], None)
    return kind, T.first_of([(taken & e.contains(part), F.lit(label).cast("string")) for part, _, label in KINDS], None)


def historic_candidates(rows: DataFrame) -> DataFrame:
    """Source people of archived elections from rows of cells (path, entry, line, cells), with the party file of the same folder."""
    kind, label = entry_kind()
    folder = F.regexp_extract("entry", r"^(.*)/[^/]*$", 1)
    parties = rows.where(F.col("entry").endswith("/elpaty.csv")).select(F.col("path").alias("p_path"), folder.alias("p_folder"), cell(0).alias("p_code"), T.party_name(cell(1)).alias("party"))
    parties = parties.dropDuplicates(["p_path", "p_folder", "p_code"])
    c = rows.select("path", "entry", folder.alias("folder"), kind.alias("kind"), label.alias("label"), T.year_from_path("entry").alias("election_year"), *(cell(i).alias(n) for n, i in CELLS.items()))
    c = c.where("kind IS NOT NULL AND number <> '' AND name <> '' AND name <> '姓名'")
    joined = c.join(parties, (F.col("path") == F.col("p_path")) & (F.col("folder") == F.col("p_folder")) & (F.col("party_code") == F.col("p_code")), "left")
    key = county_key(F.col("county"), F.col("sub"))
    county = T.lookup(key, COUNTIES, None)
    known = F.coalesce(county, F.concat(F.lit("縣市代碼"), key))
    number = F.concat(F.lit("第"), F.regexp_replace("district", "^0+(?=.)", ""), F.lit("選舉區"))
    council = F.col("kind").startswith("local-councilor")
    where = T.first_of([(F.col("label").isNotNull(), F.col("label")), (F.col("kind") == "legislator-district", F.concat(known, number)), (F.col("kind") == "local-mayor", known), (council, F.concat(known, number, F.lit("議員")))], None)
    won, year = F.col("elected") == "*", F.concat(F.col("election_year").cast("string"), F.lit("年"))
    office = T.first_of([(F.col("kind") == "local-mayor", F.coalesce(F.concat(county, F.lit("首長")), F.lit("縣市首長"))), (council, F.concat(T.text(county), T.text("label"), F.lit("議員")))], None)
    yearly = T.first_of([((F.col("kind") == "president") & (F.col("vice") == "Y"), "副總統"), (F.col("kind") == "president", "總統")], "立法委員")
    position = F.coalesce(F.when(won, office).otherwise(F.concat(office, F.lit("候選人"))), F.concat(year, yearly, F.when(won, "當選人").otherwise("候選人")))
    return joined.select(
        F.concat(F.lit("cec-historical:"), T.hash_id("entry", "number", "name", "county", "sub", "district", "vice")).alias("source_person_key"), F.col("name").alias("raw_name"), T.gender("gender").alias("gender"),
        T.text("party").alias("party"), position.alias("position"), T.role_of(position).alias("role"), where.alias("district"), "election_year", "kind", won.alias("elected"), F.lit("A").alias("confidence_suggestion"),
    )


def party_registry(rows: DataFrame, wanted: list[str], names: tuple[str, ...] = ("政黨名稱", "名稱", "黨名")) -> DataFrame:
    """Parties of an allow-list from a registry's rows (with ``line``): the first row of each name."""
    have = [n for n in names if n in rows.columns]
    named = rows.withColumn("name_", T.pick(*have)).where(F.col("name_").isin(*wanted))
    first = named.withColumn("rn_", F.row_number().over(Window.partitionBy("name_").orderBy("line"))).where("rn_ = 1").drop("rn_")
    return first.withColumns({"external_id": F.concat(F.lit("moi-party-"), T.hash_id("name_")), "status": F.lit("active")})


def photo_code(url: str | Column) -> Column:
    """The number that a photo's file is named by, or empty."""
    return F.regexp_extract(T.text(url), r"(?i)/(\d+)\.[a-z]+$", 1)


def officeholders(rows: DataFrame) -> DataFrame:
    """Legislators in office from rows with leaveFlag, term, name, ename, sex, partyGroup, areaName, onboardDate, picUrl, degree, experience."""
    term = F.coalesce(F.nullif(F.trim(T.text("term")), F.lit("")), F.lit("11"))
    code = F.coalesce(F.nullif(photo_code("picUrl"), F.lit("")), T.hash_id("name", "partyGroup", "areaName", "onboardDate"))
    here = rows.where((F.trim(T.text("leaveFlag")) == "否") & ~T.is_blank("name"))
    return here.select(
        F.concat(F.lit("ly-legislator-"), term, F.lit("-"), code).alias("external_id"), F.trim("name").alias("name"), F.nullif(F.trim(T.text("ename")), F.lit("")).alias("alias"), T.gender("sex").alias("gender"),
        F.col("partyGroup").alias("party"), F.concat(F.lit("第"), term, F.lit("屆立法委員")).alias("position"), F.col("areaName").alias("district"), F.nullif(F.trim(T.text("degree")), F.lit("")).alias("education"),
        F.nullif(F.trim(T.text("experience")), F.lit("")).alias("experience"),
    )


def changed_documents(lists: DataFrame) -> DataFrame:
    """Distinct judgment ids of change lists (text in JSON: objects with a list), with their parts."""
    ids = lists.select(F.explode(F.from_json("text", "array<struct<date: string, list: array<string>>>")).alias("d")).select(F.explode("d.list").alias("jid")).distinct()
    return ids.select("jid", T.legal_parts("jid").alias("p")).select("jid", "p.*")
