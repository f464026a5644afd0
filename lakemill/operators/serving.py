"""What pages ask for: search, regions and their races, contributions, party figures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.functions import text as T
from lakemill.operators.views import keep_first
from lakemill.session import checkpoint

NATIONAL_TYPES = ("president", "vice_president", "party_list_legislator", "referendum")
NATIONAL_NAMES = ("全國", "臺灣", "台灣")
FINISHED = ("completed", "cancelled")
HIDDEN_CANDIDATES = ("disqualified", "withdrawn", "unknown")


def search(query: str, parties: DataFrame, elections: DataFrame, regions: DataFrame, people: DataFrame, companies: DataFrame, most: int = 12) -> DataFrame:
    """Rows of all kinds that contain the query, kinds in a fixed order; queries of under two characters find nothing."""
    q = query.strip().lower()
    kinds = [
        ("party", parties, "party_id", ("name", "short_name")), ("election", elections, "election_id", ("name", "election_type", "status")), ("region", regions, "region_id", ("name", "slug")),
        ("person", people, "person_id", ("name", "alias", "party", "position", "district")), ("company", companies, "company_id", ("name", "unified_business_no", "representative_name", "address_region")),
    ]
    found = None
    for rank, (kind, df, key, fields) in enumerate(kinds):
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.lower(F.col(f)).contains(q), F.lit(False))
        rows = df.where(hit & F.lit(len(q) >= 2)).select(F.lit(rank).alias("type_rank"), F.lit(kind).alias("type"), F.col(key).alias("id"), F.col("name").alias("title"))
        found = rows if found is None else found.unionByName(rows)
    return found.orderBy("type_rank", "id").limit(most)


def search_groups(results: DataFrame) -> DataFrame:
    """Search results by kind; kinds without results don't appear."""
    return results.groupBy("type_rank", "type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids")).orderBy("type_rank")


def region_closure(regions: DataFrame, start: str) -> DataFrame:
    """A region and all below it, level by level, however many levels there are.

    A level's ids are broadcast only if Spark finds them small. A region that is
    met again, in a circle of parents, is not followed a second time.
    """
    links = regions.select("region_id", F.col("parent_region_id").alias("up_"))
    level = links.where(F.col("region_id") == start).select("region_id").distinct().withColumn("level", F.lit(0))
    out, i = level, 0
    while not level.isEmpty():
        i += 1
        ups = level.select(F.col("region_id").alias("id_"))
        below = links.join(ups, F.col("up_") == F.col("id_")).select("region_id").distinct()
        level = checkpoint(below.join(out.select("region_id"), "region_id", "left_anti").withColumn("level", F.lit(i)))
        out = out.unionByName(level)
    return out


def region_aliases(regions: DataFrame) -> DataFrame:
    """(alias, region_id): the id, the id without its prefix, and the slug."""
    names = F.array_distinct(F.array_compact(F.array("region_id", F.regexp_replace("region_id", "^region-", ""), "slug")))
    return regions.select(F.explode(names).alias("alias"), "region_id")


def is_national() -> Column:
    return F.col("race_type").isin(*NATIONAL_TYPES) | F.coalesce(F.col("region_name").isin(*NATIONAL_NAMES), F.lit(False))


def related_races(races: DataFrame, regions: DataFrame, start: str) -> DataFrame:
    """Races of a region, of those below it, and national ones."""
    below = region_closure(regions, start).select("region_id").distinct().withColumnRenamed("region_id", "b_id")
    rows = races.join(below, F.col("region_id") == F.col("b_id"), "left")
    return rows.where(F.col("b_id").isNotNull() | is_national()).drop("b_id")


def unfinished() -> Column:
    return ~F.col("status").isin(*FINISHED)


def race_order(races: DataFrame) -> DataFrame:
    """Finished races first, then by district number, latest date, title."""
    return races.withColumns({"open": unfinished().cast("int"), "district_no": T.district_number("title")}).orderBy("open", "district_no", F.desc("voting_date"), "title", "race_id")


def race_groups(races: DataFrame) -> DataFrame:
    """Village, council and district races folded by kind, election and date."""
    title = F.col("title")
    kind = T.first_of(
        [
            ((F.col("race_type") == "village_chief") | T.has_any(title, ("里長", "村長")), "village"),
            (F.col("race_type").isin("city_councilor", "county_councilor") | title.contains("議員"), "councilor"),
            ((F.col("race_type") == "legislator") & T.has_any(title, ("第", "選舉區")), "legislator"),
        ],
        None,
    )
    rows = races.withColumn("kind", kind).where("kind IS NOT NULL")
    return rows.groupBy("kind", "election_name", "voting_date").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("race_id")), ",").alias("races"), F.count(F.when(unfinished(), 1)).alias("n_open"))


def race_candidate_counts(races: DataFrame, candidates: DataFrame) -> DataFrame:
    c = candidates.where(~F.col("registration_status").isin(*HIDDEN_CANDIDATES)).select(F.col("race_id").alias("c_race"))
    return races.join(c, F.col("race_id") == F.col("c_race"), "left").groupBy("race_id").agg(F.count("c_race").alias("n"))


def contributions(income: DataFrame, parties: DataFrame, account: str) -> DataFrame:
    """Company donations by party, company and year: rows of the account with a valid company number, donor, year and amount.

    income: account, business_no, party, donor, year and amount as text. Only
    aggregates come out, never a row of a donor.
    """
    p = parties.select(F.col("name").alias("p_name"), F.col("external_id").alias("party_id"))
    # The account first: the texts of other rows are never parsed.
    rows = income.where((F.col("account") == account) & ~T.is_blank("donor"))
    # Patterns run once a row: what a generator gives isn't worked out again for each of the conditions on it.
    raw = F.struct(T.business_number("business_no").alias("company_no"), T.party_name("party").alias("party_"), T.year_digits("year").alias("year_"), T.amount_digits("amount").alias("digits_"))
    rows = rows.select(F.inline(F.array(raw))).select("company_no", "party_", T.year_of("year_").alias("report_year"), T.amount_of("digits_").alias("amount_"))
    rows = rows.where(F.col("company_no").isNotNull() & (F.col("report_year") > 0) & (F.col("amount_") > 0))
    joined = rows.join(p, F.col("party_") == F.col("p_name"))
    return joined.groupBy("party_id", "company_no", "report_year").agg(F.round(F.sum("amount_"), 2).alias("amount_total"), F.count("*").alias("donation_count"))


def latest_finance(summaries: DataFrame) -> DataFrame:
    return keep_first(summaries, ["party_id"], [F.desc("report_year")])


def party_figures(summaries: DataFrame, contributions_: DataFrame, parties: DataFrame) -> DataFrame:
    """Over all parties: income and company donations of each one's latest year, and the number of contribution rows."""
    latest = latest_finance(summaries).agg(F.round(F.sum("income_total"), 2).alias("income"), F.round(F.sum("business_donation_total"), 2).alias("donations"))
    rows = contributions_.join(parties.select("party_id"), "party_id", "left_semi").agg(F.count("*").alias("contributions"))
    return latest.join(rows)


def party_people(people: DataFrame, parties: DataFrame) -> DataFrame:
    """Office-holders by party: the person's label and a party's names contain each other. Parties are a small, fixed table."""
    p = F.broadcast(parties.select(F.col("party_id"), F.col("name").alias("p_name"), "short_name"))
    holders = people.where(~T.is_blank("position") & ~F.col("position").contains("候選人"))
    labels = holders.groupBy("party").agg(F.count("*").alias("n")).where("party IS NOT NULL")
    hit = T.label_matches(F.col("party"), F.col("p_name"), F.col("short_name"))
    return labels.join(p, hit).groupBy("party_id").agg(F.sum("n").alias("n"))


#: Characters of a name by which texts and names meet; bits of the table that tells which may meet; texts of one numpy step, in characters.
GRAM, GRAM_BITS, STEP = 8, 24, 1 << 18


def mentions(documents: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name_id): names of two characters and more that a text contains as it stands.

    A name meets texts by one stretch of at most GRAM characters of it, the one
    with the smallest hash, so that names which begin alike don't all meet the
    same texts. Names and texts are joined by that hash and then compared; neither
    is collected. A table of fixed size, which says what hashes names have at all,
    keeps most stretches of texts from moving.
    """
    kinds = f"{documents.schema['doc_id'].dataType.simpleString()}", f"{names.schema['name_id'].dataType.simpleString()}"
    names = names.where(F.length("name") >= 2).select("name_id", "name").distinct()
    keyed = names.mapInArrow(_grams_of_names, f"name_id {kinds[1]}, name string, gram long")
    flags, sizes = np.zeros(1 << GRAM_BITS >> 3, np.uint8), set()
    for row in keyed.select("name", "gram").mapInArrow(_flags, "flags binary, sizes array<int>").toLocalIterator():  # a table of fixed size from each task
        flags |= np.frombuffer(row["flags"], np.uint8)
        sizes |= set(row["sizes"])
    if not sizes:
        return keyed.select(F.lit(None).cast(kinds[0]).alias("doc_id"), "name_id").where(F.lit(False))
    met = documents.select("doc_id", "text").mapInArrow(_grams_of_texts(flags, sorted(sizes)), f"m_id {kinds[0]}, gram long")
    pairs = met.join(keyed, "gram").select("m_id", "name_id", "name").distinct()
    return documents.select("doc_id", "text").join(pairs, F.col("doc_id") == F.col("m_id")).where(F.expr("contains(text, name)")).select("doc_id", "name_id").distinct()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each stretch of so many characters."""
    out = np.full(max(0, len(codes) - size + 1), size, np.uint64)
    for k in range(size):
        out = (out ^ codes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _grams_of_names(batches):
    for rows in batches:
        names = rows.column(1).to_pylist()
        grams = [int(_gram_hashes(c, min(GRAM, len(c))).min().view(np.int64)) for c in map(_codes, names)]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(grams, pa.int64())], names=["name_id", "name", "gram"])


def _flags(batches):
    flags, sizes = np.zeros(1 << GRAM_BITS, bool), set()
    for rows in batches:
        flags[(rows.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)] = True
        sizes |= {min(GRAM, len(n)) for n in rows.column(0).to_pylist()}
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(flags).tobytes()], pa.binary()), pa.array([sorted(sizes)], pa.list_(pa.int32()))], names=["flags", "sizes"])


def _grams_of_texts(flags: np.ndarray, sizes: list[int]):
    def run(batches):
        bits = np.unpackbits(flags).astype(bool)
        for rows in batches:
            at, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for i, text in enumerate(rows.column(1).to_pylist()):
                codes = _codes(text or "")
                found = [np.zeros(0, np.uint64)]
                for start in range(0, len(codes), STEP):
                    part = codes[start : start + STEP + GRAM]
                    for size in sizes:
                        h = _gram_hashes(part, size)
                        found.append(np.unique(h[bits[(h >> np.uint64(64 - GRAM_BITS)).astype(np.int64)]]))
                grams.append(np.unique(np.concatenate(found)))
                at.append(np.full(len(grams[-1]), i))
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(grams).view(np.int64))], names=["m_id", "gram"])

    return run


def page_numbers(count: int, current: int, most: int = 5) -> list[int]:
    """Page numbers to show: up to five around the current one, within what there is."""
    shown = min(most, count)
    first = max(1, min(max(1, current - shown // 2), count - shown + 1))
    return list(range(first, first + shown))


def page_window(count: Column, current: Column, most: int = 5) -> Column:
    """The same of columns, as an array."""
    shown = F.least(F.lit(most), count)
    first = F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), current - F.floor(shown / 2)), count - shown + 1))
    return F.when(shown > 0, F.sequence(first.cast("long"), (first + shown - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def default_region(regions: DataFrame) -> DataFrame:
    """The capital by code or name, else the first county, else the first region."""
    rank = T.first_of([((F.col("slug") == "63000") | (F.col("name") == "臺北市"), 0), (F.col("region_type") == "county_city", 1)], 2)
    return regions.orderBy(rank, F.col("display_order").asc_nulls_last(), "region_id").limit(1)


def merged_by_key(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of all parts; of rows with the same key that of the last part stays."""
    rows = None
    for i, part in enumerate(parts):
        part = part.withColumn("part_", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    order = Window.partitionBy(key).orderBy(F.desc("part_"))
    return rows.withColumn("rn_", F.row_number().over(order)).where("rn_ = 1").drop("rn_", "part_")
