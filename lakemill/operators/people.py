"""The read side's lists of people: building, filtering, folding duplicates, sorting, summaries of offices and profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.functions import text as T
from lakemill.operators.views import keep_first
from lakemill.session import shared_folder

ACTIVE = ("pending", "registered", "qualified")


def stage_regions(regions: DataFrame) -> DataFrame:
    """Public regions with their parent's slug and their place in display order."""
    parents = regions.select(F.col("region_id").alias("p_id"), F.col("slug").alias("parent_slug"))
    joined = regions.join(parents, F.col("parent_region_id") == F.col("p_id"), "left").drop("p_id")
    order = Window.orderBy(F.coalesce("display_order", F.lit(2147483647)), "region_id")  # regions are a small, fixed table
    return joined.withColumn("place", F.row_number().over(order))


def backfilled(people: DataFrame, claims: DataFrame) -> DataFrame:
    """Gender, education and experience from claims where the person has none."""
    told = claims.withColumn("v", F.trim(T.text("claim_value"))).where("v <> ''")
    order = F.struct(-F.col("review_score"), F.col("claim_id"))

    def joined(kind: str) -> Column:
        entries = F.sort_array(F.collect_list(F.when(F.col("claim_type") == kind, F.struct(order.alias("o"), F.col("v").alias("v")))))
        return F.nullif(F.array_join(F.array_distinct(F.transform(entries, lambda e: e["v"])), "；"), F.lit("")).alias(f"c_{kind}")

    gender = F.min_by(F.when(F.col("claim_type") == "gender", F.col("v")), F.when(F.col("claim_type") == "gender", order)).alias("c_gender")
    by_person = told.where(F.col("claim_type").isin("gender", "education", "experience")).groupBy(F.col("person_id").alias("c_id")).agg(gender, joined("education"), joined("experience"))
    rows = people.join(by_person, F.col("person_id") == F.col("c_id"), "left")
    out = {
        "gender": F.when(F.coalesce(F.col("gender") != "unknown", F.lit(False)), F.col("gender")).otherwise(F.coalesce(T.gender_of_claim("c_gender"), "gender")),
        "education": F.when(~T.is_blank("education"), F.col("education")).otherwise(F.col("c_education")),
        "experience": F.when(~T.is_blank("experience"), F.col("experience")).otherwise(F.col("c_experience")),
    }
    return rows.withColumns(out).select(*people.columns)


def first_regions(texts: DataFrame, regions: DataFrame) -> DataFrame:
    """(text, stage) of different texts: the first region (place, region_id, name) whose id or slug a text is, or whose name it contains.

    Each text is cut into its pieces of the lengths that names have, and pieces
    meet names by equality: a text costs the same however many regions there
    are. Texts without a region are left out.
    """
    stage = F.struct("place", "region_id", "name")
    keys = regions.select(stage.alias("stage"), F.explode(F.array(F.struct(F.lit(True).alias("part"), F.col("name").alias("key")), *(F.struct(F.lit(False).alias("part"), F.col(c).alias("key")) for c in ("region_id", "slug")))).alias("k"))
    keys = keys.where("k.key IS NOT NULL").groupBy("k.part", "k.key").agg(F.min("stage").alias("stage"))
    lengths = regions.where("name IS NOT NULL").agg(F.collect_set(F.char_length("name")).alias("lengths"))  # one row: no more than the longest name has characters
    size = F.char_length("text")
    pieces = F.flatten(F.transform(F.filter("lengths", lambda n: n <= size), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr("text", i, n))))
    told = F.concat(F.transform(F.array_distinct(pieces), lambda p: F.struct(F.lit(True).alias("part"), p.alias("key"))), F.array(F.struct(F.lit(False).alias("part"), F.col("text").alias("key"))))
    cut = texts.join(F.broadcast(lengths)).select("text", F.explode(told).alias("t")).select("text", "t.part", "t.key")
    return cut.join(keys, ["part", "key"]).groupBy("text").agg(F.min("stage").alias("stage"))


def person_list(people: DataFrame, candidates: DataFrame, regions: DataFrame, claims: DataFrame) -> DataFrame:
    """A row a person with role, status, region, external ids and the number of candidacies.

    The region is the first in display order whose id, slug or name a text of the
    person (district, races) is or contains.
    """
    records = candidates.groupBy(F.col("person_id").alias("r_id")).agg(
        F.concat_ws(" ", F.array_sort(F.collect_set("person_position"))).alias("positions"), F.concat_ws(" ", F.array_sort(F.collect_set("race_title"))).alias("races"),
        F.count("*").alias("candidate_count"), F.max(F.col("registration_status") == "elected").alias("elected"), F.max(F.col("registration_status").isin(*ACTIVE)).alias("active"),
        F.array_sort(F.collect_set("region_name")).alias("region_names"),
    )
    ids = claims.where(F.col("claim_type") == "external_id").select("person_id", F.explode(F.array(F.trim("claim_value"), F.concat(F.lit("wikidata:"), F.get_json_object("claim_json", "$.wikidataQid")))).alias("x"))
    ids = ids.where("x IS NOT NULL AND x <> ''").groupBy(F.col("person_id").alias("x_id")).agg(F.array_sort(F.collect_set("x")).alias("external_ids"))
    rows = backfilled(people, claims).join(records, F.col("person_id") == F.col("r_id"), "left").join(ids, F.col("person_id") == F.col("x_id"), "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"candidate_count": F.coalesce("candidate_count", F.lit(0)), "external_ids": F.coalesce("external_ids", none), "positions_": F.concat_ws(" ", "position", "positions")})
    role = T.list_role(F.col("positions_"), T.text("races"))
    rows = rows.withColumn("role", role)
    candidate_text = T.text("position").contains("候選人")
    status = T.first_of(
        [
            ((F.coalesce("elected", F.lit(False)) & (F.col("role") != "candidate")) | ((F.col("role") != "other") & ~candidate_text), "current"),
            (F.coalesce("active", F.lit(False)), "candidate"), (F.col("candidate_count") > 0, "former"), (candidate_text, "candidate"),
        ],
        "other",
    )
    texts = F.array_distinct(F.array_compact(F.concat(F.array("district"), F.coalesce("region_names", none))))
    of_person = rows.select(F.col("person_id").alias("t_id"), F.explode(texts).alias("text"))
    found = first_regions(of_person.select("text").distinct(), regions)
    region = of_person.join(found, "text").groupBy("t_id").agg(F.min("stage").alias("region"))
    rows = rows.withColumn("status", status).join(region, F.col("person_id") == F.col("t_id"), "left")
    return rows.select(
        "person_id", "name", F.col("party"), "position", "district", "gender", "education", "experience", "role", "status", F.col("region.region_id").alias("region_id"),
        F.coalesce("region.name", "district", F.get("region_names", 0)).alias("region_name"), "candidate_count", "external_ids",
    )


def filtered(items: DataFrame, query: str = "", region: str | None = None, party: str | None = None, role: str | None = None, status: str | None = None) -> DataFrame:
    """Items whose name contains the query without regard to case and spaces, and that have the asked values."""
    squeezed = "".join(query.split()).lower()
    if squeezed:
        items = items.where(F.lower(F.regexp_replace("name", f"[{T.SPACES}]+", "")).contains(squeezed))
    if region:
        items = items.where((F.col("region_id") == region) | (F.col("region_name") == region))
    if party:
        items = items.where(T.party_label("party") == party)
    for column, value in (("role", role), ("status", status)):
        if value:
            items = items.where(F.col(column) == value)
    return items


def list_order() -> list[Column]:
    """Status, role, strokes of the surname; then code points, as no stroke collation is at hand."""
    return [T.lookup(F.col("status"), T.STATUS_RANK, 9), T.lookup(F.col("role"), T.ROLE_RANK, 9), T.surname_strokes("name"), F.col("name"), F.col("person_id")]


def numbered(items: DataFrame) -> DataFrame:
    """Items with their place in the list.

    The list is sorted in ranges over all its columns, so a large group of equal
    status, role and strokes has several; each range is numbered by itself and
    begins where the ranges before it end.
    """
    order = list_order()
    keys = [f"o{i}_" for i in range(len(order))]
    stored = items.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys).withColumn("range_", F.spark_partition_id())
    shared_folder(items.sparkSession)
    stored = stored.checkpoint()  # the ranges are drawn from a sample: they must be the same in both uses
    earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy("range_").count().withColumn("start_", F.coalesce(F.sum("count").over(earlier), F.lit(0))).select(F.col("range_").alias("r_"), "start_")  # a row a partition
    inside = Window.partitionBy("range_").orderBy(*keys)
    return stored.join(F.broadcast(starts), F.col("range_") == F.col("r_")).withColumn("place", F.col("start_") + F.row_number().over(inside)).drop(*keys, "range_", "r_", "start_")


def page(items: DataFrame, number: int, size: int = 20) -> DataFrame:
    """A page of the list; the number is brought within the pages there are."""
    placed = numbered(items)
    pages = placed.agg(F.greatest(F.lit(1), F.ceil(F.max("place") / size)).alias("pages"))
    at = F.least(F.greatest(F.lit(1), F.lit(number)), F.col("pages"))
    return placed.join(F.broadcast(pages)).where((F.col("place") > (at - 1) * size) & (F.col("place") <= at * size)).drop("pages")


def fold_keys(items: DataFrame) -> DataFrame:
    """(person_id, key): by which items are taken for one person: name with party, and each external id."""
    named = F.concat_ws("|", F.lit("name-party"), T.list_name("name"), T.party_label("party"))
    keys = F.array_union(F.array(named), F.transform("external_ids", lambda x: F.concat(F.lit("external:"), T.external_id(x))))
    return items.select("person_id", F.explode(keys).alias("key")).distinct()


def groups_by_key(keys: DataFrame, rounds: int = 40) -> DataFrame:
    """(person_id, root): items connected by keys.

    A round passes the smallest id through the keys and then takes each root's own
    root, so that the rounds grow with the logarithm of the longest chain;
    checkpoints cut the lineage.
    """
    shared_folder(keys.sparkSession)
    keys = keys.checkpoint()
    roots = keys.select("person_id", F.col("person_id").alias("root")).distinct()
    for _ in range(rounds):
        by_key = keys.join(roots, "person_id").groupBy("key").agg(F.min("root").alias("least"))
        passed = keys.join(by_key, "key").groupBy("person_id").agg(F.min("least").alias("root")).checkpoint()
        onwards = passed.select(F.col("person_id").alias("root"), F.col("root").alias("further"))
        fresh = passed.join(onwards, "root").select("person_id", F.least("root", "further").alias("root")).checkpoint()
        moved = fresh.join(roots.withColumnRenamed("root", "old"), "person_id").where("root <> old").limit(1).count()
        roots = fresh
        if not moved:
            return roots
    raise RuntimeError("the groups did not settle")


_FOLDED = ["person_id", "merged_person_ids", "merged_candidate_count"]


class _Fold:
    """Items of one group in order: an item takes in all kept items that share a key with it; what is kept then has the keys of the preferred one.

    The preferred one is the first by status, role and completeness; in ties the
    one kept earlier. So the name of the other may be lost as a key, and later
    items with it stay apart; external ids are never lost. A kept item is found
    by its keys through a forest of what was taken in by what, so that a step
    costs no more than the item's own keys, and lists of ids are put together at
    the end.
    """

    def __init__(self) -> None:
        self.by_key: dict[str, int] = {}
        self.up: list[int] = []
        self.kept: dict[int, dict] = {}

    def top(self, node: int) -> int:
        up = self.up
        while up[node] != node:
            up[node] = up[up[node]]
            node = up[node]
        return node

    def take(self, person: str, name: str, ids: list[str], status: int, role: int, full: int, count: int) -> None:
        item = {"person_id": person, "name": name, "rank": (status, role), "full": full, "count": count, "merged": person}
        own = list(dict.fromkeys([name, *(f"external:{i}" for i in ids)]))
        node = len(self.up)
        self.up.append(node)
        for old_node in dict.fromkeys(self.top(self.by_key[k]) for k in own if k in self.by_key):
            old = self.kept.pop(old_node)
            new_first = (*item["rank"], -(item["full"] + item["count"])) < (*old["rank"], -(old["full"] + old["count"]))
            first, second = (item, old) if new_first else (old, item)
            item = first | {"merged": (first["merged"], second["merged"]), "count": first["count"] + second["count"]}
            self.up[old_node] = node
            self.by_key.pop(old["name"], None)  # only the preferred one's name stays a key
        self.by_key |= dict.fromkeys(own[1:], node)
        self.by_key[item["name"]] = node
        self.kept[node] = item

    def rows(self) -> pd.DataFrame:
        def ids_of(merged: object) -> list[str]:
            out: dict[str, None] = {}
            stack = [merged]
            while stack:
                one = stack.pop()
                if isinstance(one, tuple):
                    stack.extend(reversed(one))
                else:
                    out.setdefault(one)
            return list(out)

        return pd.DataFrame([(k["person_id"], ids_of(k["merged"]), k["count"]) for k in self.kept.values()], columns=_FOLDED)


def _folds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups that stand one behind the other, each in its order, in as many batches as there are."""
    root, fold = None, _Fold()
    for rows in batches:
        for at, *item in rows[["root", "person_id", "name_key", "own_ids", "status_rank", "role_rank", "full", "candidate_count"]].itertuples(index=False):
            if at != root:
                yield fold.rows()
                root, fold = at, _Fold()
            fold.take(*item)
    yield fold.rows()


def fold_duplicates(items: DataFrame, order: str = "person_id") -> DataFrame:
    """The list with duplicates folded, in the order of a column: (person_id, merged_person_ids, merged_candidate_count).

    The fold depends on the order of items, but items of different components of
    keys never meet; so components come from joins. Spark sorts each by the order
    (what memory doesn't hold is spilled) and its items stream through the fold,
    which remembers what it keeps and one place an item.
    """
    roots = groups_by_key(fold_keys(items))
    full = sum((F.coalesce(F.col(c) != "", F.lit(False)).cast("int") for c in ("position", "district", "education", "experience")), F.coalesce((F.col("gender") != "unknown").cast("int"), F.lit(0)))
    rows = items.join(roots, "person_id").select(
        "root", "person_id", F.col(order).alias("position_"), F.concat_ws("|", F.lit("name-party"), T.list_name("name"), T.party_label("party")).alias("name_key"),
        F.transform("external_ids", lambda x: T.external_id(x)).alias("own_ids"), T.lookup(F.col("status"), T.STATUS_RANK, 9).alias("status_rank"), T.lookup(F.col("role"), T.ROLE_RANK, 9).alias("role_rank"),
        full.alias("full"), F.col("candidate_count").cast("long").alias("candidate_count"),
    )
    return rows.repartition("root").sortWithinPartitions("root", "position_", "person_id").mapInPandas(_folds, "person_id string, merged_person_ids array<string>, merged_candidate_count long")


def local_offices(items: DataFrame) -> DataFrame:
    """For each region its current chief, the numbers of deputies, agency heads and councilors, and what is still to do."""
    rows = items.where((F.col("status") == "current") & F.col("region_id").isNotNull())
    chief = F.min_by(F.when(F.col("role") == "local_chief", F.col("person_id")), F.when(F.col("role") == "local_chief", F.struct(T.surname_strokes("name"), "name", "person_id")))
    counts = [F.count(F.when(F.col("role") == role, 1)).alias(name) for role, name in (("local_deputy", "deputies"), ("agency_head", "agency_heads"), ("councilor", "councilors"))]
    out = rows.groupBy("region_id").agg(chief.alias("chief_id"), *counts)
    todo = F.array_compact(F.array(F.when(F.col("chief_id").isNull(), "chief"), *(F.when(F.col(c) == 0, c) for c in ("deputies", "agency_heads", "councilors"))))
    return out.withColumn("todo", F.array_join(todo, ","))


def councilor_parties(items: DataFrame) -> DataFrame:
    """Councilors of each region by party, most first."""
    rows = items.where((F.col("status") == "current") & (F.col("role") == "councilor") & F.col("region_id").isNotNull())
    return rows.groupBy("region_id", T.party_label("party").alias("party")).agg(F.count("*").alias("n")).orderBy("region_id", F.desc("n"), "party")


def profiles(items: DataFrame, claims: DataFrame) -> DataFrame:
    """Which sections of a person's profile have something to show."""
    kinds = claims.groupBy(F.col("person_id").alias("k_id")).agg(*(F.max(F.col("claim_type") == k).alias(k) for k in ("finance_summary", "platform", "legal_case", "family_relation")))
    rows = items.join(kinds, F.col("person_id") == F.col("k_id"), "left")

    def section(condition: Column, shown: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), shown).otherwise("todo")

    return rows.select(
        "person_id", section(~T.is_blank("experience"), "available").alias("experience_status"), section(F.col("finance_summary"), "summary_only").alias("contribution_status"),
        section(F.col("platform"), "available").alias("platform_status"), section(F.col("legal_case"), "review_required").alias("legal_record_status"), section(F.col("family_relation"), "review_required").alias("family_relation_status"),
    )


def party_options(items: DataFrame, majors: tuple[str, ...] = ("民主進步黨", "中國國民黨", "台灣民眾黨")) -> DataFrame:
    """Party labels in the order of a filter: majors, others, unknown, independents at last."""
    labels = items.select(T.party_label("party").alias("party")).distinct()
    rank = T.first_of([(F.col("party") == "無黨籍", 100), (F.col("party") == T.WITHOUT_PARTY, 99), *((F.col("party") == p, i) for i, p in enumerate(majors))], 50)
    return labels.withColumn("rank", rank).orderBy("rank", "party")


def latest_of(df: DataFrame, key: str, order: list) -> DataFrame:
    return keep_first(df, [key], order)
