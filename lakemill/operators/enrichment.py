"""Claims that come from entity records and official profiles, and what reviewers' decisions do to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.functions import text as T
from lakemill.operators.claims import ENTITY_SOURCE, SENSITIVE, UNLOCKED, claim_score
from lakemill.operators.identity import alone_at_top, asked_kinds, contained, identity_value, matching_cells, told_to_rows
from lakemill.operators.views import REVIEWABLE

#: Words of a description that tell of public office.
OFFICE_WORDS = r"(?i)政治|政黨|立法|議員|市長|縣長|總統|候選|minister|politician|legislator|mayor|president"


def resolved_people(claims: DataFrame, people: DataFrame) -> DataFrame:
    """Claims with the person they are about: by id, else by external id, else, if the claim's identity was matched, by name.

    claims: claim_id, person_id, person_external_id, normalized_name, source_id,
    claim_json. Unmatched claims of the entity source and claims about nobody are
    left out; of several people of a name the smallest id is taken.
    """
    matched = F.coalesce(F.get_json_object("claim_json", "$.identityMatch.status") == "matched", F.lit(False))
    rows = claims.where(F.coalesce(F.col("source_id") != "wikidata-person-enrichment", F.lit(True)) | matched)
    rows = rows.withColumn("name_key", F.when(matched & (F.col("normalized_name") != ""), F.col("normalized_name")))
    by_id = people.select(F.col("id").alias("i_id"))
    by_external = people.where("external_id IS NOT NULL").groupBy(F.col("external_id").alias("x_key")).agg(F.min("id").alias("x_id"))
    by_name = people.groupBy(T.identity_text("name").alias("n_key")).agg(F.min("id").alias("n_id"))
    rows = rows.join(by_id, F.col("person_id") == F.col("i_id"), "left").join(by_external, F.col("person_external_id") == F.col("x_key"), "left").join(by_name, F.col("name_key") == F.col("n_key"), "left")
    found = F.coalesce("i_id", "x_id", "n_id")
    return rows.withColumn("found_id", found).where("found_id IS NOT NULL").drop("i_id", "x_key", "x_id", "n_key", "n_id", "name_key")


def enrichment_claims(claims: DataFrame, people: DataFrame, rejected: DataFrame, threshold: int = 90) -> DataFrame:
    """Resolved claims with score and state: public only if asked for, verified, not sensitive and scored high enough; entities that were rejected for the person stay rejected.

    rejected: (person_id, qid).
    """
    rows = resolved_people(claims, people)
    score, reasons = claim_score(F.col("claim_type"), T.source_type("source_id"), F.col("confidence_level"), F.lit(True))
    r = rejected.select(F.col("person_id").alias("r_id"), F.upper("qid").alias("r_qid")).distinct()
    rows = rows.withColumns({"review_score": score, "scoring_reasons": reasons, "q": T.qid_of("claim_json")})
    rows = rows.join(r, (F.col("found_id") == F.col("r_id")) & (F.col("q") == F.col("r_qid")), "left")
    no = F.col("r_id").isNotNull()
    public = F.coalesce((F.col("visibility") == "public") & (F.col("review_status") == "verified") & (F.col("review_score") >= threshold) & ~F.col("claim_type").isin(*SENSITIVE), F.lit(False))
    return rows.select(
        "claim_id", F.col("found_id").alias("person_id"), "claim_type", "claim_value", "review_score", T.first_of([(no, "rejected"), (public, "verified")], "pending").alias("review_status"),
        T.first_of([(no, "private"), (public, "public")], "review_only").alias("visibility"), (public & ~no).alias("is_public"),
    )


def reject_known_entities(claims: DataFrame, rejected: DataFrame) -> DataFrame:
    """Open claims about an entity that was rejected for their person: to be rejected too."""
    r = rejected.select(F.col("person_id").alias("r_id"), F.upper("qid").alias("r_qid")).distinct()
    rows = claims.where(F.col("review_status").isin(*REVIEWABLE)).withColumn("q", T.qid_of("claim_json"))
    hit = rows.join(r, (F.col("person_id") == F.col("r_id")) & (F.col("q") == F.col("r_qid")), "left_semi")
    return hit.select(F.col("id").alias("claim_id"), F.lit("rejected").alias("review_status"), F.lit("private").alias("visibility"), F.lit(False).alias("is_public"))


def decision_cascade(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """What decisions of reviewers (claim_id, decision) change: the claim itself, and open claims of the same person and entity.

    Approving an external id of the entity source approves open claims of unlocked
    types; rejecting any claim of that source rejects all open ones. A rejection
    outweighs an approval.
    """
    decided = claims.join(decisions.select(F.col("claim_id").alias("d_id"), "decision"), F.col("id") == F.col("d_id")).withColumn("q", T.qid_of("claim_json"))
    own = decided.select(F.col("id").alias("claim_id"), "decision")
    spread = decided.where((F.col("source_name") == ENTITY_SOURCE) & F.col("person_id").isNotNull() & F.col("q").isNotNull() & ((F.col("decision") == "reject") | (F.col("claim_type") == "external_id")))
    spread = spread.select(F.col("person_id").alias("s_id"), F.col("q").alias("s_q"), F.col("decision").alias("s_decision")).distinct()
    open_ = claims.where((F.col("source_name") == ENTITY_SOURCE) & F.col("review_status").isin(*REVIEWABLE)).withColumn("q", T.qid_of("claim_json"))
    hit = open_.join(spread, (F.col("person_id") == F.col("s_id")) & (F.col("q") == F.col("s_q"))).where((F.col("s_decision") == "reject") | F.col("claim_type").isin(*UNLOCKED))
    both = own.unionByName(hit.select(F.col("id").alias("claim_id"), F.col("s_decision").alias("decision"))).groupBy("claim_id").agg(F.max("decision").alias("decision"))
    no = F.col("decision") == "reject"
    return both.select("claim_id", F.when(no, "rejected").otherwise("verified").alias("review_status"), F.when(no, "private").otherwise("public").alias("visibility"), (~no).alias("is_public"))


def gender_points(row: Column, person: Column, same: int, different: int) -> Column:
    told = (row != "unknown") & row.isNotNull()
    return F.when(told & (row == person), same).when(told & person.isNotNull() & (person != "unknown"), different).otherwise(0)


def legislator_matches(rows: DataFrame, people: DataFrame) -> DataFrame:
    """Legislators' official profiles (row_id, name, gender, party, area) matched to people of the name: 75 points, 15 ahead of the next."""
    left = rows.select("row_id", T.identity_text("name").alias("l_name"), F.col("gender").alias("l_gender"), *(identity_value(c).alias(f"l_{c}") for c in ("party", "area")))
    seat = T.text("position").contains("立法委員").alias("seat")
    right = people.select("person_id", T.identity_text("name").alias("l_name"), "gender", seat, *(identity_value(c).alias(c) for c in ("party", "district")))
    asked = asked_kinds(left, ("l_name", "l_gender", "l_party", "l_area"))
    cells = matching_cells(asked, right, "l_name", "person_id", ("gender", "seat"), {"party": ("l_party", contained, 15), "district": ("l_area", contained, 15)})
    score = F.lit(50) + gender_points(F.col("l_gender"), F.col("gender"), 20, -30) + F.when(F.col("seat"), 10).otherwise(0) + F.col("points")
    return told_to_rows(left, asked, alone_at_top(cells.withColumn("score", score), 75, 15)).select("row_id", F.col("first_").alias("person_id"), "score")


def city_profile_matches(rows: DataFrame, people: DataFrame) -> DataFrame:
    """City officials' profiles (row_id, name, gender, party, position, district, kind: council or government) matched to people: 75 points, 10 ahead."""
    council, mayor = (F.col("kind") == "council").alias("l_council"), ((F.col("kind") == "government") & T.text("position").contains("市長")).alias("l_mayor")
    left = rows.select("row_id", T.identity_text("name").alias("l_name"), F.col("gender").alias("l_gender"), council, mayor, *(identity_value(c).alias(f"l_{c}") for c in ("party", "position", "district")))
    offices = [T.text("position").contains(word).alias(name) for word, name in (("議員", "councilor"), ("市長", "mayor"))]
    right = people.select("person_id", T.identity_text("name").alias("l_name"), "gender", *offices, *(identity_value(c).alias(c) for c in ("party", "position", "district")))
    asked = asked_kinds(left, ("l_name", "l_gender", "l_council", "l_mayor", "l_party", "l_position", "l_district"))
    features = {"party": ("l_party", contained, 10), "position": ("l_position", contained, 15), "district": ("l_district", contained, 15)}
    cells = matching_cells(asked, right, "l_name", "person_id", ("gender", "councilor", "mayor"), features)
    score = F.lit(50) + gender_points(F.col("l_gender"), F.col("gender"), 15, -50) + F.col("points")
    for both in (F.col("l_council") & F.col("councilor"), F.col("l_mayor") & F.col("mayor")):
        score = score + F.when(both, 10).otherwise(0)
    return told_to_rows(left, asked, alone_at_top(cells.withColumn("score", score), 75, 10)).select("row_id", F.col("first_").alias("person_id"), "score")


def hinted(hints: list[Column], evidence: Column) -> Column:
    """Whether a token of the hints is in the evidence."""
    tokens = T.tokens(F.concat_ws(" ", *hints))
    return F.exists(tokens, lambda x: F.instr(F.lower(evidence), x) > 0)


def entity_matches(targets: DataFrame, entities: DataFrame) -> DataFrame:
    """Targets beside entities found for them: matched only with name, gender, a description of public office and one more signal.

    targets: target_id, name, gender, position, education, experience, district,
    party. entities: target_id, qid, names, gender, description, education,
    positions, occupations (arrays of labels).
    """
    e = entities.select(*(F.col(c).alias(f"e_{c}") for c in ("target_id", "qid", "names", "gender", "description", "education", "positions", "occupations")))
    rows = targets.join(e, F.col("target_id") == F.col("e_target_id"))
    named = F.array_contains(F.transform("e_names", lambda x: T.person_name(x)), T.person_name("name"))
    gender = T.gender("gender")
    fits = named & (gender != "unknown") & (gender == F.col("e_gender")) & T.text("e_description").rlike(OFFICE_WORDS)
    description, schools, offices = T.text("e_description"), F.concat_ws(" ", "e_education"), F.concat_ws(" ", "e_positions", "e_occupations")
    signals = [(hinted([T.text("position")], F.concat_ws(" ", description, offices, schools)), 10), (hinted([T.text("education")], schools), 10), (hinted([T.text("experience")], offices), 10), (hinted([T.text("district"), T.text("party")], description), 5)]
    more = sum((F.when(c, n).otherwise(0) for c, n in signals), F.lit(0))
    score = F.when(~named, 0).when(~F.coalesce(fits, F.lit(False)), F.when((gender != "unknown") & (gender == F.col("e_gender")), 75).otherwise(50)).otherwise(F.least(F.lit(100), 75 + more))
    return rows.select("target_id", F.col("e_qid").alias("qid"), (F.coalesce(fits, F.lit(False)) & (more > 0)).alias("matched"), score.alias("score"))


def entity_claims(entities: DataFrame) -> DataFrame:
    """Claims that a matched entity makes: id, gender, birth date, education, at most twelve offices, and each relative.

    entities: target_id, qid, gender, birth_date, education, positions,
    occupations (arrays), relatives (array of relation and label).
    """
    offices = F.slice(F.array_distinct(F.concat("positions", "occupations")), 1, 12)
    fixed = [("external_id", F.concat(F.lit("wikidata:"), "qid")), ("gender", F.nullif("gender", F.lit("unknown"))), ("birth_date", F.col("birth_date")), ("education", F.array_join(F.array_distinct("education"), "；")), ("experience", F.array_join(offices, "；"))]
    rows = [F.struct(F.lit(kind).alias("claim_type"), value.alias("claim_value")) for kind, value in fixed]
    relatives = F.transform("relatives", lambda x: F.struct(F.lit("family_relation").alias("claim_type"), F.concat(x["relation"], F.lit("："), x["label"]).alias("claim_value")))
    out = entities.select("target_id", "qid", F.explode(F.concat(F.array(*rows), relatives)).alias("c"))
    return out.where("c.claim_value IS NOT NULL AND c.claim_value <> ''").select("target_id", "qid", "c.claim_type", "c.claim_value")


