"""The publication views and review queues, each a function of the base tables.

Tables come as a mapping from name to DataFrame. Rows are gated by named
predicates; a person's rows are folded on the canonical person by a mapping of a
single hop.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]

OPEN_RACES = ("announced", "upcoming", "registration_open", "candidates_announced", "voting")
TICKER_STATUSES = ("announced", "upcoming", "active")
REVIEWABLE = ("pending", "needs_more_evidence")


#: What a primary photo carries beside its address.
PHOTO_COLUMNS = ("thumbnail_url", "source_name", "source_url", "license_type", "license_url", "attribution")


def published(review: str = "review_status") -> Column:
    """Verified, of public visibility, and public."""
    return (F.col(review) == "verified") & (F.col("visibility") == "public") & F.col("is_public")


def renamed(df: DataFrame, prefix: str, *names: str) -> DataFrame:
    """Only these columns, with a prefix: joins then have no clashing names."""
    return df.select(*(F.col(n).alias(f"{prefix}{n}") for n in names))


def newest(column: str, order: str = "updated_at", tie: str = "id") -> Column:
    """The newest value that isn't null; a null time counts as newest, of equal times the larger id wins."""
    return F.expr(f"max_by({column}, struct({order} IS NULL, {order}, {tie})) FILTER (WHERE {column} IS NOT NULL)")


def person_canonical_map(t: Tables) -> DataFrame:
    decisions = t["person_merge_decisions"].where(F.col("status") == "verified").select(F.col("duplicate_person_id").alias("d"), F.col("canonical_person_id").alias("c"))
    people = t["people"].select(F.col("id").alias("person_id"))
    return people.join(decisions, F.col("person_id") == F.col("d"), "left").select("person_id", F.coalesce("c", "person_id").alias("canonical_person_id"))


def public_person_primary_photos(t: Tables) -> DataFrame:
    people = t["people"].where("is_public").select(F.col("id").alias("p_id"))
    media = t["person_media"].where((F.col("verification_status") == "verified") & F.col("is_public") & F.col("is_primary") & (F.col("license_type") != "unknown"))
    return media.join(people, F.col("person_id") == F.col("p_id"), "left_semi").select("person_id", F.col("id").alias("media_id"), F.col("url").alias("photo_url"), *PHOTO_COLUMNS)


def public_people(t: Tables) -> DataFrame:
    """A row for each public canonical person; what it lacks comes from the newest of its rows that has it."""
    public = t["people"].where("is_public")
    mapped = public.join(person_canonical_map(t).withColumnRenamed("person_id", "m_id"), F.col("id") == F.col("m_id")).withColumn("gender", F.nullif("gender", F.lit("unknown")))
    fields = ("alias", "party", "position", "election_year", "district", "gender", "education", "experience")
    folded = mapped.groupBy("canonical_person_id").agg(*(newest(c).alias(f"n_{c}") for c in fields), F.max("updated_at").alias("n_updated_at"))
    photos = renamed(public_person_primary_photos(t), "ph_", "person_id", "photo_url", *PHOTO_COLUMNS)
    own = public.join(folded, F.col("id") == F.col("canonical_person_id")).join(photos, F.col("id") == F.col("ph_person_id"), "left")
    plain = [F.coalesce(c, f"n_{c}").alias(c) for c in fields if c != "gender"]
    known = F.coalesce(F.nullif("gender", F.lit("unknown")), "n_gender", "gender").alias("gender")
    photo = [F.col("ph_photo_url").alias("primary_photo_url"), F.col("ph_thumbnail_url").alias("primary_photo_thumbnail_url"), *(F.col(f"ph_{c}").alias(f"photo_{c}") for c in PHOTO_COLUMNS[1:])]
    return own.select(F.col("id").alias("person_id"), "name", *plain, known, F.col("n_updated_at").alias("updated_at"), *photo)


def public_companies(t: Tables) -> DataFrame:
    return t["companies"].where("is_public").select(F.col("id").alias("company_id"), "unified_business_no", "name", "representative_name", "status", "capital", "address_region", "updated_at")


def public_relation_details(t: Tables) -> DataFrame:
    """Relations of public canonical people and companies; a private document leaves the row and takes its columns."""
    people = renamed(t["people"].where("is_public"), "p_", "id", "name", "party", "position", "district")
    companies = renamed(t["companies"].where("is_public"), "c_", "id", "name", "unified_business_no")
    documents = renamed(t["source_documents"].where("is_public"), "s_", "id", "source_name", "source_url")
    relations = t["person_company_relations"].where((F.col("verification_status") == "verified") & F.col("is_public"))
    mapping = person_canonical_map(t).withColumnRenamed("person_id", "m_id")
    joined = relations.join(mapping, F.col("person_id") == F.col("m_id")).join(people, F.col("canonical_person_id") == F.col("p_id"))
    joined = joined.join(companies, F.col("company_id") == F.col("c_id")).join(documents, F.col("evidence_source_id") == F.col("s_id"), "left")
    return joined.select(
        F.col("id").alias("relation_id"), F.col("p_id").alias("person_id"), F.col("p_name").alias("person_name"), F.col("p_party").alias("person_party"), F.col("p_position").alias("person_position"), F.col("p_district").alias("person_district"), "company_id",
        F.col("c_name").alias("company_name"), F.col("c_unified_business_no").alias("unified_business_no"), "relation_type", "confidence_level", "evidence_text",
        F.col("s_id").alias("source_document_id"), F.col("s_source_name").alias("source_name"), F.col("s_source_url").alias("source_url"), "verification_status",
        F.col("created_at").alias("relation_created_at"), F.col("updated_at").alias("relation_updated_at"),
    )


def public_regions(t: Tables) -> DataFrame:
    return t["regions"].where("is_public").select(F.col("id").alias("region_id"), "name", "slug", "region_type", "parent_region_id", "official_code", "map_code", "display_order")


def public_elections(t: Tables) -> DataFrame:
    return t["elections"].where("is_public").select(F.col("id").alias("election_id"), "name", "year", "election_type", "voting_date", "status", "source_name", "source_url")


def public_races(t: Tables) -> DataFrame:
    """Public races of public elections; a race without region stays, one of a private region doesn't."""
    elections = renamed(t["elections"].where("is_public"), "e_", "id", "name")
    regions = renamed(t["regions"], "g_", "id", "name", "slug", "is_public")
    joined = t["races"].where("is_public").join(elections, F.col("election_id") == F.col("e_id")).join(regions, F.col("region_id") == F.col("g_id"), "left")
    visible = joined.where(F.col("region_id").isNull() | F.col("g_is_public"))
    return visible.select(
        F.col("id").alias("race_id"), "election_id", F.col("e_name").alias("election_name"), F.col("g_id").alias("region_id"), F.col("g_name").alias("region_name"), F.col("g_slug").alias("region_slug"),
        "race_type", "title", "voting_date", "status", "source_name", "source_url",
    )


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key; the order must be total for the same rows each time."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn_ = 1").drop("rn_")


def public_candidates(t: Tables) -> DataFrame:
    """The newest candidacy of a canonical person, race and number, if it is public: a newer private one hides older ones."""
    mapping = person_canonical_map(t).withColumnRenamed("person_id", "m_id")
    mapped = t["candidates"].join(mapping, F.col("person_id") == F.col("m_id"))
    latest = keep_first(mapped, ["canonical_person_id", "race_id", F.coalesce("candidate_no", F.lit(""))], [F.col("updated_at").desc_nulls_first(), F.desc("id")])
    people = renamed(t["people"].where("is_public"), "p_", "id", "name", "party", "position")
    races = renamed(t["races"].where("is_public"), "r_", "id", "title", "election_id", "region_id")
    elections = renamed(t["elections"].where("is_public"), "e_", "id", "name")
    regions = renamed(t["regions"], "g_", "id", "name", "is_public")
    photos = renamed(public_person_primary_photos(t), "ph_", "person_id", "photo_url", "thumbnail_url", "attribution", "license_type")
    joined = latest.where("is_public").join(people, F.col("canonical_person_id") == F.col("p_id")).join(races, F.col("race_id") == F.col("r_id"))
    joined = joined.join(elections, F.col("r_election_id") == F.col("e_id")).join(regions, F.col("r_region_id") == F.col("g_id"), "left").join(photos, F.col("p_id") == F.col("ph_person_id"), "left")
    return joined.where(F.col("r_region_id").isNull() | F.col("g_is_public")).select(
        F.col("id").alias("candidate_id"), F.col("p_id").alias("person_id"), F.col("p_name").alias("person_name"), F.col("p_party").alias("person_party"), F.col("p_position").alias("person_position"),
        "race_id", F.col("r_title").alias("race_title"), F.col("e_id").alias("election_id"), F.col("e_name").alias("election_name"), F.col("g_id").alias("region_id"),
        F.col("g_name").alias("region_name"), "party", "candidate_no", "registration_status", "source_name", "source_url", F.col("ph_photo_url").alias("primary_photo_url"), F.col("ph_thumbnail_url").alias("primary_photo_thumbnail_url"),
        F.col("ph_attribution").alias("photo_attribution"), F.col("ph_license_type").alias("photo_license_type"),
    )


def public_region_election_summary(t: Tables) -> DataFrame:
    """Each public region's open races counted, and the next of them: of a region one row of sums moves."""
    races = renamed(t["races"].where(F.col("is_public") & F.col("status").isin(*OPEN_RACES)), "r_", "id", "region_id", "election_id", "title", "voting_date")
    elections = renamed(t["elections"].where("is_public"), "e_", "id", "name")
    joined = races.where(F.col("r_region_id").isNotNull()).join(elections, F.col("r_election_id") == F.col("e_id"), "left")
    order = F.struct(*(x for c in ("r_voting_date", "e_name", "r_title", "r_id") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))))  # nulls last
    nearest = joined.groupBy("r_region_id").agg(F.count("r_id").alias("n"), F.min(F.struct(order.alias("o"), F.col("e_id"), F.col("e_name"), F.col("r_voting_date"))).alias("next"))
    return t["regions"].where("is_public").join(nearest, F.col("id") == F.col("r_region_id"), "left").select(
        F.col("id").alias("region_id"), F.col("name").alias("region_name"), F.col("slug").alias("region_slug"), "region_type", F.col("next.e_id").alias("next_election_id"),
        F.col("next.e_name").alias("next_election_name"), F.col("next.r_voting_date").alias("next_voting_date"), F.coalesce("n", F.lit(0)).alias("upcoming_race_count"),
    )


def public_home_election_ticker(t: Tables) -> DataFrame:
    rows = t["elections"].where(F.col("is_public") & F.col("status").isin(*TICKER_STATUSES) & F.col("voting_date").isNotNull())
    return rows.select(F.col("id").alias("election_id"), F.col("name").alias("election_name"), "voting_date", "election_type", "status", "source_name", "source_url").orderBy("voting_date", "election_id")


#: A party's public columns.
PARTY_COLUMNS = (
    "name", "short_name", "slug", "theme_key", "official_site_url", "chairperson_name", "registry_no", "founded_date_text", "filed_date_text", "headquarters_address", "contact_phone", "status", "source_name",
    "source_url", "updated_at",
)


def public_parties(t: Tables) -> DataFrame:
    return t["parties"].where("is_public").select(F.col("id").alias("party_id"), *PARTY_COLUMNS)


#: A year's figures of a party and where they come from.
FINANCE_COLUMNS = (
    "income_total", "expense_total", "balance_amount", "individual_donation_total", "business_donation_total", "civil_group_donation_total", "anonymous_donation_total", "other_income_total", "source_name",
    "source_url", "updated_at",
)


def public_party_finance_summaries(t: Tables) -> DataFrame:
    parties = renamed(t["parties"].where("is_public"), "p_", "id", "name")
    joined = t["party_finance_summaries"].where("is_public").join(parties, F.col("party_id") == F.col("p_id"))
    return joined.select("party_id", F.col("p_name").alias("party_name"), "report_year", *FINANCE_COLUMNS)


def public_party_company_contribution_summaries(t: Tables) -> DataFrame:
    parties, companies = renamed(t["parties"].where("is_public"), "p_", "id"), renamed(t["companies"].where("is_public"), "c_", "id", "name")
    joined = t["party_company_contribution_summaries"].where("is_public").join(parties, F.col("party_id") == F.col("p_id")).join(companies, F.col("company_id") == F.col("c_id"))
    return joined.select("party_id", "company_id", F.col("c_name").alias("company_name"), "report_year", "amount_total", "donation_count", "confidence_level", "source_name", "source_url", "reviewed_at")


def public_person_claims(t: Tables) -> DataFrame:
    mapping = person_canonical_map(t).withColumnRenamed("person_id", "m_id")
    people = t["people"].where("is_public").select(F.col("id").alias("p_id"))
    claims = t["person_claims"].where(published()).join(mapping, F.col("person_id") == F.col("m_id")).join(people, F.col("canonical_person_id") == F.col("p_id"), "left_semi")
    return claims.select(F.col("id").alias("claim_id"), F.col("canonical_person_id").alias("person_id"), "claim_type", "claim_value", "claim_json", "confidence_level", "review_score", "source_name", "source_url", "updated_at")


def public_person_identity_sources(t: Tables) -> DataFrame:
    mapping = person_canonical_map(t).withColumnRenamed("person_id", "m_id")
    people = renamed(t["people"].where("is_public"), "p_", "id", "name")
    kept = ("source_type", "source_name", "source_url", "raw_name", "normalized_name", "party", "position", "district", "election_year", "confidence_suggestion", "updated_at")
    sources = renamed(t["source_people"].where("is_public"), "s_", "id", *kept)
    matches = t["person_identity_matches"].where(F.col("match_status") == "auto_matched").select("person_id", "source_person_id", "match_status", "score")
    joined = matches.join(sources, F.col("source_person_id") == F.col("s_id")).join(mapping, F.col("person_id") == F.col("m_id")).join(people, F.col("canonical_person_id") == F.col("p_id"))
    return joined.select(
        F.col("s_id").alias("identity_source_id"), F.col("p_id").alias("person_id"), F.col("p_name").alias("person_name"), *(F.col(f"s_{c}").alias(c) for c in kept), "match_status", F.col("score").alias("match_score")
    )


def person_claim_review_queue(t: Tables) -> DataFrame:
    sources = renamed(t["source_people"], "s_", "id", "raw_name", "normalized_name")
    rows = t["person_claims"].where(F.col("review_status").isin(*REVIEWABLE)).join(sources, F.col("source_person_id") == F.col("s_id"), "left")
    out = rows.select(
        F.col("id").alias("claim_id"), "person_id", "source_person_id", F.col("s_raw_name").alias("raw_name"), F.col("s_normalized_name").alias("normalized_name"), "claim_type", "claim_value", "claim_json",
        "confidence_level", "review_score", "review_status", "visibility", "source_name", "source_url", "scoring_version", "scoring_reasons", "updated_at",
    )
    return out.orderBy(F.desc("review_score"), F.desc("updated_at"), "claim_id")


def identity_probable_match_queue(t: Tables) -> DataFrame:
    told = ("party", "position", "district")
    sources, people = renamed(t["source_people"], "s_", "id", "source_person_key", "raw_name", "election_year", *told), renamed(t["people"], "p_", "id", "name", *told)
    matches = t["person_identity_matches"].where(F.col("match_status") == "probable_match")
    joined = matches.join(sources, F.col("source_person_id") == F.col("s_id")).join(people, F.col("person_id") == F.col("p_id"))
    out = joined.select(
        F.col("id").alias("match_id"), "source_person_id", F.col("s_source_person_key").alias("source_person_key"), F.col("s_raw_name").alias("raw_name"), *(F.col(f"s_{c}").alias(f"source_{c}") for c in told),
        F.col("s_election_year").alias("election_year"), "person_id", F.col("p_name").alias("person_name"), *(F.col(f"p_{c}").alias(f"person_{c}") for c in told), "score", "match_method", "match_reason", "evidence_json",
        "updated_at",
    )
    return out.orderBy(F.desc("score"), "election_year", "raw_name", "match_id")


#: States of a match that a reviewer hasn't settled.
OPEN_MATCHES = ("possible_match", "probable_match")


def identity_unmatched_source_people(t: Tables) -> DataFrame:
    """Source people without a confirmed match, with their best score and the lexically first open status."""
    matches = t["person_identity_matches"].select(F.col("source_person_id").alias("m_source"), "match_status", "score")
    confirmed = matches.where(F.col("match_status") == "auto_matched").select("m_source")
    best = matches.groupBy("m_source").agg(F.max("score").alias("best"), F.min(F.when(F.col("match_status").isin(*OPEN_MATCHES), F.col("match_status"))).alias("open_status"))
    left = t["source_people"].join(confirmed, F.col("id") == F.col("m_source"), "left_anti")
    joined = left.join(best, F.col("id") == F.col("m_source"), "left")
    kept = ("source_person_key", "source_type", "source_name", "source_url", "raw_name", "normalized_name", "party", "position", "district", "election_year", "confidence_suggestion", "updated_at")
    return joined.select(F.col("id").alias("source_person_id"), *kept, F.coalesce("best", F.lit(0)).alias("best_match_score"), F.coalesce("open_status", F.lit("unmatched")).alias("review_status"))


#: A lead's columns in the review queue, beside its id and the person's.
LEAD_COLUMNS = (
    "lead_key", "source_type", "source_name", "source_url", "court_name", "case_year", "case_code", "case_number", "judgment_date", "case_type", "reason", "title", "summary", "raw_name", "normalized_name",
    "match_score", "match_status", "confidence_level", "review_status", "review_note", "updated_at",
)


def legal_record_review_queue(t: Tables) -> DataFrame:
    told = ("name", "party", "position", "district")
    people = renamed(t["people"], "p_", "id", *told)
    leads = t["legal_record_leads"].where(F.col("review_status").isin(*REVIEWABLE) & ~F.col("is_public")).join(people, F.col("matched_person_id") == F.col("p_id"), "left")
    out = leads.select(F.col("id").alias("lead_id"), *LEAD_COLUMNS, F.col("matched_person_id").alias("person_id"), *(F.col(f"p_{c}").alias(f"person_{c}") for c in told))
    return out.orderBy(F.desc("match_score"), F.desc("updated_at"), "lead_id")


#: Views that readers may use, and those that only reviewers may.
PUBLIC_VIEWS: dict[str, Callable[[Tables], DataFrame]] = {
    f.__name__: f
    for f in (
        public_people, public_companies, public_relation_details, public_regions, public_elections, public_races, public_candidates, public_region_election_summary, public_home_election_ticker,
        public_person_primary_photos, public_parties, public_party_finance_summaries, public_party_company_contribution_summaries, public_person_claims, public_person_identity_sources,
    )
}
INTERNAL_VIEWS: dict[str, Callable[[Tables], DataFrame]] = {
    f.__name__: f for f in (person_canonical_map, person_claim_review_queue, identity_probable_match_queue, identity_unmatched_source_people, legal_record_review_queue)
}


def public_view(name: str, t: Tables) -> DataFrame:
    """A view by name; raises for names that aren't public views."""
    if name not in PUBLIC_VIEWS:
        raise KeyError(f"not a public view: {name}")
    return PUBLIC_VIEWS[name](t)


def register_public_views(t: Tables) -> list[str]:
    """Registers all public views for SQL; gives their names."""
    for name, view in PUBLIC_VIEWS.items():
        view(t).createOrReplaceTempView(name)
    return list(PUBLIC_VIEWS)
