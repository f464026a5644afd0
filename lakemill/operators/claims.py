"""Claims about people: scoring, typed claims from records, the review workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.functions import text as T
from lakemill.operators.store import deleted
from lakemill.operators.views import REVIEWABLE, published

SENSITIVE = ("legal_case", "family_relation")
CLEAR_TYPES = ("name", "gender", "party", "position", "district", "external_id")
ENTITY_SOURCE = "Wikidata 人物補充資料"
#: Claim types that a verified entity id unlocks.
UNLOCKED = ("external_id", "gender", "birth_date", "education", "experience", "position", "office", "district", "party")
#: Claim types that the entity source may only fill where nothing else tells them.
FALLBACK = ("education", "experience")
TERMINAL_REVIEWS = ("verified", "rejected", "archived")


def claim_score(claim_type: Column, kind: Column, level: Column, matched: Column) -> tuple[Column, Column]:
    """Score of 0 to 100 and the reasons for it, in order."""
    official = T.is_official(kind)
    rules = [
        (level == "A", 45, "A-level source"), (level == "B", 35, "B-level source"), (level == "C", 20, "C-level source"),
        (~F.coalesce(level.isin("A", "B", "C"), F.lit(False)), 10, "D-level source"), (official, 25, "official structured source"), (matched, 15, "linked to canonical person"),
        (claim_type.isin(*CLEAR_TYPES), 10, "low-ambiguity identity field"), (claim_type.isin("education", "experience") & official, 10, "official public profile field"),
        (claim_type.isin(*SENSITIVE), -25, "sensitive claim requires stronger evidence"),
    ]
    score = sum((F.when(c, n).otherwise(0) for c, n, _ in rules), F.lit(0))
    reasons = F.filter(F.array(*(F.when(c, F.lit(why)) for c, _, why in rules)), lambda x: x.isNotNull())
    return F.least(F.lit(100), F.greatest(F.lit(0), score)), reasons


def explode_claims(records: DataFrame, key: str, fields: dict[str, str], matched: Column, threshold: int = 90) -> DataFrame:
    """A claim for each told field of a record (type by field); records have source_type and confidence_level.

    Blank and unknown values make no claim. A matched record's claims are
    verified and public from the threshold on, all else is pending.
    """
    claims = F.array(*(F.struct(F.lit(kind).alias("claim_type"), F.trim(F.col(field).cast("string")).alias("claim_value")) for kind, field in fields.items()))
    rows = records.withColumn("c", F.explode(claims)).where("c.claim_value IS NOT NULL AND c.claim_value NOT IN ('', 'unknown')")
    score, reasons = claim_score(F.col("c.claim_type"), F.col("source_type"), F.col("confidence_level"), matched)
    rows = rows.withColumns({"review_score": score, "scoring_reasons": reasons}).withColumn("ok", matched & (F.col("review_score") >= threshold))
    return rows.select(
        F.concat_ws(":", key, "c.claim_type").alias("claim_key"), "c.claim_type", "c.claim_value", "review_score", "scoring_reasons", F.when(F.col("ok"), "verified").otherwise("pending").alias("review_status"),
        F.when(F.col("ok"), "public").otherwise("review_only").alias("visibility"), F.col("ok").alias("is_public"),
    )


def eligibility(claims: DataFrame, people: DataFrame, least: int = 0) -> DataFrame:
    """Why each reviewable claim may or may not be approved by itself: claim_id, eligible, reason.

    Three sets of keys decide about claims of the entity source: verified ids of
    people, and, for education and experience, what the person's public row
    (``people`` is the public view) or a public claim of another source tells.
    Sensitive types are never eligible.
    """
    public = claims.where(published())
    ids = public.where((F.col("claim_type") == "external_id") & (F.col("source_name") == ENTITY_SOURCE) & F.col("person_id").isNotNull())
    told_id = F.upper(F.nullif(F.regexp_extract(T.text("claim_value"), r"(?i)^wikidata:(Q\d+)$", 1), F.lit("")))
    ids = ids.select("person_id", F.explode(F.array(told_id, T.qid_of("claim_json"))).alias("q")).where("q IS NOT NULL")
    verified = ids.select(F.concat_ws(":", "person_id", "q").alias("v_key")).distinct()
    told = people.select("person_id", F.explode(F.array(*(F.when(~T.is_blank(c), F.lit(c)) for c in FALLBACK))).alias("f")).where("f IS NOT NULL")
    told = told.select(F.concat_ws(":", "person_id", "f").alias("f_key"))
    others = public.where(F.col("claim_type").isin(*FALLBACK) & ~F.col("source_name").eqNullSafe(F.lit(ENTITY_SOURCE)))
    others = others.select(F.concat_ws(":", "person_id", "claim_type").alias("o_key")).distinct()
    rows = claims.where(F.col("review_status").isin(*REVIEWABLE))
    key, qid = F.when(F.col("person_id").isNotNull() & F.col("claim_type").isin(*FALLBACK), F.concat_ws(":", "person_id", "claim_type")), T.qid_of("claim_json")
    rows = rows.withColumns({"key": key, "id_key": F.when(F.col("person_id").isNotNull() & qid.isNotNull(), F.concat_ws(":", "person_id", qid))})
    rows = rows.join(verified, F.col("id_key") == F.col("v_key"), "left").join(told, F.col("key") == F.col("f_key"), "left").join(others, F.col("key") == F.col("o_key"), "left")
    matched = F.get_json_object("claim_json", "$.identityMatch.status") == "matched"
    outcomes = [
        (F.col("claim_type").isin(*SENSITIVE), False, "blocked-sensitive-claim-type"),
        (F.coalesce("review_score", F.lit(0)) < least, False, "below-min-score"),
        (~F.col("source_name").eqNullSafe(F.lit(ENTITY_SOURCE)), True, "non-wikidata-non-sensitive"),
        (~F.col("claim_type").isin(*UNLOCKED), False, "wikidata-claim-type-not-auto-unlocked"),
        (F.col("f_key").isNotNull(), False, "wikidata-fallback-skipped-public-field-exists"),
        (F.col("o_key").isNotNull(), False, "wikidata-fallback-skipped-primary-claim-exists"),
        (F.col("id_key").isNull(), False, "wikidata-missing-person-or-qid"),
        (F.col("v_key").isNotNull(), True, "wikidata-verified-external-id-unlocked"),
        (F.coalesce(matched, F.lit(False)), True, "wikidata-identity-match-auto-unlocked"),
    ]
    reason = T.first_of([(c, why) for c, _, why in outcomes], "wikidata-external-id-not-verified")
    eligible = T.first_of([(c, yes) for c, yes, _ in outcomes], False)
    return rows.select(F.col("id").alias("claim_id"), "claim_type", eligible.alias("eligible"), reason.alias("reason"))


#: Fixed value: what is noted with a claim that was approved by itself.
AUTO_REASON = "low-sensitivity claim auto-approved after verified external_id or matched identity evidence for the same person and source entity"


def approve_eligible(claims: DataFrame, verdicts: DataFrame, version: str = "auto-review", reviewed_at: str | None = None) -> DataFrame:
    """Claims after one pass of automatic review. A set-based pass leaves nothing eligible, so no batches are needed.

    Only approved rows change: state, visibility, version, times, and
    scoring_reasons, a JSON array that gets one more entry (another value than an
    array is replaced). Columns that the table lacks are added, null elsewhere.
    """
    ok = verdicts.where("eligible").select(F.col("claim_id").alias("ok_id")).distinct().withColumn("ok_", F.lit(True))
    rows = claims.join(ok, F.col("id") == F.col("ok_id"), "left").drop("ok_id").withColumn("ok_", F.coalesce("ok_", F.lit(False)))
    now = F.lit(reviewed_at) if reviewed_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    entry = F.to_json(F.struct(F.lit(version).alias("version"), F.lit(AUTO_REASON).alias("reason"), now.alias("reviewedAt")))
    kinds = {f.name: f.dataType for f in claims.schema}
    told = F.col("scoring_reasons") if "scoring_reasons" in kinds else F.lit(None)
    told = F.trim(F.to_json(told) if "scoring_reasons" in kinds and kinds["scoring_reasons"].typeName() == "array" else told.cast("string"))
    listed = told.rlike(r"(?s)^\[.*\S.*\]$") & ~told.rlike(r"(?s)^\[\s*\]$")
    reasons = F.when(listed, F.concat(F.substr(told, F.lit(1), F.char_length(told) - 1), F.lit(","), entry, F.lit("]"))).otherwise(F.concat(F.lit("["), entry, F.lit("]")))
    changes = {"review_status": F.lit("verified"), "visibility": F.lit("public"), "is_public": F.lit(True), "scoring_version": F.lit(version), "scoring_reasons": reasons, "auto_reviewed_at": now}
    if "updated_at" in kinds and kinds["updated_at"].typeName() in ("string", "timestamp"):
        changes["updated_at"] = now.cast(kinds["updated_at"])
    old = {c: (told if c == "scoring_reasons" else F.col(c)) if c in kinds else F.lit(None) for c in changes}
    out = {c: F.when(F.col("ok_"), v).otherwise(old[c]) for c, v in changes.items()}
    return rows.select(*(out[c].alias(c) if c in out else F.col(f"`{c}`") for c in claims.columns), *(out[c].alias(c) for c in out if c not in kinds))


def sensitive_public_count(claims: DataFrame) -> DataFrame:
    """Public claims of sensitive types; must be the same before and after automatic review."""
    return claims.where(F.col("claim_type").isin(*SENSITIVE) & F.col("is_public")).agg(F.count("*").alias("n"))


def keep_review_state(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """Fresh claims with the terminal state of an existing one: by claim key, else rejected person and entity, else the same statement.

    Verified A claims of external ids replace an archived state. Of several
    existing rows for a key the newest counts.
    """
    terminal = existing.where(F.col("review_status").isin(*TERMINAL_REVIEWS))
    state = F.struct("review_status", "visibility", "is_public")

    def latest(rows: DataFrame, key: Column, name: str) -> DataFrame:
        return rows.withColumn("k", key).where("k IS NOT NULL").groupBy(F.col("k").alias(f"k_{name}")).agg(F.max_by(state, F.struct("updated_at", "id")).alias(name))

    qid = T.qid_of("claim_json")
    entity = F.when(F.col("person_id").isNotNull() & qid.isNotNull(), F.concat_ws(":", "person_id", qid))
    statement = F.when(entity.isNotNull(), F.concat_ws(":", "person_id", qid, "claim_type", T.text("claim_value")))

    def spread(key: Column) -> Column:
        """A key that stays apart for each claim without one: an outer join sends all nulls to the same task."""
        return F.coalesce(key, F.concat(F.lit("\x00"), F.coalesce("id", F.lit(""))))

    joined = fresh.withColumns({"f_key": spread(F.col("claim_key")), "f_entity": spread(entity), "f_statement": spread(statement)})
    joined = joined.join(latest(terminal, F.col("claim_key"), "s1"), F.col("f_key") == F.col("k_s1"), "left")
    joined = joined.join(latest(terminal.where(F.col("review_status") == "rejected"), entity, "s2"), F.col("f_entity") == F.col("k_s2"), "left")
    joined = joined.join(latest(terminal, statement, "s3"), F.col("f_statement") == F.col("k_s3"), "left").withColumn("s", F.coalesce("s1", "s2", "s3"))
    revived = (F.col("claim_type") == "external_id") & (F.col("confidence_level") == "A") & published() & (F.col("s.review_status") == "archived")
    kept = F.col("s").isNotNull() & ~F.coalesce(revived, F.lit(False))
    return joined.select(*(F.when(kept, F.col(f"s.{c}")).otherwise(F.col(c)).alias(c) if c in ("review_status", "visibility", "is_public") else F.col(c) for c in fresh.columns))


def spread_terminal_states(claims: DataFrame) -> DataFrame:
    """Pending claims that say what a settled one of the same person and entity says, with that one's status; the first settled one counts."""
    qid = T.qid_of("claim_json")
    keyed = claims.withColumn("k", F.when(F.col("person_id").isNotNull() & qid.isNotNull(), F.concat_ws(":", "person_id", qid, "claim_type", T.text("claim_value")))).where("k IS NOT NULL")
    first = keyed.where(F.col("review_status").isin(*TERMINAL_REVIEWS)).groupBy(F.col("k").alias("s_k")).agg(F.min_by(F.struct("review_status", "visibility"), "id").alias("s"))
    pending = keyed.where(F.col("review_status").isin(*REVIEWABLE)).join(first, F.col("k") == F.col("s_k"))
    return pending.select(F.col("id").alias("claim_id"), F.col("s.review_status").alias("review_status"), F.col("s.visibility").alias("visibility"))


def missing_match_changes(claims: DataFrame) -> DataFrame:
    """What becomes of entity claims without identity match: restored by a former decision, else held back for more evidence."""
    decision = F.get_json_object("claim_json", "$.reviewDecision.decision")
    missing = claims.where((F.col("source_name") == ENTITY_SOURCE) & F.get_json_object("claim_json", "$.identityMatch.status").isNull())
    open_ = F.col("review_status").isin(*REVIEWABLE)
    action = T.first_of([(open_ & (decision == "reject"), "reject"), (open_ & (decision == "approve"), "approve"), ((F.col("review_status") == "pending") & decision.isNull(), "hold")], None)
    new = T.lookup(action, {"reject": "rejected", "approve": "verified", "hold": "needs_more_evidence"}, None)
    visible = T.lookup(action, {"reject": "private", "approve": "public", "hold": "review_only"}, None)
    return missing.select(F.col("id").alias("claim_id"), action.alias("action"), new.alias("review_status"), visible.alias("visibility"), F.coalesce(action == "approve", F.lit(False)).alias("is_public")).where("action IS NOT NULL")


def public_claim_key(person: str) -> Column:
    return F.concat_ws("|", T.text(person), T.text("claim_type"), T.text("claim_value"), T.text("source_name"))


def merged_claims_to_archive(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Open claims of merged duplicates that the canonical person has in public already."""
    merged = decisions.where(F.col("status") == "verified").select(F.col("duplicate_person_id").alias("d"), F.col("canonical_person_id").alias("canonical"))
    public = claims.where(published()).groupBy(public_claim_key("person_id").alias("p_key")).agg(F.max("id").alias("canonical_claim_id"))
    open_ = claims.where(F.col("review_status").isin(*REVIEWABLE)).join(merged, F.col("person_id") == F.col("d"))
    joined = open_.withColumn("key", public_claim_key("canonical")).join(public, F.col("key") == F.col("p_key"))
    return joined.select(F.col("id").alias("claim_id"), F.col("canonical").alias("canonical_person_id"), "canonical_claim_id")


def official_ids_to_promote(claims: DataFrame) -> DataFrame:
    """External ids of an official source, by its name and the id's prefix, that aren't public yet."""
    official = (F.col("source_name").contains("中央選舉委員會") & F.col("claim_value").startswith("cec-")) | (F.col("source_name").contains("立法院開放資料") & F.col("claim_value").startswith("ly-legislator-"))
    return claims.where((F.col("claim_type") == "external_id") & official & ~published()).select(F.col("id").alias("claim_id"), "claim_value", "source_name")


def visible_profile_claims(claims: DataFrame, most: int = 12) -> DataFrame:
    """A person's public claims for the profile page: no names, ids or those with a section of their own; each statement once."""
    hidden = ("name", "external_id", "education", "experience", "platform", "finance_summary", *SENSITIVE)
    rows = claims.where(~F.col("claim_type").isin(*hidden))
    once = Window.partitionBy("person_id", "claim_type", "claim_value").orderBy(F.desc("review_score"), "claim_id")
    first = rows.withColumn("seen", F.row_number().over(once)).where("seen = 1")
    order = Window.partitionBy("person_id").orderBy(F.desc("review_score"), "claim_type", "claim_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("person_id", "rank", "claim_id", "claim_type", "claim_value")


def of_source_only(sources: tuple[str, ...]) -> Column:
    """Claims without a person, of these sources."""
    return F.col("person_id").isNull() & F.col("source_name").isin(*sources)


def source_only_claims(claims: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """What stays after claims without a person of these sources are deleted."""
    return deleted(claims, of_source_only(sources))


def malformed_keys(claims: DataFrame) -> DataFrame:
    """Claims whose key has three colons and more: to be archived."""
    return claims.where(F.length("claim_key") - F.length(F.replace(F.col("claim_key"), F.lit(":"), F.lit(""))) >= 3).select(F.col("id").alias("claim_id"), F.lit("archived").alias("review_status"))
