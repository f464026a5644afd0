"""The staging importer: privacy scan, validation of change sets, promotion of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.functions import text as T
from lakemill.operators.contracts import ENUMS
from lakemill.session import checkpoint

#: Patterns of personal data, with the names of their rules.
RISK_PATTERNS = {
    "national_id": r"\b[A-Z][12]\d{8}\b",
    "mobile_phone": r"\b09\d{8}\b",
    "landline_phone": r"\b0\d{1,2}-?\d{6,8}\b",
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "birthday": r"\b(19|20)\d{2}[-/]\d{1,2}[-/]\d{1,2}\b",
    "full_address": r"\b.+(?:縣|市).+(?:區|鄉|鎮|市).+(?:路|街|大道).+(?:號)\b",
}
MINOR = "未成年子女"
ACTIONS = ("create_raw_source_record", "create_relation_candidate", "create_company_candidate", "create_person_candidate")


def risks(x: Column) -> Column:
    """Names of the rules that a text matches, in order."""
    # Only texts that can match are tried: the address pattern starts anew at every word, an address of mail has its sign.
    gates = {"full_address": (x.contains("縣") | x.contains("市")) & x.contains("號"), "email": x.contains("@")}
    hits = [F.when(gates[n] & x.rlike(p) if n in gates else x.rlike(p), F.lit(n)) for n, p in RISK_PATTERNS.items()]
    return F.array_compact(F.array(*hits, F.when(x.contains(MINOR), F.lit("minor_child_reference"))))


def combined(*columns: str) -> Column:
    return F.concat_ws(" ", *(T.text(c) for c in columns))


def scanned(rows: DataFrame) -> DataFrame:
    """Rows with the rules that their texts match, as scan_; a generator works them out once, whatever asks for them."""
    scan = risks(combined("person_name", "company_name", "evidence_text", "source_name", "source_url"))
    return rows.select("*", F.explode(F.array(scan)).alias("scan_"))


def item_errors(changes: DataFrame) -> DataFrame:
    """Each change item with its position and messages of all it breaks."""
    changes, scan = scanned(changes), F.col("scan_")
    blank = T.is_blank
    prefix = F.concat(F.lit("changes["), F.col("position").cast("string"), F.lit("]: "))
    rules = [
        (~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), F.concat(F.lit("action not allowed: "), T.text("action"))),
        ((F.col("action") == "create_relation_candidate") & blank("person_name"), F.lit("personName is required for create_relation_candidate.")),
        ((F.col("action") == "create_person_candidate") & blank("person_name"), F.lit("personName is required for create_person_candidate.")),
        (F.col("action").isin("create_relation_candidate", "create_company_candidate") & blank("company_name"), F.lit("companyName is required.")),
        (blank("evidence_text"), F.lit("evidenceText is required.")),
        (blank("source_name") & blank("source_url"), F.lit("sourceName or sourceUrl is required.")),
        (blank("source_type"), F.lit("sourceType is required.")),
        (~F.coalesce(F.col("confidence_suggestion").isin("A", "B", "C", "D"), F.lit(False)), F.concat(F.lit("confidenceSuggestion must be A/B/C/D: "), T.text("confidence_suggestion"))),
        (~F.coalesce(F.col("review_status") == "pending", F.lit(False)), F.lit("reviewStatus must be pending.")),
        (F.coalesce("is_public", F.lit(False)), F.lit("isPublic must be false.")),
        (~blank("guessed_relation_type") & ~F.col("guessed_relation_type").isin(*ENUMS["relation_type"]), F.concat(F.lit("guessedRelationType is not in whitelist: "), T.text("guessed_relation_type"))),
        (~blank("unified_business_no") & ~F.col("unified_business_no").rlike(r"^\d{8}$"), F.lit("unifiedBusinessNo must be 8 digits.")),
        (F.size(scan) > 0, F.concat(F.lit("sensitive data detected ("), F.array_join(scan, ", "), F.lit(")"))),
    ]
    errors = F.array_compact(F.array(*(F.when(c, F.concat(prefix, m)) for c, m in rules)))
    return changes.select("position", errors.alias("errors"))


def promotion_errors(candidates: DataFrame) -> DataFrame:
    """Each relation candidate with what speaks against promoting it. Level D is never promoted."""
    blank = T.is_blank
    candidates, scan = scanned(candidates), F.col("scan_")
    level = F.upper(T.text("confidence_suggestion"))
    rules = [
        (blank("person_name"), F.lit("person_name cannot be blank")), (blank("company_name"), F.lit("company_name cannot be blank")),
        (F.lower(T.text("review_status")) != "pending", F.lit("candidate review_status must be pending")),
        (~F.coalesce(F.col("guessed_relation_type").isin(*ENUMS["relation_type"]), F.lit(False)), F.lit("guessed_relation_type is not in allowlist")),
        (level == "D", F.lit("confidence_suggestion D cannot be promoted")),
        ((level != "D") & ~F.coalesce(F.col("confidence_suggestion").isin("A", "B", "C"), F.lit(False)), F.lit("confidence_suggestion must be A, B, or C")),
        (blank("evidence_text"), F.lit("evidence_text cannot be blank")),
        (blank("source_url") & F.col("source_record_id").isNull(), F.lit("source_url or source_record_id is required")),
        (F.size(scan) > 0, F.concat(F.lit("privacy risk detected: "), F.array_join(scan, ", "))),
    ]
    return candidates.select("id", F.array_compact(F.array(*(F.when(c, m) for c, m in rules))).alias("errors"))


def _companies_of(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Candidates (id, place, company_name, number) with the company that each reuses or makes: company_id and company_new.

    As if candidates were taken one by one in the order of place: a company of
    the same number is reused (the oldest), else one of the same name, else one
    is made, which later candidates may reuse. In each round all that depend on
    no undecided candidate are decided, at least the first of all; rounds are
    few, as a candidate only waits where names and numbers cross.
    """
    known = companies.select(F.lit("0").alias("k_place"), F.col("id").alias("k_id"), F.col("name").alias("k_name"), F.nullif(F.trim("unified_business_no"), F.lit("")).alias("k_number"))
    open_, done = rows, None
    while True:
        first = lambda key: F.min("place").over(Window.partitionBy(key))
        oldest = F.min(F.struct("k_place", "k_id"))
        by_number = known.where("k_number IS NOT NULL").groupBy("k_number").agg(oldest.alias("n_"))
        by_name = known.groupBy("k_name").agg(oldest.alias("m_"))
        seen = open_.withColumns({"number_first": F.when(F.col("number").isNotNull(), first("number")), "name_first": first("company_name")})
        seen = seen.join(by_number, F.col("number") == F.col("k_number"), "left").join(by_name, F.col("company_name") == F.col("k_name"), "left")
        waits_number, waits_name = F.coalesce(F.col("number_first") < F.col("place"), F.lit(False)), F.col("name_first") < F.col("place")
        told_number, told_name = F.coalesce(F.col("n_.k_place") < F.col("place"), F.lit(False)), F.coalesce(F.col("m_.k_place") < F.col("place"), F.lit(False))
        found = F.when(told_number, F.col("n_.k_id")).when(~waits_number & told_name, F.col("m_.k_id"))
        makes = ~told_number & ~waits_number & ~told_name & ~waits_name
        step = checkpoint(seen.select(*rows.columns, F.coalesce(found, F.when(makes, F.concat(F.lit("company-"), T.hash_id("company_name")))).alias("company_id"), F.coalesce(makes, F.lit(False)).alias("company_new")))
        settled = step.where("company_id IS NOT NULL")
        done = settled if done is None else done.unionByName(settled)
        open_ = step.where("company_id IS NULL").drop("company_id", "company_new")
        if open_.isEmpty():
            return done
        known = known.unionByName(settled.where("company_new").select(F.col("place").alias("k_place"), F.col("company_id").alias("k_id"), F.col("company_name").alias("k_name"), F.col("number").alias("k_number")))


def promotion(candidates: DataFrame, people: DataFrame, companies: DataFrame, documents: DataFrame, relations: DataFrame, at: str, by: str = "local-admin") -> dict[str, DataFrame]:
    """What promoting all candidates that may be promoted adds and changes, table by table.

    As if they were promoted one by one in the order of their ids. A person is
    reused by name, a company by its business number, else by name, a public
    source document by the raw record it was made of, a relation by person,
    company, type and document; what is missing is made, once. ``candidates``
    gives the new state of the promoted ones. Ids of new rows come from their
    content, so that a run that is repeated on the same tables gives the same
    rows, and one on the tables it has changed gives none: promoted candidates
    are no longer pending. candidates: the columns of promotion_errors and
    unified_business_no, review_note; documents: id, raw_record_id, is_public;
    relations: id, person_id, company_id, relation_type, evidence_source_id.
    """
    fine = promotion_errors(candidates).where(F.size("errors") == 0).select(F.col("id").alias("ok_id"))
    rows = candidates.join(fine, F.col("id") == F.col("ok_id"), "left_semi").withColumn("place", F.concat(F.lit("1"), "id"))  # what is there comes before, at 0
    rows = checkpoint(rows.withColumn("number", F.nullif(F.trim(T.text("unified_business_no")), F.lit(""))))
    first = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy("place")) == 1
    person = people.groupBy(F.col("name").alias("p_name")).agg(F.min("id").alias("p_id"))
    named = rows.join(person, F.col("person_name") == F.col("p_name"), "left")
    named = named.select(*rows.columns, F.coalesce("p_id", F.concat(F.lit("person-"), T.hash_id("person_name"))).alias("person_id"), (F.col("p_id").isNull() & first("person_name")).alias("person_new"))
    company = _companies_of(rows.select("id", "place", "company_name", "number"), companies).select(F.col("id").alias("c_id"), "company_id", "company_new")
    named = named.join(company, F.col("id") == F.col("c_id")).drop("c_id")
    of_raw = documents.where("is_public AND raw_record_id IS NOT NULL").groupBy(F.col("raw_record_id").alias("d_raw")).agg(F.min("id").alias("d_id"))
    named = named.join(of_raw, F.col("source_record_id") == F.col("d_raw"), "left")
    made = F.concat(F.lit("document-"), T.hash_id(F.coalesce("source_record_id", "id")))
    named = named.withColumn("document_new", F.col("d_id").isNull() & (F.col("source_record_id").isNull() | first("source_record_id"))).withColumn("document_id", F.coalesce("d_id", made))
    tie = ("person_id", "company_id", "relation_type", "evidence_source_id")
    known = relations.groupBy(*(F.col(c).alias(f"r_{c}") for c in tie)).agg(F.min("id").alias("r_id"))
    named = named.withColumnsRenamed({"guessed_relation_type": "relation_type", "document_id": "evidence_source_id"})
    on = [F.col(c) == F.col(f"r_{c}") for c in tie]
    named = named.join(known, on, "left").withColumn("relation_new", F.col("r_id").isNull() & first(*tie))
    named = checkpoint(named.withColumn("relation_id", F.coalesce("r_id", F.concat(F.lit("relation-"), T.hash_id(*tie)))))
    url = F.nullif(F.trim(T.text("source_url")), F.lit(""))
    note = F.concat(F.lit(f"promoted_at={at}; relation_id="), F.col("relation_id"))
    old = F.nullif(T.text("review_note"), F.lit(""))
    return {
        "people": named.where("person_new").select(F.col("person_id").alias("id"), F.col("person_name").alias("name"), F.lit(True).alias("is_public")),
        "companies": named.where("company_new").select(F.col("company_id").alias("id"), F.col("company_name").alias("name"), F.col("number").alias("unified_business_no"), url.alias("source_url"), F.lit(True).alias("is_public")),
        "source_documents": named.where("document_new").select(
            F.col("evidence_source_id").alias("id"), F.coalesce(F.nullif(F.trim(T.text("source_type")), F.lit("")), F.lit("manual_review")).alias("source_type"), F.nullif(F.trim(T.text("source_name")), F.lit("")).alias("source_name"),
            url.alias("source_url"), F.col("source_record_id").alias("raw_record_id"), F.lit(True).alias("is_public"),
        ),
        "person_company_relations": named.where("relation_new").select(
            F.col("relation_id").alias("id"), *tie, F.col("confidence_suggestion").alias("confidence_level"), "evidence_text", F.lit("verified").alias("verification_status"), F.lit(True).alias("is_public"),
            F.lit(by).alias("reviewed_by"), F.lit(at).alias("reviewed_at"),
        ),
        "relation_candidates": named.select("id", F.lit("verified").alias("review_status"), F.concat_ws("\n", old, note).alias("review_note"), F.lit(at).alias("updated_at")),
    }


def staged(changes: DataFrame) -> DataFrame:
    """Valid items as rows of the staging tables: ids come from the content, nothing is public, everything is pending."""
    bad = item_errors(changes).where(F.size("errors") > 0).select(F.col("position").alias("b"))
    rows = changes.join(bad, F.col("position") == F.col("b"), "left_anti")
    record = F.concat(F.lit("raw-"), T.hash_id("source_name", "source_url", "evidence_text"))
    return rows.select(
        record.alias("source_record_id"), F.concat(F.lit("candidate-"), T.hash_id("person_name", "company_name", "guessed_relation_type", "evidence_text")).alias("candidate_id"), "person_name", "company_name",
        "guessed_relation_type", "evidence_text", F.lit("pending").alias("review_status"), F.lit(False).alias("is_public"),
    )
