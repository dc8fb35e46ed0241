"""Redaction, its verification, reviews and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import value_key
from veilspark.operators.spans import merge_touching

# Types that must not remain after redaction, and types whose values are looked for in the whole text.
HIGH_RISK = ("ACCESS_CODE", "ADDRESS", "DATE_OF_BIRTH", "EMAIL", "INSURANCE_ID", "MEDICAL_RECORD_NUMBER", "MEMBER_ID", "PATIENT", "REPORT_ID", "PHONE_NUMBER", "SSN", "TRACKING_NUMBER", "US_PHONE_NUMBER")
EXPANDED = ("PERSON", "PATIENT", "DOCTOR", "PROVIDER", "HOSPITAL", "ORGANIZATION", "ADDRESS", "EMAIL", "PHONE_NUMBER", "US_PHONE_NUMBER", "SSN", "MEMBER_ID", "GROUP_NUMBER", "CLAIM_NUMBER", "POLICY_NUMBER", "MEDICAL_RECORD_NUMBER", "BANK_ACCOUNT_NUMBER", "CREDIT_CARD_NUMBER", "PASSPORT_NUMBER", "EMPLOYEE_ID", "INSURANCE_ID", "DOCUMENT_ID")


def redact(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, redacted_text: each union of overlapping spans becomes [REDACTED_TYPE].

    Spans are merged first, so left to right each piece of text is copied once.
    """
    merged = merge_touching(spans.withColumn("page", F.lit(1)))
    per = merged.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "entity_type"))).alias("spans"))
    joined = docs.select("doc_id", "text").join(per, "doc_id", "left")
    s = F.col("spans")
    before = lambda i: F.when(i > 0, F.get(s, i - 1)["end"]).otherwise(F.lit(0))
    pieces = F.transform(s, lambda x, i: F.concat(F.substring(F.col("text"), before(i) + 1, x["start"] - before(i)), F.lit("[REDACTED_"), x["entity_type"], F.lit("]")))
    tail = F.substring(F.col("text"), F.element_at(s, -1)["end"] + 1, F.length("text"))
    return joined.select("doc_id", F.when(F.size(s) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text")).alias("redacted_text"))


def expand_occurrences(docs: DataFrame, spans: DataFrame, bounded: bool = False) -> DataFrame:
    """Spans of every other place where a detected value stands in its document.

    Values of the listed types, or of two words at least, from four characters,
    case-insensitively; ``bounded`` asks for word edges. A document meets its own values only.
    """
    words = F.split(F.trim("value"), r"\s+")
    long_words = (F.size(words) >= 2) & F.forall(words, lambda w: F.length(w) >= 2)
    values = spans.where((F.length("value") >= 4) & (F.col("entity_type").isin(*EXPANDED) | long_words))
    values = values.groupBy("doc_id", F.lower("value").alias("needle")).agg(F.min("entity_type").alias("entity_type"), F.max("confidence").alias("confidence"))
    quoted = F.concat(F.lit("\\Q"), F.replace(F.col("needle"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    edge = F.lit(r"\b" if bounded else "")
    both = values.join(docs.select("doc_id", "text"), "doc_id").withColumn("pattern", F.concat(F.lit(r"(?is)\G(.*?)("), edge, quoted, edge, F.lit(")")))
    found = both.withColumn("gaps", F.expr("regexp_extract_all(text, pattern, 1)")).where(F.size("gaps") > 0)
    n = F.length("needle")
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1) + n, F.lit(0))
    starts = F.aggregate("gaps", F.array().cast("array<int>"), lambda acc, g: F.concat(acc, F.array(last(acc) + F.length(g))))
    at = found.withColumn("start", F.explode(starts))
    return at.select("doc_id", F.lit(1).alias("page"), "start", (F.col("start") + n).alias("end"), "entity_type", F.substring(F.col("text"), F.col("start") + 1, n).alias("value"), "confidence", F.lit("expansion").alias("detector"))


def verify(docs: DataFrame, spans: DataFrame, redacted: DataFrame, residual: DataFrame | None = None) -> DataFrame:
    """doc_id, status, issues: BLOCKED if a span's value is not the text there, a value
    of four characters at least remains as a word, or a high-risk type is still found
    (``residual``: spans detected in the redacted texts)."""
    checked = spans.join(docs.select("doc_id", "text"), "doc_id").join(redacted, "doc_id")
    slice_ = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    low = F.lower("value")
    quoted = F.concat(F.lit("(?is).*\\b\\Q"), F.replace(low, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E\\b.*"))
    remains = (F.length("value") >= 4) & F.expr("redacted_text").rlike("\\S") & F.contains(F.lower("redacted_text"), low)
    exact = remains & F.call_function("regexp_like", F.col("redacted_text"), quoted)
    issues = checked.select("doc_id", F.explode(F.filter(F.array(F.when(value_key(slice_) != value_key(F.col("value")), "SPAN_MISMATCH"), F.when(exact, "VALUE_REMAINS")), lambda x: x.isNotNull())).alias("issue"))
    if residual is not None:
        issues = issues.unionByName(residual.where(F.col("entity_type").isin(*HIGH_RISK)).select("doc_id", F.lit("HIGH_RISK_REMAINS").alias("issue")))
    per = issues.groupBy("doc_id").agg(F.sort_array(F.collect_set("issue")).alias("issues"))
    out = docs.select("doc_id").join(per, "doc_id", "left")
    return out.select("doc_id", F.when(F.size("issues") > 0, "BLOCKED").otherwise("RELEASED").alias("status"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))


def needs_review(confidence: Column) -> Column:
    return confidence < 0.80


def review_queue(entities: DataFrame, reviews: DataFrame) -> DataFrame:
    """A PENDING review for each flagged entity that has none."""
    return entities.where(needs_review(F.col("confidence"))).join(reviews.select("entity_id"), "entity_id", "left_anti").select("entity_id", "doc_id", F.lit("PENDING").alias("status"))


def decide(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviews with the latest decision (entity_id, status, decided_at) in force."""
    last = decisions.groupBy("entity_id").agg(F.max_by("status", "decided_at").alias("new"))
    return reviews.join(last, "entity_id", "left").withColumn("status", F.coalesce("new", "status")).drop("new")


def accepted(entities: DataFrame) -> DataFrame:
    """Entities that neither a model nor a reviewer rejected; an open decision counts as accepted."""
    return entities.where((F.coalesce("decision", F.lit("")) != "REJECTED_BY_AI") & F.coalesce("accepted", F.lit(True)))


def report(entities: DataFrame) -> DataFrame:
    """doc_id, total, pii, phi, pending, detectors, entities: one nested row a document."""
    item = F.struct("page", "start", "end", "entity_type", "value", "confidence")
    return entities.groupBy("doc_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("privacy_category") == "PII").alias("pii"),
        F.count_if(F.col("privacy_category") == "PHI").alias("phi"),
        F.count_if(needs_review(F.col("confidence"))).alias("pending"),
        F.sort_array(F.collect_set("detector")).alias("detectors"),
        F.sort_array(F.collect_list(item)).alias("entities"),
    )


def usage_ledger(calls: DataFrame) -> DataFrame:
    """doc_id, tokens_in, tokens_out, cost over calls (doc_id, tokens_in, tokens_out, cached, rate_in, rate_out per million).

    An unknown rate or cached count makes the document's cost unknown.
    """
    cached = F.col("cached").cast("decimal(20,0)")
    micro = F.col("tokens_in").cast("decimal(20,0)") - cached
    cost = (micro * F.col("rate_in").cast("decimal(12,6)") + F.col("tokens_out").cast("decimal(20,0)") * F.col("rate_out").cast("decimal(12,6)")).cast("decimal(28,6)")
    known = F.col("rate_in").isNotNull() & F.col("rate_out").isNotNull() & F.col("cached").isNotNull()
    return calls.groupBy("doc_id").agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.when(F.bool_and(known), (F.sum(cost).cast("decimal(32,6)") * F.lit(0.000001).cast("decimal(6,6)"))).alias("cost")
    )


def normalize_audits(reports: DataFrame) -> DataFrame:
    """doc_id, accepted, rejected of each report (doc_id, payload as JSON): the objects its audit lists, as JSON texts.

    A payload that is no object, or names another document, has no audit (nulls);
    a missing or odd audit is empty; entries that are no objects go.
    """
    audit = lambda side: F.coalesce(F.from_json(F.get_json_object("payload", f"$.llm_candidate_audit.{side}"), "array<string>"), F.array().cast("array<string>"))
    objects = lambda side: F.filter(audit(side), lambda x: x.rlike(r"^\s*\{"))
    owned = F.coalesce(F.get_json_object("payload", "$.document_id") == F.col("doc_id").cast("string"), F.lit(False))
    return reports.select("doc_id", F.when(owned, objects("accepted")).alias("accepted"), F.when(owned, objects("rejected")).alias("rejected"))


def audit_of(decisions: DataFrame) -> DataFrame:
    """doc_id, accepted, rejected: the values a model's decisions kept and refused, in order of place."""
    item = F.struct("start", "end", "entity_type", "value")
    side = lambda kept: F.transform(F.sort_array(F.collect_list(F.when((F.col("decision") != "REJECT") == kept, item))), lambda x: F.to_json(x))
    return decisions.groupBy("doc_id").agg(side(F.lit(True)).alias("accepted"), side(F.lit(False)).alias("rejected"))
