"""From texts to released or blocked redactions with their reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import tables as T
from veilspark.functions import vocabulary as V
from veilspark.operators import detect, documents, redact, rules, spans, taxonomy, validate
from veilspark.operators.store import fence, settle

LEAST = 0.60


@dataclass
class Release:
    spans: DataFrame
    redacted: DataFrame
    status: DataFrame
    reports: DataFrame


def candidates(docs: DataFrame, entities: tuple[str, ...] | None = None) -> DataFrame:
    """Spans of all detectors that need no model, over the pages of whole documents."""
    pages = documents.split_pages(docs)
    found = detect.detect(pages, entities)
    if entities is not None:
        return found
    return found.unionByName(rules.supplements(pages)).unionByName(rules.care_roles(pages)).unionByName(rules.phrases(pages))


def finalize(found: DataFrame, docs: DataFrame, as_of: int, policies: DataFrame | None = None) -> DataFrame:
    """What stands of found spans, in the order: validation, type names, policy, confidence, duplicates, overlaps,
    lines, addresses, names, the safety net, words around, calibration.

    docs may have document_type; without it no policy drops anything.
    """
    # validation judges each span by itself, so the net is a part of what it lets pass
    good = valid = settle(spans.normalize_types(validate.validate(found, docs, as_of).drop("original_type", "proven")))
    if "document_type" in docs.columns:
        typed = settle(valid.join(docs.select("doc_id", "document_type"), "doc_id"))
        good = fence(taxonomy.apply(typed, policies).drop("document_type", "priority", "should_mask"))
    good = spans.calibrate(good.where(F.col("confidence") >= LEAST)).drop("level")
    good = settle(spans.drop_line_crossing(spans.resolve(spans.dedupe(good))))
    good = spans.merge_persons(spans.merge_addresses(good, docs), docs)
    net = valid.where((F.col("detector") == "regex") & F.col("entity_type").isin(*redact.HIGH_RISK)).select(*good.columns)
    every = spans.resolve(spans.dedupe(good.unionByName(net)))
    return spans.calibrate(spans.reclassify(every, docs))


def find_spans(docs: DataFrame, as_of: int, entities: tuple[str, ...] | None = None, policies: DataFrame | None = None) -> DataFrame:
    """Validated, calibrated spans of whole documents that do not overlap."""
    return finalize(settle(candidates(docs, entities)), docs, as_of, policies)


def _residual(text: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    found = detect.detect(text.select("doc_id", F.col("redacted_text").alias("text")), kinds)
    return spans.normalize_types(found).where(F.col("entity_type").isin(*redact.HIGH_RISK))


def _release(docs: DataFrame, as_of: int, rounds: int, entities: tuple[str, ...] | None, policies: DataFrame | None) -> Release:
    found = settle(find_spans(docs, as_of, entities, policies))
    wide = found.select("doc_id", "page", "start", "end", "entity_type", "value", "confidence", "detector")
    text = settle(redact.redact(docs, wide.unionByName(redact.expand_occurrences(docs, wide))))
    kinds = tuple(t for t in T.PATTERNS if V.TYPE_ALIASES.get(t, t) in redact.HIGH_RISK)
    changed = text  # a text that a round left as it was holds no more than that round found
    for _ in range(rounds):
        left = settle(_residual(changed, kinds))
        if left.isEmpty():
            break
        text = settle(redact.redact(text.select("doc_id", F.col("redacted_text").alias("text")), left))
        changed = text.join(left.select("doc_id").distinct(), "doc_id", "left_semi")
    else:
        left = _residual(changed, kinds)
    return Release(found, text, settle(redact.verify(docs, wide, text, left)), redact.report(found))


def release(docs: DataFrame, as_of: int = 2025, rounds: int = 3, entities: tuple[str, ...] | None = None, policies: DataFrame | None = None) -> Release:
    """Detect, redact, redact up to ``rounds`` times what the high-risk patterns still find, verify and report.

    A document is RELEASED only if each span's text was what it says, no value is
    left as a word, and no high-risk pattern matches what is to go out. ``as_of``
    is the year that dates are judged in. A document's result follows from its text and
    type alone, so equal documents are worked through once and each gets the result.
    """
    heads, members = documents.share_copies(docs)
    done = _release(heads, as_of, rounds, entities, policies)
    each = lambda part: members.join(part.withColumnRenamed("doc_id", "head_id"), "head_id").select(*part.columns)
    return Release(*[each(part) for part in (done.spans, done.redacted, done.status, done.reports)])
