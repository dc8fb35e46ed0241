"""Which spans hold what their type says, decided by tables of rules on columns.

A span is aligned with its text, freed of labels, checked against words that are no
values, given a more exact type where its value shows one, and kept if the rule of
its type holds. Spans meet their text once; all else is one projection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import tables as T
from veilspark.functions import vocabulary as V
from veilspark.functions.dates import is_real_date, is_real_date_range
from veilspark.functions.text import semantic_key
from veilspark.operators.store import fence

# blanks as a class whose usual characters need one look each, and as characters
_BLANK = r" \t\n\x0B\f\r\x{1c}\x{1d}\x{1e}\x{1f}\x{85}\x{a0}[\x{2000}-\x{3000}&&[\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]]"
_BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u3000"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def _squeeze(c: Column) -> Column:
    return _strip(F.regexp_replace(c, f"[{_BLANK}]+", " "))


def _cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end], ends clipped to the text."""
    start = F.greatest(start, F.lit(0))
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def align(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans whose text says their value, without a label in front and blanks at the ends; adds ``text``."""
    out = spans.join(docs.select("doc_id", "text"), "doc_id").where("start >= 0 and start < end and end <= length(text)")
    out = out.withColumn("span", _cut(F.col("text"), F.col("start"), F.col("end")))
    out = out.withColumn("start", F.col("start") + F.length(F.regexp_extract("span", V.SPAN_LABEL, 0))).withColumn("span", F.regexp_replace("span", V.SPAN_LABEL, ""))
    says = _squeeze(F.col("span"))
    out = fence(out).where((says != "") & ((says == _squeeze(F.col("value"))) | (says == _squeeze(F.regexp_replace("value", V.SPAN_LABEL, "")))))
    out = out.withColumn("start", F.col("start") + F.length("span") - F.length(F.ltrim(F.col("span"), F.lit(_BLANKS)))).withColumn("value", _strip(F.col("span")))
    return out.withColumn("end", F.col("start") + F.length("value")).drop("span")


def known_types(spans: DataFrame) -> DataFrame:
    """Spans of known types, under the name the type stands for."""
    names = F.create_map(*[F.lit(x) for kv in V.TYPE_ALIASES.items() for x in kv])
    raw = F.upper(F.trim("entity_type"))
    return spans.withColumn("entity_type", F.coalesce(F.try_element_at(names, raw), raw)).where(F.col("entity_type").isin(*sorted(V.KNOWN)))


def cut_labels(spans: DataFrame) -> DataFrame:
    """Names end before a second line that is a label; labels in front of values go."""
    lines = F.filter(F.transform(F.split("value", r"\R"), _strip), lambda x: x != "")
    two = F.col("entity_type").isin(*V.NAME_TYPES) & F.coalesce(F.get(lines, 1).rlike(V.SECOND_LINE_LABEL), F.lit(False))
    out = spans.withColumn("value", F.when(two, F.get(lines, 0)).otherwise(F.col("value")))
    rest = _strip(F.regexp_replace("value", V.VALUE_LABEL, ""))
    label = F.when(rest != "", F.length(F.regexp_extract("value", V.VALUE_LABEL, 0))).otherwise(0)
    out = out.withColumn("label", label).withColumn("value", F.when(label > 0, rest).otherwise(F.col("value"))).withColumn("start", F.col("start") + F.col("label"))
    return out.withColumn("end", F.col("start") + F.length("value")).drop("label")


def is_noise(t: Column, value: Column) -> Column:
    """Values that are words of forms and reports, units or sentences rather than what their type says."""
    clean = F.regexp_replace(_strip(value), V.BULLET, "")
    low, words = F.lower(clean), F.size(F.filter(F.split(_strip(clean), f"[{_BLANK}]+"), lambda w: w != ""))
    any_type = low.isin(*V.NO_VALUE, *V.NO_IDENTIFIER) | low.rlike(V.AUDIT_WORDS) | ((words > 4) & ~t.isin("ADDRESS", "LOCATION"))
    person = t.isin(*V.NAME_TYPES) & low.rlike(V.NO_PERSON)
    document = t.isin("DOCUMENT_ID", "RX_NUMBER", "DEVICE_ID") & (low.rlike(V.UNIT) | low.isin("access credential", "diagnosis", "prescription", "confidential record"))
    named = t.isin(*V.GENERIC_TYPES, "HOSPITAL", "MEDICAL_FACILITY", "HEALTHCARE_ORGANIZATION", "VITAL_SIGN", "LAB", "PROCEDURE", "SYMPTOM", "CLINICAL_MEASUREMENT", "MEDICATION", "CLINICAL_NOTES") | t.rlike("PERSON|NAME|PHONE|NOTE|DIAGNOSIS")
    words_of_forms = low.isin(*V.NO_NAME) | F.regexp_replace(low, "[^a-z0-9]", "").isin(*V.NO_NAME_SQUEEZED) | _squeeze(clean).rlike(V.KEPT_BULLET) | _squeeze(clean).rlike(V.HEADING)
    return any_type | person | document | (named & words_of_forms)


def label_before(text: Column, start: Column, pattern: str, reach: int = 100) -> Column:
    return _cut(text, start - reach, start).rlike(pattern)


def is_icd10(v: Column) -> Column:
    return _strip(v).rlike(V.ICD10)


def is_cpt(v: Column) -> Column:
    return F.regexp_replace(_strip(v), r"(?i)^CPT\s*[:#-]?\s*", "").rlike(V.CPT)


def in_cpt_context(text: Column, start: Column, end: Column) -> Column:
    """A label of procedure codes around the span, or a date before and a diagnosis code behind it on its line."""
    left = F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)
    right = F.substring_index(F.substring(text, end + 1, F.length(text)), "\n", 1)
    return (left.rlike("(?i)" + T.DATE_VALUE_PATTERN) & right.rlike(V.ICD10_WORD)) | _cut(text, start - 180, end + 120).rlike(V.CPT_LABEL)


def is_identifier(t: Column, v: Column) -> Column:
    v = _strip(v)
    prefixed = F.coalesce(*[F.when(t == k, F.upper(v).rlike(f"^(?:{p})")) for k, p in V.IDENTIFIER_PREFIXES.items()], F.lit(False))
    return ~F.trim(F.regexp_replace(F.lower(v), "[^a-z0-9]+", " ")).isin(*V.NO_IDENTIFIER) & v.rlike("^[A-Za-z0-9-]{4,24}$") & (v.rlike("[0-9]") | prefixed)


@dataclass(frozen=True)
class Rule:
    """Types, what must hold of them, and the type that a span gets (its own if null)."""

    types: tuple[str, ...]
    holds: Callable[[int], Column]
    becomes: str | None = None


_t, _v, _text, _start, _end = ((lambda c=c: F.col(c)) for c in ("entity_type", "value", "text", "start", "end"))
_digits = lambda: F.length(F.regexp_replace("value", "[^0-9]", ""))
_opening = lambda: (_t() == "DATE_TIME") & _v().rlike(V.OPENING_TIME) & F.lower(F.concat_ws(" ", _cut(_text(), _start() - 80, _start()), _v(), _cut(_text(), _end(), _end() + 80))).rlike("|".join(V.OPENING_WORDS))
#: Checked in order; a span whose type is listed takes the first rule that holds and goes if none does.
RULES = (
    Rule(("POLICY_NUMBER",), lambda y: label_before(_text(), _start(), V.POLICY_LABEL)),
    Rule(("POLICY_NUMBER",), lambda y: label_before(_text(), _start(), V.CODE_LABEL), "ACCESS_CODE_SHOWN"),
    Rule(V.DATE_TYPES, lambda y: ~_opening() & is_icd10(_v()), "ICD10_CODE"),
    Rule(V.DATE_TYPES, lambda y: ~_opening() & is_cpt(_v()) & in_cpt_context(_text(), _start(), _end()), "CPT_CODE"),
    Rule(V.DATE_TYPES, lambda y: ~_opening() & is_real_date(_v(), y, _t() == "DATE_TIME")),
    Rule(("DATE_RANGE",), lambda y: is_real_date_range(_v(), y)),
    Rule(("ICD10_CODE",), lambda y: is_icd10(_v())),
    Rule(("CPT_CODE",), lambda y: is_cpt(_v()) & in_cpt_context(_text(), _start(), _end())),
    Rule(("ACCESS_CODE", "ACCESS_CODE_SHOWN"), lambda y: _v().rlike("^[A-Za-z0-9][A-Za-z0-9-]{5,30}$") & _v().rlike("[0-9]"), "ACCESS_CODE"),
    Rule(("TRACKING_NUMBER",), lambda y: _digits().between(12, 22)),
    Rule(("REPORT_ID",), lambda y: _v().rlike("^[A-Za-z0-9][A-Za-z0-9-]{5,40}$") & _v().rlike("[0-9]")),
    Rule(V.PHONE_TYPES, lambda y: _digits() >= 7),
    Rule(tuple(V.IDENTIFIER_PREFIXES), lambda y: is_identifier(_t(), _v())),
)
#: Types whose rule says nothing about the value, so a model's word on them stays a model's word.
UNPROVEN = ("POLICY_NUMBER",)


def specialise(spans: DataFrame) -> DataFrame:
    """More exact types by value: clinical terms, insurers, places of care. Adds ``original_type`` and ``proven``."""
    key = semantic_key(_v())
    clinical = F.when(_t().isin(*V.GENERIC_TYPES), F.try_element_at(F.create_map(*[F.lit(x) for kv in V.CLINICAL_VALUES.items() for x in kv]), key))
    owner = F.when((_t() == "ORGANIZATION") & (key == "medicare"), "INSURANCE_PROVIDER").when((_t() == "ORGANIZATION") & key.rlike(V.CARE), "HEALTHCARE_ORGANIZATION")
    out = spans.withColumn("original_type", _t()).withColumn("special", F.coalesce(clinical, owner)).withColumn("proven", F.col("special").isNotNull() | (_t() == "INSURANCE_PROVIDER"))
    return out.withColumn("entity_type", F.coalesce("special", "entity_type")).drop("special")


def by_rules(spans: DataFrame, as_of: int) -> DataFrame:
    """Spans that their type's rule lets pass, under the type it gives. Two rounds: a type that a rule shows must pass its own."""
    for types in (V.IDENTIFIER_PREFIXES.keys() | {x for r in RULES for x in r.types} - {"ACCESS_CODE_SHOWN"}, {"ACCESS_CODE_SHOWN"}):
        listed = _t().isin(*sorted(types))
        choice = F.coalesce(*[F.when(_t().isin(*r.types) & r.holds(as_of), F.lit(r.becomes) if r.becomes else _t()) for r in RULES if types & set(r.types)])
        out = spans.withColumn("choice", F.when(listed, choice).otherwise(_t())).where("choice is not null")
        spans = fence(out.withColumn("proven", F.col("proven") | (listed & ~_t().isin(*UNPROVEN))).withColumn("entity_type", F.col("choice")).drop("choice"))
    return spans


def cap_models(spans: DataFrame, most: float = 0.79) -> DataFrame:
    """A language model's own confidence stays below automatic acceptance unless a rule proved the value."""
    return spans.withColumn("confidence", F.when((F.col("detector") == "llm") & ~F.col("proven"), F.least("confidence", F.lit(most))).otherwise(F.col("confidence")))


def validate(spans: DataFrame, docs: DataFrame, as_of: int) -> DataFrame:
    """Spans that pass, with aligned offsets and values, final types, privacy category, original_type and proven.

    Spans of documents that are not in docs, with null fields or outside of
    their text go; repeated spans are judged alike; no spans give none.
    """
    out = fence(cut_labels(fence(known_types(fence(align(spans, docs))))))
    out = by_rules(fence(specialise(out.where(~is_noise(_t(), _v())))), as_of)
    return cap_models(out).drop("text").withColumn("privacy_category", F.when(F.col("entity_type").isin(*V.HEALTH), "PHI").otherwise("PII"))
