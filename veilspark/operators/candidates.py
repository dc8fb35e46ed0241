"""Which candidate spans stand, which wait for a second look, which go.

Candidates carry (doc_id, page, start, end, entity_type, value, confidence,
detector). Decisions are columns; nothing depends on the order in which detectors ran.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import tables as T
from veilspark.functions.text import cosine

NAME = r"^(?:Dr\.?\s+|Mr\.?\s+|Mrs\.?\s+|Ms\.?\s+)?[A-Z][a-z]+(?:\s+[A-Z][a-zA-Z.]+)+$"
LABEL = r"(?i)\b(?:name|patient|doctor|physician|employee|client|subscriber|member|holder|beneficiary|attn|contact|user)\b"
# Types that a zero-shot detector settles at lower confidence.
SETTLED = ("PATIENT", "DOCTOR", "PHYSICIAN", "NURSE", "HEALTHCARE_STAFF", "HOSPITAL", "CLINIC", "MEDICAL_FACILITY", "HEALTHCARE_ORGANIZATION", "INSURANCE_PROVIDER", "SSN", "PASSPORT_NUMBER", "DRIVING_LICENSE")
HIGH_RISK_CUE = r"(?i)\b(?:account|acct|beneficiary|routing|ssn|social security|passport|tax|member|policy|claim|mrn|medical record|dob|date of birth|card|cvv|bank)\b"


def authoritative(detector: Column, kind: Column, confidence: Column, validated: Column | None = None) -> Column:
    """Whether a span is settled: regular expressions and clinical phrases from 0.80, zero-shot from 0.85 or for
    settled types, statistical names only for provider numbers or validated values from 0.85."""
    checked = F.coalesce(validated, F.lit(False)) if validated is not None else F.lit(False)
    by = F.when(detector == "zero_shot", (confidence >= 0.85) | kind.isin(*SETTLED)).when(detector == "ner", (kind == "NPI_NUMBER") | checked & (confidence >= 0.85)).otherwise(F.lit(True))
    return (confidence >= 0.80) & by


def specializes(general: Column, special: Column) -> Column:
    out = F.lit(False)
    for g, kinds in T.ENTITY_SPECIALIZATIONS.items():
        out = out | (general == g) & special.isin(*sorted(kinds))
    return out


def replaces(old: dict[str, Column], new: dict[str, Column], threshold: float = 0.60) -> Column:
    """Whether a candidate takes the place of a known span it repeats (confidence, detector, entity_type of each)."""
    special = specializes(old["entity_type"], new["entity_type"])
    shielded = (old["confidence"] >= 0.80) & (old["detector"] == "regex") & ~special
    upgrade = (old["confidence"] < threshold) & (new["confidence"] >= old["confidence"]) & (new["detector"] != old["detector"])
    return ~shielded & ((new["confidence"] > old["confidence"]) | special & (new["confidence"] >= 0.70) | upgrade)


def _any(c: Column, words: set[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in sorted(words)]), lambda w: c.contains(w))


def quality_gate(candidates: DataFrame, docs: DataFrame, similarity: str = "similarity") -> DataFrame:
    """Adds quality (OBVIOUS_NOISE, HIGH_VALUE, PLAUSIBLE, AMBIGUOUS) and decision.

    ``similarity`` names a column with the candidate's likeness to its type, 0 to 1.
    The first rule that holds decides.
    """
    rows = candidates.join(docs.select("doc_id", "text"), "doc_id")
    key = F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))
    before = F.substring(F.col("text"), F.lit(1), F.col("start"))
    line = F.concat(F.regexp_extract(before, r"([^\n]*)$", 1), F.regexp_extract(F.substring(F.col("text"), F.col("start") + 1, F.length("text")), r"^([^\n]*)", 1))
    label = F.substring(F.col("text"), F.greatest(F.col("start") - 60, F.lit(0)) + 1, F.least(F.col("start"), F.lit(60))).rlike(LABEL)
    t, s, words = F.col("entity_type"), F.col(similarity), F.size(F.split(key, " "))
    generic = t.isin("PERSON", "ORGANIZATION", "LOCATION")
    noise = (
        key.isin(*sorted(T.DATABASE_SENTINELS))
        | key.rlike(r"^(\w+)(?: \1){2,}$")
        | _any(key, T.LANGUAGE_DISCLAIMER_TERMS)
        | F.col("value").rlike(r"[:\-][ \t]*$")
        | generic & (key.isin(*sorted(T.TRANSACTION_TABLE_NOISE | T.STRUCTURAL_TABLE_LABELS)) | line.rlike(r"[|\t]|\s{3,}") & (s < 0.35) & (words <= 3) & ~F.col("value").rlike(NAME))
        | t.isin("PERSON", "LOCATION") & F.col("value").rlike("[0-9]{3,}")
        | (t == "PERSON") & key.isin(*sorted(T.ROLE_WORDS))
    )
    named = t.isin("PERSON", "PATIENT", "DOCTOR", "PHYSICIAN") & (F.col("value").rlike(NAME) | label) & ~key.isin(*sorted(T.ROLE_WORDS))
    quality = F.when(noise, "OBVIOUS_NOISE").when(named, "PLAUSIBLE").when(t.isin(*sorted(T.HIGH_VALUE_IDENTIFIERS)), "HIGH_VALUE").when(s < 0.20, "OBVIOUS_NOISE").when(s >= 0.40, "PLAUSIBLE").otherwise("AMBIGUOUS")
    return rows.withColumn("quality", quality).withColumn("decision", F.when(F.col("quality") == "OBVIOUS_NOISE", "PRE_LLM_REJECT").otherwise("PENDING")).drop("text")


def status(candidates: DataFrame) -> DataFrame:
    """Adds status: LOCKED if settled, else the gate's decision."""
    return candidates.withColumn("status", F.when(authoritative(F.col("detector"), F.col("entity_type"), F.col("confidence")), "LOCKED").otherwise(F.col("decision")))


def routing_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("detector").pivot("status", ["LOCKED", "PENDING", "PRE_LLM_REJECT"]).count().na.fill(0)


def text_vector(c: Column, size: int = 320) -> Column:
    """A text's hashed words (256 places, weight 1) and three-letter pieces (64 places, 0.5), of length one.

    Hashes are the same in every process. Texts without words give zeros.
    """
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_-]+"), F.lit(0))
    whole = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(256)).cast("int"))
    parts = F.flatten(F.transform(words, lambda w: F.when(F.length(w) >= 3, F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: (F.lit(256) + F.pmod(F.xxhash64(F.substring(w, i, F.lit(3))), F.lit(64))).cast("int"))).otherwise(F.array().cast("array<int>"))))
    count = lambda places, i: F.size(F.filter(places, lambda p: p == i))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: count(whole, i) + 0.5 * count(parts, i))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def compatibility(value: Column, context: Column, anchor: Column) -> Column:
    """0.6 x likeness of value and context to the type's description + 0.4 x likeness of the value alone."""
    both = F.concat_ws(" ", value, F.substring(context, 1, 200))
    return 0.6 * cosine(text_vector(both), text_vector(anchor)) + 0.4 * cosine(text_vector(value), text_vector(anchor))


def contexts(candidates: DataFrame, docs: DataFrame, window: int = 80, most: int = 3) -> DataFrame:
    """doc_id, start, end, context, score: the contexts of the most telling candidates, distinct ranges, at most ``most`` a document."""
    rows = candidates.join(docs.select("doc_id", "text"), "doc_id")
    a, b = F.greatest(F.lit(0), F.col("start") - window), F.least(F.length("text"), F.col("end") + window)
    around = F.substring(F.col("text"), a + 1, b - a)
    score = F.when(around.rlike(HIGH_RISK_CUE), 100).otherwise(0) + F.when(F.col("value").rlike("(?=.*[0-9])[A-Za-z0-9-]{8,}"), 20).otherwise(0) + F.when(F.substring(F.col("text"), a + 1, F.col("start") - a).rlike(r"[:\-]\s*$"), 5).otherwise(0)
    made = rows.select("doc_id", a.alias("start"), b.alias("end"), around.alias("context"), score.alias("score")).dropDuplicates(["doc_id", "start", "end"])
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "start", "end"))
    return made.withColumn("r", rank).where(F.col("r") <= most).drop("r")


def origin(final: DataFrame, raw: DataFrame) -> DataFrame:
    """Adds origin: what of a final span a detector saw. Its best raw match by overlap, equal value, equal type makes it
    detector_origin (all), reclass_origin (another type), partial_origin, or downstream_origin (none)."""
    f, r = final.alias("f"), raw.alias("r")
    near = (F.col("f.doc_id") == F.col("r.doc_id")) & (F.col("f.page") == F.col("r.page")) & (F.col("f.start") < F.col("r.end")) & (F.col("r.start") < F.col("f.end"))
    inter = F.least("f.end", "r.end") - F.greatest("f.start", "r.start")
    ratio = inter / F.greatest(F.col("f.end") - F.col("f.start"), F.col("r.end") - F.col("r.start"))
    value, kind = F.lower("f.value") == F.lower("r.value"), F.col("f.entity_type") == F.col("r.entity_type")
    keys = ["doc_id", "page", "start", "end", "entity_type", "value"]
    best = f.join(r, near).groupBy(*[F.col(f"f.{k}").alias(k) for k in keys]).agg(F.max(F.struct((ratio + value.cast("int") + kind.cast("int")).alias("score"), value.alias("v"), kind.alias("t"), F.col("r.detector").alias("by"))).alias("m"))
    out = final.join(best, keys, "left")
    label = F.when(F.col("m").isNull(), "downstream_origin").when(F.col("m.v") & F.col("m.t"), "detector_origin").when(F.col("m.v"), "reclass_origin").otherwise("partial_origin")
    return out.withColumn("origin", label).withColumn("raw_detector", F.col("m.by")).drop("m")
