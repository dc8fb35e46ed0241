"""Column functions on text and numbers. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_BREAK = "\n\n\f\n\n"


def normalize_text(c: Column) -> Column:
    """Line ends to LF, zero-width characters out, quotes, dashes and no-break
    spaces unified, lines trimmed on the right, at most one blank line in a row."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[\\u200B\\u200C\\u200D\\u2060\\uFEFF\\x00]", "")
    c = F.translate(c, "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0", "''\"\"-- ")
    c = F.regexp_replace(c, "[ \t]+\n", "\n")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return F.regexp_replace(c, "^[ \t\n]+|[ \t\n]+$", "")


def value_key(c: Column) -> Column:
    """White space collapsed, lower case: what makes two values the same."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def semantic_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """Mod-10 check over the digits; false without any."""
    return F.coalesce(F.call_function("luhn_check", digits(c)), F.lit(False)) & (F.length(digits(c)) > 0)


def npi(c: Column) -> Column:
    """Provider number: ten digits that pass mod-10 behind the prefix 80840."""
    d = digits(c)
    return (F.length(d) == 10) & F.coalesce(F.call_function("luhn_check", F.concat(F.lit("80840"), d)), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((size(a) == 0) | (size(b) == 0), F.lit(0.0)).otherwise(dot / (size(a) * size(b)))


def overlap_ratio(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Overlap of two half-open intervals over the longer one's length."""
    inter = F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1))
    return inter / F.greatest(a2 - a1, b2 - b1)


# Characters a page needs for each coverage, and how quality and coverage bound the confidence of recognised text.
PAGE_COVERAGE = ((500, 1.0), (200, 0.85), (75, 0.70), (25, 0.45))
LEAST_COVERAGE = 0.20


def text_quality(text: Column) -> Column:
    """0.6 valid characters + 0.4 words of 2 to 35 characters, less a penalty for question marks and runs of symbols; four decimals."""
    shown = F.length(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]", ""))
    valid = F.length(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}!-/:-@\[-`{-~]", ""))
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9][A-Za-z0-9'/-]*"), F.lit(0))
    meant = F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.length(w).between(2, 35))) / F.size(words)).otherwise(F.lit(0.0))
    odd = F.length(text) - F.length(F.translate(text, "?\ufffd", ""))
    runs = F.least(F.regexp_count(text, F.lit(r"(?U)[^A-Za-z0-9\s]{4,}")) * 0.05, F.lit(0.25))
    noise = F.least(odd / F.greatest(F.length(text), F.lit(1)) + runs, F.lit(0.40))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), valid / shown * 0.60 + meant * 0.40 - noise))
    return F.when(shown > 0, F.round(score, 4)).otherwise(F.lit(0.0))


def page_coverage(text: Column, pages: Column) -> Column:
    each = F.length(text) / F.greatest(pages, F.lit(1))
    return F.coalesce(*[F.when(each >= least, F.lit(share)) for least, share in PAGE_COVERAGE], F.lit(LEAST_COVERAGE))


def ocr_confidence(engine: Column, text: Column, pages: Column) -> Column:
    """0.7 engine + 0.2 quality + 0.1 coverage, four decimals; poor text bounds it."""
    quality, coverage = text_quality(text), page_coverage(text, pages)
    bound = F.when(quality < 0.30, 0.45).when(quality < 0.50, 0.65).when((coverage <= LEAST_COVERAGE) & (quality < 0.80), 0.75).otherwise(1.0)
    return F.round(F.greatest(F.lit(0.0), F.least(0.7 * engine + 0.2 * quality + 0.1 * coverage, bound)), 4)


# Labels that say nothing about what a text holds.
FIELD_LABELS = (
    "email", "phone", "mobile", "contact", "pan", "aadhaar", "passport", "ssn", "mrn", "insurance id", "insurance", "policy", "claim number", "claim", "ifsc code", "ifsc", "upi id", "upi", "pin code", "pin", "zip code", "zip",
    "url", "ip address", "ip", "passport number", "aadhaar number", "pan number", "phone number", "date of birth", "dob", "customer name", "account holder", "account number", "patient name", "patient", "doctor", "consultant",
    "hospital", "address", "diagnosis", "medication", "medicines", "cpt", "icd", "history", "symptom", "procedure", "vital signs", "lab", "laboratory", "results", "date", "time", "location", "organization", "person", "gender",
    "age", "sex",
)


def without_labels(text: Column) -> Column:
    """Lower-case words of three letters at least, without field labels, digits and marks."""
    # no label ends with the word that another begins with, so one pass in list order is the same as one for each
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"(?U)\b(?:{'|'.join(FIELD_LABELS)})\b", " ")
    words = F.filter(F.split(F.regexp_replace(out, r"(?U)[\W\d_]+", " "), " "), lambda w: F.length(w) >= 3)
    return F.array_join(words, " ")
