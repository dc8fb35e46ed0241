"""Which detectors a text needs, and what of it no span explains yet.

Gates are columns, so all texts are judged in one pass. ``plan_detectors`` keeps every
detector whose gate is open (exhaustive); ``next_detector`` gives the routed form, in which
a document stops once nothing uncertain is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.text import without_labels
from veilspark.operators.store import fence, let

# What in a text, or in its words without labels, calls for a detector.
TITLES = ("mr", "mrs", "ms", "dr", "prof", "professor", "hon", "consultant")
NER_WORDS = (
    "street", "st.", "road", "rd.", "avenue", "ave.", "lane", "ln.", "boulevard", "blvd.", "zip", "postal", "address", "po box", "p.o. box", "city", "state", "country", "apartment", "apt", "suite", "inc.", "inc", "corp.", "corp", "ltd.",
    "ltd", "llc", "co.", "company", "pharmacy", "association", "dob", "birth", "date", "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december", "jan", "feb", "mar", "apr", "jun",
    "jul", "aug", "sep", "oct", "nov", "dec",
)
NO_PAIR = (
    "claim number", "insurance id", "phone number", "aadhaar number", "pan number", "passport number", "date of birth", "pin code", "zip code", "ifsc code", "ip address", "us phone", "customer name", "account holder",
)
CARE_PHRASES = ("dr.", "dr ", "medical center", "healthcare organization", "medical facility", "clinical role", "healthcare staff")
CARE_WORDS = (
    "doctor physician surgeon consultant specialist md patient admitted discharged hospital clinic healthcare ward icu nursing hospice referred mrn clinical attending referring resident intern practitioner np pa nurse staff provider "
    "facility outpatient inpatient"
).split()
CLINICAL_PHRASES = ("chief complaint", "ct scan", "x-ray")
CLINICAL_WORDS = (
    "patient doctor hospital diagnosis diagnoses complaint history symptom symptoms medication medicine drug prescription allergy procedure surgery lab laboratory blood glucose hemoglobin diabetes hypertension asthma fever headache pain "
    "mri ct biopsy findings clinical"
).split()


def _any(text: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def gates(text: Column) -> dict[str, Column]:
    """By detector, whether a text may hold what it finds. The patterns' detector and the language model always run on texts that say something."""
    said = F.coalesce(text.rlike(r"\S"), F.lit(False))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z]+\b"), F.lit(0))
    low = F.lower(text)
    titled = lambda clean: F.exists(F.array(*map(F.lit, TITLES)), lambda t: F.contains(F.concat(F.lit(" "), clean, F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" "))) | F.startswith(clean, t))
    pairs = F.exists(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"), F.lit(0)), lambda p: ~F.lower(p).isin(*NO_PAIR))
    listed = lambda names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    judged = let(without_labels(text), lambda clean: F.struct((clean != "").alias("any"), (titled(clean) | _any(clean, NER_WORDS)).alias("ner")))
    ner = judged["any"] & (judged["ner"] | pairs)
    care = judged["any"] & (_any(low, CARE_PHRASES) | listed(CARE_WORDS))
    clinical = judged["any"] & (_any(low, CLINICAL_PHRASES) | listed(CLINICAL_WORDS))
    yes = lambda c: F.coalesce(said & c, F.lit(False))
    return {"regex": said, "ner": yes(ner), "zero_shot": yes(care), "clinical": yes(clinical), "llm": said}


def plan_detectors(docs: DataFrame, route: str = "route") -> DataFrame:
    """doc_id, detectors: the route's detectors whose gate is open, in route order. docs: doc_id, text and ``route`` (comma-joined names)."""
    # the words without labels are worked out in a step of their own, for all gates
    out = fence(docs.select("doc_id", route, *[gate.alias(f"g_{name}") for name, gate in gates(F.col("text")).items()]))
    out = out.withColumn("open", F.create_map(*[x for name in ("regex", "ner", "zero_shot", "clinical", "llm") for x in (F.lit(name), F.col(f"g_{name}"))]))
    return out.select("doc_id", F.filter(F.split(route, ","), lambda d: F.coalesce(F.try_element_at(F.col("open"), d), F.lit(False))).alias("detectors"))


def next_detector(docs: DataFrame, state: DataFrame, least: float = 0.80, exhaustive: bool = False) -> DataFrame:
    """doc_id, detector, reason: what to run next on each document (doc_id, text, route).

    state: doc_id, executed (array), candidates (unexplained pieces), uncertain (spans under
    ``least`` or pending). A document stops once something has run and neither is
    left; else the first open detector of its route that has not run is next.
    """
    planned = plan_detectors(docs, "route").join(state, "doc_id", "left")
    executed = F.coalesce("executed", F.array().cast("array<string>"))
    n, low = F.coalesce("candidates", F.lit(0)), F.coalesce("uncertain", F.lit(0))
    done = (F.size(executed) > 0) & (n <= 0) & (low <= 0) & F.lit(not exhaustive)
    first = F.get(F.filter("detectors", lambda d: ~F.array_contains(executed, d)), 0)
    reason = F.when(done, "DONE").when(first.isNull(), "EXHAUSTED").when(n > 0, "CANDIDATES").when(low > 0, "UNCERTAIN").otherwise("OPEN")
    return planned.select("doc_id", F.when(~done, first).alias("detector"), reason.alias("reason"))


def context_bounds(length: Column, start: Column, end: Column, window: int) -> tuple[Column, Column]:
    """A window around a span, centred as far as the text allows, and never the whole of a text longer than the span."""
    own = F.greatest(end - start, F.lit(1))
    most = F.least(length, own + 2 * max(0, window))
    most = F.when((length > own) & (most >= length), F.greatest(own, length - 1)).otherwise(most)
    left = F.greatest(F.lit(0), F.floor((start + end) / 2).cast("int") - F.floor(most / 2).cast("int"))
    right = F.least(length, left + most)
    return F.greatest(F.lit(0), right - most).cast("int"), right.cast("int")


def project_known(contexts: DataFrame, spans: DataFrame) -> DataFrame:
    """Known spans in each context (doc_id, context_id, start, end), clipped and counted from the context's start."""
    from veilspark.operators.spans import overlap_pairs

    hits = overlap_pairs(contexts, spans.select("doc_id", "start", "end", "entity_type", "value"), ["doc_id"])
    return hits.select("doc_id", "context_id", (F.greatest("r_start", "start") - F.col("start")).alias("start"), (F.least("r_end", "end") - F.col("start")).alias("end"), "entity_type", "value")


def on_chunks(chunks: DataFrame, detector, gate: str | None = None) -> DataFrame:
    """A detector (docs -> spans) run on chunks (doc_id, chunk_id, start, end, chunk_text) that say something and whose gate is open; offsets are the document's."""
    rows = chunks.where(F.col("chunk_text").rlike(r"\S"))
    if gate is not None:
        rows = rows.where(gates(F.col("chunk_text"))[gate])
    pages = rows.select("doc_id", (F.col("chunk_id") + 1).alias("page_number"), F.col("start").alias("page_offset"), F.col("chunk_text").alias("page_text"))
    return detector(pages).withColumnRenamed("page", "chunk").withColumn("chunk", F.col("chunk") - 1)


def merge_residual(found: DataFrame, locked: DataFrame, docs: DataFrame) -> DataFrame:
    """New spans whose value is the text at their place and that overlap no locked span, one for each place."""
    from veilspark.operators.spans import dedupe, not_overlapping

    at = found.join(docs.select("doc_id", "text"), "doc_id").where(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("value")).drop("text")
    return dedupe(not_overlapping(at, locked))


# Words of labels, words that point to health, and headings that are no candidates; patterns of candidates.
LABEL_WORDS = (
    "account address aadhaar age allergy claim clinical consultant contact date diagnosis doctor dob email employee holder hospital ifsc insurance lab medical medication mobile mrn name pan passport patient phone physician policy "
    "procedure provider ssn agreement amount authorized billed customer driving emergency gstin id invoice license number organization salary signatory witness upi"
).split()
SIGNAL_WORDS = "admission allergy asthma biopsy clinic clinical diabetes diagnosis fever glucose hospital hypertension laboratory medication metformin mri pain paracetamol physician procedure symptom treatment".split()
NO_CANDIDATE = ("company information", "contact information", "enterprise service agreement", "footer", "legal section", "medical information")
PARTICLES = "of and the in on at for with a an to by or about from as into".split()
LABELLED = (r"^\s*([A-Za-z0-9][A-Za-z0-9\s]{0,25})\s*:\s*(?=\S)", r"^\s*([A-Za-z0-9][A-Za-z0-9\s]{0,25})\s+-\s+(?=\S)")
SHAPES = (
    ("structured_token", r"\b[\w.+-]+@[\w.-]+\.\w+\b|\b(?:\+?\d[\d\s().-]{5,}\d)\b|\b[A-Z]{5}\d{4}[A-Z]\b|\b[A-Z]{2,}\d[A-Z0-9-]{3,}\b|\b\d{3}-\d{2}-\d{4}\b|\b\d{2,4}[-/]\d{1,2}[-/]\d{1,4}\b"),
    ("titled_name", r"\b(?:Dr|Mr|Mrs|Ms|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b"),
    ("organization_or_facility", r"\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,5}\s+(?:Association|Clinic|Company|Corp|Corporation|Group|Hospital|Inc|LLC|Ltd|Medical Center)\b"),
    ("proper_noun", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,4}\b"),
    ("domain_signal", r"(?i:\b(?:" + "|".join(SIGNAL_WORDS) + r")\b)"),
)


def _telling(value: Column, kind: Column, least: int) -> Column:
    """Whether a piece of text says something besides labels: a label's value needs ``least`` letters or digits, others a sign of an entity or two words as well."""
    tokens = F.transform(F.regexp_extract_all(value, F.lit("[A-Za-z0-9@._#:/+-]+"), F.lit(0)), lambda t: F.lower(F.regexp_replace(t, r"^[._#:/+-]+|[._#:/+-]+$", "")))
    tokens = F.filter(tokens, lambda t: (t != "") & ~t.isin(*LABEL_WORDS))

    def judge(tokens: Column) -> Column:
        letters = F.length(F.regexp_replace(F.array_join(tokens, ""), "[^a-z]", ""))
        digits = F.length(F.regexp_replace(F.array_join(tokens, ""), "[^0-9]", ""))
        sign = F.exists(tokens, lambda t: t.isin(*SIGNAL_WORDS) | t.rlike("[@0-9]"))
        named = (letters >= least) & F.when(kind == "label_value", F.lit(True)).otherwise(sign | (F.size(tokens) >= 2))
        return named | (digits >= least)

    return ~F.lower(F.trim(F.regexp_replace(value, r"\s+", " "))).isin(*NO_CANDIDATE) & let(tokens, judge)


def remaining_candidates(docs: DataFrame, locked: DataFrame | None = None, least: int = 3) -> DataFrame:
    """doc_id, start, end, kind: pieces of texts that look like entities and that no locked span (doc_id, start, end) explains.

    A line's value behind a label; else, unless the line is a heading, tokens,
    titled names, organisations, proper nouns and words of health. Of pieces
    within one another the outer stays, of equal ones the first kind.
    """
    from veilspark.operators.rules import find_all
    from veilspark.operators.spans import not_overlapping

    lines = docs.select("doc_id", F.explode(find_all(F.col("text"), r"[^\r\n]+")).alias("m")).select("doc_id", F.col("m.start").alias("at"), F.col("m.value").alias("line"))
    line = F.col("line")
    label = lambda p: F.when(F.arrays_overlap(F.regexp_extract_all(F.lower(F.regexp_extract(line, p, 1)), F.lit("[a-z]+"), F.lit(0)), F.array(*map(F.lit, LABEL_WORDS))), F.length(F.regexp_extract(line, p, 0)))
    dashes = (F.length(line) - F.length(F.replace(line, F.lit(" - "), F.lit("")))) == 3
    lines = lines.withColumn("colon", label(LABELLED[0])).withColumn("dash", F.when(dashes, label(LABELLED[1]))).withColumn("value_at", F.coalesce("colon", "dash"))
    name = F.when(F.col("colon").isNotNull(), F.regexp_extract(line, LABELLED[0], 1)).when(F.col("dash").isNotNull(), F.regexp_extract(line, LABELLED[1], 1))
    lead = F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))
    words = F.regexp_extract_all(line, F.lit(r"\b[A-Za-z]+\b"), F.lit(0))
    heading = F.col("value_at").isNull() & ~line.rlike(r"[.?!]\s*\z") & F.size(words).between(1, 8) & F.forall(words, lambda w: F.lower(w).isin(*PARTICLES) | w.rlike("^[A-Z]"))
    lines = lines.withColumn("label_from", F.when(name.isNotNull(), lead)).withColumn("label_to", F.when(name.isNotNull(), lead + F.length(name))).where(~heading)
    piece = lambda kind, rank, start, end: F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"))

    def shaped(kind: str, rank: int):
        return lambda m: piece(kind, rank, m["start"], m["end"])

    value = F.when(F.col("value_at").isNotNull(), F.array(piece("label_value", 0, F.col("value_at"), F.length(F.regexp_replace(line, r"\s+$", ""))))).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,rank:int>>"))
    found = F.concat(value, *[F.transform(find_all(line, p), shaped(kind, i)) for i, (kind, p) in enumerate(SHAPES, 1)])
    rows = lines.select("doc_id", "at", "line", "label_from", "label_to", F.explode(found).alias("c"))
    rows = rows.where((F.col("c.kind") == "label_value") | ~F.coalesce((F.col("c.start") >= F.col("label_from")) & (F.col("c.end") <= F.col("label_to")), F.lit(False)))
    text = F.substring(line, F.col("c.start") + 1, F.col("c.end") - F.col("c.start"))
    rows = rows.where(_telling(text, F.col("c.kind"), least)).select("doc_id", (F.col("at") + F.col("c.start")).alias("start"), (F.col("at") + F.col("c.end")).alias("end"), F.col("c.kind").alias("kind"), F.col("c.rank").alias("rank"))
    if locked is not None:
        shut = locked.select("doc_id", F.lit(1).alias("page"), "start", "end", F.lit("").alias("entity_type"))
        rows = not_overlapping(rows.withColumn("page", F.lit(1)), shut).drop("page")
    before = F.max("end").over(Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "rank").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", before).where(F.coalesce(F.col("end") > F.col("before"), F.lit(True))).select("doc_id", "start", "end", "kind")
