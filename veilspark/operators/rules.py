"""Detectors and decisions that need no model: patterns with fixed confidence, listed phrases, filters of names
that a statistical recogniser found, and the decisions that stand in for a language model's.

Matches come from ``find_all``, built-in expressions only. Each rule set is a table. Its patterns run only on texts that
pass a quicker look (``_where``), true of every text with a match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.spans import dedupe, resolve

COLUMNS = ("doc_id", "page", "start", "end", "entity_type", "value", "confidence", "detector")


def find_all(text: Column, value: str, lead: str = "", tail: str = "") -> Column:
    """start, end, value of each match of ``value`` behind ``lead`` and before ``tail``, from left to right.

    Matches are cut off one after another, with what lies before them, so their
    places are sums of lengths in code points. The patterns have no groups.
    """
    pattern = rf"\G([\s\S]*?(?:{lead}))({value})(?={tail or ''})"
    cuts = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda gap, v: F.struct(gap.alias("gap"), v.alias("v")))
    kind = "array<struct<start:int,end:int,value:string>>"
    at = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0))
    one = lambda acc, c: F.struct((at(acc) + F.length(c["gap"])).alias("start"), (at(acc) + F.length(c["gap"]) + F.length(c["v"])).alias("end"), c["v"].alias("value"))
    cuts = F.when(text.rlike(f"{lead}{value}(?={tail})" if tail else f"{lead}{value}"), cuts)  # most texts hold no match: one look tells
    return F.aggregate(F.coalesce(cuts, F.array().cast("array<struct<gap:string,v:string>>")), F.array().cast(kind), lambda acc, c: F.concat(acc, F.array(one(acc, c))))


def _rows(docs: DataFrame) -> DataFrame:
    if "page_text" in docs.columns:
        return docs.select(F.col("doc_id").cast("long"), F.col("page_number").cast("int").alias("page"), F.col("page_offset").cast("int").alias("base"), F.col("page_text").alias("text"))
    return docs.select(F.col("doc_id").cast("long"), F.lit(1).alias("page"), F.lit(0).alias("base"), "text")


def _where(rows: DataFrame, look: str) -> DataFrame:
    """Rows in whose text a pattern of RE2 is found: one pass of an automaton, however many words it lists. It also
    keeps the optimizer from running the patterns behind it once more as a filter of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pc.fill_null(pc.match_substring_regex(b.column("text"), look), False))

    return rows.mapInArrow(run, rows.schema)


def _spans(docs: DataFrame, found: list[tuple[str, Column]], confidence: dict[str, float] | float, detector: str, look: str) -> DataFrame:
    def named(kind: str, rule: int):
        return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("entity_type"), m["value"].alias("value"), F.lit(rule).alias("rule"))

    parts = [F.transform(c, named(kind, i)) for i, (kind, c) in enumerate(found)]
    out = _where(_rows(docs), look).select("doc_id", "page", "base", F.explode(F.flatten(F.array(*parts))).alias("m"))
    sure = F.lit(confidence) if isinstance(confidence, float) else F.coalesce(*[F.when(F.col("m.entity_type") == k, F.lit(c)) for k, c in confidence.items()])
    return out.select("doc_id", "page", (F.col("base") + F.col("m.start")).alias("start"), (F.col("base") + F.col("m.end")).alias("end"), "m.entity_type", "m.value", sure.cast("double").alias("confidence"), F.lit(detector).alias("detector"), "m.rule")


# ---- beside a statistical recogniser -------------------------------------------------

# Patterns of people in context, organisations and streets; labels and phrases that are none.
_NAME = r"(?:[A-Z][a-z]+(?:['-][A-Z][a-z]+)*|[A-Z]\.)"
_PERSON = rf"{_NAME}(?:\s+{_NAME}){{1,3}}"
_DEGREE = r"(?:\s+(?:DVM|MD|DO|DDS|PhD|CPA|Esq\.?|RN|NP|PA-C))?"
PEOPLE = (
    (r"\b(?:verify that|certify that|confirm that)\s+", rf"{_DEGREE}\s+(?:is|was|has|currently|will|,)"),
    (r"(?im:^\s*(?:Customer Name|Patient Name|Witness|Authorized Signatory|Emergency Contact|Employee Name|Candidate Name|Staff Member)[ \t]*[:\-]?[ \t]*(?:\r?\n[ \t]*)?)", rf"(?im:{_DEGREE}[ \t]*$)"),
)
ORGANISATION = r"\b[A-Z][a-zA-Z0-9_]+(?:\s+[A-Z][a-zA-Z0-9_]+)*\s+(?:Corporation|Corp\b|Inc\b|Inc\.|Llc|Ltd|Company|Association|Group|Solutions)\b"
STREET = r"\b(?:[Oo]ne|[Tt]wo|[Tt]hree|\d+)\s+[A-Z][a-zA-Z0-9_]+(?:\s+[A-Z][a-zA-Z0-9_]+)*\s+(?:Way|Street|St\b|St\.|Road|Rd\b|Rd\.|Avenue|Ave\b|Ave\.|Lane|Ln\b|Ln\.|Boulevard|Blvd\b|Blvd\.|Drive|Dr\b|Dr\.|Court|Ct\b|Ct\.)\b"
# What RE2 must find first: words of the patterns above behind what stands before them, without word edges.
_BLANK = r"[\s\x0B]"
SUPPLEMENT_LOOK = "|".join((
    "(?:verify|certify|confirm) that", "(?i:customer name|patient name|witness|authorized signatory|emergency contact|employee name|candidate name|staff member)",
    rf"[a-zA-Z0-9_]{_BLANK}+(?:Corp|Inc|Llc|Ltd|Company|Association|Group|Solutions)",
    rf"(?:[Oo]ne|[Tt]wo|[Tt]hree|[0-9]){_BLANK}+[A-Z](?:[a-zA-Z0-9_]|{_BLANK})*{_BLANK}(?:Way|St|Road|Rd|Ave|Lane|Ln|Boulevard|Blvd|Dr|Court|Ct)",
))
FIELD_LABELS = (
    "account", "account holder", "agreement id", "authorized signatory", "bank account", "claim number", "company information", "contact information", "customer name", "driving license", "emergency contact", "employee id",
    "enterprise service agreement", "footer", "gstin", "ifsc", "insurance company", "invoice number", "legal section", "medical information", "organization", "passport no", "policy number", "start date", "visit date", "witness",
)
TITLES = ("dr", "dr.", "mr", "mr.", "mrs", "mrs.", "ms", "ms.")
NO_PERSON = (*FIELD_LABELS, *TITLES, "employment verification", "hr department", "human resources")
NO_ORGANISATION = (*FIELD_LABELS, "insurance")
CARE_ENDS = r"(?:hospital|hospitals|clinic|medical center|healthcare|institute)$"


def supplements(docs: DataFrame) -> DataFrame:
    """People in set phrases (0.88), organisations by their suffix and street addresses (0.85)."""
    text = F.col("text")
    found = [*[("PERSON", find_all(text, _PERSON, lead, tail)) for lead, tail in PEOPLE], ("ORGANIZATION", find_all(text, ORGANISATION)), ("ADDRESS", find_all(text, STREET))]
    out = _spans(docs, found, {"PERSON": 0.88, "ORGANIZATION": 0.85, "ADDRESS": 0.85}, "ner", SUPPLEMENT_LOOK)
    flat = F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))
    tokens = F.split(F.trim("value"), r"\s+")
    person = ~flat.isin(*NO_PERSON) & ~flat.rlike(CARE_ENDS) & F.size(tokens).between(2, 4) & F.forall(tokens, lambda t: t.rlike(f"^{_NAME}$"))
    keep = F.when(F.col("entity_type") == "PERSON", person).when(F.col("entity_type") == "ORGANIZATION", ~F.regexp_replace(flat, ":+$", "").isin(*NO_ORGANISATION)).otherwise(True)
    return out.where(keep).select(*COLUMNS).dropDuplicates(["doc_id", "page", "start", "end", "entity_type"])


# ---- instead of a zero-shot recogniser -------------------------------------------------

# Patterns of roles and places of care in the order tried, and labels that are no values.
CARE_ROLES = (
    ("DOCTOR", r"\bDr\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b", ""), ("HOSPITAL", r"\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+Hospital\b", ""), ("MEDICAL_FACILITY", r"\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+Clinic\b", ""),
    ("MEDICAL_FACILITY", r"\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+Medical Center\b", ""), ("PATIENT", r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b", r"\bPatient\s*[:\-]\s*"),
    ("PATIENT", r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b", r"\bPatient Name\s*[:\-]\s*"),
)
CARE_LOOK = "Dr|Hospital|Clinic|Medical Center|Patient"
NO_ROLE = (
    "address", "email", "e-mail", "phone", "telephone", "mobile", "fax", "name", "patient", "patient name", "doctor", "hospital", "diagnosis", "chief complaint", "complaint", "medication", "medications", "procedure", "procedures",
    "laboratory", "lab", "results", "allergy", "vital signs",
)


def care_roles(docs: DataFrame) -> DataFrame:
    """Doctors, places of care and labelled patients (0.76). A value counts once for a page and type; of overlapping matches the earlier rule's stays."""
    out = _spans(docs, [(kind, find_all(F.col("text"), value, lead)) for kind, value, lead in CARE_ROLES], 0.76, "zero_shot", CARE_LOOK)
    flat = F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))
    out = out.where(~F.regexp_replace(flat, ":+$", "").isin(*NO_ROLE)).withColumn("key", flat)
    first = out.groupBy("doc_id", "page", "entity_type", "key").agg(F.min(F.struct("rule", "start", "end", "value", "confidence", "detector")).alias("m"))
    rows = first.select("doc_id", "page", "m.start", "m.end", "entity_type", "m.value", "m.confidence", "m.detector", "m.rule")
    return resolve(rows, ("rule", "start"), keep_same=False).select(*COLUMNS)


# ---- listed clinical phrases ------------------------------------------------------------

# Clinical phrases by type.
PHRASES = {
    "DISEASE": ("type 2 diabetes mellitus", "diabetes", "hypertension", "asthma", "hyperlipidemia", "hypercholesterolemia", "irritable bowel syndrome"),
    "SYMPTOM": ("persistent fever", "shortness of breath", "chest pain", "abdominal pain", "loose stools", "fever", "headache"),
    "DIAGNOSIS": ("back pain", "acute non-st elevation myocardial infarction", "myocardial infarction"),
    "MEDICATION": (
        "paracetamol", "ibuprofen", "metformin", "aspirin", "lisinopril", "atorvastatin", "lipitor", "zocor", "synthroid", "crestor", "align", "dicyclomine", "probiotic", "amoxicillin", "omeprazole", "gabapentin", "levothyroxine",
        "ozempic", "metoprolol", "losartan", "hydrochlorothiazide", "simvastatin", "sertraline", "prednisone", "doxycycline", "ciprofloxacin", "clopidogrel", "eliquis", "xarelto", "januvia", "farxiga", "jardiance", "humira",
        "keytruda", "dupixent", "adderall", "vyvanse", "warfarin", "tramadol", "albuterol", "montelukast", "brilinta",
    ),
    "PROCEDURE": ("chest x-ray", "x-ray", "mri", "ct scan", "biopsy", "ecg", "coronary angiography", "percutaneous coronary intervention", "transthoracic echocardiogram"),
    "LAB": (
        "blood glucose", "complete blood count", "cbc", "hemoglobin", "hemoglobin a1c", "a1c", "comprehensive metabolic panel (cmp)", "comprehensive metabolic panel", "lipid panel", "total cholesterol", "hdl", "ldl", "triglycerides",
        "celiac disease antibody panel", "calprotectin test", "calprotectin",
    ),
    "ALLERGY": ("penicillin allergy",), "CLINICAL_FINDING": ("abnormal ecg findings", "elevated blood glucose", "high blood pressure"),
}


def phrase_pattern(phrases: list[str]) -> str:
    """One alternation, longest first: hyphens and blanks stand for one another, a plural s may follow."""
    each = [r"[-\s]+".join(re.escape(w) for w in re.split(r"[-\s]+", p)) for p in sorted(set(phrases), key=lambda p: (-len(p), p))]
    return r"(?i:(?<![A-Za-z0-9_])(?:" + "|".join(each) + r")s?(?![A-Za-z0-9_]))"


def phrase_look(phrases: list[str]) -> str:
    """The first words of phrases, for RE2, whose word edges are those of ``phrase_pattern``."""
    first = [re.search("[A-Za-z0-9_]+", p) for p in phrases]
    return r"(?i)\b(?:" + "|".join(sorted({m.group() for m in first})) + r")s?\b" if all(first) else ""


def phrases(docs: DataFrame, listed: dict[str, tuple[str, ...]] = PHRASES) -> DataFrame:
    """Spans of listed phrases (0.85), of overlapping ones the longest."""
    key = lambda c: F.regexp_replace(F.lower(c), r"[-\s]+", " ")
    kinds = {" ".join(re.split(r"[-\s]+", p)): kind for kind, ps in listed.items() for p in ps}
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    # a phrase within a longer one is found by a pass for each length of words, so that the longest can win
    sizes = sorted({len(p.split(" ")) for p in kinds}, reverse=True)
    found = [("PHRASE", find_all(F.col("text"), phrase_pattern([p for p in kinds if len(p.split(" ")) == n]))) for n in sizes]
    out = _spans(docs, found, 0.85, "clinical", phrase_look(list(kinds)))
    kind = F.coalesce(F.try_element_at(table, key(F.col("value"))), F.try_element_at(table, F.regexp_replace(key(F.col("value")), "s$", "")))
    return resolve(dedupe(out.withColumn("entity_type", kind).select(*COLUMNS)), (("length", False), ("start", True)), keep_same=False)


# ---- what a statistical recogniser's spans must pass --------------------------------------

# Words of drugs, diseases, examinations and devices; durations; phrases that are no entities.
DRUGS = (
    "aspirin atorvastatin metformin lisinopril amoxicillin omeprazole gabapentin levothyroxine ozempic metoprolol losartan hydrochlorothiazide simvastatin sertraline prednisone doxycycline ciprofloxacin clopidogrel eliquis xarelto "
    "januvia farxiga jardiance humira keytruda dupixent adderall vyvanse warfarin tramadol albuterol montelukast brilinta lipitor zocor synthroid crestor align dicyclomine probiotic insulin ibuprofen paracetamol acetaminophen advil "
    "tylenol motrin zofran ondansetron pantoprazole escitalopram lexapro zoloft prozac fluoxetine amiodarone digoxin heparin enoxaparin lovenox"
).split()
DISEASES = (
    "hyperlipidemia", "hypercholesterolemia", "diabetes", "hypertension", "celiac", "thyroid", "anemia", "heart disease", "gerd", "reflux", "ibs", "asthma", "pneumonia", "bronchitis", "covid", "infarction", "ischemia", "arrhythmia",
    "fibrillation", "carcinoma", "lymphoma", "leukemia", "sepsis", "stroke",
)
EXAMINATIONS = ("chest x-ray", "ecg", "coronary angiography", "x-ray", "mri", "ct scan", "ct", "biopsy", "findings", "glucose", "creatinine", "troponin", "blood pressure", "heart rate")
DEVICES = ("machine", "serial", "catheter", "equipment", "lot number", "asset tag")
NO_ENTITY = (
    "reschedule", "copay", "appointment", "visit", "date", "phone", "email", "address", "portal", "patient", "provider", "doctor", "hospital", "clinic", "amount", "billed", "covered", "cpt", "dob", "ssn", "insurance", "policy", "claim",
    "history", "results", "medication", "procedure", "diagnosis", "information", "details", "city", "state", "zip", "complimentary", "annual", "plan year", "plan years", "plan-year", "service date", "collection date", "certified mail",
    "ciso", "complete", "fsa", "health", "hipaa", "implemented", "medical", "medical record", "needed", "protected health information", "secured", "the health insurance portability", "fasting blood glucose", "blood glucose", "glucose",
    "serum creatinine", "creatinine", "troponin", "troponin i", "peak troponin", "blood pressure", "heart rate", "spo2", "lvef", "left ventricular ejection fraction", "transthoracic echocardiogram", "echocardiogram", "pci",
    "percutaneous coronary intervention", "acute non-st elevation myocardial infarction", "nstemi", "myocardial infarction", "hypertension", "hyperlipidemia", "diabetes mellitus", "type 2 diabetes", "vital signs", "lab results",
    "laboratory", "brilinta", "aspirin", "atorvastatin", "metformin", "disclaimer & notice", "disclaimer", "equipment & technical metadata", "technical metadata", "attending physician", "primary nurse", "discharge summary",
    "patient information", "admission & discharge", "clinical course & diagnosis", "procedures performed", "discharge medications", "laboratory & vital signs at discharge", "insurance & billing", "direct deposit bank",
    "direct deposit", "bank account", "billing account", "discharge", "md", "rn", "do", "pa", "np", "sn", "npi", "acc", "grp", "mem", "ecg", "lot", "asset",
)
DOSE = r"\b\d+\s*(?:mg|mcg|ml|g|tablets?|capsules?)\b"
DOSE_WORDS = "take|rx|daily|dispense|oral|dose|tablet|capsule|medication|prescribed"
DEGREE_BEHIND = r"(?i)\s+(?:DVM|MD|DO|DDS|PhD|CPA|Esq\.?|RN|NP|PA-C)\.?$"
ASSET = r"(?i)^(?:ASSET|SN|LOT|ACC|MEM|GRP|BCBS|NPI)[\-_]"
_listed = lambda words: "|".join(re.escape(w) for w in words)


def filter_recognised(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans of a statistical recogniser without what its kind takes for names, places and dates by mistake.

    Names behind "address" are places, places with "box" addresses; people lose
    degrees and further lines; a bare 0.85 becomes 0.75 for people, organisations and places.
    """
    from veilspark.functions.text import npi

    text, kind, conf = F.col("text"), F.col("entity_type"), F.col("confidence")
    out = found.join(docs.select("doc_id", "text"), "doc_id")
    before = F.lower(F.substring(text, F.greatest(F.col("start") - 39, F.lit(1)), F.least(F.col("start"), F.lit(40))))
    out = out.withColumn("entity_type", F.when(kind.isin("PERSON", "ORGANIZATION") & before.contains("address"), "LOCATION").otherwise(kind))
    low = F.lower(F.trim("value"))
    out = out.withColumn("entity_type", F.when(kind.isin("LOCATION", "ORGANIZATION") & low.contains("box"), "ADDRESS").otherwise(kind))
    around = F.lower(F.substring(text, F.greatest(F.col("start") - 29, F.lit(1)), F.col("end") + 30 - F.greatest(F.col("start") - 30, F.lit(0))))
    named = kind.isin("PERSON", "ORGANIZATION", "LOCATION")
    clinical = named & (low.rlike(_listed((*DRUGS, *DISEASES))) | (around.rlike(DOSE) & around.rlike(DOSE_WORDS)))
    out = out.where(~clinical & ~((kind == "NPI_NUMBER") & ~npi(F.col("value"))))
    one_line = F.regexp_replace(F.trim(F.get(F.split(F.trim("value"), r"\R"), 0)), DEGREE_BEHIND, "")
    out = out.withColumn("value", F.when(kind == "PERSON", one_line).otherwise(F.trim("value"))).withColumn("end", F.when(kind == "PERSON", F.col("start") + F.length("value")).otherwise(F.col("end")))
    date = kind == "DATE_TIME"
    year = low.try_cast("int")
    wrong = (
        low.isin(*NO_ENTITY) | low.rlike(ASSET) | low.rlike(_listed(DEVICES)) | (date & ((conf < 0.35) | low.rlike(r"^\d{5}$") | low.rlike("month|year|day|hour|minute|week") | (low == "daily") | (low.rlike(r"^\d{4}$") & ~year.between(1900, 2100))))
        | ((kind == "PERSON") & (low.rlike(_listed(EXAMINATIONS)) | low.isin(*TITLES) | low.rlike(CARE_ENDS))) | (named & low.isin(*FIELD_LABELS))
    )
    out = out.where(~F.coalesce(wrong, F.lit(False))).withColumn("confidence", F.when((conf == 0.85) & named, 0.75).otherwise(conf))
    return out.select(*found.columns).dropDuplicates(["doc_id", "page", "start", "end", "entity_type"])


# ---- instead of a language model's decisions ------------------------------------------------

# Words of disclaimers in other languages, of benefits and headings, and of pharmacies.
OTHER_LANGUAGE = (
    "español", "espanol", "spanish", "tagalog", "chinese", "navajo", "para obtener", "para obtener ayuda", "llame al", "si usted", "o alguien", "language access", "language access services", "ayuda en español", "atención", "atencion",
    "assistance services",
)
BENEFITS = (
    "mail order", "mail-order", "preauth", "pre-auth", "preauthorization", "minimum value", "minimum value standard", "hearing", "hearing aids", "in-network", "out-of-network", "tier 1", "tier 2", "tier 3", "copay", "coinsurance",
    "deductible", "generic", "preferred brand", "non-preferred", "specialty", "prior authorization", "step therapy", "quantity limit", "emergency room", "urgent care", "routine exam", "preventive", "wellness",
    "schedule of benefits", "explanation of benefits", "plan provisions", "disclaimer", "notice", "patient information", "appointment details", "medical history", "coverage", "benefit", "summary", "coinsurance rate",
    "eligible expenses", "out of pocket", "out-of-pocket", "amountcovered", "amount covered", "amountbilled", "amount billed", "amountpaid", "amount paid", "totalbilled", "total billed", "visitdate", "visit date", "procedurecode",
    "procedure code", "diagnosiscode", "diagnosis code", "insuranceid", "insurance id", "policynumber", "policy number", "claimnumber", "claim number", "groupnumber", "group number", "subscriberid", "memberid",
)
HEADINGS = (
    "patient", "doctor", "physician", "provider", "nurse", "member", "subscriber", "admin", "preauth", "hearing", "vision", "dental", "request", "requests", "transfer", "cif", "sb", "rd", "statement", "holder", "summary", "notices",
    "info", "details", "period", "balance", "amount", "total", "ending", "logo", "logo placeholder", "placeholder", "field discrepancy", "discrepancy", "field", "form title", "header", "footer", "page", "signature", "stamp", "label",
)
PHARMACIES = "westfield|walgreens|cvs|rite aid|walmart|kroger|pharmacy|apothecary"
VISITS = r"(?i)(?: office visit| specialist consult| consult| follow up| evaluation| exam)$"
BOX = r"^(?:p\.?o\.?\s*)?box\s+\d+$"
CITY = r"^[a-zA-Z\s.'-]+,\s*[A-Z]{2}(?:\s+\d{5})?$"


def decide(found: DataFrame, context: str = "context") -> DataFrame:
    """Adds decision (CONFIRM, RECLASSIFY, REJECT), corrected_type and decision_confidence to candidates by the words around them (column ``context``).

    The first rule that holds decides. Doctors lose the kind of visit behind their name.
    """
    kind, value = F.col("entity_type"), F.trim("value")
    low, near, words = F.lower(value), F.lower(F.col(context)), F.split(value, r"\s+")
    named = kind.isin("PERSON", "LOCATION", "ORGANIZATION")
    capital = F.forall(words, lambda w: ~F.regexp_replace(w, r"^\.+|\.+$", "").rlike(r"^\p{L}+$") | w.rlike(r"^\p{Lu}"))
    small = low.isin(*HEADINGS) | (F.length(value) <= 2) | ((low == value) & value.rlike(r"\p{Ll}"))
    rules = (
        ("REJECT", None, 0.95, F.exists(F.array(*map(F.lit, OTHER_LANGUAGE)), lambda w: low.contains(w)) | low.isin("al", "para", "obtener", "ayuda")),
        ("REJECT", None, 0.95, kind.isin("PERSON", "LOCATION") & value.rlike(r"(?U)\d")),
        ("RECLASSIFY", "ADDRESS", 0.95, kind.isin("EOB_NUMBER", "INSURANCE_ID", "POLICY_NUMBER", "CLAIM_NUMBER") & low.rlike(BOX)),
        ("CONFIRM", None, 0.95, kind.isin("ADDRESS", "LOCATION", "CITY_STATE_ZIP") & value.rlike(CITY)),
        ("REJECT", None, 0.95, low.isin(*BENEFITS) | F.regexp_replace(low, "[^a-z0-9]", "").isin(*BENEFITS)),
        ("REJECT", None, 0.95, low.contains("hearing") & near.rlike("hearing aid|benefit")),
        ("RECLASSIFY", "ORGANIZATION", 0.90, (near.rlike("pharmacy|rx|dispense") | low.contains("pharmacy")) & (kind == "PERSON") & low.rlike(PHARMACIES)),
        ("CONFIRM", None, 0.90, kind.isin("DOCTOR", "PHYSICIAN")),
        ("REJECT", None, 0.95, named & low.isin(*HEADINGS)),
        ("REJECT", None, 0.95, named & (F.size(words) == 1) & small),
        ("CONFIRM", None, 0.88, named & (F.size(words) >= 2) & capital),
    )
    choice = reduce(lambda out, r: out.when(r[3], F.struct(F.lit(r[0]).alias("decision"), F.lit(r[1]).cast("string").alias("kind"), F.lit(r[2]).alias("sure"))), rules, F.when(F.lit(False), F.lit(None)))
    sure = F.when(F.col("confidence") >= 0.80, F.col("confidence")).otherwise(F.lit(0.85))
    choice = choice.otherwise(F.struct(F.lit("CONFIRM").alias("decision"), F.lit(None).cast("string").alias("kind"), sure.alias("sure")))
    out = found.withColumn("choice", choice)
    doctor = kind.isin("DOCTOR", "PHYSICIAN") & (F.col("choice.decision") == "CONFIRM")
    out = out.withColumn("value", F.when(doctor, F.trim(F.regexp_replace("value", VISITS, ""))).otherwise(F.col("value")))
    out = out.withColumn("end", F.when(doctor, F.col("start") + F.length("value")).otherwise(F.col("end")))
    return out.withColumns({"decision": F.col("choice.decision"), "corrected_type": F.col("choice.kind"), "decision_confidence": F.col("choice.sure")}).drop("choice")


def apply_decisions(found: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with a model's decisions (keys, decision, corrected_type, decision_confidence) in force: rejected ones go,
    reclassified ones change type, confidence becomes the decision's. Candidates without a decision stay as they are."""
    out = found.join(decisions, keys, "left").where(F.coalesce("decision", F.lit("")) != "REJECT")
    out = out.withColumn("entity_type", F.when(F.col("decision") == "RECLASSIFY", F.coalesce("corrected_type", "entity_type")).otherwise(F.col("entity_type")))
    return out.withColumn("confidence", F.coalesce("decision_confidence", "confidence")).drop("decision", "corrected_type", "decision_confidence")


def is_structured(text: Column) -> Column:
    """JSON, or lines of one delimiter: the first ten with the same number of it and short fields in the first."""
    said = F.regexp_replace(text, r"^\s+|\s+$", "")
    lines = F.filter(F.split(said, r"\R"), lambda x: x.rlike(r"\S"))
    first, same = F.get(lines, 0), F.slice(lines, 1, 10)
    delimited = F.lit(False)
    for d in (",", "\t", "|"):
        count = lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit("")))  # noqa: B023, E731
        short = F.forall(F.split(first, re.escape(d)), lambda f: F.length(F.trim(f)) <= 40)
        delimited = delimited | ((count(first) > 0) & F.forall(same, lambda x: count(x) == count(first)) & short)  # noqa: B023
    as_json = said.rlike(r"^[{\[]") & F.try_parse_json(said).isNotNull()
    return F.coalesce(as_json | ((F.size(lines) >= 2) & delimited), F.lit(False))


def detectors() -> dict[str, object]:
    """Detectors of this package by name, each docs -> spans. Others join as tables of spans with the same columns."""
    from veilspark.operators.detect import detect

    return {"regex": detect, "ner": supplements, "zero_shot": care_roles, "clinical": phrases}
