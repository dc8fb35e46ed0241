"""Queries over stated cases: each order plays one case, with its key as a number in the text, and the SQL holds the
results the case must have, stated by hand and not worked out by a formula. ``{n}`` is the order's number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import documents, evaluate, layout, redact, routing, rules, spans, taxonomy, validate
from veilspark.streaming import jobs

CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ANSWERS: dict[str, str] = {}
#: The year dates are judged in.
AS_OF = 2025


def _sql(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, str):
        return "replace('" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "', '{n}', n)"
    return repr(x)


def _number():
    return (F.col("o_orderkey") + 1_000_000).cast("string")


def _played(spark: SparkSession, sf_dir: str, cases: list[tuple], ddl: str) -> DataFrame:
    """doc_id and the columns of the case that each order plays."""
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, " + ddl)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % len(cases)).cast("int").alias("i"), _number().alias("n"))
    out = orders.join(F.broadcast(rows), "i")
    return out.select("doc_id", *[F.replace(c, F.lit("{n}"), F.col("n")).alias(c) if t == "string" else F.col(c) for c, t in rows.drop("i").dtypes])


def _answers(results: list[list[tuple]], columns: list[str]) -> str:
    """SQL with the rows (of ``columns``) each case must give."""
    parts = [f"SELECT doc_id, {', '.join(f'{_sql(v)} AS {c}' for c, v in zip(columns, row))} FROM o WHERE i = {i}" for i, rows in enumerate(results) for row in rows]
    return f"WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % {len(results)} AS i, (o_orderkey + 1000000)::VARCHAR AS n FROM orders) " + " UNION ALL ".join(parts)


def case_query(results: list[list[tuple]], columns: list[str]):
    def add(f):
        CASES[f.__name__] = f
        ANSWERS[f.__name__] = _answers(results, columns)
        return f

    return add


def _one_span(played: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs and spans of cases with columns before, entity_type, value, after, confidence, detector."""
    docs = played.select("doc_id", F.concat("before", "value", "after").alias("text"))
    start = F.length("before")
    found = played.select("doc_id", F.lit(1).alias("page"), start.alias("start"), (start + F.length("value")).alias("end"), "entity_type", "value", "confidence", "detector")
    return docs, found


_SPAN = "before string, entity_type string, value string, after string, confidence double, detector string"

# before, type, value, after, confidence, detector -> type, value, confidence of what stands (None: nothing)
_VALIDATED = [
    (("", "SSN", "SSN: 123-45-6789", "", 0.9, "regex"), ("SSN", "123-45-6789", 0.9)),
    (("call ", "PHONE", "555-{n}", " now", 0.9, "regex"), ("PHONE_NUMBER", "555-{n}", 0.9)),
    (("call ", "PHONE_NUMBER", "55-12", " now", 0.9, "regex"), None),
    (("", "WIDGET", "w{n}", "", 0.9, "regex"), None),
    (("", "PATIENT", "Linda Morgan\nFamily Member", "", 0.9, "regex"), ("PATIENT", "Linda Morgan", 0.9)),
    (("", "EMAIL", "Email Address: a{n}@x.org", "", 0.9, "regex"), ("EMAIL", "a{n}@x.org", 0.9)),
    (("", "MEMBER_ID", "subscriber", "", 0.9, "regex"), None),
    (("", "MEMBER_ID", "MBRX", " {n}", 0.9, "regex"), ("MEMBER_ID", "MBRX", 0.9)),
    (("", "MEMBER_ID", "ABCX", " {n}", 0.9, "regex"), None),
    (("", "CLAIM_NUMBER", "CLM-{n}", "", 0.9, "regex"), ("CLAIM_NUMBER", "CLM-{n}", 0.9)),
    (("", "GROUP_NUMBER", "G 1{n}", "", 0.9, "regex"), None),
    (("", "PERSON", "Blood Pressure", " {n}", 0.9, "llm"), None),
    (("", "PERSON", "Scar Face", " {n}", 0.9, "ner"), None),
    (("", "PERSON", "Ann of the old green house", "", 0.9, "ner"), None),
    (("", "ADDRESS", "12 Oak Street Apartment {n} Salem", "", 0.9, "regex"), ("ADDRESS", "12 Oak Street Apartment {n} Salem", 0.9)),
    (("", "ORGANIZATION", "review board {n}", "", 0.9, "ner"), None),
    (("", "PROBLEM", "Abdominal pain", " {n}", 0.9, "llm"), ("SYMPTOM", "Abdominal pain", 0.9)),
    (("", "ORGANIZATION", "Medicare", " {n}", 0.9, "llm"), ("INSURANCE_PROVIDER", "Medicare", 0.9)),
    (("", "ORG", "Mercy Hospital", " {n}", 0.9, "ner"), ("HEALTHCARE_ORGANIZATION", "Mercy Hospital", 0.9)),
    (("", "ORGANIZATION", "Acme Widgets", " {n}", 0.9, "llm"), ("ORGANIZATION", "Acme Widgets", 0.79)),
    (("Policy ", "POLICY_NUMBER", "P{n}", "", 0.9, "llm"), ("POLICY_NUMBER", "P{n}", 0.79)),
    (("enter using code ", "PF_NUMBER", "AX-{n}", "", 0.9, "regex"), ("ACCESS_CODE", "AX-{n}", 0.9)),
    (("enter using code ", "PF_NUMBER", "AX{n}!", "", 0.9, "regex"), None),
    (("ticket ", "POLICY_NUMBER", "P{n}", "", 0.9, "regex"), None),
    (("on ", "DATE", "02/29/2024", " {n}", 0.9, "regex"), ("DATE", "02/29/2024", 0.9)),
    (("on ", "DATE", "02/30/2024", " {n}", 0.9, "regex"), None),
    (("on ", "DATE", "31-12-1999", " {n}", 0.9, "regex"), ("DATE", "31-12-1999", 0.9)),
    (("on ", "DATE", "5/10", " {n}", 0.9, "ner"), None),
    (("on ", "DATE", "Jan 5, 2020", " {n}", 0.9, "regex"), ("DATE", "Jan 5, 2020", 0.9)),
    (("on ", "DATE", "2051-01-01", " {n}", 0.9, "regex"), None),
    (("on ", "DATE_TIME", "Monday, March 3, 2021 at 10:30 AM", " {n}", 0.9, "regex"), None),
    (("on ", "DATE_TIME", "2021-03-03T10:30:00Z", " {n}", 0.9, "regex"), ("DATE_TIME", "2021-03-03T10:30:00Z", 0.9)),
    (("at ", "DATE_TIME", "10:30 AM", " {n}", 0.9, "regex"), ("DATE_TIME", "10:30 AM", 0.9)),
    (("office hours ", "DATE_TIME", "10:30 AM", " {n}", 0.9, "regex"), None),
    (("on ", "DATE", "$45.00", " {n}", 0.9, "regex"), None),
    (("code ", "DATE", "E11.9", " {n}", 0.9, "llm"), ("ICD10_CODE", "E11.9", 0.9)),
    (("CPT ", "DATE", "99213", " {n}", 0.9, "regex"), ("CPT_CODE", "99213", 0.9)),
    (("zip ", "CPT_CODE", "99213", " {n}", 0.9, "regex"), None),
    (("01/02/2020 ", "CPT_CODE", "99213", " E11.9 {n}", 0.9, "regex"), ("CPT_CODE", "99213", 0.9)),
    (("from ", "DATE_RANGE", "May 3-5, 2021", " {n}", 0.9, "regex"), ("DATE_RANGE", "May 3-5, 2021", 0.9)),
    (("from ", "DATE_RANGE", "May 7-5, 2021", " {n}", 0.9, "regex"), None),
    (("", "TRACKING_NUMBER", "94001{n}", "", 0.9, "regex"), ("TRACKING_NUMBER", "94001{n}", 0.9)),
    (("", "TRACKING_NUMBER", "940{n}", "", 0.9, "regex"), None),
    (("", "REPORT_ID", "R-{n}", "", 0.9, "regex"), ("REPORT_ID", "R-{n}", 0.9)),
    (("", "REPORT_ID", "ABCDEFG", " {n}", 0.9, "regex"), None),
    (("", "DEVICE_ID", "90 mm", " {n}", 0.9, "regex"), None),
    (("", "ICD10_CODE", "U99.9", " {n}", 0.9, "regex"), None),
]


@case_query([[a] if a else [] for _, a in _VALIDATED], ["entity_type", "value", "confidence"])
def validate_spans(spark, sf_dir):
    docs, found = _one_span(_played(spark, sf_dir, [c for c, _ in _VALIDATED], _SPAN))
    return validate.validate(found, docs, AS_OF).select("doc_id", "entity_type", "value", "confidence")


_RETYPED = [
    (("", "CLAIM_NUMBER", "XXX-XX-1234", " {n}", 0.9, "regex"), ("SSN", 0.9)),
    (("", "INSURANCE_ID", "P.O. Box 12", " {n}", 0.7, "regex"), ("ADDRESS", 0.95)),
    (("Member ", "INSURANCE_ID", "A{n}", "", 0.9, "regex"), ("MEMBER_ID", 0.9)),
    (("", "POLICY_NUMBER", "A{n}", " of the group", 0.9, "regex"), ("GROUP_NUMBER", 0.9)),
    (("see EOB\n", "CLAIM_NUMBER", "A{n}", "", 0.9, "regex"), ("EOB_NUMBER", 0.9)),
    (("home ", "US_PHONE_NUMBER", "217-555-0187", " {n}", 0.9, "regex"), ("PHONE_NUMBER", 0.9)),
    (("hotline ", "PHONE_NUMBER", "217-555-0187", " {n}", 0.9, "regex"), ("ORGANIZATION_CONTACT_INFO", 0.9)),
    (("for {n} ", "PHONE_NUMBER", "800-555-0187", "", 0.9, "regex"), ("ORGANIZATION_CONTACT_INFO", 0.9)),
    (("for {n} ", "US_PHONE_NUMBER", "217-555-0187", "", 0.9, "regex"), ("US_PHONE_NUMBER", 0.9)),
    (("Invoice date ", "DATE", "01/02/2020", " {n}", 0.9, "regex"), ("DOCUMENT_CREATION_DATE", 0.9)),
    (("born ", "DATE_TIME", "01/02/2020", " {n}", 0.9, "regex"), ("DATE_OF_BIRTH", 0.9)),
    (("Discharge date: ", "DATE", "01/02/2020", " {n}", 0.9, "regex"), ("DATE_OF_SERVICE", 0.9)),
    (("effective date ", "DATE", "01/02/2020", " {n}", 0.9, "regex"), ("COVERAGE_DATE", 0.9)),
    (("payment due ", "DATE", "01/02/2020", " {n}", 0.9, "regex"), ("DUE_DATE", 0.9)),
    (("on\n", "DATE", "01/02/2020", " {n} born", 0.9, "regex"), ("DATE", 0.9)),
    (("", "PERSON", "Asthma", " {n}", 0.9, "ner"), ("DISEASE", 0.9)),
    (("", "ORGANIZATION", "Lipitor Plus", " {n}", 0.9, "ner"), ("MEDICATION", 0.9)),
    (("take ", "PERSON", "Veltra", " 20 mg {n}", 0.9, "ner"), ("MEDICATION", 0.9)),
    (("in ", "LOCATION", "Salem, OR", " {n}", 0.7, "ner"), ("LOCATION", 0.95)),
    (("Patient information\nName: ", "PERSON", "Ann Hill", "", 0.9, "ner"), ("PATIENT", 0.9)),
    (("Patient information, medical history\nName: ", "PERSON", "Ann Hill", "", 0.9, "ner"), ("PERSON", 0.9)),
]


@case_query([[a] for _, a in _RETYPED], ["entity_type", "confidence"])
def reclassify_spans(spark, sf_dir):
    docs, found = _one_span(_played(spark, sf_dir, [c for c, _ in _RETYPED], _SPAN))
    return spans.reclassify(found, docs).select("doc_id", "entity_type", "confidence")


_DECIDED = [
    (("", "PERSON", "Para Obtener Ayuda", "", 0.7, "ner"), ("REJECT", None, 0.95)),
    (("", "PERSON", "Ann {n}", "", 0.7, "ner"), ("REJECT", None, 0.95)),
    (("", "EOB_NUMBER", "Box 12", " {n}", 0.7, "ner"), ("RECLASSIFY", "ADDRESS", 0.95)),
    (("", "LOCATION", "Salem, OR", " {n}", 0.7, "ner"), ("CONFIRM", None, 0.95)),
    (("", "ORGANIZATION", "Copay", " {n}", 0.7, "ner"), ("REJECT", None, 0.95)),
    (("", "ORGANIZATION", "Hearing Centre", " benefit {n}", 0.7, "ner"), ("REJECT", None, 0.95)),
    (("rx ", "PERSON", "Kroger Main", " {n}", 0.7, "ner"), ("RECLASSIFY", "ORGANIZATION", 0.90)),
    (("", "DOCTOR", "Ann Hill consult", " {n}", 0.7, "ner"), ("CONFIRM", None, 0.90)),
    (("", "PERSON", "Signature", " {n}", 0.7, "ner"), ("REJECT", None, 0.95)),
    (("", "PERSON", "widget", " {n}", 0.7, "ner"), ("REJECT", None, 0.95)),
    (("", "PERSON", "Ann Hill", " {n}", 0.7, "ner"), ("CONFIRM", None, 0.88)),
    (("", "EMAIL", "a{n}@x.org", "", 0.93, "ner"), ("CONFIRM", None, 0.93)),
    (("", "EMAIL", "a{n}@x.org", "", 0.7, "ner"), ("CONFIRM", None, 0.85)),
]


@case_query([[a] for _, a in _DECIDED], ["decision", "corrected_type", "decision_confidence"])
def decide_candidates(spark, sf_dir):
    docs, found = _one_span(_played(spark, sf_dir, [c for c, _ in _DECIDED], _SPAN))
    return rules.decide(found.join(docs.withColumnRenamed("text", "context"), "doc_id")).select("doc_id", "decision", "corrected_type", "decision_confidence")


_RECOGNISED = [
    (("address ", "PERSON", "Oak Hill", " {n}", 0.6, "ner"), ("LOCATION", "Oak Hill", 0.6)),
    (("at ", "LOCATION", "Box Hill", " {n}", 0.85, "ner"), ("ADDRESS", "Box Hill", 0.85)),
    (("on ", "PERSON", "Metformin", " {n}", 0.85, "ner"), None),
    (("take ", "PERSON", "Veltra", " 20 mg {n}", 0.85, "ner"), None),
    (("by ", "PERSON", "Ann Hill MD", " {n}", 0.85, "ner"), ("PERSON", "Ann Hill", 0.75)),
    (("by ", "PERSON", "Ann Hill\nNurse", " {n}", 0.7, "ner"), ("PERSON", "Ann Hill", 0.7)),
    (("by ", "ORGANIZATION", "Copay", " {n}", 0.85, "ner"), None),
    (("by ", "ORGANIZATION", "SN-{n}", "", 0.85, "ner"), None),
    (("in ", "DATE_TIME", "three weeks", " {n}", 0.85, "ner"), None),
    (("in ", "DATE_TIME", "1492", " {n}", 0.85, "ner"), None),
    (("in ", "DATE_TIME", "1992", " {n}", 0.85, "ner"), ("DATE_TIME", "1992", 0.85)),
    (("in ", "DATE_TIME", "5/10", " {n}", 0.2, "ner"), None),
    (("by ", "PERSON", "Dr.", " {n}", 0.85, "ner"), None),
    (("by ", "PERSON", "Mercy Hospital", " {n}", 0.85, "ner"), None),
    (("by ", "NPI_NUMBER", "1234567890", " {n}", 0.85, "ner"), None),
    (("by ", "NPI_NUMBER", "1234567893", " {n}", 0.85, "ner"), ("NPI_NUMBER", "1234567893", 0.85)),
]


@case_query([[a] if a else [] for _, a in _RECOGNISED], ["entity_type", "value", "confidence"])
def filter_recognised(spark, sf_dir):
    docs, found = _one_span(_played(spark, sf_dir, [c for c, _ in _RECOGNISED], _SPAN))
    return rules.filter_recognised(found, docs).select("doc_id", "entity_type", "value", "confidence")


# text -> (type, value, start, confidence)
_SUPPLEMENTED = [
    ("We certify that Ann B. Hill is here. {n}", [("PERSON", "Ann B. Hill", 16, 0.88)]),
    ("Witness: Bob Ray MD\n{n}", [("PERSON", "Bob Ray", 9, 0.88)]),
    ("Witness: Insurance Company\n{n}", []),
    ("the Acme Widget Corporation {n}", [("ORGANIZATION", "Acme Widget Corporation", 4, 0.85)]),
    ("at 12 Old Oak Street {n}", [("ADDRESS", "12 Old Oak Street", 3, 0.85)]),
    ("nothing here {n}", []),
]
_ROLES = [
    ("seen by Dr. Ann Hill and Dr. Ann Hill {n}", [("DOCTOR", "Dr. Ann Hill", 8, 0.76)]),
    ("at Old Mercy Hospital {n}", [("HOSPITAL", "Old Mercy Hospital", 3, 0.76)]),
    ("Patient: Bob Ray, {n}", [("PATIENT", "Bob Ray", 9, 0.76)]),
    ("Oak Clinic and Elm Medical Center {n}", [("MEDICAL_FACILITY", "Oak Clinic", 0, 0.76), ("MEDICAL_FACILITY", "Elm Medical Center", 15, 0.76)]),
    ("none {n}", []),
]
_PHRASES = [
    ("High  blood-pressure and type 2 diabetes mellitus {n}", [("CLINICAL_FINDING", "High  blood-pressure", 0, 0.85), ("DISEASE", "type 2 diabetes mellitus", 25, 0.85)]),
    ("two biopsies, two MRIs {n}", [("PROCEDURE", "MRIs", 18, 0.85)]),
    ("aspirins and aligned {n}", [("MEDICATION", "aspirins", 0, 0.85)]),
    ("hemoglobin A1c {n}", [("LAB", "hemoglobin A1c", 0, 0.85)]),
]


def _texts(spark, sf_dir, cases) -> DataFrame:
    return _played(spark, sf_dir, [(t,) for t, _ in cases], "text string")


@case_query([a for _, a in _SUPPLEMENTED], ["entity_type", "value", "start", "confidence"])
def supplement_spans(spark, sf_dir):
    return rules.supplements(_texts(spark, sf_dir, _SUPPLEMENTED)).select("doc_id", "entity_type", "value", "start", "confidence")


@case_query([a for _, a in _ROLES], ["entity_type", "value", "start", "confidence"])
def care_role_spans(spark, sf_dir):
    return rules.care_roles(_texts(spark, sf_dir, _ROLES)).select("doc_id", "entity_type", "value", "start", "confidence")


@case_query([a for _, a in _PHRASES], ["entity_type", "value", "start", "confidence"])
def clinical_phrase_spans(spark, sf_dir):
    return rules.phrases(_texts(spark, sf_dir, _PHRASES)).select("doc_id", "entity_type", "value", "start", "confidence")


_GATED = [
    (("Bob Ray met {n}",), "regex,ner,llm"), (("email phone {n}",), "regex,llm"), (("seen by a nurse {n}",), "regex,zero_shot,llm"), (("blood test of the patient {n}",), "regex,clinical,zero_shot,llm"),
    (("Phone Number of him {n}",), "regex,llm"), (("an avenue {n}",), "regex,ner,llm"), (("  ",), ""),
]


@case_query([[(a,)] for _, a in _GATED], ["detectors"])
def open_detectors(spark, sf_dir):
    docs = _played(spark, sf_dir, [c for c, _ in _GATED], "text string").withColumn("route", F.lit("regex,clinical,ner,zero_shot,llm"))
    return routing.plan_detectors(docs).select("doc_id", F.array_join("detectors", ",").alias("detectors"))


_NEXT = [
    (("Bob Ray met {n}", "regex", 0, 0), (None, "DONE")), (("Bob Ray met {n}", "regex", 2, 0), ("ner", "CANDIDATES")), (("Bob Ray met {n}", "regex,ner", 0, 1), ("llm", "UNCERTAIN")),
    (("Bob Ray met {n}", "", 0, 0), ("regex", "OPEN")), (("Bob Ray met {n}", "regex,ner,llm", 0, 1), (None, "EXHAUSTED")),
]


@case_query([[a] for _, a in _NEXT], ["detector", "reason"])
def next_detectors(spark, sf_dir):
    played = _played(spark, sf_dir, [c for c, _ in _NEXT], "text string, ran string, candidates int, uncertain int").withColumn("route", F.lit("regex,ner,zero_shot,llm"))
    state = played.select("doc_id", F.filter(F.split("ran", ","), lambda x: x != "").alias("executed"), "candidates", "uncertain")
    return routing.next_detector(played.select("doc_id", "text", "route"), state)


# document type hint, entity type -> priority, should_mask (None: dropped)
_POLICED = [
    (("Bank Statement", "PERSON"), ("MUST_HAVE", True)), (("bank-statement", "DATE"), ("DROP", False)), (("bank statement", "CVV"), ("NICE_TO_HAVE", True)), ((None, "ORGANIZATION"), ("DROP", False)), (("UNKNOWN", "ORGANIZATION"), None),
    (("nda", "IP_ADDRESS"), ("NICE_TO_HAVE", True)), (("prescript", "MEDICATION"), ("NICE_TO_HAVE", True)), ((None, "LAB"), ("NICE_TO_HAVE", True)), (("", "INVOICE NUMBER"), ("DROP", False)), (("kyc", "SSN"), ("MUST_HAVE", True)),
    (("cv", "PREMIUM AMOUNT"), ("NICE_TO_HAVE", True)), (("cv", "WIDGET {n}"), ("NICE_TO_HAVE", True)),
]
_POLICIES = [("Bank Statement", "FULL NAME / PERSON NAME", "MUST_HAVE"), ("Bank Statement", "ADMISSION / DISCHARGE / SERVICE DATE", "DROP"), ("Bank Statement", "CARD VERIFICATION CODE (CVV/CVC/CID/CAV2)", "NICE_TO_HAVE"), ("Prescription", "MEDICATION / PRESCRIPTION DETAIL", "NICE_TO_HAVE")]


@case_query([[a] if a and not (c[0] == "bank-statement") else [] for c, a in _POLICED], ["priority", "should_mask"])
def document_policies(spark, sf_dir):
    played = _played(spark, sf_dir, [c for c, _ in _POLICED], "document_type string, entity_type string")
    policies = spark.createDataFrame(_POLICIES, "document_type string, name string, priority string")
    return taxonomy.apply(played, policies).select("doc_id", "priority", "should_mask")


_COVERED = [
    ("", [], ("FULLY_COVERED", 100.0, 0, 0, 0, False, True)), ("some words {n}", [], ("UNCOVERED", 0.0, 0, 1, 1, False, False)), (" -- ", [], ("UNCOVERED", 0.0, 0, 0, 0, False, True)),
    ("Name: Ann", [(6, 9)], ("FULLY_COVERED", 33.3, 1, 1, 0, False, True)), ("Ann Hill paid 12", [(0, 8)], ("PARTIALLY_COVERED", 50.0, 1, 1, 1, False, False)),
    ("Ann card 12 x", [(0, 3)], ("INSUFFICIENTLY_COVERED", 23.1, 1, 1, 1, True, False)), ("Ann, Bob", [(0, 3), (5, 8)], ("FULLY_COVERED", 75.0, 2, 1, 0, False, True)),
    ("abcdefgh 1234 ijklmnop", [(0, 4), (2, 8), (14, 22)], ("PARTIALLY_COVERED", 72.7, 2, 1, 1, False, False)),
]


@case_query([[a] for *_, a in _COVERED], ["status", "percentage", "resolved", "unresolved", "meaningful", "high_risk", "skip"])
def chunk_coverage(spark, sf_dir):
    played = _played(spark, sf_dir, [(t, [list(x) for x in s]) for t, s, _ in _COVERED], "text string, places array<array<int>>")
    chunks = played.select("doc_id", F.lit(0).alias("chunk_id"), F.lit(0).alias("start"), F.length("text").alias("end"), "text")
    found = played.select("doc_id", F.explode("places").alias("x")).select("doc_id", F.get("x", 0).alias("start"), F.get("x", 1).alias("end"))
    return spans.coverage(chunks, found).drop("chunk_id")


_PROVIDERS = [(("Azure-OpenAI",), "Azure"), (("my gemma 3",), "Gemma"), ((" ollama ",), "Gemma"), ((" Local ",), "Local"), (("  ",), None), ((None,), None)]


@case_query([[(a,)] for _, a in _PROVIDERS], ["provider"])
def provider_names(spark, sf_dir):
    from veilspark.operators.relational import canonical_provider

    return _played(spark, sf_dir, [c for c, _ in _PROVIDERS], "name string").select("doc_id", canonical_provider(F.col("name")).alias("provider"))


_STRUCTURED = [(('{"a": {n}}',), True), (('{"a": ',), False), (("a,b\n1,2\n{n},4",), True), (("a,b\n1,2,3",), False), (("one line, here {n}",), False), (("x|y\n{n}|2",), True), (("",), False)]


@case_query([[(a,)] for _, a in _STRUCTURED], ["structured"])
def structured_inputs(spark, sf_dir):
    return _played(spark, sf_dir, [c for c, _ in _STRUCTURED], "text string").select("doc_id", rules.is_structured(F.col("text")).alias("structured"))


_AUDITS = [
    ('{"document_id": "{n}", "llm_candidate_audit": {"accepted": [{"a": 1}, 2], "rejected": [{"b": 2}]}}', (1, 1)), ('{"document_id": "{n}", "llm_candidate_audit": 5}', (0, 0)), ('{"document_id": "other"}', (None, None)), ("[]", (None, None)),
    ('{"document_id": "{n}", "llm_candidate_audit": {"accepted": {"a": 1}, "rejected": []}}', (0, 0)),
]


@case_query([[a] for _, a in _AUDITS], ["accepted", "rejected"])
def report_audits(spark, sf_dir):
    played = _played(spark, sf_dir, [(p,) for p, _ in _AUDITS], "payload string")
    made = redact.normalize_audits(played.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "payload"))
    return made.select((F.col("doc_id") - 1_000_000).alias("doc_id"), F.when(F.col("accepted").isNotNull(), F.size("accepted")).alias("accepted"), F.when(F.col("rejected").isNotNull(), F.size("rejected")).alias("rejected"))


_ANNOTATED = [
    ("Ann saw Ann  Hill and Ann {n}", [("Ann", None, None), ("Ann Hill", None, None), ("Ann", None, None), ("Bob", None, None)], [("Ann", 0, 3), ("Ann Hill", 8, 17), ("Ann", 8, 11), ("Bob", None, None)]),
    ("Ann saw Ann {n}", [("Ann", 0, 3), ("Ann", None, None)], [("Ann", 0, 3), ("Ann", 8, 11)]),
]


@case_query([a for *_, a in _ANNOTATED], ["value", "start", "end_"])
def resolve_annotations(spark, sf_dir):
    played = _played(spark, sf_dir, [(t, [list(map(str, x)) for x in g]) for t, g, _ in _ANNOTATED], "text string, gold array<array<string>>")
    gold = played.select("doc_id", F.posexplode("gold").alias("seq", "g")).select("doc_id", "seq", F.get("g", 0).alias("value"), F.get("g", 1).try_cast("int").alias("start"), F.get("g", 2).try_cast("int").alias("end"))
    return evaluate.resolve_annotations(gold, played).select("doc_id", "value", "start", F.col("end").alias("end_"))


_PAGED = [(("one\n\n\f\n\ntwo {n}", 1), 1), (("one\n\n\f\n\ntwo {n}", 9), 2), (("one\n\n\f\n\ntwo {n}", 4), 2), (("one {n}", 99), 1)]


@case_query([[(a,)] for _, a in _PAGED], ["page"])
def page_of_offset(spark, sf_dir):
    played = _played(spark, sf_dir, [c for c, _ in _PAGED], "text string, offset int")
    return evaluate.page_of(played.select("doc_id", "offset"), played).select("doc_id", "page")


_SCORED = [(("Nurse",), "PERSON"), (("clinical finding",), "CLINICAL_FINDING"), ((" po_box ",), "ADDRESS"), (("HOSPITAL",), "ORGANIZATION"), (("WIDGET{n}",), "WIDGET{n}"), ((None,), "")]


@case_query([[(a,)] for _, a in _SCORED], ["scored"])
def scored_types(spark, sf_dir):
    return _played(spark, sf_dir, [c for c, _ in _SCORED], "kind string").select("doc_id", evaluate.scored_type(F.col("kind")).alias("scored"))


_RESUMED = [
    ((None, False, False), "LOAD_DOCUMENT"), (("UPDATE_PROCESSING_STATUS", False, False), "DOCUMENT_CLASSIFICATION"), (("STORE_OCR_RESULTS", True, False), "DETECTION_EXECUTION"), (("STORE_OCR_RESULTS", False, False), "DOCUMENT_CLASSIFICATION"),
    (("REDACTION", True, True), "REPORT_GENERATION"), (("REDACTION", True, False), "DOCUMENT_CLASSIFICATION"), (("COMPLETE_WORKFLOW", False, False), "COMPLETE_WORKFLOW"),
]


@case_query([[(a,)] for _, a in _RESUMED], ["resume_at"])
def resume_stages(spark, sf_dir):
    return jobs.resume_stage(_played(spark, sf_dir, [c for c, _ in _RESUMED], "last_stage string, has_text boolean, has_redaction boolean")).select("doc_id", "resume_at")


_RETRIED = [((0, "TIMEOUT"), ("RETRY", 1)), ((3, "TIMEOUT"), ("DEAD", 3)), ((0, "REDACTION_VERIFICATION_FAILED"), ("DEAD", 0)), ((None, None), ("RETRY", 1))]


@case_query([[a] for _, a in _RETRIED], ["next", "retry_count"])
def retried_jobs(spark, sf_dir):
    return jobs.retry_or_fail(_played(spark, sf_dir, [c for c, _ in _RETRIED], "retry_count int, error string")).select("doc_id", "next", "retry_count")


_CUT_TABLES = [
    ("<table><tr><th>a<th>b &amp; c<tr><td>1<td>{n}</table>", [(0, 0, 0, "a"), (0, 0, 1, "b & c"), (0, 1, 0, "1"), (0, 1, 1, "{n}")]), ("<p>none {n}</p>", []),
    ("<table><tr><td>x <table><tr><td>in {n}</td></tr></table> y</td></tr></table>", [(0, 0, 0, "x y"), (1, 0, 0, "in {n}")]),
]


@case_query([a for _, a in _CUT_TABLES], ["table_", "row_", "cell", "text"])
def html_table_cells(spark, sf_dir):
    pages = _texts(spark, sf_dir, _CUT_TABLES).select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))
    return layout.html_tables(pages).select(F.col("page_id").alias("doc_id"), F.col("table").alias("table_"), F.col("row").alias("row_"), "cell", "text")


_STRIPPED = [(("Patient Name: Ann Hill {n}",), "ann hill"), (("email phone 12",), ""), (("the SSN of Bob_Ray",), "the bob ray")]


@case_query([[(a,)] for _, a in _STRIPPED], ["words"])
def label_stripper(spark, sf_dir):
    from veilspark.functions.text import without_labels

    return _played(spark, sf_dir, [c for c, _ in _STRIPPED], "text string").select("doc_id", without_labels(F.col("text")).alias("words"))


_BOUNDED = [((100, 40, 50, 10), (30, 60)), ((20, 5, 10, 50), (0, 19)), ((10, 0, 10, 5), (0, 10)), ((100, 0, 4, 10), (0, 24)), ((100, 95, 100, 10), (75, 100))]


@case_query([[a] for _, a in _BOUNDED], ["left_", "right_"])
def context_windows(spark, sf_dir):
    played = _played(spark, sf_dir, [(*c[:3],) for c, _ in _BOUNDED], "size int, start int, stop int").withColumn("i", (F.col("doc_id") % len(_BOUNDED)))
    out = None
    for w in sorted({c[3] for c, _ in _BOUNDED}):
        a, b = routing.context_bounds(F.col("size"), F.col("start"), F.col("stop"), w)
        part = played.where(F.col("i").isin(*[i for i, (c, _) in enumerate(_BOUNDED) if c[3] == w])).select("doc_id", a.alias("left_"), b.alias("right_"))
        out = part if out is None else out.unionByName(part)
    return out


_ENCLOSED = [([(0, 10), (8, 20), (15, 30)], (9, 12), 1), ([(0, 10), (8, 20)], (8, 10), 0), ([(0, 10)], (5, 12), None)]


@case_query([[(a,)] for *_, a in _ENCLOSED], ["chunk_id"])
def enclosing_chunks(spark, sf_dir):
    played = _played(spark, sf_dir, [([list(x) for x in c], *s) for c, s, _ in _ENCLOSED], "chunks array<array<int>>, start int, end int")
    chunks = played.select("doc_id", F.posexplode("chunks").alias("chunk_id", "c")).select("doc_id", "chunk_id", F.get("c", 0).alias("start"), F.get("c", 1).alias("end"))
    return documents.enclosing_chunk(played.select("doc_id", "start", "end"), chunks).select("doc_id", "chunk_id")


_RANKED = [
    ([(0, 100), (100, 200), (200, 300)], [(10, 20, 0.9), (150, 160, 0.5), (155, 170, 0.9)], [(200, 300)], [(0, 6.0), (1, 13.0)]), ([(0, 100)], [], [(0, 40), (30, 60)], [(0, 1.8)]), ([(0, 100)], [(5, 9, 0.5)], [(0, 100)], []),
]


@case_query([a for *_, a in _RANKED], ["chunk_id", "score"])
def relevant_chunks(spark, sf_dir):
    rows = [([list(map(float, x)) for x in c], [list(map(float, x)) for x in s], [list(map(float, x)) for x in lo]) for c, s, lo, _ in _RANKED]
    played = _played(spark, sf_dir, rows, "chunks array<array<double>>, found array<array<double>>, locked array<array<double>>")
    place = [F.get("x", 0).cast("int").alias("start"), F.get("x", 1).cast("int").alias("end")]
    chunks = played.select("doc_id", F.posexplode("chunks").alias("chunk_id", "x")).select("doc_id", "chunk_id", *place)
    found = played.select("doc_id", F.explode("found").alias("x")).select("doc_id", *place, F.get("x", 2).alias("confidence"))
    return documents.relevant_chunks(chunks, found, played.select("doc_id", F.explode("locked").alias("x")).select("doc_id", *place))


_DETECTED = [
    ("Patient Name: Anna B. Smith", [("PATIENT", "Anna B. Smith", 14, 1.0)]), ("Card Number: 4111 1111 1111 1111", [("CREDIT_CARD", "4111 1111 1111 1111", 13, 1.0)]), ("Card 4111 1111 1111 1112", [("CREDIT_CARD", "4111 1111 1111 1112", 5, 0.4)]),
    ("order 4111 1111 1111 1112 shipped", []), ("SSN: 123-45-6788", [("SSN", "123-45-6788", 5, 1.0)]), ("Member ID: ABX12345", [("MEMBER_ID", "ABX12345", 11, 1.0)]), ("DOB: 04/12/1980", [("DATE_OF_BIRTH", "04/12/1980", 5, 1.0)]),
    ("write to ann@mail.com", [("EMAIL", "ann@mail.com", 9, 1.0)]), ("from 10.20.30.40 on", [("IP_ADDRESS", "10.20.30.40", 5, 1.0)]), ("00480 Cook Cove", []), ("Patient: Customer Service", []),
    ("Claim Number: CLM778112", [("CLAIM_NUMBER", "CLM778112", 14, 1.0)]), ("Aadhaar 1234 5678 9012", [("AADHAAR_NUMBER", "1234 5678 9012", 8, 1.0)]), ("code 1234 5678 9012", []), ("see http://x.org/y now", [("URL", "http://x.org/y", 4, 1.0)]),
    ("NPI 1234567893", [("NPI_NUMBER", "NPI 1234567893", 0, 1.0)]), ("Invoice Number: INV-2020-11", [("INVOICE_NUMBER", "INV-2020-11", 16, 1.0)]), ("CPT 99213", [("CPT_CODE", "CPT 99213", 0, 1.0)]), ("ticket 99213", []),
    ("May 3-5, 2021", [("DATE_RANGE", "May 3-5, 2021", 0, 0.8)]), ("Passport A1234567", [("PASSPORT_NUMBER", "A1234567", 9, 1.0)]),
]


@case_query([a for _, a in _DETECTED], ["entity_type", "value", "start", "confidence"])
def detect_cases(spark, sf_dir):
    from veilspark.operators import detect

    return detect.detect(_texts(spark, sf_dir, _DETECTED)).select("doc_id", "entity_type", "value", "start", "confidence")


_RELEASED = [
    ("Mail ann@mail.com, again ANN@mail.com.", ("Mail [REDACTED_EMAIL], again [REDACTED_EMAIL].", "RELEASED")), ("SSN: 123-45-6788", ("SSN: [REDACTED_SSN]", "RELEASED")), ("DOB: 04/12/1980", ("DOB: [REDACTED_DATE_OF_BIRTH]", "RELEASED")),
    ("Nothing here.", ("Nothing here.", "RELEASED")), ("Patient Name: Anna B. Smith\nAnna B. Smith left.", ("Patient Name: [REDACTED_PATIENT]\n[REDACTED_PATIENT] left.", "RELEASED")),
    ("Member ID: ABX12345\nAddress: 12 Oak Street, Salem, OR 97301", ("Member ID: [REDACTED_MEMBER_ID]\nAddress: [REDACTED_ADDRESS]", "RELEASED")),
    ("Witness: Bob Ray MD\nseen at Old Mercy Hospital with aspirin", ("Witness: [REDACTED_PERSON]\nseen at [REDACTED_HOSPITAL] with [REDACTED_MEDICATION]", "RELEASED")),
]


@case_query([[a] for _, a in _RELEASED], ["redacted_text", "status"])
def release_cases(spark, sf_dir):
    from veilspark.plans.release import release

    done = release(_texts(spark, sf_dir, _RELEASED), AS_OF)
    return done.redacted.join(done.status, "doc_id").select("doc_id", "redacted_text", "status")


_MERGED = [
    ("12 Oak Street\nSalem, OR 97301", [(0, 13, "ADDRESS")], [("ADDRESS", "12 Oak Street\nSalem, OR 97301")]), ("12 Oak Street, Apt 4", [(0, 13, "ADDRESS"), (15, 20, "ADDRESS")], [("ADDRESS", "12 Oak Street, Apt 4")]),
    ("9 Elm Road-x-7 Ash Lane", [(0, 10, "ADDRESS"), (13, 23, "ADDRESS")], [("ADDRESS", "9 Elm Road"), ("ADDRESS", "7 Ash Lane")]), ("Salem, OR 97301", [(0, 9, "CITY_STATE_ZIP")], [("ADDRESS", "Salem, OR 97301")]),
    ("Patient: David A Wilson", [(9, 16, "PERSON"), (17, 23, "PERSON")], [("PATIENT", "David A Wilson")]), ("Nurse David A Wilson", [(6, 13, "PERSON"), (14, 20, "PERSON")], [("PERSON", "David A"), ("PERSON", "Wilson")]),
    ("David\nWilson", [(0, 5, "PATIENT"), (6, 12, "PERSON")], [("PATIENT", "David"), ("PERSON", "Wilson")]),
]


@case_query([a for *_, a in _MERGED], ["entity_type", "value"])
def merge_parts(spark, sf_dir):
    played = _played(spark, sf_dir, [(t, [list(map(str, x)) for x in s]) for t, s, _ in _MERGED], "text string, parts array<array<string>>")
    at = played.select("doc_id", "text", F.explode("parts").alias("x")).select("doc_id", "text", F.get("x", 0).cast("int").alias("start"), F.get("x", 1).cast("int").alias("end"), F.get("x", 2).alias("entity_type"))
    found = at.select("doc_id", F.lit(1).alias("page"), "start", "end", "entity_type", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("value"), F.lit(0.9).alias("confidence"), F.lit("regex").alias("detector"))
    return spans.merge_persons(spans.merge_addresses(found, played), played).select("doc_id", "entity_type", "value")


_DATES = [
    ("02/29/2024", True), ("02/29/2023", False), ("29/02/2024", True), ("13/13/2020", False), ("1-2-2020", True), ("1/2/68", False), ("1/2/69", True), ("1/2/30", True), ("5-Mar-1999", True), ("5 march 1999", True), ("Sept 5, 1999", False),
    ("May 5 1999", True), ("2020-2-30", False), ("20200229", True), ("1849-12-31", False), ("Monday, May 5, 1999", True), ("2021-03-03T10:30:00Z", True), ("10:30", False), ("x", False), ("", False),
]


@case_query([[(a,)] for _, a in _DATES], ["real"])
def real_dates(spark, sf_dir):
    from veilspark.functions.dates import is_real_date

    return _texts(spark, sf_dir, _DATES).select("doc_id", is_real_date(F.col("text"), AS_OF).alias("real"))


_REMAINING = [
    ("Patient Name: Ann Hill", [], [("label_value", 14, 22)]), ("Summary of the Visit", [], []), ("saw Dr. Ann Hill at Old Mercy Hospital today.", [], [("titled_name", 4, 16), ("organization_or_facility", 20, 38)]),
    ("mail a@b.org or 217-555-0187 now.", [(5, 12)], [("structured_token", 16, 28)]), ("he has fever and Pain.", [], [("domain_signal", 7, 12), ("proper_noun", 17, 21)]), ("Salary - 90,000 a year", [], [("label_value", 9, 22)]),
    ("Contact: medical information", [], []), ("met Bob once.", [], []), ("met Bob Ray once.", [], [("proper_noun", 4, 11)]),
]


@case_query([a for *_, a in _REMAINING], ["kind", "start", "end_"])
def remaining_candidates(spark, sf_dir):
    played = _played(spark, sf_dir, [(t, [list(x) for x in s]) for t, s, _ in _REMAINING], "text string, shut array<array<int>>")
    locked = played.select("doc_id", F.explode("shut").alias("x")).select("doc_id", F.get("x", 0).alias("start"), F.get("x", 1).alias("end"))
    return routing.remaining_candidates(played, locked).select("doc_id", "kind", "start", F.col("end").alias("end_"))
