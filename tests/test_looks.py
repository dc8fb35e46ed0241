"""The quicker looks before patterns lose nothing."""

import re

from veilspark.functions import tables as T
from veilspark.operators import detect, rules

TEXTS = (
    "Acme Holdings Inc. since included", "since trust\nincidents, hundred addresses", "seen by Dr. Ann Hill", "dr\tBob Ray", "EIN: 12-3456789, TIN none", "1 2 3 4 5 6 7 8 9 0 1 2 3", "BP 120/80, A12.3, CPT 99213", "Salem, OR 97301 +91 9876543210",
    "SSN: XXX-XX-1357 and (217) 555-0187", "NPI 1234567893 Member ID: A1BC", "born DOB: ٠٤/12/1980", "Company: Old Mill", "agreement is signed between Foo Bar and x", "B1234567 ABCDE1234F 1234 5678 9012 560001", "CVV 123 exp 01/29",
)


def test_looks_before_patterns_lose_no_match():
    for text in TEXTS:
        low, digit = text.lower(), re.search(r"\d", text)
        want = [(k, *detect._value_at(m, k in T.GROUP_VALUE_ENTITIES)) for k in T.PATTERNS if (any(w in low for w in detect.NEEDS[k]) if k in detect.NEEDS else digit) for m in detect.compiled(k).finditer(text)]
        assert list(detect.matches_of(text)) == want, text
    assert {k for t in TEXTS for k, *_ in detect.matches_of(t)} > {"ORGANIZATION", "DOCTOR", "TAX_ID", "CREDIT_CARD", "CITY_STATE_ZIP", "SSN", "NPI_NUMBER", "ICD10_CODE", "PASSPORT_NUMBER"}


def test_patterns_are_spared_where_nothing_can_match(monkeypatch):
    asked, compiled = set(), detect.compiled
    monkeypatch.setattr(detect, "compiled", lambda k: asked.add(k) or compiled(k))
    list(detect.matches_of("since the 7 incidents, hundred addresses of tin"))
    assert not asked & {"ORGANIZATION", "DOCTOR", "TAX_ID", "ZIP_CODE", "CITY_STATE_ZIP"}


def test_rules_see_texts_beside_their_looks(spark):
    texts = ["Kaspirin", "takes MRIs", "éasthma_ asthmaİ", "I certify that Ann Hill is", "PATIENT NAME: Ann Hill", "by\x0bOld Mill\x0bGroup", "Two\x0bOak Tree\nLane 5", "1Oak Street", "Patient :\tAnn Hill", "seen at Old Mercy\x0bHospital", "no match", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for found, own in ((rules.supplements(docs), rules.SUPPLEMENT_LOOK), (rules.care_roles(docs), rules.CARE_LOOK), (rules.phrases(docs), "phrases")):
        assert "MapInArrow" in found._jdf.queryExecution().toString(), own
    got = lambda df: sorted((r.doc_id, r.entity_type, r.value) for r in df.collect())
    look = rules._where
    seen = [got(f(docs)) for f in (rules.supplements, rules.care_roles, rules.phrases)]
    try:
        rules._where = lambda rows, _: rows
        assert seen == [got(f(docs)) for f in (rules.supplements, rules.care_roles, rules.phrases)]
    finally:
        rules._where = look
    assert all(seen) and len(seen[2]) == 3
