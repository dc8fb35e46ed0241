import random

from veilspark.operators import evaluate, redact, spans

SCHEMA = "doc_id long, page int, start int, end int, entity_type string, value string, confidence double, detector string"


def made(n=300, seed=1):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a = r.randrange(60)
        out.append((r.randrange(6), r.randrange(1, 3), a, a + r.randrange(1, 15), r.choice(["DATE", "PERSON"]), r.choice("abc"), r.randrange(5, 11) / 10, r.choice(["regex", "llm"])))
    return out


def greedy(rows):
    """The definition: in order, a span enters if it overlaps none that entered, or equals one in interval and value."""
    out = []
    for s in sorted(rows, key=lambda s: (-(s[3] - s[2]), -s[6], s[2], s[3], s[4], s[5])):
        clash = [t for t in out if t[:2] == s[:2] and t[2] < s[3] and s[2] < t[3]]
        if all((t[2], t[3], t[5]) == (s[2], s[3], s[5]) for t in clash):
            out.append(s)
    return out


def test_resolve_is_the_greedy_set(spark):
    rows = list({r[:6]: r for r in made()}.values())
    got = [tuple(r) for r in spans.resolve(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted(greedy(rows))


def test_rejected_span_rejects_nothing(spark):
    rows = [(1, 1, 0, 10, "A", "x", 0.9, "d"), (1, 1, 8, 14, "B", "y", 0.9, "d"), (1, 1, 12, 16, "C", "z", 0.9, "d")]
    got = spans.resolve(spark.createDataFrame(rows, SCHEMA))
    assert {r.entity_type for r in got.collect()} == {"A", "C"}


def test_redaction_of_touching_and_overlapping_spans(spark):
    docs = spark.createDataFrame([(1, "😀 ab cdef gh"), (2, "none"), (3, None)], "doc_id long, text string")
    s = spark.createDataFrame([(1, 1, 2, 4, "X", "ab", 1.0, "d"), (1, 1, 4, 9, "Y", " cdef", 1.0, "d"), (1, 1, 5, 7, "Z", "cd", 1.0, "d")], SCHEMA)
    got = {r.doc_id: r.redacted_text for r in redact.redact(docs, s).collect()}
    assert got == {1: "😀 [REDACTED_X][REDACTED_Y] gh", 2: "none", 3: None}


def test_verify_blocks_what_remains(spark):
    docs = spark.createDataFrame([(1, "Anna met anna."), (2, "Bert left.")], "doc_id long, text string")
    s = spark.createDataFrame([(1, 1, 0, 4, "PERSON", "Anna", 1.0, "d"), (2, 1, 0, 4, "PERSON", "Bert", 1.0, "d")], SCHEMA)
    status = {r.doc_id: (r.status, r.issues) for r in redact.verify(docs, s, redact.redact(docs, s)).collect()}
    assert status == {1: ("BLOCKED", ["VALUE_REMAINS"]), 2: ("RELEASED", [])}
    wide = s.unionByName(redact.expand_occurrences(docs, s))
    assert {r.status for r in redact.verify(docs, s, redact.redact(docs, wide)).collect()} == {"RELEASED"}


def test_expansion_takes_values_literally(spark):
    docs = spark.createDataFrame([(1, "a.b+c(d) A.B+C(D) aXb")], "doc_id long, text string")
    s = spark.createDataFrame([(1, 1, 0, 8, "EMAIL", "a.b+c(d)", 1.0, "d")], SCHEMA)
    assert sorted((r.start, r.end) for r in redact.expand_occurrences(docs, s).collect()) == [(0, 8), (9, 17)]


def test_match_gold(spark):
    p = spark.createDataFrame([(1, 1, 0, 10, "A", "", 1.0, "d"), (1, 1, 2, 12, "A", "", 1.0, "d"), (1, 1, 40, 44, "A", "", 1.0, "d")], SCHEMA)
    g = spark.createDataFrame([(1, 1, 1, 11, "A", "", 1.0, "d"), (2, 1, 0, 3, "B", "", 1.0, "d")], SCHEMA)
    m = evaluate.metrics(evaluate.match_gold(p, g)).first()
    assert (m.tp, m.fp, m.fn) == (1, 2, 1) and m.precision == 0.333333


def test_addresses_merge_over_blanks_and_take_in_their_city(spark):
    text = "Home 12 Oak Street\nApt 4, Salem, OR 97301 and 9 Elm Road-x-7 Ash Lane."
    at = lambda v, kind="ADDRESS": (1, 1, text.index(v), text.index(v) + len(v), kind, v, 0.9, "d")
    rows = [at("12 Oak Street"), at("Apt 4"), at("9 Elm Road"), at("7 Ash Lane")]
    got = spans.merge_addresses(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert sorted((r.value, r.confidence) for r in got.collect()) == [("12 Oak Street\nApt 4, Salem, OR 97301 and 9 Elm Road", 1.0), ("7 Ash Lane", 0.9)]
    city = "9 Elm Road\nSalem, OR 97301"
    got = spans.merge_addresses(spark.createDataFrame([(1, 1, 0, 10, "ADDRESS", "9 Elm Road", 0.9, "d")], SCHEMA), spark.createDataFrame([(1, city)], "doc_id long, text string"))
    assert [(r.value, r.end) for r in got.collect()] == [(city, len(city))]


def test_parts_of_a_patients_name_merge(spark):
    text = "Patient Name: David A Wilson. Nurse Ann Hill saw Bob Ray"
    at = lambda v, kind: (1, 1, text.index(v), text.index(v) + len(v), kind, v, 0.8, "d")
    rows = [at("David A", "PERSON"), at("Wilson", "PERSON"), at("Ann", "PERSON"), at("Hill", "PERSON"), at("Bob Ray", "PERSON")]
    got = spans.merge_persons(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert sorted((r.value, r.entity_type) for r in got.collect()) == [("Ann", "PERSON"), ("Bob Ray", "PERSON"), ("David A Wilson", "PATIENT"), ("Hill", "PERSON")]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], SCHEMA)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spans.resolve(none).count() == spans.merge_touching(none).count() == redact.redact(docs, none).count() == 0
    assert evaluate.metrics(evaluate.match_gold(none, none)).first().f1 == 0


def test_usage_is_unknown_for_the_whole_document(spark):
    calls = spark.createDataFrame([(1, 1000, 10, 0, 2.0, 4.0), (1, 5, 5, None, 2.0, 4.0), (2, 1000, 10, 100, 2.0, 4.0)], "doc_id long, tokens_in long, tokens_out long, cached long, rate_in double, rate_out double")
    got = {r.doc_id: r.cost for r in redact.usage_ledger(calls).collect()}
    assert got[1] is None and float(got[2]) == 0.00184


def test_reclassify(spark):
    text = "Patient information\nName: Anna Smith DOB: 1980-01-01\nTicket of Bob Ray"
    at = lambda v, kind: (1, 1, text.index(v), text.index(v) + len(v), kind, v, 1.0, "d")
    s = spark.createDataFrame([at("Anna Smith", "PERSON"), at("1980-01-01", "DATE"), at("Bob Ray", "PERSON")], SCHEMA)
    got = spans.reclassify(s, spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert {r.value: r.entity_type for r in got.collect()} == {"Anna Smith": "PATIENT", "1980-01-01": "DATE_OF_BIRTH", "Bob Ray": "PERSON"}


def test_not_overlapping_is_its_definition(spark):
    rows, locked = made(300, 1), made(40, 2)
    free = [s for s in rows if not any(t[:2] == s[:2] and t[2] < s[3] and s[2] < t[3] for t in locked)]
    got = [tuple(r) for r in spans.not_overlapping(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(locked, SCHEMA)).collect()]
    assert sorted(got) == sorted(free) and free


def test_overlap_pairs_meet_once(spark):
    a, b = made(120, 3), made(120, 4)
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA).select("doc_id", "start", "end")
    got = spans.overlap_pairs(left.select("doc_id", "start", "end"), right, ["doc_id"], size=4)
    want = sorted((x[0], x[2], x[3], y[2], y[3]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert sorted((r.doc_id, r.start, r.end, r.r_start, r.r_end) for r in got.collect()) == want
