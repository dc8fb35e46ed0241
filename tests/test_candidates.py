from pyspark.sql import functions as F

from veilspark.operators import candidates as C

SCHEMA = "doc_id long, page int, start int, end int, entity_type string, value string, confidence double, detector string, similarity double"


def test_gate(spark):
    text = "Name: Alice Smith | balance\nN/A x copay patient"
    rows = [(6, 17, "PERSON", "Alice Smith", 0.1), (20, 27, "ORGANIZATION", "balance", 0.9), (28, 31, "PERSON", "N/A", 0.9), (34, 39, "LOCATION", "copay", 0.9), (40, 47, "PERSON", "patient", 0.9), (32, 33, "SSN", "x", 0.0), (32, 33, "DISEASE", "x", 0.1), (32, 33, "DISEASE", "y", 0.3), (32, 33, "DISEASE", "z", 0.5)]
    made = spark.createDataFrame([(1, 1, a, b, t, v, 0.5, "ner", s) for a, b, t, v, s in rows], SCHEMA)
    got = {(r.entity_type, r.value): r.quality for r in C.quality_gate(made, spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert [got[t, v] for _, _, t, v, _ in rows] == ["PLAUSIBLE", *["OBVIOUS_NOISE"] * 4, "HIGH_VALUE", "OBVIOUS_NOISE", "AMBIGUOUS", "PLAUSIBLE"]


def test_settled_and_replaced(spark):
    rows = [("regex", "DATE", 0.8), ("regex", "DATE", 0.7), ("zero_shot", "PERSON", 0.82), ("zero_shot", "PATIENT", 0.82), ("ner", "PERSON", 0.95), ("ner", "NPI_NUMBER", 0.9)]
    got = [r.x for r in spark.createDataFrame(rows, "d string, t string, c double").select(C.authoritative(F.col("d"), F.col("t"), F.col("c")).alias("x")).collect()]
    assert got == [True, False, False, True, False, True]
    pair = lambda *p: dict(zip(("entity_type", "confidence", "detector"), map(F.lit, p)))
    cases = [(("PERSON", 0.9, "regex"), ("PATIENT", 0.75, "ner")), (("DATE", 0.9, "regex"), ("DATE", 0.99, "llm")), (("DATE", 0.5, "ner"), ("DATE", 0.5, "llm")), (("DATE", 0.7, "ner"), ("DATE", 0.6, "llm"))]
    row = spark.range(1).select(*[C.replaces(pair(*a), pair(*b)).alias(f"c{i}") for i, (a, b) in enumerate(cases)]).first()
    assert list(row) == [True, False, True, False]


def test_vectors_and_contexts(spark):
    row = spark.range(1).select(C.compatibility(F.lit("heart disease"), F.lit("the heart disease"), F.lit("heart disease")).alias("a"), C.compatibility(F.lit("qq"), F.lit(""), F.lit("heart disease")).alias("b"), F.size(C.text_vector(F.lit(""))).alias("n")).first()
    assert row.a > 0.9 and row.b < 0.2 and row.n == 320
    docs = spark.createDataFrame([(1, "x" * 100 + " account: AB1234567 " + "y" * 100 + " word " + "z" * 200 + " end")], "doc_id long, text string")
    s = spark.createDataFrame([(1, 1, 110, 119, "ID", "AB1234567", 0.5, "ner", 0.0), (1, 1, 221, 225, "ID", "word", 0.5, "ner", 0.0)], SCHEMA)
    got = C.contexts(s, docs, most=1).collect()
    assert len(got) == 1 and got[0].score == 125


def test_origin(spark):
    f = spark.createDataFrame([(1, 1, 0, 5, "A", "hello", 1.0, "regex", 0.0), (1, 1, 10, 15, "B", "there", 1.0, "regex", 0.0), (1, 1, 20, 25, "C", "world", 1.0, "regex", 0.0), (1, 1, 40, 45, "D", "gone!", 1.0, "regex", 0.0)], SCHEMA)
    r = spark.createDataFrame([(1, 1, 0, 5, "A", "hello", 1.0, "regex", 0.0), (1, 1, 10, 15, "X", "there", 1.0, "ner", 0.0), (1, 1, 22, 25, "C", "rld", 1.0, "ner", 0.0)], SCHEMA)
    assert [x.origin for x in C.origin(f, r).orderBy("start").collect()] == ["detector_origin", "reclass_origin", "partial_origin", "downstream_origin"]
