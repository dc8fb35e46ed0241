"""Predictions against gold annotations, and text recognition quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilspark.operators.fold import fold_groups


def match_gold(predictions: DataFrame, gold: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, outcome (TP, FP, FN), entity_type, detector: greedy one-to-one matching.

    Predictions in order of page, start, end take the gold span of their page and
    type with the largest overlap over the longer length, from ``least``; each gold
    span once, the earlier on ties. The order matters, so a document is one group.
    """
    p = predictions.select("doc_id", F.lit(0).alias("gold"), "page", "start", "end", "entity_type", "detector")
    g = gold.select("doc_id", F.lit(1).alias("gold"), "page", "start", "end", "entity_type", F.lit(None).cast("string").alias("detector"))

    def one(rows: list[tuple]) -> list[tuple]:
        out, free = [], {}
        for _, is_gold, page, start, end, kind, _ in rows:
            if is_gold:
                free.setdefault((page, kind), []).append((start, end))
        for doc, is_gold, page, start, end, kind, detector in rows:
            if is_gold:
                continue
            best, at = 0.0, None
            for i, (a, b) in enumerate(free.get((page, kind), [])):
                ratio = max(0, min(b, end) - max(a, start)) / max(b - a, end - start, 1)
                if ratio >= least and ratio > best:
                    best, at = ratio, i
            if at is not None:
                free[page, kind].pop(at)
            out.append((doc, "FP" if at is None else "TP", kind, detector))
        return out + [(rows[0][0], "FN", kind, None) for (_, kind), left in free.items() for _ in left]

    schema = StructType.fromDDL("doc_id long, outcome string, entity_type string, detector string")
    return fold_groups(p.unionByName(g), ["doc_id"], [F.col(c) for c in ("page", "start", "end", "entity_type", "detector")], one, schema)


def metrics(outcomes: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, accuracy (tp over all three); 0 where undefined."""
    n = outcomes.groupBy(*by).agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("TP", "FP", "FN")])
    return n.select(*by, "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = share(tp, tp + fp), share(tp, tp + fn)
    return [F.round(x, 6).alias(n) for n, x in (("precision", p), ("recall", r), ("f1", share(2 * p * r, p + r)), ("accuracy", share(tp, tp + fp + fn)))]


def value_sets(found: Column, expected: Column) -> list[Column]:
    """Precision, recall, F1 and accuracy of two arrays taken as sets."""
    tp = F.size(F.array_intersect(found, expected))
    return scores(tp, F.size(F.array_except(found, expected)), F.size(F.array_except(expected, found)))


def error_rates(read: Column, truth: Column) -> tuple[Column, Column]:
    """Character edits over the truth's length, and over its number of words."""
    edits = F.levenshtein(read, truth)
    words = F.regexp_count(truth, F.lit(r"\S+"))
    return F.round(edits / F.greatest(F.length(truth), F.lit(1)), 6), F.round(edits / F.greatest(words, F.lit(1)), 6)


# Types that count as one in scoring; types not named count as themselves.
SCORED_AS = {
    "PERSON": "PATIENT PROVIDER DOCTOR PHYSICIAN NURSE", "DISEASE": "DIAGNOSIS PROBLEM MEDICAL_CONDITION", "MEDICATION": "DRUG", "LAB": "LAB_RESULT LAB_TEST", "DATE": "DATE_TIME START_DATE VISIT_DATE TIME", "DATE_OF_BIRTH": "DOB",
    "EMAIL": "EMAIL_ADDRESS", "US_PHONE_NUMBER": "PHONE_NUMBER PHONE MOBILE", "ADDRESS": "PO_BOX", "LOCATION": "CITY STATE COUNTRY", "ORGANIZATION": "ORG COMPANY HOSPITAL CLINIC INSTITUTE MEDICAL_FACILITY HEALTHCARE_ORGANIZATION INSURANCE_PROVIDER",
    "POLICY_NUMBER": "INSURANCE_ID", "TAX_ID": "EIN", "MRN": "MEDICAL_RECORD_NUMBER", "ZIP_CODE": "PIN_CODE POSTAL_CODE", "BANK_ACCOUNT_NUMBER": "BANK_ACCOUNT", "CREDIT_CARD_NUMBER": "CREDIT_CARD", "AADHAAR_NUMBER": "AADHAAR",
    "PASSPORT_NUMBER": "PASSPORT", "DRIVING_LICENSE": "DRIVING_LICENSE_NUMBER",
}


def scored_type(kind: Column) -> Column:
    """The type a detector's type counts as in scoring."""
    name = F.upper(F.trim(F.coalesce(kind, F.lit(""))))
    pairs = [*[(a, k) for k, names in SCORED_AS.items() for a in names.split()], ("CLINICAL FINDING", "CLINICAL_FINDING")]
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs for x in kv]), name), name)


def resolve_annotations(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """Gold annotations (doc_id, seq, entity_type, value, start, end, page) with missing offsets filled in.

    Equal values of a document take its occurrences one after another, in the
    order of ``seq``, without those that annotations with offsets hold already;
    blanks in a value match any blanks. Values that do not occur stay without offsets.
    """
    given = gold.where("start is not null and end is not null")
    asked = gold.where("start is null or end is null")
    words = F.transform(F.split("value", " "), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    wanted = asked.where("value <> ''").select("doc_id", "value").distinct().withColumn("pattern", F.concat(F.lit(r"\G([\s\S]*?)("), F.array_join(words, r"\s+"), F.lit(")")))
    both = wanted.join(docs.select("doc_id", "text"), "doc_id")
    cuts = F.zip_with(F.expr("regexp_extract_all(text, pattern, 1)"), F.expr("regexp_extract_all(text, pattern, 2)"), lambda g, v: F.struct(F.length(g).alias("g"), F.length(v).alias("v")))
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1)["b"], F.lit(0))
    found = F.aggregate(cuts, F.array().cast("array<struct<a:int,b:int>>"), lambda acc, c: F.concat(acc, F.array(F.struct((last(acc) + c["g"]).alias("a"), (last(acc) + c["g"] + c["v"]).alias("b")))))
    places = both.select("doc_id", "value", F.explode(found).alias("m")).select("doc_id", "value", F.col("m.a").alias("a"), F.col("m.b").alias("b"))
    used = given.select("doc_id", F.col("start").alias("a"), F.col("end").alias("b"))
    places = places.join(used, ["doc_id", "a", "b"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "value").orderBy("a")))
    numbered = asked.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "value").orderBy("seq")))
    filled = numbered.join(places, ["doc_id", "value", "n"], "left").withColumn("start", F.coalesce("a", "start")).withColumn("end", F.coalesce("b", "end"))
    return given.unionByName(filled.select(*gold.columns))


def page_of(offsets: DataFrame, docs: DataFrame) -> DataFrame:
    """offsets (doc_id, offset) with page: the page of the document's text that holds it; the last page for what no page holds."""
    from veilspark.functions.text import PAGE_BREAK

    sizes = F.transform(F.split("text", PAGE_BREAK.replace("\f", "\\f").replace("\n", "\\n")), lambda p: F.length(p))
    ends = F.aggregate(sizes, F.array().cast("array<struct<a:int,b:int>>"), lambda acc, n: F.concat(acc, F.array(F.struct((F.coalesce(F.get(acc, F.size(acc) - 1)["b"] + len(PAGE_BREAK), F.lit(0))).alias("a"), (F.coalesce(F.get(acc, F.size(acc) - 1)["b"] + len(PAGE_BREAK), F.lit(0)) + n).alias("b")))))
    out = offsets.join(docs.select("doc_id", ends.alias("pages")), "doc_id", "left")
    at = F.filter(F.transform("pages", lambda p, i: F.when((p["a"] <= F.col("offset")) & (F.col("offset") < p["b"]), i + 1)), lambda x: x.isNotNull())
    return out.withColumn("page", F.coalesce(F.get(at, 0), F.size("pages"), F.lit(1))).drop("pages")
