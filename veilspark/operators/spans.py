"""Interval algebra on spans (doc_id, page, start, end, entity_type, value, confidence, detector).

Intervals are half-open and live within one page of one document, so every
window and join below is keyed by (doc_id, page) first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import vocabulary as V
from veilspark.functions.text import overlap_ratio, value_key
from veilspark.operators.fold import fold_groups
from veilspark.operators.store import deal, fence

PAGE = ["doc_id", "page"]


def dedupe(spans: DataFrame) -> DataFrame:
    """One span for each (page, start, end, type): the most confident, then the least value and detector."""
    rank = F.row_number().over(Window.partitionBy(*PAGE, "start", "end", "entity_type").orderBy(F.desc("confidence"), "value", "detector"))
    return spans.withColumn("r", rank).where("r = 1").drop("r")


def resolve(spans: DataFrame, order: Sequence[str | tuple[str, bool]] = (("length", False), ("confidence", False), ("start", True)), keep_same: bool = True) -> DataFrame:
    """The greedy set of non-overlapping spans taken in ``order`` on each page.

    A rejected span rejects nothing itself, which no window expresses, so a page
    is folded in order. With ``keep_same``, equal intervals with equal values stay
    together for a later choice between their types.
    """
    from veilspark.operators.detect import _greedy

    i, j, v = (spans.columns.index(c) for c in ("start", "end", "value"))
    by = {"length": F.col("end") - F.col("start")}
    keys = [(by.get(k, F.col(k)), up) for k, up in (o if isinstance(o, tuple) else (o, True) for o in order)]
    ranks = [c.asc() if up else c.desc() for c, up in keys] + [F.col(c) for c in ("start", "end", "entity_type", "value")]

    def one(rows: list[tuple]) -> list[tuple]:
        same: dict[tuple, list[tuple]] = {}
        for r in rows:
            same.setdefault((r[i], r[j], r[v]), []).append(r)
        taken = _greedy([(*k[:2], group) for k, group in same.items()])
        return [r for t in taken for r in (t[2] if keep_same else t[2][:1])]

    return fold_groups(spans, PAGE, ranks, one, spans.schema)


def merge_touching(spans: DataFrame, gap: int = 0) -> DataFrame:
    """doc_id, page, start, end, entity_type, n: unions of overlapping spans.

    With gap 0 spans that only touch stay apart; with gap g, spans at most g
    apart join. The type is that of the first by (start, longest). Two windows over one sort.
    """
    w = Window.partitionBy(*PAGE).orderBy("start", F.desc("end"), "entity_type")
    so_far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = so_far.isNull() | (F.col("start") >= so_far) if gap == 0 else so_far.isNull() | (F.col("start") > so_far + gap)
    marked = deal(PAGE, spans)[0].withColumn("fresh", fresh.cast("int"))
    marked = marked.withColumn("island", F.sum("fresh").over(w))
    first = F.min_by("entity_type", F.struct("start", -F.col("end"), "entity_type"))
    return marked.groupBy(*PAGE, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), first.alias("entity_type"), F.count("*").alias("n")).drop("island")


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], size: int = 256) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose intervals [start, end) overlap; right's interval becomes r_start, r_end.

    Both sides are posted at each bucket of ``size`` they touch, and a pair counts
    in the bucket where the later one starts, so rows of one key do not all meet.
    """
    bucket = lambda d: d.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.greatest("end", F.col("start") + 1) - 1) / size))))
    r = bucket(right).withColumnRenamed("start", "r_start").withColumnRenamed("end", "r_end")
    out = bucket(left).join(r, [*keys, "bucket"]).where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")))
    return out.where(F.col("bucket") == F.floor(F.greatest("start", "r_start") / size)).drop("bucket")


# Words that make an uncovered part of a text high-risk.
RISK_CUES = (
    "account", "acct", "holder", "patient", "mrn", "member", "policy", "dob", "birth", "ssn", "tax", "pan", "aadhaar", "passport", "rx", "diagnosis", "condition", "medication", "prescribed", "dr.", "doctor", "physician", "hospital",
    "clinic", "address", "phone", "mobile", "card", "cvv", "amount", "balance", "total", "claim", "employer", "tin", "cin", "npi",
)


def _gap(text: Column, gap: Column) -> Column:
    """Whether a part of a text that no span covers says something, and whether among high-risk words."""
    raw = F.substring(text, gap["a"] + 1, gap["b"] - gap["a"])
    said = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    label = F.regexp_replace(said, r"^[\s\[\](){}|,;]+|[\s\[\](){}|,;]+$", "").rlike(r"^[A-Za-z\s\-_/]+[:|\-]\s*$")
    words = F.filter(F.split(said, r"[\s,:;|/\-]+"), lambda w: w != "")
    telling = said.rlike(r"(?U)\d") | F.exists(words, lambda w: w.rlike(r"^\p{Lu}\p{L}*$")) | (F.length(said) >= 4)
    meant = (F.length(said) >= 2) & said.rlike(r"[\p{L}\p{N}]") & ~label & (F.size(words) > 0) & telling
    from_ = F.greatest(gap["a"] - 30, F.lit(0))
    around = F.lower(F.substring(text, from_ + 1, gap["b"] - from_))
    risky = F.exists(F.array(*map(F.lit, RISK_CUES)), lambda w: F.contains(around, w))
    return F.struct(meant.alias("meant"), (meant & risky).alias("risky"))


def coverage(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, chunk_id, status, percentage, resolved, unresolved, meaningful, high_risk, skip of each chunk (doc_id, chunk_id, start, end, text).

    Spans are clipped to the chunk and merged (touching ones too). What lies between is
    meaningful by what it says. UNCOVERED: no span; FULLY_COVERED: nothing meaningful
    left; INSUFFICIENTLY_COVERED: under 35 % or three meaningful gaps; else PARTIALLY_COVERED.
    """
    hits = overlap_pairs(chunks.select("doc_id", "chunk_id", "start", "end"), spans.select("doc_id", "start", "end"), ["doc_id"])
    part = F.struct((F.greatest("r_start", "start") - F.col("start")).cast("int").alias("a"), (F.least("r_end", "end") - F.col("start")).cast("int").alias("b"))
    per = hits.select("doc_id", "chunk_id", part.alias("x")).groupBy("doc_id", "chunk_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    last = lambda acc: F.element_at(acc, -1)
    grow = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], x["b"]).alias("b"))))
    merged = F.aggregate(F.coalesce("x", none), none, lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(x["a"] <= F.get(acc, F.size(acc) - 1)["b"], grow(acc, x)).otherwise(F.concat(acc, F.array(x))))
    out = chunks.join(per, ["doc_id", "chunk_id"], "left").withColumn("m", F.when(F.size("x") > 0, merged).otherwise(none)).withColumn("n", F.length("text"))
    zero = F.lit(0)
    gaps = F.zip_with(F.concat(F.array(zero), F.transform("m", lambda m: m["b"])), F.concat(F.transform("m", lambda m: m["a"]), F.array(F.col("n"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    out = out.withColumn("gaps", F.filter(gaps, lambda g: g["a"] < g["b"])).withColumn("judged", F.transform("gaps", lambda g: _gap(F.col("text"), g)))
    covered = F.aggregate("m", zero, lambda acc, m: acc + m["b"] - m["a"])
    percentage = F.when(F.col("n") == 0, 100.0).otherwise(F.round(covered / F.greatest("n", F.lit(1)) * 100, 1))
    said = F.col("text").rlike("[a-zA-Z0-9]")
    bare = (F.size("m") == 0) & (F.col("n") > 0)
    meaningful = F.when(bare, said.cast("int")).otherwise(F.size(F.filter("judged", lambda j: j["meant"])))
    out = out.withColumn("percentage", percentage).withColumn("meaningful", meaningful)
    status = F.when(bare, "UNCOVERED").when(F.col("meaningful") == 0, "FULLY_COVERED").when((F.col("percentage") < 35) | (F.col("meaningful") >= 3), "INSUFFICIENTLY_COVERED").otherwise("PARTIALLY_COVERED")
    return out.select(
        "doc_id", "chunk_id", status.alias("status"), "percentage", F.size("m").alias("resolved"), F.when(bare, said.cast("int")).when(F.col("n") == 0, zero).otherwise(F.size("gaps")).alias("unresolved"), "meaningful",
        (~bare & F.exists("judged", lambda j: j["risky"])).alias("high_risk"), F.when(bare, ~said).otherwise(F.col("meaningful") == 0).alias("skip"),
    )


def nearest_dosage(spans: DataFrame, reach: int = 30, drug: str = "MEDICATION", dose: str = "DOSAGE") -> DataFrame:
    """doc_id, page, start, end, value, dosage, distance: each drug's nearest dose within reach.

    A range join in buckets of ``reach``: a dose is offered to its own and the
    neighbouring buckets, so pages with many spans do not meet all with all.
    """
    # ends of a span may lie buckets apart, so both sides are posted at every bucket they touch
    bucket = lambda lo, hi: F.explode(F.sequence(F.floor(lo / reach), F.floor(hi / reach)))
    d = spans.where(F.col("entity_type") == drug).withColumn("bucket", bucket(F.col("start") - reach, F.col("end") + reach))
    q = spans.where(F.col("entity_type") == dose).select(*PAGE, F.col("start").alias("qs"), F.col("end").alias("qe"), F.col("value").alias("qv"), bucket(F.col("start"), F.col("end")).alias("bucket"))
    away = F.greatest(F.lit(0), F.col("qs") - F.col("end"), F.col("start") - F.col("qe"))
    near = d.join(q, [*PAGE, "bucket"]).withColumn("distance", away).where(F.col("distance") <= reach)
    best = near.groupBy(*PAGE, "start", "end", "value").agg(F.min(F.struct("distance", "qs", "qe", "qv")).alias("m"))
    return best.select(*PAGE, "start", "end", "value", F.col("m.qv").alias("dosage"), F.col("m.distance").alias("distance"))


def not_overlapping(spans: DataFrame, locked: DataFrame) -> DataFrame:
    """Spans that overlap no locked span of their page.

    Locked spans are merged into islands; the last island that starts before a
    span's end is the only one that can overlap it, so one sorted pass decides.
    """
    island = merge_touching(locked).select(*PAGE, F.col("start").alias("at"), F.lit(1).alias("kind"), F.col("end").alias("until"), F.lit(None).cast(_row_type(spans)).alias("row"))
    span = spans.select(*PAGE, F.col("end").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("until"), F.struct(*spans.columns).alias("row"))
    before = F.last("until", ignorenulls=True).over(Window.partitionBy(*PAGE).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return span.unionByName(island).withColumn("before", before).where("kind = 0").where(F.coalesce(F.col("before") <= F.col("row")["start"], F.lit(True))).select("row.*")


def _row_type(df: DataFrame) -> str:
    return df.schema.simpleString()


def duplicates_of(spans: DataFrame, known: DataFrame) -> DataFrame:
    """Spans that repeat a known one: same page and type, equal interval, or equal value with overlap of half at least."""
    s, k = spans.alias("s"), known.alias("k")
    same = (F.col("s.start") == F.col("k.start")) & (F.col("s.end") == F.col("k.end"))
    close = (value_key(F.col("s.value")) == value_key(F.col("k.value"))) & (overlap_ratio(F.col("s.start"), F.col("s.end"), F.col("k.start"), F.col("k.end")) >= 0.5)
    on = (F.col("s.doc_id") == F.col("k.doc_id")) & (F.col("s.page") == F.col("k.page")) & (F.col("s.entity_type") == F.col("k.entity_type")) & (same | close)
    return s.join(k, on, "left_semi")


def calibrate(spans: DataFrame) -> DataFrame:
    """Confidence by detector, and its level."""
    c = F.when((F.col("detector") == "ner") & (F.col("entity_type") == "DATE_TIME") & (F.col("confidence") >= 0.6), F.lit(0.80))
    c = c.when(F.col("detector") == "clinical", F.least("confidence", F.lit(0.95))).when(F.col("detector") == "llm", F.greatest("confidence", F.lit(0.88))).otherwise(F.col("confidence"))
    level = F.when(F.col("confidence") >= 0.80, "HIGH").when(F.col("confidence") >= 0.60, "MEDIUM").otherwise("LOW")
    return spans.withColumn("confidence", c).withColumn("level", level).withColumn("confidence", F.round("confidence", 3))


def normalize_types(spans: DataFrame) -> DataFrame:
    """The type each detector's type stands for, and its privacy category; types no table names are personal."""
    names = F.create_map(*[F.lit(x) for kv in V.TYPE_ALIASES.items() for x in kv])
    kind = F.upper("entity_type")
    out = spans.withColumn("entity_type", F.coalesce(F.try_element_at(names, kind), kind))
    return out.withColumn("privacy_category", F.when(F.col("entity_type").isin(*V.HEALTH), "PHI").otherwise("PII"))


# What follows an address that belongs to it.
CITY_LINE = r"(?i)^[ \t]*(?:\r?\n)?[ \t]*(?:City,?[ \t]*State[ \t]*(?:and[ \t]*)?Zip|City/State/Zip|CSZ)?[ \t]*[:\-]?[ \t]*[A-Za-z\s.'-]+,[ \t]*[A-Z]{2}[ \t]+\d{5}(?:-\d{4})?"
ZIP_BEHIND = r"^[ \t]+\d{5}(?:-\d{4})?\b"
ADDRESSES = ("ADDRESS", "CITY_STATE_ZIP")


def _between(text: Column, a: Column, b: Column) -> Column:
    return F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _chains(spans: DataFrame, docs: DataFrame, joins) -> DataFrame:
    """Spans with their text and the number of their chain: a span goes on with the chain of the one before it on its page where ``joins`` holds.

    joins(gap) is asked of the text between the two; b_type and b_end are the one before's.
    """
    w = Window.partitionBy(*PAGE).orderBy("start", "end", "entity_type", "value")
    left, right = deal(["doc_id"], spans, docs.select("doc_id", "text"))
    out = left.join(right, "doc_id").withColumn("b_end", F.lag("end").over(w)).withColumn("b_type", F.lag("entity_type").over(w))
    goes_on = F.coalesce((F.col("start") >= F.col("b_end")) & joins(_between(F.col("text"), F.col("b_end"), F.col("start"))), F.lit(False))
    return out.withColumn("chain", F.sum((~goes_on).cast("int")).over(w)).drop("b_end", "b_type")


def merge_addresses(spans: DataFrame, docs: DataFrame, reach: int = 60) -> DataFrame:
    """Addresses that follow one another within ``reach`` characters with a line end, comma or space between become one
    (confidence 1), and an address takes in a city, state and ZIP code, or a ZIP code, right behind it. Other columns are the first's."""
    is_address = F.col("entity_type").isin(*ADDRESSES)
    linked = _chains(spans, docs, lambda gap: is_address & F.col("b_type").isin(*ADDRESSES) & (F.length(gap) <= reach) & gap.rlike("[\n, ]"))
    first = F.min_by(F.struct(*spans.columns), F.struct("start", "end", "entity_type", "value"))
    out = linked.groupBy(*PAGE, "chain").agg(first.alias("f"), F.max("end").alias("z"), F.count("*").alias("n"), F.first("text").alias("text"))
    address = F.col("f.entity_type").isin(*ADDRESSES)
    value = F.when(F.col("n") > 1, _stripped(_between(F.col("text"), F.col("f.start"), F.col("z")))).otherwise(F.col("f.value"))
    behind = F.substring(F.col("text"), F.col("z") + 1, 120)
    more = F.length(F.regexp_extract(behind, CITY_LINE, 0))
    zip_ = F.when(_stripped(value).rlike(r",[ \t]*[A-Z]{2}$"), F.length(F.regexp_extract(behind, ZIP_BEHIND, 0))).otherwise(0)
    out = out.withColumn("more", F.when(~address, 0).when(more > 0, more).otherwise(zip_)).withColumn("joined", (F.col("n") > 1) | (F.col("more") > 0)).withColumn("z", F.col("z") + F.col("more"))
    new = {
        "end": F.col("z"), "entity_type": F.when(F.col("joined"), "ADDRESS").otherwise(F.col("f.entity_type")), "confidence": F.when(F.col("joined"), 1.0).otherwise(F.col("f.confidence")),
        "value": F.when(F.col("joined"), _stripped(_between(F.col("text"), F.col("f.start"), F.col("z")))).otherwise(F.col("f.value")),
    }
    return out.select(*[(new[c] if c in new else F.col("f")[c]).alias(c) for c in spans.columns])


# A label in front of a patient's name.
PATIENT_LABEL = r"(?i)\bpatient(?:\s+name)?\s*[:\-]?\s*$"
PEOPLE = ("PATIENT", "PERSON")


def merge_persons(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Parts of one patient's name, at most three blanks or marks apart, become one span while the whole still reads as a name.

    Parts are chained by what stands between them; a chain, a few spans long, is then folded from the left.
    """
    from veilspark.operators.detect import reads_as_name

    linked = _chains(spans, docs, lambda gap: F.col("entity_type").isin(*PEOPLE) & F.col("b_type").isin(*PEOPLE) & (F.length(gap) <= 3) & gap.rlike(r"^[ \t\r\f.'-]*\z"))
    row = F.struct("start", "end", "entity_type", "value", *[c for c in spans.columns if c not in (*PAGE, "start", "end", "entity_type", "value")])
    per = linked.groupBy(*PAGE, "chain").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.first("text").alias("text"))
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        whole = _stripped(_between(text, last["start"], x["end"]))
        labelled = _between(text, F.greatest(last["start"] - 40, F.lit(0)), last["start"]).rlike(PATIENT_LABEL)
        patient = (last["entity_type"] == "PATIENT") | (x["entity_type"] == "PATIENT") | labelled
        both = last.withField("end", x["end"]).withField("value", whole).withField("entity_type", F.lit("PATIENT")).withField("confidence", F.greatest(last["confidence"], x["confidence"]))
        return F.when((F.size(acc) > 0) & F.coalesce(patient & reads_as_name(whole), F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(x)))

    kind = dict(per.dtypes)["rows"]
    folded = F.aggregate("rows", F.array().cast(kind), step)
    out = per.select(*PAGE, F.explode(F.when(F.size("rows") > 1, folded).otherwise(F.col("rows"))).alias("r"))
    return out.select(*[F.col(c) if c in PAGE else F.col("r")[c].alias(c) for c in spans.columns])


# Types whose value may run over a line's end.
MULTILINE = ("ADDRESS", "CITY_STATE_ZIP", "CLINICAL_SECTION", "PHONE_NUMBER", "US_PHONE_NUMBER", "CUSTOMER_SERVICE_NUMBER", "ORGANIZATION_CONTACT_INFO")


def drop_line_crossing(spans: DataFrame) -> DataFrame:
    return spans.where(~F.col("value").contains("\n") | F.col("entity_type").isin(*MULTILINE))


# What words around a span make of its type, in the order tried. ``line`` is what stands before it on its
# line, ``near`` 80 characters on either side, ``value`` the span itself; patterns are over lower-case text but for value.
RETYPED = (
    (("INSURANCE_ID", "POLICY_NUMBER", "EOB_NUMBER", "CLAIM_NUMBER"), (
        ("SSN", {"value": r"^(?:[Xx*]{3}[-\s]?[Xx*]{2}[-\s]?\d{4}|\d{3}[-\s]?[Xx*]{2}[-\s]?\d{4})$"}), ("ADDRESS", {"value": r"(?i)^(?:P\.?O\.?\s*)?Box\s+\d+$"}), ("MEMBER_ID", {"near": "member"}), ("GROUP_NUMBER", {"near": "group"}),
        ("EOB_NUMBER", {"near": "eob"}),
    )),
    (("PHONE_NUMBER", "US_PHONE_NUMBER", "ORGANIZATION_CONTACT_INFO"), (
        ("PHONE_NUMBER", {"line": "patient|home|mobile|cell|personal"}),
        ("ORGANIZATION_CONTACT_INFO", {"line": "customer service|support|help desk|inquiries|contact us|response line|hotline|office phone|claims phone|claims|appeals|toll-free|toll free"}),
        ("PHONE_NUMBER", {"near": "patient"}), ("ORGANIZATION_CONTACT_INFO", {"near": "customer service|support|help desk|inquiries|contact us|claims|appeals"}),
        ("ORGANIZATION_CONTACT_INFO", {"value": r"^\+?1?[-. \t]?\(?(?:800|888|877|866|855|844|833)\)?[-. \t]?\d{3}[-. \t]?\d{4}$"}),
    )),
    (("DATE", "DATE_TIME"), (
        ("DOCUMENT_CREATION_DATE", {"line": "eob date|statement date|print date|created on|invoice date|generated on|issue date"}), ("DATE_OF_BIRTH", {"line": "date of birth|dob|birth date|born|dependent|child|spouse|beneficiary"}),
        ("DATE_OF_SERVICE", {"line": r"date\(s\) of service|service date|admission date|discharge date|visit date|date of service|dos"}),
        ("COVERAGE_DATE", {"line": "coverage date|effective date|enrollment date|termination date"}), ("DUE_DATE", {"line": "due date|payment due"}),
    )),
    (("PERSON", "ORGANIZATION"), (
        ("DISEASE", {"value": "(?i)^(?:cancer|diabetes|hypertension|asthma|arthritis|depression|anxiety|copd|leukemia|lymphoma)$"}),
        ("MEDICATION", {"value": "(?i)aspirin|atorvastatin|metformin|lisinopril|amoxicillin|omeprazole|gabapentin|levothyroxine|ozempic|metoprolol|losartan|hydrochlorothiazide|simvastatin|sertraline|prednisone|doxycycline|ciprofloxacin|clopidogrel|eliquis|xarelto|januvia|farxiga|jardiance|humira|keytruda|dupixent|adderall|vyvanse|warfarin|tramadol|albuterol|montelukast|brilinta|lipitor|zocor|synthroid|crestor|align|dicyclomine|probiotic|insulin|ibuprofen|paracetamol|acetaminophen"}),
        ("MEDICATION", {"near": r"\b\d+\s*(?:mg|mcg|ml|g|tablets?|capsules?)\b", "near too": "rx|take|daily|dispense|oral|dose|tablet|capsule|medication|prescribed"}),
    )),
)
PLACE = r"^[A-Za-z\s.'-]+,\s*[A-Z]{2}(?:\s+\d{5})?$"
NAME_LABEL = r"(?i)(?:^|\n)[ \t]*[*•\-]?[ \t]*Name[ \t]*[:\-][ \t]*\z"


def reclassify(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Types put right by the words around a span (RETYPED), and people named in a section of patient information; places that read as city and state are sure to 0.95."""
    out = spans.join(docs.select("doc_id", "text"), "doc_id")
    before = lambda n: _between(F.col("text"), F.greatest(F.col("start") - n, F.lit(0)), F.col("start"))
    out = out.withColumn("near", F.lower(F.concat(before(80), F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start") + 80))))
    out = fence(out.withColumn("line", F.lower(F.regexp_extract(before(80), r"[^\n]*\z", 0))))
    where = {"near": F.col("near"), "near too": F.col("near"), "line": F.col("line"), "value": F.trim("value")}
    for types, rules in RETYPED:
        new = F.coalesce(*[F.when(_all([where[k].rlike(p) for k, p in signs.items()]), F.lit(kind)) for kind, signs in rules], F.col("entity_type"))
        boxed = F.col("entity_type").isin(*types) & (F.lit(types[0] == "INSURANCE_ID")) & (new == "ADDRESS")
        out = fence(out.withColumns({"confidence": F.when(boxed, 0.95).otherwise(F.col("confidence")), "entity_type": F.when(F.col("entity_type").isin(*types), new).otherwise(F.col("entity_type"))}))
    place = F.col("entity_type").isin("ADDRESS", "LOCATION", "CITY_STATE_ZIP") & F.trim("value").rlike(PLACE)
    out = out.withColumn("confidence", F.when(place, F.greatest("confidence", F.lit(0.95))).otherwise(F.col("confidence")))
    said = F.lower(before(240))
    from_end = lambda words: F.greatest(*[F.when(F.contains(said, F.lit(w)), F.length(said) - F.locate(w[::-1], F.reverse(said)) - len(w) + 1).otherwise(-1) for w in words])
    section = from_end(("patient information", "patient information")) > from_end(("appointment details", "medical history"))
    patient = (F.col("entity_type") == "PERSON") & before(240).rlike(NAME_LABEL) & section
    out = out.withColumn("entity_type", F.when(patient, "PATIENT").otherwise(F.col("entity_type"))).select(*spans.columns)
    if "privacy_category" in spans.columns:
        out = out.withColumn("privacy_category", F.when(F.col("entity_type").isin(*V.HEALTH), "PHI").otherwise("PII"))
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
