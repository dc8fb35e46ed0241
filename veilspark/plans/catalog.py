"""Named queries over the test tables, each with SQL for the same result where SQL can say it.

Span operators need spans; ``SPANS`` derives some from lineitem: an order is a
document, its lines are spans on two pages, so groups, overlaps and ties occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import tables as T
from veilspark.functions import text as X
from veilspark.operators import candidates, detect, documents, evaluate, layout, redact, relational, spans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("DATE", "PERSON", "MEDICATION", "DOSAGE"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    start = (F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 160
    who = F.when(F.col("l_returnflag") == "A", "regex").when(F.col("l_returnflag") == "N", "clinical").otherwise("llm")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2 + 1).cast("int").alias("page"), start.cast("int").alias("start"), (start + 4 + F.col("l_quantity") % 17).cast("int").alias("end"),
        kind.alias("entity_type"), F.concat(F.lit("v"), (F.col("l_partkey") % 50).cast("string")).alias("value"), F.round(F.col("l_discount") * 5 + 0.5, 2).alias("confidence"), who.alias("detector"),
    )


SPANS = """s AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 + 1 AS INT) AS page, CAST((l_partkey * 7 + l_linenumber * 13) % 160 AS INT) AS start,
  CAST((l_partkey * 7 + l_linenumber * 13) % 160 + 4 + l_quantity % 17 AS INT) AS "end", ['DATE', 'PERSON', 'MEDICATION', 'DOSAGE'][l_suppkey % 4 + 1] AS entity_type,
  'v' || (l_partkey % 50) AS value, round(l_discount * 5 + 0.5, 2) AS confidence, CASE l_returnflag WHEN 'A' THEN 'regex' WHEN 'N' THEN 'clinical' ELSE 'llm' END AS detector FROM lineitem)"""


# ---- documents --------------------------------------------------------------


@query("SELECT doc_id, content_hash, min(doc_id) OVER (PARTITION BY content_hash) AS first_id, doc_id <> min(doc_id) OVER (PARTITION BY content_hash) AS duplicate FROM (SELECT doc_id, sha256(text) AS content_hash FROM documents)")
def exact_duplicates(spark, sf_dir):
    return documents.exact_duplicates(read(spark, sf_dir, "documents"))


@query("SELECT count(DISTINCT sha256(text)) AS fresh FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def new_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return documents.new_documents(docs, documents.with_content_hash(docs.where("doc_id % 3 = 0"))).agg(F.count("*").alias("fresh"))


@query(r"""WITH c AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) || chr(12) || chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1),
p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10) || chr(12) || chr(10) || chr(10))) AS page_text, generate_subscripts(string_split(text, chr(10) || chr(10) || chr(12) || chr(10) || chr(10)), 1) AS page_number FROM c)
SELECT doc_id, page_number, page_text, coalesce(sum(length(page_text) + 5) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS page_offset FROM p""")
def split_pages(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return documents.split_pages(turns.select("doc_id", F.array_join("t.text", X.PAGE_BREAK).alias("text")))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x00]', '', 'g'),
chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8211) || chr(8212) || chr(160), '''''""-- '), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g')) AS normal_sha FROM documents""")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(X.normalize_text(F.col("text")), 256).alias("normal_sha"))


def _cues(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in sorted(words)) + ")"


@query(f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents UNION ALL SELECT -l_orderkey * 10 - l_linenumber, lower(['patient discharge', 'invoice agreement', 'company manager', 'court clause', 'nothing'][l_suppkey % 5 + 1]) FROM lineitem WHERE l_linenumber = 1),
c AS (SELECT doc_id, {_cues(T.HEALTHCARE_CUES)} AS h, {_cues(T.FINANCIAL_CUES)} AS f, {_cues(T.LEGAL_CUES)} AS l, {_cues(T.CORPORATE_CUES)} AS c FROM d),
o AS (SELECT doc_id, CASE WHEN h THEN 'healthcare' WHEN f::INT + l::INT + c::INT >= 2 THEN 'mixed' WHEN f THEN 'financial' WHEN l THEN 'legal' WHEN c THEN 'corporate' ELSE 'generic' END AS domain FROM c)
SELECT doc_id, domain, CASE WHEN domain IN ('healthcare', 'mixed') THEN 'regex,clinical,ner,zero_shot,llm' ELSE 'regex,ner,zero_shot,llm' END AS route FROM o""")
def classify_domain(spark, sf_dir):
    words = F.array(*map(F.lit, ("patient discharge", "invoice agreement", "company manager", "court clause", "nothing")))
    made = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select((-F.col("l_orderkey") * 10 - F.col("l_linenumber")).alias("doc_id"), F.element_at(words, (F.col("l_suppkey") % 5 + 1).cast("int")).alias("text"))
    return documents.classify_domain(read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(made))


#: Texts with document signals: a phrase drawn by each of an order's lines. Classified besides the documents, under -l_orderkey - 1.
_PHRASES = ("bank statement with account number and ifsc", "tax invoice bill to amount due", "sales receipt cashier change due", "medical record patient diagnosis physician", "lab report specimen reference range", "prescription rx dosage refill pharmacy", "insurance policy number claim number premium", "form 1099 tax year wages", "passport date of birth nationality", "this agreement whereas governing law signed by", "agreement", "branch and rate")


def _classified_sql() -> str:
    rows = ", ".join(f"('{kind}', {i}, '{g}', {w}, {n}, '{s}', {sw})" for i, (kind, groups) in enumerate(T.DOCUMENT_SIGNALS.items()) for n, (g, w, sig) in enumerate(groups) for s, sw in sig)
    phrases = ", ".join(f"'{p}'" for p in _PHRASES)
    repaired = "x"
    for pattern, to in documents.REPAIRS:
        repaired = f"regexp_replace({repaired}, '{pattern}', '{to}', 'g')"
    return rf"""WITH sig(kind, ord, grp, gw, gn, signal, w) AS (VALUES {rows}),
raw AS (SELECT -l_orderkey - 1 AS doc_id, string_agg([{phrases}][l_partkey % 12 + 1], ' ' ORDER BY l_linenumber) AS x FROM lineitem GROUP BY 1 UNION ALL SELECT doc_id, text FROM documents),
low AS (SELECT doc_id, lower(substr(coalesce(x, ''), 1, {documents.MOST_CHARS})) AS x FROM raw),
fixed AS (SELECT doc_id, CASE WHEN regexp_matches(x, '{documents.REPAIR_SIGNS}') THEN {repaired} ELSE x END AS x FROM low),
d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(x, '[^a-z0-9#\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM fixed),
hit AS (SELECT doc_id, sig.* FROM d JOIN sig ON CASE WHEN contains(signal, ' ') OR contains(signal, '#') THEN contains(t, signal) ELSE regexp_matches(t, '\b' || signal || '\b') END),
grp AS (SELECT doc_id, kind, ord, grp, sum(w) * (1 + any_value(gw) / 10) AS score, bool_or(signal <> 'agreement') AS strong FROM hit GROUP BY ALL),
size AS (SELECT kind, count(DISTINCT grp) AS groups FROM sig GROUP BY 1),
kinds AS (SELECT doc_id, kind, ord, sum(score) AS score, count(*) AS active, any_value(groups) AS groups,
  bool_or((grp LIKE '%identity%' OR grp LIKE '%structure%') AND grp <> 'agreement_identity') OR (bool_or(grp = 'agreement_identity') AND bool_or(strong)) AS identity FROM grp JOIN size USING (kind) GROUP BY doc_id, kind, ord),
r AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(score) OVER w, 0) AS second FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY round(score * active / groups, 9) DESC, round(score, 9) DESC, ord))
SELECT d.doc_id, CASE WHEN r.score IS NULL OR r.score < 2.5 OR (active = 1 AND NOT identity AND r.score < 3.5) THEN 'UNKNOWN' ELSE kind END AS document_type,
 CASE WHEN r.score IS NULL THEN 0.0 WHEN active = 1 AND NOT identity AND r.score < 3.5 THEN 0.15 WHEN r.score < 2.5 THEN 0.0
 ELSE round(greatest(0.2, least(0.98, least(r.score / 10.0, 1.0) * (0.5 + 0.5 * active / groups) + CASE WHEN identity THEN 0.1 ELSE 0.0 END - CASE WHEN second > 0 AND r.score - second < 2 THEN 0.1 ELSE 0.0 END)), 4) END::DOUBLE AS confidence
FROM d LEFT JOIN r ON d.doc_id = r.doc_id AND rn = 1"""


@query(_classified_sql())
def classify_documents(spark, sf_dir):
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("l_partkey") % 12 + 1).cast("int"))
    lines = read(spark, sf_dir, "lineitem").select((-F.col("l_orderkey") - 1).alias("doc_id"), "l_linenumber", phrase.alias("p"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "p"))), lambda x: x["p"]), " ")
    return documents.classify(read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(lines.groupBy("doc_id").agg(text.alias("text"))))


@query()
def semantic_chunks(spark, sf_dir):
    return documents.chunk(read(spark, sf_dir, "documents"), texts=False).select("doc_id", "chunk_id", "start", "end")


# ---- detection and redaction ---------------------------------------------


_union = " UNION ALL ".join(rf"SELECT doc_id, '{k}' AS entity_type, generate_subscripts(regexp_extract_all(text, '{p}'), 1) - 1 AS ordinal, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for k, p in detect.SIMPLE.items())


@query(_union)
def detect_simple(spark, sf_dir):
    return detect.detect_simple(read(spark, sf_dir, "documents"))


@query()
def detect_spans(spark, sf_dir):
    return detect.detect(read(spark, sf_dir, "documents"))


_safe = {k: detect.SIMPLE[k] for k in ("EMAIL", "IP_ADDRESS")}
_nested = "text"
for _k, _p in _safe.items():
    _nested = f"regexp_replace({_nested}, '{_p}', '[REDACTED_{_k}]', 'g')"


@query(f"SELECT doc_id, sha256({_nested}) AS redacted_sha FROM documents")
def redact_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = detect.detect(docs, ("EMAIL", "IP_ADDRESS"))
    return redact.redact(docs, found).select("doc_id", F.sha2("redacted_text", 256).alias("redacted_sha"))


@query()
def release_documents(spark, sf_dir):
    from veilspark.plans.release import release

    done = release(read(spark, sf_dir, "documents"))
    return done.status.join(done.reports.drop("entities"), "doc_id", "left").select("doc_id", "status", "total", "pii", "phi", "pending")


# ---- span algebra ---------------------------------------------------------


@query(f"""WITH {SPANS} SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, page, start, "end", entity_type ORDER BY confidence DESC, value, detector) = 1""")
def dedupe_spans(spark, sf_dir):
    return spans.dedupe(line_spans(spark, sf_dir))


@query(f"""WITH {SPANS}, m AS (SELECT *, max("end") OVER (PARTITION BY doc_id, page ORDER BY start, "end" DESC, entity_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR start >= before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY start, "end" DESC, entity_type ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT doc_id, page, min(start) AS start, max("end") AS "end", first(entity_type ORDER BY start, "end" DESC, entity_type) AS entity_type, count(*) AS n FROM i GROUP BY doc_id, page, island""")
def merge_overlaps(spark, sf_dir):
    return spans.merge_touching(line_spans(spark, sf_dir))


_deduped = """d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, page, start, "end", entity_type ORDER BY confidence DESC, value, detector) = 1)"""


@query(f"""WITH {SPANS}, {_deduped},
g AS (SELECT doc_id, page, list([struct_pack(a := start, b := "end", t := entity_type, v := value, c := confidence, d := detector)] ORDER BY "end" - start DESC, confidence DESC, start, "end", entity_type, value) AS l FROM d GROUP BY 1, 2),
r AS (SELECT doc_id, page, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.a < x[1].b AND x[1].a < k.b AND NOT (k.a = x[1].a AND k.b = x[1].b AND k.v = x[1].v))) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM g)
SELECT doc_id, page, k.a AS start, k.b AS "end", k.t AS entity_type, k.v AS value, k.c AS confidence, k.d AS detector FROM r""")
def resolve_longest(spark, sf_dir):
    return spans.resolve(spans.dedupe(line_spans(spark, sf_dir)))


@query(f"""WITH {SPANS}, d AS (SELECT DISTINCT doc_id, page, start, "end", value FROM s WHERE entity_type = 'MEDICATION'), q AS (SELECT * FROM s WHERE entity_type = 'DOSAGE')
SELECT d.doc_id, d.page, d.start, d."end", d.value, q.value AS dosage, greatest(0, q.start - d."end", d.start - q."end")::INT AS distance FROM d JOIN q ON d.doc_id = q.doc_id AND d.page = q.page AND greatest(0, q.start - d."end", d.start - q."end") <= 30
QUALIFY row_number() OVER (PARTITION BY d.doc_id, d.page, d.start, d."end", d.value ORDER BY greatest(0, q.start - d."end", d.start - q."end"), q.start, q."end", q.value) = 1""")
def nearest_dosage(spark, sf_dir):
    return spans.nearest_dosage(line_spans(spark, sf_dir))


@query(f"""WITH {SPANS} SELECT a.* FROM s a WHERE detector = 'llm' AND NOT EXISTS (SELECT 1 FROM s b WHERE b.detector = 'regex' AND a.doc_id = b.doc_id AND a.page = b.page AND a.start < b."end" AND b.start < a."end")""")
def suppress_locked(spark, sf_dir):
    s = line_spans(spark, sf_dir)
    return spans.not_overlapping(s.where("detector = 'llm'"), s.where("detector = 'regex'"))


@query(f"""WITH {SPANS}, c AS (SELECT * REPLACE (CASE WHEN detector = 'clinical' THEN least(confidence, 0.95) WHEN detector = 'llm' THEN greatest(confidence, 0.88) ELSE confidence END AS confidence) FROM s)
SELECT * REPLACE (round(confidence, 3) AS confidence), CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM c""")
def calibrate_confidence(spark, sf_dir):
    return spans.calibrate(line_spans(spark, sf_dir))


@query(f"""WITH {SPANS} SELECT doc_id, count(*) AS total, count(*) FILTER (entity_type IN ('DATE', 'PERSON')) AS pii, count(*) FILTER (entity_type NOT IN ('DATE', 'PERSON')) AS phi, count(*) FILTER (confidence < 0.8) AS pending,
array_to_string(list_sort(list(DISTINCT detector)), ',') AS detectors FROM s GROUP BY 1""")
def audit_report(spark, sf_dir):
    made = redact.report(spans.normalize_types(line_spans(spark, sf_dir)))
    return made.select("doc_id", "total", "pii", "phi", "pending", F.array_join("detectors", ",").alias("detectors"))


@query(f"""WITH {SPANS}, d AS (SELECT detector, CASE WHEN confidence >= 0.8 THEN 'LOCKED' ELSE 'PENDING' END AS status FROM s)
SELECT detector, count(*) FILTER (status = 'LOCKED') AS "LOCKED", count(*) FILTER (status = 'PENDING') AS "PENDING", 0 AS "PRE_LLM_REJECT" FROM d GROUP BY 1""")
def routing_counts(spark, sf_dir):
    return candidates.routing_counts(candidates.status(line_spans(spark, sf_dir).withColumn("decision", F.lit("PENDING"))))


@query(f"""WITH {SPANS}, f AS (SELECT DISTINCT doc_id, page, start, "end", entity_type, value FROM s WHERE detector = 'regex'), r AS (SELECT * FROM s WHERE detector <> 'regex'),
m AS (SELECT f.doc_id, f.page, f.start, f."end", f.entity_type, f.value, f.value = r.value AS v, f.entity_type = r.entity_type AS t,
 (least(f."end", r."end") - greatest(f.start, r.start)) / greatest(f."end" - f.start, r."end" - r.start) + (f.value = r.value)::INT + (f.entity_type = r.entity_type)::INT AS score, r.detector AS det
 FROM f JOIN r ON f.doc_id = r.doc_id AND f.page = r.page AND f.start < r."end" AND r.start < f."end" QUALIFY row_number() OVER (PARTITION BY f.doc_id, f.page, f.start, f."end", f.entity_type, f.value ORDER BY score DESC, v DESC, t DESC, det DESC) = 1)
SELECT CASE WHEN m.v IS NULL THEN 'downstream_origin' WHEN v AND t THEN 'detector_origin' WHEN v THEN 'reclass_origin' ELSE 'partial_origin' END AS origin, det AS raw_detector, count(*) AS n FROM f LEFT JOIN m USING (doc_id, page, start, "end", entity_type, value) GROUP BY 1, 2""")
def span_origins(spark, sf_dir):
    s = line_spans(spark, sf_dir)
    final = s.where("detector = 'regex'").select("doc_id", "page", "start", "end", "entity_type", "value").distinct()
    return candidates.origin(final, s.where("detector <> 'regex'")).groupBy("origin", "raw_detector").agg(F.count("*").alias("n"))


# ---- scalar functions -----------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey AS k, (1000000000 + o_orderkey * 7919 % 999999999)::VARCHAR AS n FROM orders),
l AS (SELECT k, n, (SELECT sum(CASE WHEN i % 2 = 0 THEN CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END ELSE d END) FROM (SELECT i, substr('80840' || n, 15 - i + 1, 1)::INT AS d FROM range(1, 16) r(i))) % 10 = 0 AS npi,
(SELECT sum(CASE WHEN i % 2 = 0 THEN CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END ELSE d END) FROM (SELECT i, substr(n, 10 - i + 1, 1)::INT AS d FROM range(1, 11) r(i))) % 10 = 0 AS luhn FROM o) SELECT * FROM l""")
def check_digits(spark, sf_dir):
    n = (1000000000 + F.col("o_orderkey") * 7919 % 999999999).cast("string")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), n.alias("n")).select("k", "n", X.npi(F.col("n")).alias("npi"), X.luhn(F.col("n")).alias("luhn"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_cosine(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query(r"""WITH t AS (SELECT doc_id, text, (doc_id % 10) / 10.0 AS e, regexp_replace(text, '\s', '', 'g') AS shown, regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''/-]*') AS w FROM documents),
v AS (SELECT *, length(regexp_replace(shown, '[^\p{L}\p{N}!-/:-@\[-`{-~]', '', 'g')) AS valid, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: length(x) BETWEEN 2 AND 35)) / len(w) ELSE 0 END AS meant,
 least((length(text) - length(replace(replace(text, '?', ''), chr(65533), ''))) / greatest(length(text), 1) + least(len(regexp_extract_all(text, '[^A-Za-z0-9\s]{4,}')) * 0.05, 0.25), 0.40) AS noise FROM t),
q AS (SELECT doc_id, e, CASE WHEN length(shown) > 0 THEN round(greatest(0, least(1, valid / length(shown) * 0.6 + meant * 0.4 - noise)), 4) ELSE 0 END AS q,
 CASE WHEN length(text) >= 500 THEN 1.0 WHEN length(text) >= 200 THEN 0.85 WHEN length(text) >= 75 THEN 0.70 WHEN length(text) >= 25 THEN 0.45 ELSE 0.20 END AS c FROM v)
SELECT doc_id, round(greatest(0, least(0.7 * e + 0.2 * q + 0.1 * c, CASE WHEN q < 0.30 THEN 0.45 WHEN q < 0.50 THEN 0.65 WHEN c <= 0.20 AND q < 0.80 THEN 0.75 ELSE 1.0 END)), 4)::DOUBLE AS confidence FROM q""")
def recognition_confidence(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.ocr_confidence((F.col("doc_id") % 10) / F.lit(10.0), F.col("text"), F.lit(1)).alias("confidence"))


# ---- evaluation ---------------------------------------------------------


@query(f"""WITH {SPANS}, n AS (SELECT detector, count(*) FILTER (confidence >= 0.7 AND entity_type <> 'DATE') AS tp, count(*) FILTER (confidence >= 0.7 AND entity_type = 'DATE') AS fp, count(*) FILTER (confidence < 0.7) AS fn FROM s GROUP BY 1)
SELECT detector, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 6) AS f1, round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END, 6) AS accuracy FROM n""")
def detector_metrics(spark, sf_dir):
    kind = F.when(F.col("confidence") < 0.7, "FN").when(F.col("entity_type") == "DATE", "FP").otherwise("TP")
    return evaluate.metrics(line_spans(spark, sf_dir).withColumn("outcome", kind), "detector")


@query(f"""WITH {SPANS}, {_deduped},
gold AS (SELECT doc_id, list(struct_pack(p := page, a := start, b := "end", t := entity_type) ORDER BY page, start, "end", entity_type) AS g FROM d WHERE detector <> 'regex' GROUP BY 1),
pred AS (SELECT doc_id, list([struct_pack(p := page, a := start, b := "end", t := entity_type, d := detector, m := 0::BIGINT)] ORDER BY page, start, "end", entity_type, detector) AS l FROM d WHERE detector = 'regex' GROUP BY 1),
both_ AS (SELECT doc_id, coalesce(g, []) AS g, list_concat([[struct_pack(p := -1, a := 0, b := 0, t := '', d := '', m := 0::BIGINT)]], l) AS l FROM pred LEFT JOIN gold USING (doc_id)),
done AS (SELECT doc_id, g, list_reduce(l, lambda acc, x: list_concat(acc, [struct_pack(p := x[1].p, a := x[1].a, b := x[1].b, t := x[1].t, d := x[1].d, m := coalesce(list_sort(list_transform(
  list_filter(range(1, len(g) + 1), lambda i: g[i].p = x[1].p AND g[i].t = x[1].t AND NOT list_contains(list_transform(acc, lambda y: y.m), i) AND (least(g[i].b, x[1].b) - greatest(g[i].a, x[1].a)) / greatest(g[i].b - g[i].a, x[1].b - x[1].a) >= 0.5),
  lambda i: struct_pack(r := -(least(g[i].b, x[1].b) - greatest(g[i].a, x[1].a)) / greatest(g[i].b - g[i].a, x[1].b - x[1].a), i := i)))[1].i, 0))])) AS k FROM both_),
hit AS (SELECT doc_id, unnest(k) AS y FROM done)
SELECT doc_id, CASE WHEN y.m > 0 THEN 'TP' ELSE 'FP' END AS outcome, y.t AS entity_type, y.d AS detector FROM hit WHERE y.p > 0
UNION ALL SELECT gold.doc_id, 'FN', g[i].t, NULL FROM gold, range(1, len(g) + 1) r(i) WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.doc_id = gold.doc_id AND y.m = i)""")
def match_gold(spark, sf_dir):
    s = spans.dedupe(line_spans(spark, sf_dir))
    return evaluate.match_gold(s.where("detector = 'regex'"), s.where("detector <> 'regex'"))


@query("""WITH p AS (SELECT a.item_id, regexp_replace(a.text, '[^ -~]', '', 'g') AS x, regexp_replace(b.text, '[^ -~]', '', 'g') AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)
SELECT item_id, round(levenshtein(x, y) / greatest(length(y), 1), 6) AS cer, round(levenshtein(x, y) / greatest(len(regexp_extract_all(y, '\\S+')), 1), 6) AS wer FROM p""".replace("\\\\", "\\"))
def error_rates(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("x"))
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y")), "item_id")
    cer, wer = evaluate.error_rates(F.col("x"), F.col("y"))
    return pairs.select("item_id", cer.alias("cer"), wer.alias("wer"))


# ---- audit database -----------------------------------------------------


@query("SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, sf_dir):
    return relational.latest(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")


@query("SELECT o.o_orderkey, o_orderdate, n FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10) o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o.o_orderkey")
def recent_with_counts(spark, sf_dir):
    recent = relational.top_recent(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 10)
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return recent.join(lines, "o_orderkey", "left")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def pending_membership(spark, sf_dir):
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey AS entity_id, o_custkey AS doc_id, 'PENDING' AS status FROM orders WHERE o_totalprice / 400000 < 0.8 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)")
def review_queue(spark, sf_dir):
    entities = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity_id"), F.col("o_custkey").alias("doc_id"), (F.col("o_totalprice") / 400000).alias("confidence"))
    return redact.review_queue(entities, read(spark, sf_dir, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("entity_id")))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def page_of_rows(spark, sf_dir):
    return relational.page(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 3, 25)


@query("""WITH j AS (SELECT user_id AS run_id, event_id AS job_id, ts AS finished_at, CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM events)
SELECT run_id, count(*) AS total, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, arg_max(status, (finished_at, job_id)) AS status FROM j GROUP BY 1""")
def run_outcomes(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED")
    return relational.run_outcomes(read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("job_id"), F.col("ts").alias("finished_at"), status.alias("status")))


@query("SELECT n_name, c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS negative, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def category_counts(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' OR (c_nationkey % 5 = 0 AND 'me@example.com' = lower('ME@example.com'))")
def visible_rows(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("owner", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment")).when(F.col("c_mktsegment") == "BUILDING", F.lit("BUILDING")))
    return relational.visible_to(c.withColumn("mail", F.lit("me@example.com")), F.col("owner"), F.col("mail"), "BUILDING", "ME@example.com", "USER").select("c_custkey", "c_name")


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_partkey AS tokens_in, l_suppkey AS tokens_out, CASE WHEN l_linenumber < 6 THEN l_suppkey % 7 END AS cached FROM lineitem)
SELECT doc_id, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, CASE WHEN bool_and(cached IS NOT NULL) THEN round(sum((tokens_in - cached) * 0.15 + tokens_out * 0.6) / 1000000, 8)::DOUBLE END AS cost FROM c GROUP BY 1""")
def usage_ledger(spark, sf_dir):
    calls = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("tokens_in"), F.col("l_suppkey").alias("tokens_out"), F.when(F.col("l_linenumber") < 6, F.col("l_suppkey") % 7).alias("cached"), F.lit(0.15).alias("rate_in"), F.lit(0.6).alias("rate_out"))
    return redact.usage_ledger(calls).select("doc_id", "tokens_in", "tokens_out", F.round(F.col("cost").cast("double"), 8).alias("cost"))


# ---- layout -----------------------------------------------------------------


@query("""WITH r AS (SELECT l_orderkey AS doc_id, 1 AS page, l_linenumber, (l_partkey % 400)::DOUBLE AS top, (l_partkey % 400 + 10 + l_linenumber)::DOUBLE AS bottom, (10 + l_linenumber)::DOUBLE AS height FROM lineitem),
m AS (SELECT *, median(height) OVER (PARTITION BY doc_id) AS med, lag(bottom) OVER (PARTITION BY doc_id ORDER BY top, bottom, l_linenumber) AS pb FROM r)
SELECT doc_id, page, top, bottom, height, sum(CASE WHEN top - pb > greatest(1.75 * med, 12) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY top, bottom)::BIGINT AS block FROM m""")
def layout_blocks(spark, sf_dir):
    top = (F.col("l_partkey") % 400).cast("double")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), top.alias("top"), (top + 10 + F.col("l_linenumber")).alias("bottom"), (F.col("l_linenumber") + 10).cast("double").alias("height"))
    return layout.blocks(rows)


@query("""WITH b AS (SELECT l_orderkey AS doc_id, 't' || l_linenumber AS t, (l_partkey % 600)::DOUBLE AS x, (l_partkey % 600 + 40)::DOUBLE AS r, (l_suppkey % 50)::DOUBLE AS y FROM lineitem),
l AS (SELECT doc_id, list_concat([[struct_pack(t := '', x := 0.0::DOUBLE, r := 0.0::DOUBLE, y := -1e9::DOUBLE, row_ := -1, mean := -1e9::DOUBLE, n := 0)]], list([struct_pack(t := t, x := x, r := r, y := y, row_ := 0, mean := 0.0::DOUBLE, n := 0)] ORDER BY y, x, t)) AS l, max(r) AS width FROM b GROUP BY 1),
f AS (SELECT doc_id, width, unnest(list_reduce(l, lambda acc, k: list_concat(acc, [struct_pack(t := k[1].t, x := k[1].x, r := k[1].r, y := k[1].y,
  row_ := acc[len(acc)].row_ + CASE WHEN abs(k[1].y - acc[len(acc)].mean) > 0.6::DOUBLE * 9::DOUBLE THEN 1 ELSE 0 END,
  mean := CASE WHEN abs(k[1].y - acc[len(acc)].mean) > 0.6::DOUBLE * 9::DOUBLE THEN k[1].y ELSE acc[len(acc)].mean + (k[1].y - acc[len(acc)].mean) / (acc[len(acc)].n + 1) END,
  n := CASE WHEN abs(k[1].y - acc[len(acc)].mean) > 0.6::DOUBLE * 9::DOUBLE THEN 1 ELSE acc[len(acc)].n + 1 END)]))) AS q FROM l),
g AS (SELECT doc_id, width, q.row_ AS row_, q.x AS x, q.t AS t, q.x - lag(q.r) OVER (PARTITION BY doc_id, q.row_ ORDER BY q.x, q.t) AS gap FROM f WHERE q.row_ >= 0)
SELECT doc_id, 1 AS page, row_ AS row, string_agg(CASE WHEN gap IS NULL THEN '' WHEN gap > greatest(22.5, 0.025 * width) THEN chr(9) ELSE ' ' END || t, '' ORDER BY x, t) AS text FROM g GROUP BY doc_id, row_""")
def layout_rows(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("text"), (F.col("l_partkey") % 600).cast("double").alias("left"), (F.col("l_partkey") % 600 + 40).cast("double").alias("right"), (F.col("l_suppkey") % 50).cast("double").alias("center_y"), F.lit(9.0).alias("height"))
    return layout.row_text(layout.visual_rows(lines))


# edges are whole numbers, so the area is the number of unit squares, counted by columns
@query("""WITH b AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey % 100 AS x, least((l_partkey % 100 + l_quantity)::BIGINT, 100) AS x2, l_suppkey % 100 AS y FROM lineitem),
c AS (SELECT doc_id, unnest(range(x, x2)) AS x, y FROM b), d AS (SELECT DISTINCT doc_id, x, unnest(range(y, least(y + 20, 100))) AS y FROM c)
SELECT doc_id, 1 AS page, count(*)::DOUBLE AS area, count(*) / 10000.0::DOUBLE AS share FROM d GROUP BY 1""")
def image_area(spark, sf_dir):
    x, y = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double")
    boxes = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), x.alias("left"), y.alias("top"), (x + F.col("l_quantity")).alias("right"), (y + 20).alias("bottom"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"))
    return layout.union_area(boxes)


from veilspark.plans import cases  # noqa: E402

QUERIES |= cases.CASES
ORACLES |= cases.ANSWERS
