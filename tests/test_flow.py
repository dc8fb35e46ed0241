import importlib

from pyspark.sql import functions as F

from veilspark.operators import documents, layout
from veilspark.plans.release import release
from veilspark.sources import files
from veilspark.streaming import jobs


def test_uploads(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello ann@mail.com")
    (tmp_path / "b.txt").write_text("hello ann@mail.com")
    (tmp_path / "c.exe").write_text("x")
    (tmp_path / "d.txt").write_text("")
    got = {r.filename: r.problem for r in files.read_uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": None, "b.txt": None, "c.exe": "EXTENSION"}
    listed = spark.createDataFrame([("d.txt", 0), ("e.pdf", 30 << 20), ("", 5), (None, 5)], "filename string, size long")
    assert [r.problem for r in files.check_uploads(listed).collect()] == ["EMPTY", "TOO_LARGE", "NO_NAME", "NO_NAME"]
    assert files.read_texts(spark, str(tmp_path / "a.txt")).first().text == "hello ann@mail.com"


def test_routing(spark):
    pages = [("p", "pdf", 600, 0.9), ("p", "pdf", 5, 0.0), ("q", "pdf", 20, 0.1), ("r", "png", 0, 1.0), ("s", "txt", 1, 0.0)]
    got = {r.path: r.source for r in files.route(spark.createDataFrame(pages, "path string, extension string, chars int, image_share double")).collect()}
    assert got == {"p": "MIXED_PDF", "q": "NATIVE_PDF", "r": "OCR", "s": "NATIVE_TEXT"}


def test_release(spark):
    docs = spark.createDataFrame([(1, "Mail ann@mail.com, again ANN@mail.com."), (2, "Nothing here."), (3, None)], "doc_id long, text string")
    done = release(docs)
    text = {r.doc_id: r.redacted_text for r in done.redacted.collect()}
    assert "mail.com" not in text[1].lower() and text[2] == "Nothing here." and text[3] is None
    assert {r.status for r in done.status.collect()} == {"RELEASED"}
    assert done.reports.where("doc_id = 1").first().total == 2


def test_release_fails_closed(spark, monkeypatch):
    from veilspark.operators import redact

    docs = spark.createDataFrame([(1, "write to ann@mail.com today"), (2, "SSN: 123-45-6788")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, page int, start int, end int, entity_type string, value string, confidence double, detector string")
    left = spark.createDataFrame([(1, "write to ann@mail.com today"), (2, "[REDACTED_SSN]")], "doc_id long, redacted_text string")
    from veilspark.plans.release import _residual

    status = {r.doc_id: (r.status, r.issues) for r in redact.verify(docs, none, left, _residual(left, ("EMAIL", "SSN"))).collect()}
    assert status == {1: ("BLOCKED", ["HIGH_RISK_REMAINS"]), 2: ("RELEASED", [])}
    done = release(docs)
    assert {r.doc_id: r.redacted_text for r in done.redacted.collect()} == {1: "write to [REDACTED_EMAIL] today", 2: "SSN: [REDACTED_SSN]"}


def test_uploads_become_runs(spark):
    files_ = [("a.txt", 5, "h1", None), ("b.txt", 5, "h1", None), ("c.txt", 6, "h2", None)]
    uploads = spark.createDataFrame(files_, "filename string, size long, content_hash string, problem string")
    assert files.create_runs(uploads, "r").first().asDict() == {"run_id": "r", "files": 3, "documents": 2, "status": "QUEUED"}
    assert files.create_runs(uploads.unionByName(spark.createDataFrame([("d.exe", 1, "h", "EXTENSION")], uploads.schema)), "r").first().status == "REFUSED"


def test_docx(spark, tmp_path):
    import zipfile

    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("One &amp; two") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}{p('c')}</w:tc></w:tr></w:tbl>" + p("") + p("end")
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "y.docx").write_bytes(b"no zip")
    got = sorted(r.text for r in files.read_docx(spark, str(tmp_path)).collect())
    assert got == ["", "One & two\na\tb c\nend"]


def test_entities_are_replaced_by_document(spark, tmp_path):
    ddl = "doc_id long, page int, start int, end int, entity_type string, value string, confidence double"
    files.write_entities(spark.createDataFrame([(1, 1, 0, 3, "PERSON", "Ann", 0.9), (2, 1, 0, 3, "PERSON", "Bob", 0.5)], ddl), str(tmp_path))
    files.write_entities(spark.createDataFrame([(1, 1, 4, 8, "EMAIL", "a@b", 0.7)], ddl), str(tmp_path))
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted((r.doc_id, r.value) for r in read("entities").collect()) == [(1, "a@b"), (2, "Bob")]
    assert sorted(r.doc_id for r in read("reviews").collect()) == [1, 2]
    assert sorted((r.doc_id, r.replacement) for r in read("redactions").collect()) == [(1, "[REDACTED_EMAIL]"), (2, "[REDACTED_PERSON]")]


def test_sinks_and_page_sources(spark, tmp_path):
    red = spark.createDataFrame([(1, "x")], "doc_id long, redacted_text string")
    for run in ("a", "b", "a"):
        files.write_redacted(red, str(tmp_path / "red"), run)
    assert spark.read.parquet(str(tmp_path / "red")).count() == 2
    files.write_reports(red, str(tmp_path / "rep"))
    assert [r.value for r in spark.read.text(str(tmp_path / "rep")).collect()] == ['{"doc_id":1,"redacted_text":"x"}']
    ddl = "doc_id long, page_number int, page_text string"
    got = files.merge_pages(spark.createDataFrame([(1, 1, "native"), (1, 2, " ")], ddl), spark.createDataFrame([(1, 2, "read"), (1, 3, "also")], ddl))
    assert sorted((r.page_number, r.page_text) for r in got.collect()) == [(1, "native"), (2, "read"), (3, "also")]


def test_tables(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>a<th>b<tr><td>1<td>2</table>"), (2, None)], "page_id long, html string")
    assert [r.text for r in layout.table_text(layout.html_tables(pages)).collect()] == ["| a | b |\n| --- | --- |\n| 1 | 2 |"]
    rows = spark.createDataFrame([(1, 1, 0, 0, "a\tb"), (1, 1, 0, 1, "c\td"), (1, 1, 1, 2, "text"), (1, 1, 1, 3, "x\ty")], "doc_id long, page int, block int, row int, text string")
    assert [(r.block, r.rows, r.columns) for r in layout.infer_tables(rows).collect()] == [(0, 2, 2)]


def test_stream_skips_known_contents_and_replays(spark, tmp_path):
    schema = "doc_id long, text string"
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema).coalesce(1).write.parquet(source)
    run = lambda: jobs.process(jobs.document_stream(spark, source, schema), lambda d: d.select("doc_id", F.upper("text").alias("t")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(4, "b"), (5, "c")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert sorted((r.doc_id, r.t) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()) == [(1, "A"), (3, "B"), (5, "C")]


def test_failed_batches_are_set_aside(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))

    def broken(df):
        raise ValueError("no")

    jobs.process(jobs.document_stream(spark, str(tmp_path / "in"), "doc_id long, text string"), broken, str(tmp_path / "out"), str(tmp_path / "cp"), dead=str(tmp_path / "dead")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 1


def test_area_of_overlapping_boxes(spark):
    boxes = [(1, 1, 0.0, 0.0, 10.0, 10.0, 20.0, 20.0), (1, 1, 5.0, 5.0, 15.0, 15.0, 20.0, 20.0), (1, 1, -5.0, 18.0, 40.0, 40.0, 20.0, 20.0)]
    got = layout.union_area(spark.createDataFrame(boxes, "doc_id long, page int, left double, top double, right double, bottom double, width double, height double")).first()
    assert got.area == 175 + 40 and got.share == 215 / 400


def test_rows_follow_the_running_mean(spark):
    lines = [(1, 1, str(i), i * 50.0, i * 50.0 + 40, y, 10.0) for i, y in enumerate([0.0, 5.0, 8.0, 30.0])]
    got = layout.row_text(layout.visual_rows(spark.createDataFrame(lines, "doc_id long, page int, text string, left double, right double, center_y double, height double")))
    assert [r.text for r in got.orderBy("row").collect()] == ["0 1 2", "3"]


def test_duplicates(spark):
    docs = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.duplicate for r in documents.exact_duplicates(docs.where("text is not null")).collect()}
    assert got == {1: False, 2: False, 3: True}


def test_entry_names():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_read_whole_texts_and_tables(spark, tmp_path):
    from veilspark.plans import catalog

    spark.createDataFrame([(1, "a" * 300 + "bc"), (2, "a" * 300 + "bd e")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = catalog.QUERIES["error_rates"](spark, str(tmp_path)).collect()
    assert [(r.item_id, r.cer, r.wer) for r in got] == [(1, round(3 / 304, 6), 1.5)]
    # part keys draw phrases 10 ("agreement") twice, then 9 (a whole agreement): the third line decides
    spark.createDataFrame([(7, 10, 1), (7, 10, 2), (7, 9, 3)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = [(1, "Medical record. Patient diagnosis by the physician."), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.document_type, r.confidence) for r in catalog.QUERIES["classify_documents"](spark, str(tmp_path)).collect()}
    texts = [*rows, (-8, " ".join(catalog._PHRASES[i] for i in (10, 10, 9)))]
    assert found == {r.doc_id: (r.document_type, r.confidence) for r in documents.classify(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found[-8][0] != "UNKNOWN" and found[1][0] != "UNKNOWN"


def test_classify_looks_for_signals_once(spark):
    rows = [(1, "Bank acct no 5, IFSC c0de"), (2, "STORE #12 sales receipt"), (3, "ébank statement"), (4, None), (5, "agreement"), (6, "rx\x0brefill pharmacy prescription dosage")]
    done = documents.classify(spark.createDataFrame(rows, "doc_id long, text string"))
    # an expression for each signal made the plan too large for the JVM to compile
    assert len(done._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = {r.doc_id: (r.document_type, r.confidence) for r in done.collect()}
    assert got[4] == ("UNKNOWN", 0.0) and got[5][0] == "UNKNOWN" and got[6][0] == "PRESCRIPTION" and set(got) == {1, 2, 3, 4, 5, 6}


def test_partitions_grow_with_the_input(spark, tmp_path, monkeypatch):
    from veilspark.operators import spans, store

    lines = spark.range(2000).selectExpr("id div 4 doc_id", "1 page", "concat('t', id) text", "cast(id % 4 * 50 as double) `left`", "cast(id % 4 * 50 + 40 as double) `right`", "cast(id % 7 as double) center_y", "9.0D height")
    lines.write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    few = layout.row_text(layout.visual_rows(lines)).collect()
    monkeypatch.setattr(store, "PART_BYTES", 500)
    many = layout.row_text(layout.visual_rows(lines))
    assert sorted(many.collect()) == sorted(few)
    found = spark.range(2000).selectExpr("id doc_id", "1 page", "0 start", "5 end", "'PERSON' entity_type", "'a' value", "0.9D confidence", "'regex' detector")
    docs = lines.groupBy("doc_id").agg(F.first("text").alias("text"))
    # a fixed number of partitions let what a task sorts grow with the input
    for plan in (many, spans.merge_persons(spans.merge_addresses(found, docs), docs)):
        steps = [x for x in plan._jdf.queryExecution().executedPlan().toString().split("\n") if "REPARTITION_BY_" in x]
        assert steps and all("REPARTITION_BY_NUM" in x for x in steps)


def test_chunks_without_texts(spark):
    docs = spark.createDataFrame([(1, "One sentence here. " * 400), (2, None), (3, " "), (4, "short")], "doc_id long, text string")
    with_texts = documents.chunk(docs)
    bare = documents.chunk(docs, texts=False)
    assert bare.columns == ["doc_id", "chunk_id", "start", "end"] and sorted(bare.collect()) == sorted(with_texts.drop("chunk_text").collect())
    assert {r.doc_id for r in bare.collect()} == {1, 4} and all(r.end - r.start == len(r.chunk_text) for r in with_texts.collect())
