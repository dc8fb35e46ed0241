"""Release does each piece of work once."""

from veilspark.operators import redact, validate
from veilspark.plans import release as plan


def test_copies_are_worked_through_once(spark, monkeypatch):
    rows = [(4, "Mail ann@mail.com now."), (2, "Mail ann@mail.com now."), (7, "Nothing here."), (9, None), (8, None), (5, ""), (6, "mail ann@mail.com now.")]
    seen, judged = [], []
    find, judge = plan.find_spans, validate.validate
    monkeypatch.setattr(plan, "find_spans", lambda docs, *a: seen.append(sorted(r.doc_id for r in docs.collect())) or find(docs, *a))
    monkeypatch.setattr(validate, "validate", lambda *a: judged.append(1) or judge(*a))
    done = plan.release(spark.createDataFrame(rows, "doc_id long, text string"))
    assert seen == [[2, 5, 6, 7, 8]] and judged == [1]
    text = {r.doc_id: r.redacted_text for r in done.redacted.collect()}
    assert text == {4: "Mail [REDACTED_EMAIL] now.", 2: "Mail [REDACTED_EMAIL] now.", 7: "Nothing here.", 9: None, 8: None, 5: "", 6: "mail [REDACTED_EMAIL] now."}
    assert sorted((r.doc_id, r.status) for r in done.status.collect()) == [(i, "RELEASED") for i in (2, 4, 5, 6, 7, 8, 9)]
    assert sorted((r.doc_id, r.total) for r in done.reports.collect()) == [(2, 1), (4, 1), (6, 1)]
    assert sorted((r.doc_id, r.start, r.value) for r in done.spans.collect()) == [(2, 5, "ann@mail.com"), (4, 5, "ann@mail.com"), (6, 5, "ann@mail.com")]


def test_equal_texts_of_other_types_stay_apart(spark):
    docs = spark.createDataFrame([(1, "Mail ann@mail.com", "A"), (2, "Mail ann@mail.com", None), (3, "Mail ann@mail.com", None)], "doc_id long, text string, document_type string")
    heads, members = plan.documents.share_copies(docs)
    assert sorted(r.doc_id for r in heads.collect()) == [1, 2]
    assert sorted(tuple(r) for r in members.collect()) == [(1, 1), (2, 2), (3, 2)]


def test_residual_is_looked_for_once_where_nothing_is_left(spark, monkeypatch):
    asked, look = [], plan._residual
    monkeypatch.setattr(plan, "_residual", lambda *a: asked.append(1) or look(*a))
    done = plan.release(spark.createDataFrame([(1, "SSN: 123-45-6788")], "doc_id long, text string"))
    assert [r.status for r in done.status.collect()] == ["RELEASED"] and asked == [1]


def test_what_is_left_after_the_last_round_blocks(spark, monkeypatch):
    monkeypatch.setattr(redact, "expand_occurrences", lambda docs, found, bounded=False: found.limit(0))
    docs = spark.createDataFrame([(1, "write to ann@mail.com today")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, page int, start int, end int, entity_type string, value string, confidence double, detector string, privacy_category string")
    monkeypatch.setattr(plan, "find_spans", lambda *a: none)
    assert [(r.status, r.issues) for r in plan.release(docs, rounds=0).status.collect()] == [("BLOCKED", ["HIGH_RISK_REMAINS"])]
    assert [r.redacted_text for r in plan.release(docs, rounds=1).redacted.collect()] == ["write to [REDACTED_EMAIL] today"]


def test_later_rounds_look_at_changed_texts_only(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "write to ann@mail.com today"), (2, "Nothing here.")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, page int, start int, end int, entity_type string, value string, confidence double, detector string, privacy_category string")
    asked, look = [], plan._residual
    monkeypatch.setattr(plan, "find_spans", lambda *a: none)
    monkeypatch.setattr(plan, "_residual", lambda text, kinds: asked.append(sorted(r.doc_id for r in text.collect())) or look(text, kinds))
    done = plan.release(docs)
    assert asked == [[1, 2], [1]]
    assert sorted((r.doc_id, r.status) for r in done.status.collect()) == [(1, "RELEASED"), (2, "RELEASED")]
    assert {r.redacted_text for r in done.redacted.collect()} == {"write to [REDACTED_EMAIL] today", "Nothing here."}
