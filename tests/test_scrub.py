"""Findings F25 to F30: word boundaries next to letters outside ASCII."""

from bookloom.operators import scrub


def test_boundaries_count_ascii_word_characters(spark):
    rows = spark.createDataFrame([("a", "2852466340876421 één"), ("b", "ñuser@mail.example.com"),
                                  ("c", "é4111 1111 1111 1111é")], "source_id string, text string")
    found = scrub.detect(rows, only=["CREDIT_CARD", "EMAIL"])
    spans = {r.source_id: [(x.start, x.value) for x in r.detections] for r in found.collect()}
    assert spans == {"a": [(0, "2852466340876421")], "b": [(1, "user@mail.example.com")],
                     "c": [(1, "4111 1111 1111 1111")]}


def test_literal_terms_keep_backslashes(spark):
    rows = spark.createDataFrame([("a", r"see C:\bin now")], "source_id string, text string")
    found = scrub.detect(rows, terms=[r"C:\bin"], only=["CUSTOM"]).first().detections
    assert [(x.start, x.value) for x in found] == [(4, r"C:\bin")]
