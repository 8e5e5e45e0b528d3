"""Findings F26 to F29: what follows from a span that ends before a letter outside ASCII."""

from pyspark.sql import functions as F

from bookloom.operators import scrub


def test_spans_before_other_letters_are_redacted_without_the_blank(spark):
    rows = spark.createDataFrame([("a", "2852466340876421 één")], "source_id string, text string")
    found = scrub.detect(rows, only=["CREDIT_CARD"])
    kept = found.select(F.explode(scrub.resolve()).alias("x")).select("x.start", "x.stop").collect()
    assert [tuple(r) for r in kept] == [(0, 16)]
    done = scrub.report(scrub.redact(found)).first()
    assert done.redacted == "██ CARD-XXXX6421 ██ één"
    assert (done.original_chars, done.redacted_chars, done.items) == (20, 23, 1)
