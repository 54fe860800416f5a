"""The index of character runs lets few wrong terms through, however alike the terms are."""

from pyspark.sql import functions as F

from kuronuri.operators.dictionary import company_terms, detect_term_table, possible_terms


def test_numbered_names_wait_where_they_stand(spark):
    """Runs of three digits stand in nearly every text; names that share them must not wait there."""
    digits = " ".join(f"{i:03d}" for i in range(200))
    docs = spark.createDataFrame(
        [(i, f"Supplier#{i:09d} (supplier#{i + 1:09d}) {digits} #00 er#") for i in range(40)], "doc_id long, text string")
    terms = company_terms(spark.range(200).select(F.format_string("Supplier#%09d", "id").alias("term")))
    assert possible_terms(docs, terms).count() == 80
    found = detect_term_table(docs, terms).collect()
    assert sorted((r.doc_id, r.original) for r in found) == sorted(
        [(i, f"Supplier#{i:09d}") for i in range(40)] + [(i, f"supplier#{i + 1:09d}") for i in range(40)])


def test_terms_of_every_length_are_found(spark):
    text = "abcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(n, f"<{text[:n]}> <{text[n:]}>") for n in range(1, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = company_terms(spark.createDataFrame([(text[:n],) for n in range(1, 30)], "term string"))
    assert sorted((r.doc_id, r.original) for r in detect_term_table(docs, terms).collect()) == [
        (n, text[:n]) for n in range(1, 30)]
