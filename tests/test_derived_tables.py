from pyspark.sql import functions as F

from corvata.plans import queries_more


def test_all_tables_of_a_page_are_seen(spark, monkeypatch):
    """Two tables in one place make their anchors ambiguous, so their other readings are a table that no anchor has, whatever their parts are."""
    tables = [(1, "7", 1), (1, "7b", 1), (2, "7", 5), (2, "7b", 6), (3, "7", 10)]
    rows = [(d, 1, t, k, "section") for d, t, k in tables]
    ledger = spark.createDataFrame(rows, "document_id long, page int, table_id string, part long, section string")
    monkeypatch.setattr(queries_more, "ledger", lambda *_: ledger)
    whole = queries_more._proposals

    def level(*a):  # else the place down the page follows from the table's id
        return whole(*a).withColumn("box", F.col("box").withField("t", F.lit(100.0)).withField("b", F.lit(300.0)))

    monkeypatch.setattr(queries_more, "_proposals", level)
    got = {(r.document_id, r.page, r.members, r.variants) for r in queries_more.derived_tables(spark, "").collect()}
    assert got == {(1, 1, 4, 2), (2, 1, 4, 2)}
