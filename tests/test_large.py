"""Queries over more rows than the generated tables have, and what their plans exchange."""

from oracle import connect, duck_rows, spark_rows

from lectern import plans


def test_library_scan_of_many_customers(spark, tmp_path):
    """So many rows that the bounds of ranges come from a sample; names may be missing."""
    rows = spark.range(30_000).selectExpr("id AS c_custkey", "if(id % 1000 = 7, NULL, concat('Customer', id * 7919 % 30000)) AS c_name", "'SEG' AS c_mktsegment", "id / 4 AS c_acctbal")
    rows.coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "customer.parquet")
    assert spark_rows(plans.QUERIES["library_scan"](spark, str(tmp_path))) == duck_rows(connect(tmp_path), plans.ORACLES["library_scan"])


def test_words_to_sentences_exchanges_no_words(spark, sf_dir):
    plan = plans.QUERIES["words_to_sentences"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_words_to_sentences_of_odd_texts(spark, tmp_path):
    texts = [None, "", " \n ", "One two.  Three\n\nfour? Five", "na\u00efve \U0001f600 day. Next  one!", "x" * 5000, "a. " * 3000, "No end"]
    made = spark.createDataFrame([(i if i != 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    made.coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert spark_rows(plans.QUERIES["words_to_sentences"](spark, str(tmp_path))) == duck_rows(connect(tmp_path), plans.ORACLES["words_to_sentences"])
