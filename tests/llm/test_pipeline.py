import hashlib
import os

import corpus_pipeline
from test_dedup import plain_line_dedup
from test_search import plain_contamination
from test_shingles import plain_kept

from lectern.llm import language, shared


def test_stages(spark, sf_dir, documents):
    """Each stage against brute force on what its predecessor kept."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seen = {}
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = shared.stored(stage(spark, docs, sf_dir), name)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == documents.columns
    before, after = seen["language_id"]
    letters = [d for d, t in before if t and language.LETTER.search(t)]  # none is foreign
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(letters)
    before, after = seen["line_dedup"]
    assert sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in after.collect()) == sorted(x[3] for x in plain_line_dedup(before))
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = seen["near_dedup"]
    assert sorted(r["doc_id"] for r in after.collect()) == plain_kept(before)
    before, after = seen["decontamination"]
    assert sorted(str(r["doc_id"]) for r in after.collect()) == sorted(x[0] for x in plain_contamination(before, items) if not x[5])
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after.collect()} == {d for d, _ in before}
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in run.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in after.collect())


def test_stages_of_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs):
    """The chain runs on nulls in every column, repeated rows, long texts and extra columns, and on no rows."""
    for table in (odd_docs, no_docs):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            was = docs
            docs = shared.stored(stage(spark, docs, sf_dir), name)
            if name != "packing":
                assert docs.columns == table.columns and docs.count() <= was.count()
            if name == "near_dedup":
                ids = [r["doc_id"] for r in docs.collect()]
                assert ids.count(8) <= 1
        assert (docs.count() > 0) == (table is odd_docs)


def test_run_leaves_one_table(spark, sf_dir, odd_docs, tmp_path):
    """All that the stages wrote on their way is gone, and the result can still be read."""
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    root = shared.shared_root(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(root))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(os.listdir(root)) - before) == 1 and out.count() > 0


def test_discarded_after_a_failure(spark):
    root = shared.shared_root(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(root))
    kept = shared.stored(spark.range(3), "kept")
    try:
        with shared.discarded(spark):
            shared.stored(spark.range(3), "gone")
            raise ValueError
    except ValueError:
        pass
    assert len(set(os.listdir(root)) - before) == 1 and kept.count() == 3


def test_foreign_texts_go(spark, documents):
    """A text in none of the learned languages goes, and so do texts without letters; without labels all others stay."""
    odd = spark.createDataFrame([(-1, "этот текст написан не на том языке который здесь учат " * 5), (-2, "日本語の文章はここで学んだ言語ではありません。" * 5), (-3, "1234 !!"), (-4, None)], "doc_id long, text string")
    docs = documents.select("doc_id", "text", "lang").unionByName(odd, allowMissingColumns=True)
    kept = {r["doc_id"] for r in language.keep_identified(docs).collect()}
    assert not kept & {-1, -2, -3, -4} and kept == {r["doc_id"] for r in documents.where("text RLIKE '[A-Za-z]'").collect()}
    assert {r["doc_id"] for r in language.keep_identified(docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()} >= kept | {-1, -2}
