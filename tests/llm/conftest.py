import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, shard int, n_words long, uid long, component_id long"


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that break things: none, empty, blank, very long, repeated, odd white space, other scripts."""
    rng = random.Random(3)
    vocabulary = ["alpha", "beta", "gamma", "delta", "Straße", "naïve", "日本", "x1", "y-z", "ét"]
    long_text = " ".join(rng.choice(vocabulary) for _ in range(60_000))
    return [None, "", " \t\n", "one", "one", long_text, "a b c d", "中文 字", "The quick brown fox jumps over the lazy dog again and again.", "x" * 5000, "<|endoftext|> it's 'RE", "!!! 123 ...", "\x00\x1c\x85"]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """documents with nulls in every column, equal ids, and extra columns named like the operators' own."""
    rows = [(i if i != 3 else None, t, None if i % 2 else "en", None, None, "f", 1, 2, 3, 4) for i, t in enumerate(odd_texts)]
    rows += [(8, rows[8][1], "en", "s", 1, None, None, None, None, None)]  # a row that repeats
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def plain_documents(documents):
    return [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]
