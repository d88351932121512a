import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import packing, shared, tokens


def reference(name):
    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


BYTE, WORD = reference("byte_bpe_50k.json"), reference("word_bpe_49k.json")


@pytest.mark.parametrize("style, name, want", [("byte", "byte_bpe_50k.json", BYTE), ("word", "word_bpe_49k.json", WORD)])
def test_pieces_equal_whole_texts(style, name, want):
    enc = tokens.PieceEncoder(tokens.tokenizer_path(name), style, keep=50)

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab Z.,'!é\n\t\ŕ  İΣς<|")), max_size=60), st.sampled_from(["", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]))
    def check(s, mark):
        s = s + mark + s[::-1]
        assert np.frombuffer(enc.encode([s])[0], enc.dtype).tolist() == want(s)

    check()


def test_token_files(spark, odd_docs, odd_texts):
    path = shared.scratch(spark, "t")
    tokens.write_token_files(odd_docs, path)
    got = tokens.read_token_files(spark, path, with_ids=True).collect()
    rows = sorted([(i if i != 3 else None, t) for i, t in enumerate(odd_texts)] + [(8, odd_texts[8])], key=lambda r: (r[0] is not None, r[0] or 0))
    got.sort(key=lambda r: r["start"])
    at = 0
    for r, (doc, text) in zip(got, rows, strict=True):
        ids = [*BYTE(text), 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], [*r["ids"]]) == (doc, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_files_of_the_table(spark, sf_dir, plain_documents):
    at, want = 0, {}
    for doc, text, _ in sorted(plain_documents):
        ids = np.array([*BYTE(text), 2], "<u4")
        want[doc] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.op1_token_files(spark, sf_dir).collect()}
    assert got == want


def test_empty_tables(spark, no_docs):
    path = shared.scratch(spark, "t")
    tokens.write_token_files(no_docs, path)
    assert tokens.read_token_files(spark, path).count() == 0
    assert packing.pack(no_docs).count() == 0


def check_packing(rows, limit=2048):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def test_packing_places_every_piece(spark, odd_docs, odd_texts):
    rows = packing.pack(odd_docs).collect()
    check_packing(rows)
    want = []
    for doc, text in [(i if i != 3 else None, t) for i, t in enumerate(odd_texts)] + [(8, odd_texts[8])]:
        ids = np.array([*WORD(text), 0], "<u4")
        want += [(str(doc), k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)


def test_packing_of_the_table_is_tight(spark, sf_dir):
    rows = packing.op2_pattern_packing(spark, sf_dir).collect()
    n, least = check_packing(rows), -(-sum(r["length"] for r in rows) // 2048)
    assert n <= least * 1.01 + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_the_histogram_exactly(seed):
    rng = np.random.default_rng(seed)
    limit = 256
    hist = np.zeros(limit + 1, np.int64)
    for v, n in zip(*np.unique(np.minimum(limit, rng.geometric(0.02, 3000 * 10**seed)), return_counts=True)):
        hist[v] = n
    used = np.zeros_like(hist)
    plan = packing.plan(hist, limit)
    for n, parts in plan:
        assert sum(parts) <= limit
        for v in parts:
            used[v] += n
    assert (used == hist).all()
    least = -(-int((hist * np.arange(limit + 1)).sum()) // limit)
    assert sum(n for n, _ in plan) <= least * 1.01 + 1
