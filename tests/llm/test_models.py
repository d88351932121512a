import math
import zlib
from collections import Counter

import numpy as np

from lectern.llm import language, scoring


def test_language_on_held_out(spark, sf_dir, documents):
    rows = language.op3_language_id(spark, sf_dir).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == documents.count() and held
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def test_language_never_sees_the_label(spark, documents):
    from pyspark.sql import functions as F

    model_docs = documents.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.col("lang")))
    a = {r["doc_id"]: r["lang_pred"] for r in language.identify(documents).collect()}
    assert a == {r["doc_id"]: r["lang_pred"] for r in language.identify(model_docs).collect()}


def test_language_of_odd_tables(spark, odd_docs, no_docs, odd_texts):
    rows = language.identify(odd_docs).collect()
    assert len(rows) == len(odd_texts) + 1
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {0, 1, 2, 11, 12} <= und and 8 not in und and all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert language.identify(no_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", odd_docs["source"])
    assert {r["lang_pred"] for r in language.identify(unlabelled.where("doc_id <> 8")).collect()} == {"und"}
    assert language.keep_identified(odd_docs).columns == odd_docs.columns and language.keep_identified(no_docs).count() == 0


def test_three_languages_of_a_family():
    rng = np.random.default_rng(0)
    words = {"en": "the of and ship", "de": "der und nicht schiff", "nl": "het een niet schip", "xx": "qoq zaz vuv"}
    texts, langs = [], []
    for lang, w in words.items():
        for _ in range(40):
            texts.append(" ".join(rng.choice(w.split(), 12)))
            langs.append(lang)
    model = language.train(np.stack([language.features(t) for t in texts]), langs)
    assert model["families"] == ["=xx", "germanic"] and len(model["within"]["germanic"][1]) == 3
    assert language.predict(model, texts)[0] == langs


def plain_base(rows):
    counts = Counter()
    tokens = []
    for doc, text in rows:
        w = [*(text or "").encode().lower().split(), None]
        tokens.append(w)
        if zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 != 1:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    return sorted((str(doc), len(w), sum(counts[t] > 0 for t in w), n, round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w), 4)) for (doc, _), w in zip(rows, tokens))


def test_scores(spark, sf_dir, plain_documents):
    rows = scoring.op4_lm_scores(spark, sf_dir).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == plain_base([x[:2] for x in plain_documents])
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_of_odd_tables(spark, odd_docs, no_docs, odd_texts, monkeypatch):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(odd_texts)] + [(8, odd_texts[8])]
    got = scoring.score_documents(odd_docs).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == plain_base(rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert scoring.score_documents(no_docs).count() == 0
    held = odd_docs.where("doc_id IN (1, 2)").withColumn("doc_id", odd_docs["doc_id"] * 0 + 3)
    assert zlib.crc32(b"3") % 5 != 1 or scoring.score_documents(held).count() == 2


def test_probabilities_sum_to_one():
    noise = np.random.default_rng(0).random(scoring.CLASSES)
    model = scoring.start_model(noise / noise.sum(), seed=4)
    model = {k: v + np.random.default_rng(1).standard_normal(v.shape).astype(np.float32) * 0.3 for k, v in model.items()}
    near, far, bias, norm = scoring.tables(model)
    for u, v in ((0, 0), (5, scoring.END), (scoring.END, 17)):
        p = np.exp(near[v].astype(float) + far[u] + bias - norm[u, v])
        assert abs(p.sum() - 1) < 1e-3


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    seq = np.array([0, 1, 2] * 3000)
    codes, counts = scoring.trigrams_of([seq])
    noise = np.full(scoring.CLASSES, 1e-4)
    noise[:3] = 1
    noise /= noise.sum()
    model = scoring.start_model(noise)
    power = {k: np.full_like(m, 1e-6) for k, m in model.items()}
    for _ in range(200):
        scoring.train_nce(model, codes, counts, noise, rng, power)
    near, far, bias, norm = scoring.tables(model)
    assert near[1, 2] + far[0, 2] + bias[2] - norm[0, 1] > math.log(0.6)


def plain_vector(text):
    """Square roots of counts of 1- to 3-byte runs, hashed one by one, at length one."""
    raw = " " + " ".join("".join(c if c.isascii() and c.isalpha() or ord(c) >= 128 else " " for c in text.lower()).split(" ")) + " "
    while "  " in raw:
        raw = raw.replace("  ", " ")
    b = (raw if raw.strip() else "  ").encode()
    counts = [0.0] * language.DIMS
    for n in (1, 2, 3):
        for i in range(len(b) - n + 1):
            code = 0
            for c in b[i : i + n]:
                code = (code * 257 + c) % 2**32
            counts[(((code + n) % 2**32) * 2654435761 % 2**32 >> 16) % language.DIMS] += 1
    size = math.sqrt(sum(counts)) or 1
    return [math.sqrt(c) / size for c in counts]


def test_predictions_by_hand(spark, documents):
    """Each prediction recomputed from the weights: the family of the largest margin, then the pairwise votes."""
    model = language.learn(documents)
    rows = {r["doc_id"]: r for r in language.identify(documents).collect()}
    dot = lambda w, v: sum(float(a) * b for a, b in zip(w, v)) + float(w[-1])
    for r in documents.limit(40).collect():
        if not r["text"] or not any(c.isalpha() for c in r["text"]) or len(r["text"]) > 20_000:
            continue
        v = plain_vector(r["text"])
        tops = [dot(w, v) for w in model["top"]]
        family = model["families"][tops.index(max(tops))]
        names, machines = model["within"][family]
        wins = {n: [0, 0.0] for n in names}
        sure = [1 / (1 + math.exp(-4 * max(tops)))]
        pairs = {}
        for (a, b), w in machines.items():
            m = dot(w, v)
            pairs[a, b] = m
            won = a if m >= 0 else b
            wins[won] = [wins[won][0] + 1, wins[won][1] + abs(m)]
        best = max(names, key=lambda n: (wins[n], n))
        own = [1 / (1 + math.exp(-4 * (m if best == a else -m))) for (a, b), m in pairs.items() if best in (a, b)]
        want = sure[0] * (sum(own) / len(own) if own else 1)
        got = rows[r["doc_id"]]
        assert got["lang_pred"] == best and abs(got["score"] - want) < 1e-3


def test_a_large_group_of_copies_teaches_once(spark, documents):
    """Copies of one text reach the training task as one row, however many they are."""
    from pyspark.sql import functions as F

    row = documents.where("lang = 'en' AND text IS NOT NULL").orderBy("doc_id").limit(1)
    copies = row.crossJoin(spark.range(20_000)).withColumn("doc_id", F.col("id") + 10**6).drop("id")
    many = documents.unionByName(copies)
    held = {r["doc_id"]: r["lang_pred"] for r in language.identify(many, sample=400).where("held_out AND doc_id < 1000000").collect()}
    true = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert sum(held[d] == true[d] for d in held) >= 0.95 * len(held)


def test_scores_word_by_word(spark, documents):
    """The score of some documents from the model's tables: each token's class given the two classes before it, and for a
    word of a shared class its smoothed share of that class."""
    from pyspark.sql import functions as F

    from lectern.llm import shared

    rows = documents.select("doc_id", (shared.id_hash(F.col("doc_id")) % 5 == scoring.HELD_OUT).alias("held_out"), "text")
    fitted = scoring.fit(rows.where("NOT held_out").select("text"))
    got = {r["doc_id"]: r for r in scoring.score_with(fitted, rows).collect()}
    near, far, bias, _ = (np.asarray(x, float) for x in fitted["tables"])
    lex, counts = fitted["lexicon"].value, {bytes(r["word"]): r["c"] for r in fitted["counts"].collect()}
    tails = Counter()
    for w, c in counts.items():
        if lex.at.get(w, scoring.VOCAB) >= scoring.VOCAB:
            tails[scoring.tail_class(w)] += c
    distinct = Counter(scoring.tail_class(w) for w in counts if lex.at.get(w, scoring.VOCAB) >= scoring.VOCAB)
    for r in documents.orderBy("doc_id").limit(12).collect():
        words = scoring.words_of(r["text"])[:400]
        if len(words) != len(scoring.words_of(r["text"])):
            continue
        u = v = scoring.END
        total = 0.0
        for w in [*words, None]:
            k = scoring.END if w is None else lex.at[w] if lex.at.get(w, scoring.VOCAB) < scoring.VOCAB else scoring.tail_class(w)
            logits = near[v] + far[u] + bias
            top = logits.max()
            total += (logits[k] - top - math.log(np.exp(logits - top).sum())) / math.log(10)
            if w is not None and k >= scoring.VOCAB:
                total += math.log10(counts.get(w, 0) + 0.5) - math.log10(tails[k] + 0.5 * (distinct[k] + 1))
            u, v = v, k
        assert abs(total - got[r["doc_id"]]["score"]) < 1e-3 * max(1, len(words))


def test_frequent_words_of_equal_counts_and_long_words(spark):
    """A step of equal counts that is too large is taken in part; a word of thousands of bytes may be frequent."""
    long_word = "x" * 5000
    df = spark.createDataFrame([(f"w{i} {long_word}",) for i in range(3000)], "text string")
    counts = scoring.count_words(df)
    hot = scoring.frequent(counts, 500)
    assert 300 < len(hot) <= 500 and hot[0][1] == 3000 and len(hot[0][0]) == 17
    docs = spark.createDataFrame([(i, f"{long_word} a{i}") for i in range(50)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in scoring.score_documents(docs).collect())
    assert got == plain_base([(i, f"{long_word} a{i}") for i in range(50)])
