"""Operator 3: language ID by hierarchical discrimination.

A text becomes the hashed counts of its letter n-grams, over the whole text. One-versus-rest linear support vector
machines predict the language family; one-versus-one linear support vector machines then part the languages within
that family. The machines are trained in one task on at most `sample` labelled texts, the documented bound, but on one
text of each label at least; only their weights reach the driver. Every row is predicted. Text alone is looked at: the
language column only teaches, doc_id only says what may teach.

Results in special cases. Null texts and texts without a letter are `und` with score 0. With no labelled rows every
text is `und`. One learned language is predicted everywhere, with score 1. Rows that repeat are predicted alike, and
copies of a text teach once. An empty table gives no rows. A label that is empty is a language of its own; languages
outside FAMILIES are families.
"""

from __future__ import annotations

import pickle
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm import shared

#: Hashed feature dimensions, and the most rows that train.
DIMS, SAMPLE = 4096, 6000
HELD_OUT = 2
#: A text whose cosine to the mean vector of every learned language is smaller is in none of them. Texts of one short
#: word of a learned language reach 0.28 at sf0.1, whole texts 0.6 or more; other scripts and noise stay below 0.18.
LEAST_LIKENESS = 0.2
#: Up to so many labels their counts are broadcast, some 40 bytes each.
MANY_LABELS = 100_000
#: Genealogical families of languages by code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "turkic": "tr az kk ky uz tk tt",
    "uralic": "fi et hu",
    "indo-aryan": "hi bn mr gu pa ur ne si",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
LETTER = regex.compile(r"\p{L}")
#: ASCII but letters to a space: n-grams are those of letters and word ends.
SPACED = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def features(text: str, dims: int = DIMS) -> np.ndarray:
    """Unit vector of the square roots of hashed 1- to 3-byte n-gram counts of the lower-cased text."""
    counts = np.zeros(dims)
    for at in range(0, max(1, len(text)), 1 << 20):
        raw = b" " + b" ".join(text[at : at + (1 << 20)].lower().encode().translate(SPACED).split()) + b" "
        x = np.frombuffer(raw, np.uint8).astype(np.uint32)
        code = x
        for n in range(1, 4):
            if n > 1:
                code = code[:-1] * np.uint32(257) + x[n - 1 :]
            slots = ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(16)
            counts += np.bincount(slots % np.uint32(dims), minlength=dims)
    v = np.sqrt(counts)
    return (v / (np.linalg.norm(v) or 1)).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights and bias (last) of a linear machine with squared hinge loss; y is 1 or -1, the classes weigh alike.
    Accelerated gradient descent, from zero: the same rows give the same weights."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    weight, y = weight.astype(np.float32), y.astype(np.float32)
    w = last = np.zeros(x.shape[1] + 1, np.float32)
    rate = 1 / (4 + penalty)  # rows are unit vectors with a bias of 1
    for k in range(steps):
        z = w + np.float32(k / (k + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (x @ z[:-1] + z[-1]))
        pull = -2 * weight * slack * y
        last, w = w, z - np.float32(rate) * np.append(pull @ x + np.float32(penalty) * z[:-1], pull.sum())
    return w.astype(float)


def train(x: np.ndarray, langs: list[str]) -> dict | None:
    """The machines: a row of weights for each family, and one for each pair of languages of a family."""
    if not len(x):
        return None
    lang = np.array(langs, object)
    family = np.array([FAMILY_OF.get(v, f"={v}") for v in langs], object)
    families = sorted(set(family))
    means = np.stack([x[lang == v].mean(0) for v in sorted(set(langs))]).astype(float)
    model = {"families": families, "top": None, "within": {}, "means": means / np.maximum(1e-9, np.linalg.norm(means, axis=1, keepdims=True))}
    if len(families) > 1:
        model["top"] = np.stack([train_svm(x, np.where(family == f, 1, -1)) for f in families])
    for f in families:
        names = sorted(set(lang[family == f]))
        machines = {}
        for a, b in combinations(names, 2):
            rows = (lang == a) | (lang == b)
            machines[a, b] = train_svm(x[rows], np.where(lang[rows] == a, 1, -1))
        model["within"][f] = (names, machines)
    return model


def sure(margin: np.ndarray | float):
    return 1 / (1 + np.exp(-4 * np.clip(margin, -50, 50)))


def predict(model: dict | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    for text in texts:
        if not text or model is None or not LETTER.search(text):
            langs.append("und")
            scores.append(0.0)
            continue
        v, score, family = features(text).astype(float), 1.0, model["families"][0]
        if model["top"] is not None:
            margins = model["top"][:, :-1] @ v + model["top"][:, -1]
            i = int(margins.argmax())
            family, score = model["families"][i], float(sure(margins[i]))
        names, machines = model["within"][family]
        votes = dict.fromkeys(names, (0, 0.0))
        for (a, b), w in machines.items():
            m = float(w[:-1] @ v + w[-1])
            won, how = (a, m) if m >= 0 else (b, -m)
            votes[won] = (votes[won][0] + 1, votes[won][1] + how)
        best = max(names, key=lambda n: (votes[n], n))
        if machines:
            score *= float(np.mean([sure(m if best == a else -m) for (a, b), w in machines.items() if best in (a, b) for m in [float(w[:-1] @ v + w[-1])]]))
        langs.append(best)
        scores.append(score)
    return langs, scores


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Train on labelled texts outside the held-out fold, `sample` at most and as many of each language.

    Texts are taken by the smallest hashes of each language, so the choice does not depend on partitions. A first cut by
    the hash leaves some 1.3 times what is wanted; copies of a text are one row of it, and one row of each task before
    the shuffle. Vectors of 4 kB each meet in the one task that trains; the driver sees the weights."""
    teach = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(shared.id_hash(F.col("doc_id")) % 4 != HELD_OUT).select("lang", "text")
    teach = teach.where(F.expr("text RLIKE '\\\\p{L}'"))
    hashed = teach.select("lang", "text", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 62)).alias("h"))
    counts = shared.stored(hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")), "labels")  # a row for each label
    labels = counts.count()
    each = max(1, sample // max(1, labels))
    # a language with few texts is taken whole
    share = F.when(F.col("n") <= 8 * each, 1.0).otherwise(1.3 * each / F.col("n"))
    drawn = hashed.join(F.broadcast(counts) if labels <= MANY_LABELS else counts, "lang").where(F.col("h") < share * float(1 << 62)).dropDuplicates(["lang", "h"])
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h"))

    def vectors(batches):
        for b in batches:
            v = [np.round(features(t) * 255).astype(np.uint8).tobytes() for t in b.column("text").to_pylist()]
            yield {"lang": b.column("lang"), "h": b.column("h"), "v": v}

    def fit(batches):
        rows = sorted((r for b in batches for r in zip(b.column("lang").to_pylist(), b.column("h").to_pylist(), b.column("v").to_pylist())), key=lambda r: r[:2])
        if rows:
            x = np.empty((len(rows), DIMS), np.float32)
            for i, (_, _, v) in enumerate(rows):
                x[i] = np.frombuffer(v, np.uint8)
            x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
            yield pa.record_batch([pa.array([pickle.dumps(train(x, [r[0] for r in rows]))], pa.binary())], names=["model"])

    some = shared.map_texts(drawn.select("lang", "h", "text"), vectors, "lang string, h long, v binary").withColumn("nth", nth)
    got = some.where(F.col("nth") <= each).select("lang", "h", "v").repartition(1).mapInArrow(fit, "model binary").collect()  # one row
    return pickle.loads(got[0]["model"]) if got else None


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for documents (doc_id, text, lang)."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))  # some weights for each pair of languages

    def run(batches):
        for b in batches:
            langs, scores = predict(model.value, b.column("text").to_pylist())
            yield {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": langs, "score": scores}

    rows = docs.select("doc_id", (shared.id_hash(F.col("doc_id")) % 4 == HELD_OUT).alias("held_out"), "text")
    return shared.map_texts(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def is_foreign(model: dict, text: str, least: float = LEAST_LIKENESS) -> bool:
    """Whether a text is unlike every learned language."""
    return float((model["means"] @ features(text)).max()) < least


def keep_identified(docs: DataFrame, least: float = 0.0, sample: int = SAMPLE) -> DataFrame:
    """The documents whose language is told, with a score of `least` or more, and that are not foreign to all learned
    languages; all columns as they were. Where no labelled row teaches anything, the documents with a letter stay."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))

    def run(batches):
        for b in shared.small_batches(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            if model.value is None:
                keep = [bool(t and LETTER.search(t)) for t in texts]
            else:
                keep = [lang != "und" and s >= least and not is_foreign(model.value, t) for t, lang, s in zip(texts, *predict(model.value, texts))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(shared.table(spark, sf_dir, "documents"))
