"""Operator 4: scores of a log-bilinear language model, trained with noise-contrastive estimation.

Words are counted over all training documents. The `VOCAB` most frequent words are classes of their own, the others
fall into classes by their last two bytes, and the end is a class. The model predicts a class from the two classes
before it: score(w | u, v) = (C1 * q[v] + C2 * q[u]) . r[w] + b[w]. A pilot on a bounded sample sets its start; then
every partition trains on all of its training documents and the weights are averaged by their token counts. Scores are
additive over the context, so the normaliser of all contexts is one matrix product of exponentials, made once; the
log-probability of a token is then exact and normalised. A word of a shared class takes its smoothed share of that
class, so that the probabilities of all words, unseen ones together counted as one, sum to one.

Counts of the `HOT` most frequent words are broadcast, a bounded table; of words that are equally frequent where it ends
a part goes in, by hash. Words of more than `LONGEST` bytes stand under a 128-bit hash, so that a long one may be frequent
as well. Other words are counted in each document and joined with the corpus counts; none of them is a hot key.

The number of classes is a fixed bound of the model, `VOCAB` and `TAILS`, like its dimensions; the counts that part the
words of a class grow with the corpus. The pilot is the `PILOT_DOCS` texts or so of the smallest hashes. Weights are
averages over partitions, so scores change a little when the rows are dealt to other partitions; base_score does not.

Results in special cases. Null and empty texts are the end alone. Rows that repeat a doc_id are scored, and learned
from, each for itself; a null doc_id counts as the empty text in the fold. With no training documents the base is the
log of 0.5 / 0.5, that is 0, for each token and the model knows no word. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import shared

HELD_OUT = 1
VOCAB, TAILS, HOT, DIM, NOISE = 1000, 256, 100_000, 24, 48
#: Longer words, in bytes, stand under a hash. Parts of a count step that is too large for the broadcast table.
LONGEST, PARTS = 64, 1024
PILOT_DOCS = 2000
#: Distinct words a task counts before it hands them on, and tokens it trains on at a time.
COUNT_AT_ONCE, TRAIN_AT_ONCE = 100_000, 1 << 20
END = VOCAB + TAILS
CLASSES = END + 1


def words_of(text: str | None) -> list[bytes]:
    words = (text or "").encode().lower().split()  # ASCII case and white space only
    if words and max(map(len, words)) > LONGEST:
        words = [w if len(w) <= LONGEST else b"\0" + xxhash.xxh3_128_digest(w) for w in words]
    return words


def tail_class(word: bytes) -> int:
    return VOCAB + (zlib.crc32(word[-2:]) & (TAILS - 1))


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, tail int, c long) over all rows of texts (text)."""

    def run(batches):
        seen: Counter = Counter()

        def flush():
            out = {"word": list(seen), "tail": [tail_class(w) for w in seen], "c": list(seen.values())}
            seen.clear()
            return out

        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(words_of(t))
                if len(seen) > COUNT_AT_ONCE:
                    yield flush()
        yield flush()

    return shared.map_texts(texts, run, "word binary, tail int, c long").groupBy("word", "tail").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int = HOT) -> list[tuple[bytes, int]]:
    """At most `most` words, the most frequent first. Steps of the logarithm of the count, some thousand at most, tell
    how far down the table may go; of the first step that does not fit, parts by a hash are taken while they fit. Only the
    words above that line leave the executors."""
    words = counts.select("word", "c", F.floor(F.log2("c") * 64).alias("step"), F.pmod(F.xxhash64("word"), F.lit(PARTS)).alias("part"))
    least, total, parts = None, 0, 0
    for r in sorted(words.groupBy("step").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        least = r["step"]
        if total + r["n"] > most:
            for p in sorted(words.where(F.col("step") == least).groupBy("part").agg(F.count("*").alias("n")).collect(), key=lambda p: p["part"]):
                if total + p["n"] > most:
                    break
                total, parts = total + p["n"], p["part"] + 1
            break
        total, parts = total + r["n"], PARTS
    if least is None:
        return []
    some = words.where((F.col("step") > least) | (F.col("step") == least) & (F.col("part") < parts))
    return sorted(((bytes(r["word"]), r["c"]) for r in some.collect()), key=lambda x: (-x[1], x[0]))


class Lexicon:
    """The frequent words: their class, and the log10 of their count plus one half."""

    def __init__(self, hot: list[tuple[bytes, int]]):
        self.at = {w: i for i, (w, _) in enumerate(hot)}
        self.cls = np.array([i if i < VOCAB else tail_class(w) for i, (w, _) in enumerate(hot)] + [0], np.int32)
        self.log = np.array([np.log10(c + 0.5) for _, c in hot] + [0.0])

    def classes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Indices in the table, -1 for other words, and the classes of all words."""
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        cls = self.cls[at]
        other = np.flatnonzero(at < 0)
        if len(other):
            cls[other] = [tail_class(words[i]) for i in other.tolist()]
        return at, cls


def scatter(ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by id."""
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    out[ids[first]] = np.add.reduceat(rows[order], first)
    return out


def start_model(noise: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    rand = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    return {"q": rand(CLASSES, DIM), "r": rand(CLASSES, DIM), "c": np.ones((2, DIM), np.float32), "b": np.log(noise).astype(np.float32)}


def train_nce(model: dict, trigrams: np.ndarray, weights: np.ndarray, noise: np.ndarray, rng, power: dict, batch: int = 8192, rate: float = 0.04) -> None:
    """One pass over distinct trigrams (code of u, v, w) and their counts, in place. Each batch shares its noise
    classes; steps are Adagrad's, whose sums of squares are in `power`."""
    order = rng.permutation(len(trigrams))
    upto = np.cumsum(noise)
    log_kn = (np.log(noise) + np.log(NOISE)).astype(np.float32)
    q, r, c, b = (model[k] for k in "qrcb")
    for at in range(0, len(order), batch):
        some = order[at : at + batch]
        code, weight = trigrams[some], weights[some].astype(np.float32)
        weight /= weight.mean()
        w, v, u = code % CLASSES, code // CLASSES % CLASSES, code // CLASSES**2
        fake = np.minimum(np.searchsorted(upto, rng.random(NOISE) * upto[-1]), CLASSES - 1)
        qv, qu, rw, rf = q[v], q[u], r[w], r[fake]
        h = c[0] * qv + c[1] * qu
        real = 1 / (1 + np.exp(-np.clip((h * rw).sum(1) + b[w] - log_kn[w], -30, 30)))
        false = 1 / (1 + np.exp(-np.clip(h @ rf.T + b[fake] - log_kn[fake], -30, 30)))
        dr, df = ((real - 1) * weight)[:, None], false * weight[:, None]
        gh = dr * rw + df @ rf
        grads = {
            "q": scatter(v, gh * c[0], CLASSES) + scatter(u, gh * c[1], CLASSES),
            "r": scatter(w, dr * h, CLASSES) + scatter(fake, df.T @ h, CLASSES),
            "c": np.stack([(gh * qv).sum(0), (gh * qu).sum(0)]),
            "b": (scatter(w, dr, CLASSES) + scatter(fake, df.sum(0)[:, None], CLASSES))[:, 0],
        }
        for k, g in grads.items():
            g /= len(some)
            power[k] += g * g
            model[k] -= np.float32(rate) * g / np.sqrt(power[k] + np.float32(1e-8))


def trigrams_of(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of (before last, last, class) over texts, and their counts."""
    pads = np.array([END, END], np.int64)
    codes, at = np.empty(sum(len(c) + 1 for c in classes), np.int64), 0
    for c in classes:
        x = np.concatenate([pads, c, pads[:1]])
        codes[at : at + len(c) + 1] = (x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:]
        at += len(c) + 1
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes)))


def blob(model: dict) -> bytes:
    return np.concatenate([model[k].ravel() for k in "qrcb"]).astype("<f4").tobytes()


def unblob(raw: bytes | np.ndarray) -> dict[str, np.ndarray]:
    x = np.frombuffer(raw, "<f4") if isinstance(raw, bytes) else raw
    cuts = np.cumsum([0, CLASSES * DIM, CLASSES * DIM, 2 * DIM, CLASSES])
    shapes = ((CLASSES, DIM), (CLASSES, DIM), (2, DIM), (CLASSES,))
    return {k: x[a:z].reshape(s).astype(np.float32) for k, a, z, s in zip("qrcb", cuts, cuts[1:], shapes)}


def train_model(texts: DataFrame, lexicon, noise: np.ndarray) -> dict[str, np.ndarray]:
    """Train on all rows of texts (text); see the module's docstring."""
    spark = texts.sparkSession
    size = (2 * DIM + 1) * CLASSES + 2 * DIM

    def learn(first: bytes | None, passes: int):
        def run(batches):
            lex, rng = lexicon.value, np.random.default_rng(TaskContext.get().partitionId() if first else 0)
            model = unblob(first) if first else start_model(noise)
            power = {k: np.full_like(m, 1e-3 if first else 1e-6) for k, m in model.items()}
            held, n, total = [], 0, 0

            def step():
                codes, counts = trigrams_of(held)
                for _ in range(passes):
                    train_nce(model, codes, counts, noise, rng, power)

            for b in batches:
                for t in b.column("text").to_pylist():
                    held.append(lex.classes(words_of(t))[1])
                    n += len(held[-1]) + 1
                if n >= TRAIN_AT_ONCE:
                    step()
                    total, n = total + n, 0
                    held.clear()
            if held:
                step()
                total += n
            if total:
                yield {"n": [total], "model": [blob(model)]}

        return run

    def average(batches):
        total, n = np.zeros(size), 0
        for b in batches:
            for k, raw in zip(b.column("n").to_pylist(), b.column("model").to_pylist()):
                total, n = total + k * np.frombuffer(raw, "<f4"), n + k
        if n:
            yield pa.record_batch([pa.array([n], pa.int64()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["n", "model"])

    hashed = texts.where(F.col("text").isNotNull()).select("text", F.xxhash64("text", F.lit(5)).alias("h"))
    rows = texts.count()
    pilot = hashed.where(F.pmod("h", F.lit(max(1, rows // PILOT_DOCS))) == 0).orderBy("h").limit(2 * PILOT_DOCS).select("text").coalesce(1)
    got = shared.map_texts(pilot, learn(None, 3), "n long, model binary").collect()  # one model
    first = bytes(got[0]["model"]) if got else blob(start_model(noise))
    models = shared.stored(shared.map_texts(texts, learn(first, 1), "n long, model binary"), "models")
    parts = models.repartition(16).mapInArrow(average, "n long, model binary").collect()  # 16 sums of one model's size
    if not parts:
        return unblob(first)
    return unblob((sum(np.frombuffer(bytes(p["model"]), "<f8") for p in parts) / sum(p["n"] for p in parts)).astype("<f4"))


def tables(model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores by last and by second last class, biases, and the log normaliser of every context."""
    near = ((model["q"] * model["c"][0]) @ model["r"].T).astype(float)
    far = ((model["q"] * model["c"][1]) @ model["r"].T).astype(float)
    a, z, bias = near.max(1), far.max(1), model["b"].astype(float)
    norm = np.log(np.exp(far - z[:, None] + bias) @ np.exp(near - a[:, None]).T) + z[:, None] + a[None, :]
    return near.astype(np.float32), far.astype(np.float32), model["b"], norm.astype(np.float32)


def fit(teach: DataFrame) -> dict:
    """What scoring needs, learnt from all rows of teach (text): the corpus counts as a table, the frequent words, the
    shared classes' sizes, the totals and the model's tables."""
    spark = teach.sparkSession
    counts = shared.stored(count_words(teach), "counts")
    hot = frequent(counts)
    lexicon = Lexicon(hot)
    n_docs = teach.count()
    tails = np.zeros((CLASSES, 2))  # of each shared class, tokens and distinct words in training
    for r in counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # at most TAILS rows
        tails[r["tail"]] = r["c"], r["v"]
    n, v = tails.sum(0) + (n_docs, n_docs > 0)
    for w, c in hot[:VOCAB]:
        tails[tail_class(w)] -= c, 1
    share = np.log10(tails[:, 0] + 0.5 * (tails[:, 1] + 1))
    noise = tails[:, 0].copy()
    noise[: len(hot[:VOCAB])] = [c for _, c in hot[:VOCAB]]
    noise[END] = n_docs
    noise = (noise + 0.5) / (noise + 0.5).sum()
    held = spark.sparkContext.broadcast(lexicon)
    return {"counts": counts, "lexicon": held, "tables": tables(train_model(teach, held, noise)), "share": share, "n": n, "v": v, "n_docs": n_docs}


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for documents (doc_id, text)."""
    rows = docs.select("doc_id", (shared.id_hash(F.col("doc_id")) % 5 == HELD_OUT).alias("held_out"), "text")
    return score_with(fit(rows.where("NOT held_out").select("text")), rows)


def score_with(fitted: dict, rows: DataFrame) -> DataFrame:
    """score_documents for rows (doc_id, held_out, text) by what fit() has learnt."""
    counts, lexicon, share, n, v, n_docs = (fitted[k] for k in ("counts", "lexicon", "share", "n", "v", "n_docs"))
    ready = rows.sparkSession.sparkContext.broadcast(fitted["tables"])
    base_of, end_log = float(np.log10(n + 0.5 * (v + 1))), float(np.log10(n_docs + 0.5))

    def score(batches):
        lex, (near, far, bias, norm) = lexicon.value, ready.value
        pid, nth = TaskContext.get().partitionId(), 0
        for b in batches:
            out = {k: [] for k in ("uid", "n_tokens", "known", "base", "score", "tail")}
            for t in b.column("text").to_pylist():
                words = words_of(t)
                at, cls = lex.classes(words)
                x = np.concatenate([[END, END], cls, [END]]).astype(np.int64)
                u, c, w = x[:-2], x[1:-1], x[2:]
                ln = near[c, w].astype(float) + far[u, w] + bias[w] - norm[u, c]
                rest = np.flatnonzero(at < 0)
                logs = lex.log[at]
                tail = Counter([words[i] for i in rest.tolist()])
                in_shared = cls >= VOCAB
                out["uid"].append((pid << 40) + nth)
                out["n_tokens"].append(len(words) + 1)
                out["known"].append(len(words) - len(rest) + (n_docs > 0))
                out["base"].append(float(logs.sum()) + end_log)
                out["score"].append(float(ln.sum() / np.log(10) + logs[in_shared].sum() - share[cls[in_shared]].sum()))
                out["tail"].append([{"word": k, "tf": f} for k, f in tail.items()])
                nth += 1
            yield out | {"doc_id": b.column("doc_id"), "held_out": b.column("held_out")}

    kind = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, tail array<struct<word:binary,tf:long>>"
    scored = shared.stored(shared.map_texts(rows, score, kind), "scored")
    rare = scored.select("uid", F.explode("tail").alias("t")).select("uid", "t.word", "t.tf")
    c = F.coalesce("c", F.lit(0))
    added = (
        rare.join(counts.select("word", "c").hint("merge"), "word", "left")
        .groupBy("uid")
        .agg(F.sum(F.col("tf") * F.log10(c + 0.5)).alias("add"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more"))
    )
    both = scored.drop("tail").join(added, "uid", "left")
    add, more = F.coalesce("add", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + more).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + add - F.col("n_tokens") * F.lit(base_of)).alias("base_score"),
        (F.col("score") + add).alias("score"),
    )


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(shared.table(spark, sf_dir, "documents"))
