"""Operator 2: best-fit packing by patterns of document lengths.

Documents become pieces of at most `limit` tokens. The histogram of piece lengths, at most `limit` numbers, goes to
the driver. There all patterns of two or three lengths that fill a sequence are enumerated, non-negative least
squares fits how often each is used, the counts are rounded down to whole numbers that the histogram covers, and the
pieces that remain are packed by best fit on their histogram. The plan has at most some thousand kinds of sequence
however many documents there are. A piece finds its place by its rank among the pieces of its length: ranks within
an input partition plus a prefix sum over partitions, so no length is ever gathered in one task. The prefix sums have a
row for each length and partition and are joined by sort and merge, never broadcast.

Results in special cases. Null and empty texts are one piece, the end id alone. Rows with equal doc_id are packed
each for itself. A null doc_id stays null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm import shared
from lectern.llm.tokens import encoder, tokenizer_path

LIMIT = 2048


def patterns(present: np.ndarray, limit: int) -> np.ndarray:
    """All ascending pairs and triples of present lengths with sum `limit`: rows of three lengths, 0 for none."""
    has = np.zeros(limit + 1, bool)
    has[present] = True
    lengths = np.flatnonzero(has[:limit])
    out = []
    low = lengths[lengths <= limit // 2]
    pair = low[has[limit - low]]
    out.append(np.stack([np.zeros_like(pair), pair, limit - pair], 1))
    for a in lengths[lengths <= limit // 3]:
        b = lengths[(lengths >= a) & (lengths <= (limit - a) // 2)]
        b = b[has[limit - a - b]]
        out.append(np.stack([np.full_like(b, a), b, limit - a - b], 1))
    return np.concatenate(out).astype(np.int64)


def nonnegative_fit(rows: np.ndarray, target: np.ndarray, rounds: int = 120, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares with an active set: which patterns are used, and how often (real numbers).

    Each round adds the patterns of steepest descent that share no length, solves the least squares on the set by
    conjugate gradients and drops what turns negative. The set stays below the number of lengths, so rounding
    down loses less than one sequence for each length."""
    size = len(target)

    def fill(p, x):
        y = np.bincount(p.ravel(), np.repeat(x, p.shape[1]), size)
        y[0] = 0
        return y

    def solve(p, x):
        r = (target - fill(p, x))[p].sum(1) if len(p) else np.zeros(0)
        d, rr = r.copy(), r @ r
        for _ in range(60):
            if rr < 1e-9:
                break
            ad = fill(p, d)[p].sum(1)
            a = rr / max(d @ ad, 1e-300)
            x, r = x + a * d, r - a * ad
            new = r @ r
            d, rr = r + new / rr * d, new
        return x

    target = target.astype(float)
    target[0] = 0
    chosen, x = np.zeros(0, np.int64), np.zeros(0)
    best, kept = float(target @ target), (chosen, x)
    noise = np.random.default_rng(seed).random(len(rows))
    stale = 0
    for _ in range(rounds):
        rest = target - fill(rows[chosen], x)
        pull = np.where(rows > 0, rest[rows], np.inf).min(1) + 1e-3 * noise
        pull[chosen] = -1
        order = np.argsort(-pull, kind="stable")[: 4 * size]
        order = order[pull[order] > 0.5]
        if not len(order):
            break
        seen, add = set(), []
        for j in order:
            parts = [v for v in rows[j] if v]
            if not any(v in seen for v in parts):
                seen.update(parts)
                add.append(j)
        chosen, x = np.concatenate([chosen, add]), np.concatenate([x, np.zeros(len(add))])
        for _ in range(8):
            x = solve(rows[chosen], x)
            if (x > 0).all():
                break
            chosen, x = chosen[x > 0], x[x > 0]
        rest = target - fill(rows[chosen], x)
        cost = float(rest @ rest)
        stale = 0 if cost < 0.999 * best else stale + 1
        if cost < best:
            best, kept = cost, (chosen.copy(), x.copy())
        if stale >= 5:
            break
    return kept


def plan(hist: np.ndarray, limit: int = LIMIT) -> list[tuple[int, tuple[int, ...]]]:
    """hist[l]: pieces of length l. Returns (how many sequences, the lengths in each), all pieces placed."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    out = [(int(left[limit]), (limit,))] if left[limit] else []
    left[limit] = 0
    rows = patterns(np.flatnonzero(left), limit)
    if len(rows):
        used, x = nonnegative_fit(rows, left)
        order = np.argsort(-x, kind="stable")
        for j, want in zip(used[order], np.floor(x[order] + 1e-6).astype(np.int64)):
            parts = [int(v) for v in rows[j] if v]
            n = min([int(want), *(int(left[v]) // parts.count(v) for v in parts)])
            if n > 0:
                out.append((n, tuple(sorted(parts, reverse=True))))
                for v in parts:
                    left[v] -= n
    return out + best_fit(left, limit)


def best_fit(left: np.ndarray, limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, longest lengths first, on counts: sequences of the same kind are filled together."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    spaces: list[int] = []

    def put(n, parts):
        space = limit - sum(parts)
        if space not in room:
            room[space] = []
            insort(spaces, space)
        room[space].append((n, parts))

    for length in range(limit, 0, -1):
        c = int(left[length])
        while c:
            i = bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                n, parts = room[space].pop()
                if not room[space]:
                    del room[space], spaces[i]
                k = min(max(1, space // length), c)
                take = min(n, c // k)
                put(take, parts + (length,) * k)
                if n > take:
                    put(n - take, parts)
                c -= take * k
            else:
                each = limit // length
                if c >= each:
                    put(c // each, (length,) * each)
                if c % each:
                    put(1, (length,) * (c % each))
                c = 0
    return [x for s in spaces for x in room[s]]


def places(kinds: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """The plan as sorted intervals: the pieces of a length with ranks from `low` on go, one each, to the sequences
    from `sequence` on, at `offset`."""
    upto: dict[int, int] = {}
    out, base = [], 0
    for n, parts in kinds:
        at = 0
        for v in parts:
            out.append((v, upto.get(v, 0), base, at))
            upto[v] = upto.get(v, 0) + n
            at += v
        base += n
    a = np.array(sorted(out), np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 48) | a[:, 1], "low": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def cut_documents(docs: DataFrame, *, tokenizer: str = "word_bpe_49k.json", style: str = "word", end_id: int = 0, limit: int = LIMIT) -> DataFrame:
    """Pieces of all documents, with the input partition `pid` and the rank `nth` among its pieces of that length."""

    def cut(batches):
        enc, pid, seen = encoder(tokenizer_path(tokenizer), style), TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for b in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "nth")}
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                ids = np.append(np.frombuffer(ids, enc.dtype), end_id).astype("<u4")
                for k, at in enumerate(range(0, len(ids), limit)):
                    part = ids[at : at + limit]
                    for name, v in zip(out, (doc, k, at, len(part), zlib.crc32(part.tobytes()), int(seen[len(part)]))):
                        out[name].append(v)
                    seen[len(part)] += 1
            yield out | {"pid": [pid] * len(out["nth"])}

    return shared.map_texts(docs.select("doc_id", "text"), cut, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, pid int")


def pack(docs: DataFrame, *, limit: int = LIMIT, **tokens) -> DataFrame:
    """Pack documents (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = shared.stored(cut_documents(docs, limit=limit, **tokens), "pieces")
    counts = shared.stored(pieces.groupBy("length", "pid").agg(F.count("*").alias("n")), "lengths")
    hist = np.zeros(limit + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `limit` rows
        hist[r["length"]] = r["n"]
    where = spark.sparkContext.broadcast(places(plan(hist, limit)))  # a row for each place in each kind of sequence
    before = W.partitionBy("length").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases.hint("merge"), ["length", "pid"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def assign(batches):
        p = where.value
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            i = np.searchsorted(p["key"], (length << 48) | rank, "right") - 1
            cols = [b.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p["sequence"][i] + rank - p["low"][i]), pa.array(p["offset"][i])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(shared.table(spark, sf_dir, "documents"))
