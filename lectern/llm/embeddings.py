"""Operator 9: embedding near-dedup on a robust-pruned flat graph.

Usable vectors are scaled to length one. Equal vectors of a label are one node, so copies cost one row from then on.
The nodes of each label and dimension get centroids from a bounded sample; each node joins its `OVERLAP` nearest
clusters. A cluster beyond `SHARD_ROWS` rows gets centroids of its own from a sample of its rows, and its nodes join the
nearest two of these; so it goes on, to `LEVELS` levels, until clusters are shards, whatever the size of a label. Only
what is left then (vectors that no centroids part) is split by hash. In each shard a graph is built by batches of greedy
searches and robust pruning, Vamana's rule; a node's adjacency lists are then united over its shards. Vectors and lists
are written as flat files in the shared folder, some for each label. Search tasks map them, or read the files they need:
every node searches from its own lists and its label's medoids with a beam; whatever it finds in range is expanded until
nothing new is in range. Everything in range is verified in double precision. Links that one end found and the other did
not would make counts differ, so each node is at last counted against all nodes of its component, in blocks.

A task links what its own batch of queries finds and hands on a spanning forest and counts, so a group of thousands of
near copies is never spelled out as pairs. `audit` measures recall against brute force on every 20th vector.

Results in special cases. Vectors that are null, empty, zero or hold null or non-finite numbers, and rows with a null
label, link with nothing and are kept. Vectors of different dimensions are not compared. A vec_id that repeats stands
for its rows together: links among its own rows do not count, and it is one row of the result for each of them. A null
vec_id links with nothing. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm import shared
from lectern.llm.components import components

LEAST_COSINE = 0.98
DEGREE, BEAM, ALPHA = 24, 48, 1.2
SHARD_ROWS, OVERLAP, CENTROID_SAMPLE = 2000, 2, 20_000
#: Centroids of a label or cluster at most, and how often clusters are cut again.
CENTROIDS, LEVELS = 1024, 4
QUERY_BATCH = 256
#: A node is put into the lists of its RETURN nearest neighbours whatever these prune, so that it can be reached. Lists
#: are kept whole and are offered to the beams STRIDE entries at a time.
RETURN, STRIDE = 4, 192
#: Queries compared at once, and members of a component in a block.
COMPARED, AGAINST = 1024, 1 << 13


def prune(x: np.ndarray, node: int, cand: np.ndarray, alpha: float = ALPHA, degree: int = DEGREE) -> np.ndarray:
    """Robust pruning: take the nearest candidate, drop those it is alpha times nearer to than the node is; repeat."""
    cand = np.unique(cand[cand != node])
    d = 1 - x[cand] @ x[node]
    order = np.argsort(d, kind="stable")[: 4 * BEAM]
    cand, d = cand[order], d[order]
    between = 1 - x[cand] @ x[cand].T
    out, alive = [], np.ones(len(cand), bool)
    for i in range(len(cand)):
        if alive[i]:
            out.append(cand[i])
            if len(out) == degree:
                break
            alive &= alpha * between[i] > d
            alive[: i + 1] = False
    return np.array(out, np.int64)


def build_graph(x: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Adjacency of one shard. Nodes are inserted in random order, a batch at a time: candidates of a batch are what a
    beam search over the graph so far meets, and the batch itself; back edges are pruned where they overflow."""
    n = len(x)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    near: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    first = order[: min(n, 4 * DEGREE)]
    done = 0
    while done < n:
        batch = first if done == 0 else order[done : done + max(64, done // 2)]
        seen = order[:done]
        if done:
            table = np.full((n, DEGREE), -1, np.int64)
            for i in seen:
                table[i, : len(near[i])] = near[i]
            found = beam_search(x, table, np.full((len(batch), 1), order[0]), x[batch])[0]
        both = x[batch] @ x[batch].T if len(batch) <= 1024 else None
        back: dict[int, list[int]] = {}
        for k, i in enumerate(batch):
            mates = batch[np.argsort(-both[k], kind="stable")[: BEAM // 2]] if both is not None else batch[np.argsort(-(x[batch] @ x[i]), kind="stable")[: BEAM // 2]]
            cand = np.concatenate([found[k][found[k] >= 0], mates]) if done else mates
            near[i] = prune(x, i, cand)
            for j in near[i]:
                back.setdefault(int(j), []).append(int(i))
        for j, add in back.items():
            every = np.unique(np.concatenate([near[j], add]))
            near[j] = every if len(every) <= DEGREE else prune(x, j, every)
        done += len(batch)
    return near


class Visited:
    """Which nodes each query has seen: a bitmap where it is small, else a set for each query, which grows with what the
    query visits and not with the label."""

    def __init__(self, queries: int, nodes: int):
        self.bits = np.zeros((queries, nodes), bool) if queries * nodes <= VISITED else None
        self.sets: list[set] = [] if self.bits is not None else [set() for _ in range(queries)]

    def fresh(self, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Of nodes, a row for each of rows, those not seen yet; -1 is none."""
        if self.bits is not None:
            return (nodes >= 0) & ~self.bits[rows[:, None], np.maximum(nodes, 0)]
        return np.array([[n >= 0 and n not in self.sets[r] for n in a] for r, a in zip(rows.tolist(), nodes.tolist())], bool).reshape(nodes.shape)

    def add(self, rows: np.ndarray, nodes: np.ndarray) -> None:
        if self.bits is not None:
            self.bits[rows, nodes] = True
        else:
            for r, n in zip(rows.tolist(), nodes.tolist()):
                self.sets[r].add(n)


def beam_search(x: np.ndarray, table: np.ndarray, start: np.ndarray, queries: np.ndarray, beam: int = BEAM, in_range: float | None = None) -> tuple[np.ndarray, list[np.ndarray] | None]:
    """Greedy search of many queries at once. table: adjacency padded with -1, or Lists. Returns each query's beam, nearest first,
    padded with -1; with in_range also all nodes met of at least that similarity, after expanding each that is near it."""
    nq, n = len(queries), len(x)
    seen = Visited(nq, n)
    ids = np.full((nq, beam), -1, np.int64)
    sims = np.full((nq, beam), -np.inf, queries.dtype)
    open_ = np.zeros((nq, beam), bool)
    hits: list[list[np.ndarray]] = [[] for _ in range(nq)]
    row = np.arange(nq)[:, None]

    def offer(new: np.ndarray, rows: np.ndarray) -> None:
        """new: candidate nodes of the queries in rows; unseen ones enter their beams."""
        nonlocal ids, sims, open_
        new = np.sort(np.where(seen.fresh(rows, new), new, -1), 1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        r, c = np.nonzero(new >= 0)
        seen.add(rows[r], new[r, c])
        s = np.full(new.shape, -np.inf, sims.dtype)
        s[r, c] = np.einsum("ij,ij->i", x[new[r, c]], queries[rows[r]])
        if in_range is not None:
            far, col = np.nonzero(s >= in_range - MARGIN)
            for a, node in zip(rows[far], new[far, col]):
                hits[a].append(node)
        both_s, both_i = np.concatenate([sims[rows], s], 1), np.concatenate([ids[rows], new], 1)
        both_o = np.concatenate([open_[rows], s > -np.inf], 1)
        order = np.argsort(-both_s, 1, kind="stable")[:, :beam]
        sims[rows], ids[rows], open_[rows] = (np.take_along_axis(m, order, 1) for m in (both_s, both_i, both_o))

    offer(start, np.arange(nq))
    while True:
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            break
        best = open_[rows].argmax(1)
        node = ids[rows, best]
        open_[rows, best] = False
        lists = table[node]
        for at in range(0, lists.shape[1], STRIDE):
            offer(lists[:, at : at + STRIDE], rows)
    if in_range is None:
        return ids, None
    every = []
    for q in range(nq):  # the range grows from what is in it
        todo = np.array(hits[q], np.int64)
        met = [todo]
        while len(todo):
            new = np.unique(table.joined(todo) if isinstance(table, Lists) else table[todo])
            new = new[new >= 0]
            new = new[seen.fresh(np.array([q]), new[None, :])[0]]
            if not len(new):
                break
            seen.add(np.full(len(new), q), new)
            todo = new[x[new] @ queries[q] >= in_range - MARGIN]
            met.append(todo)
        ids_ = np.concatenate(met)
        every.append(np.sort(ids_[x[ids_] @ queries[q] >= in_range]) if len(ids_) else ids_)
    return ids, every


CHUNK = 1 << 16
VISITED, OPEN_CHUNKS = 1 << 26, 32
#: Single precision decides what is looked at, this much below the threshold; double precision decides what links.
SLACK = 1e-4
#: The range grows through nodes this much below the threshold, since pruned lists may reach a neighbour only by them.
MARGIN = 0.05


class Flat:
    """Rows of one label, in flat files of `chunk` rows each: mapped where the store is a mounted file system, else read
    as they are needed, `OPEN_CHUNKS` at a time."""

    def __init__(self, files: list[str], kind: str, width: int, chunk: int, rows: int):
        self.files, self.kind, self.width, self.chunk, self.rows = files, kind, width, chunk, rows
        self.held: dict[int, np.ndarray] = {}

    def part(self, c: int) -> np.ndarray:
        if c not in self.held:
            fs, path = shared.open_fs(self.files[c])
            if fs.type_name == "local":
                raw = np.memmap(path, self.kind, "r")
            else:
                if len(self.held) >= OPEN_CHUNKS:
                    self.held.pop(next(iter(self.held)))
                with fs.open_input_file(path) as f:
                    raw = np.frombuffer(f.read(), self.kind)
            self.held[c] = raw.reshape(-1, self.width) if self.width else raw
        return self.held[c]

    def __len__(self) -> int:
        return self.rows

    def __getitem__(self, ids):
        ids = np.asarray(ids)
        if len(self.files) == 1:
            return self.part(0)[ids]
        if ids.ndim == 0:
            return self.part(int(ids) // self.chunk)[int(ids) % self.chunk]
        flat = ids.ravel()
        if not len(flat):
            return self.part(0)[flat].reshape(*ids.shape, *self.part(0).shape[1:])
        out = np.empty((len(flat), *self.part(int(flat[0]) // self.chunk).shape[1:]), self.kind)
        of = flat // self.chunk
        for c in np.unique(of).tolist():
            at = of == c
            out[at] = self.part(c)[flat[at] % self.chunk]
        return out.reshape(*ids.shape, *out.shape[1:])


class Lists:
    """Adjacency lists of one label, of any length: Flat offsets, one more than nodes in each file, and ids."""

    def __init__(self, starts: list[str], ids: list[str], chunk: int):
        self.starts, self.ids, self.chunk = Flat(starts, "<i8", 0, chunk, 0), Flat(ids, "<i8", 0, chunk, 0), chunk

    def one(self, node: int) -> np.ndarray:
        c, i = divmod(int(node), self.chunk)
        starts = self.starts.part(c)
        return np.asarray(self.ids.part(c)[starts[i] : starts[i + 1]])

    def joined(self, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.one(i) for i in nodes]).astype(np.int64)

    def __getitem__(self, nodes: np.ndarray) -> np.ndarray:
        """Lists padded with -1 to the longest of them."""
        lists = [self.one(i) for i in nodes]
        out = np.full((len(lists), max(map(len, lists))), -1, np.int64)
        for row, a in zip(out, lists):
            row[: len(a)] = a
        return out


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, dim, embedding, k1, k2) of the vectors that can link; k1 and k2 tell vectors apart."""
    finite = F.expr("size(embedding) > 0 AND forall(embedding, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('infinity')) AND exists(embedding, e -> e <> 0)")
    return rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(
        "vec_id", F.col("label").cast("string").alias("label"), F.size("embedding").alias("dim"), "embedding", F.xxhash64("embedding", F.lit(1)).alias("k1"), F.xxhash64("embedding", F.lit(2)).alias("k2")
    )


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(float)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(-1, dim)


def cluster_means(x: np.ndarray, n: int, most: int = CENTROIDS, shard: int = SHARD_ROWS) -> np.ndarray:
    """Centroids for n rows, by a few rounds of spherical k-means on a sample x of them, unit vectors."""
    k = max(1, min(len(x), most, -(-n * OVERLAP * 2 // shard)))
    c = x[np.random.default_rng(0).choice(len(x), k, replace=False)]
    for _ in range(8 if k > 1 else 0):
        of = (x @ c.T).argmax(1)
        order = np.argsort(of, kind="stable")
        first = np.searchsorted(of[order], np.arange(k))
        full = np.bincount(of, minlength=k) > 0
        sums = np.add.reduceat(x[order], np.minimum(first, len(x) - 1))
        c = np.where(full[:, None], sums, c)
        c = (c / np.maximum(1e-9, np.linalg.norm(c, axis=1, keepdims=True))).astype(np.float32)
    return c


def deal(rows: DataFrame, sizes: DataFrame, tag: str) -> DataFrame:
    """Rows (label, dim, cluster, node, k2, embedding) of the clusters in sizes (label, dim, cluster, n) to the nearest
    `OVERLAP` centroids of their cluster: the same columns with new clusters, and how near.

    The centroids of a cluster come from at most some `CENTROID_SAMPLE` of its rows, in one task, and are a file that the
    tasks which deal read when they meet the cluster."""
    root, bounds = shared.scratch(rows.sparkSession, tag), (CENTROIDS, SHARD_ROWS)
    keys = ["label", "dim", "cluster"]
    share = F.least(F.lit(1.0), 1.2 * F.lit(float(CENTROID_SAMPLE)) / F.col("n"))
    sample = rows.join(sizes.select(*keys, "n"), keys).where(F.pmod("k2", F.lit(1 << 30)) < share * float(1 << 30))

    def means(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        order = np.argsort(np.asarray(table.column("k2")), kind="stable")
        x = unit(matrix(table.column("embedding"), dim)[order]).astype(np.float32)
        uri = f"{root}/{uuid.uuid4().hex}"
        shared.write_arrays(uri, {"c": cluster_means(x, table.column("n")[0].as_py(), *bounds).ravel()})
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "uri": pa.array([uri])})

    files = shared.stored(sample.groupBy(*keys).applyInArrow(means, "label string, dim int, cluster string, uri string"), "means")
    held: dict[str, np.ndarray] = {}

    def near(batches):
        for b in batches:
            uris, dims = b.column("uri").to_pylist(), b.column("dim").to_pylist()
            groups: dict[str, list[int]] = {}
            for i, u in enumerate(uris):
                groups.setdefault(u, []).append(i)
            for u, at in groups.items():
                dim = dims[at[0]]
                if u not in held:
                    if len(held) >= OPEN_CHUNKS:
                        held.pop(next(iter(held)))
                    held[u] = shared.read_arrays(u)["c"].reshape(-1, dim)
                some = b.take(pa.array(at))
                sims = unit(matrix(some.column("embedding"), dim)).astype(np.float32) @ held[u].T
                ranked = np.argsort(-sims, 1, kind="stable")[:, :OVERLAP]
                for j in range(ranked.shape[1]):
                    best = ranked[:, j]
                    names = pa.array([f"{c}.{k}" for c, k in zip(some.column("cluster").to_pylist(), best.tolist())], pa.string())
                    k2 = pa.array(np.asarray(some.column("k2")) ^ (j * 0x5DEECE66D))
                    yield pa.record_batch([some.column("label"), some.column("dim"), names, some.column("node"), k2, some.column("embedding"), pa.array(sims[np.arange(len(at)), best].astype(float))], names=[*keys, "node", "k2", "embedding", "nearness"])

    kind = next(f.dataType.simpleString() for f in rows.schema if f.name == "embedding")
    ready = rows.join(files, keys).select(*keys, "node", "k2", "embedding", "uri")
    return shared.stored(ready.mapInArrow(near, f"label string, dim int, cluster string, node long, k2 long, embedding {kind}, nearness double"), "dealt")


def build_index(rows: DataFrame) -> tuple[DataFrame, dict]:
    """Number the nodes, build the shards' graphs, write the files. Returns the nodes and, by label and dimension, the
    files and medoids."""
    spark = rows.sparkSession
    root = shared.scratch(spark, "vectors")
    classes = usable(rows).groupBy("label", "dim", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = shared.stored(classes.withColumn("part", F.spark_partition_id()), "classes")
    parts = classes.groupBy("label", "dim", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("label", "dim").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    at = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {(r["label"], r["dim"]): r["n"] for r in parts.groupBy("label", "dim").agg(F.sum("n").alias("n")).collect()}  # a row for each label
    if not counts:
        return classes.withColumn("node", F.lit(0).cast("long")).limit(0), {}
    nodes = classes.join(at, ["label", "dim", "part"]).withColumn("node", F.col("base") + F.row_number().over(W.partitionBy("label", "dim", "part").orderBy("k1", "k2")) - 1)
    nodes = shared.stored(nodes.drop("part", "base"), "nodes")

    keys = ["label", "dim", "cluster"]
    rows_ = nodes.select("label", "dim", F.lit("").alias("cluster"), "node", "k2", "embedding")
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("cluster", F.lit(""))
    done, medoids = None, None
    for level in range(LEVELS):
        dealt = deal(rows_, sizes, "means")
        sizes = shared.stored(dealt.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by("node", "nearness").alias("medoid")), "clusters")
        medoids = medoids or sizes.select("label", "dim", "medoid").collect()  # of the first level: CENTROIDS a label at most
        sizes = sizes.drop("medoid")
        large = sizes.where(F.col("n") > SHARD_ROWS)
        if level == LEVELS - 1 or large.isEmpty():
            done = dealt if done is None else done.unionByName(dealt)
            break
        fit = dealt.join(large.select(*keys), keys, "left_anti")
        done = fit if done is None else done.unionByName(fit)
        rows_, sizes = dealt.join(large.select(*keys), keys, "left_semi").drop("nearness"), large
    shares = done.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.greatest(F.lit(1), F.ceil(F.col("n") / SHARD_ROWS)).cast("long").alias("pieces"))
    shards = done.join(shares, keys).withColumn("piece", F.expr("pmod(k2, pieces)")).dropDuplicates([*keys, "piece", "node"])

    def graph(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        node = np.asarray(table.column("node"))
        order = np.argsort(node, kind="stable")
        x = unit(matrix(table.column("embedding"), dim)[order]).astype(np.float32)
        node = node[order]
        near = build_graph(x)
        back: list[list[int]] = [[] for _ in near]
        for i, a in enumerate(near):
            for j in a[np.argsort(-(x[a] @ x[i]), kind="stable")[:RETURN]]:
                back[j].append(i)
        lists = [node[np.unique(np.concatenate([a, np.array(b, np.int64)]))] for a, b in zip(near, back)]
        return pa.table({"label": table.column("label"), "dim": table.column("dim"), "node": pa.array(node), "near": pa.array(lists, pa.list_(pa.int64()))})

    lists = shards.groupBy("label", "dim", "cluster", "piece").applyInArrow(graph, "label string, dim int, node long, near array<long>")
    united = shared.stored(lists, "lists").groupBy("label", "dim", "node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # OVERLAP lists for each level
    whole = nodes.join(united, ["label", "dim", "node"], "left").withColumn("chunk", F.expr(f"node div {CHUNK}")).select(
        "label", "dim", "chunk", "node", "rep", "copies", "embedding", "near"
    )

    width = "<f8" if dict(nodes.dtypes)["embedding"] == "array<double>" else "<f4"

    def write(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        order = np.argsort(np.asarray(table.column("node")), kind="stable")
        v = matrix(table.column("embedding"), dim)[order]
        lists_ = table.column("near").to_pylist()
        lists_ = [lists_[o] or () for o in order]
        starts = np.cumsum([0, *map(len, lists_)])
        near = np.array([*(j for a in lists_ for j in a), -1], np.int64)  # the last is no entry: an empty file cannot be mapped
        name = uuid.uuid4().hex
        fs, base = shared.open_fs(root)
        fs.create_dir(base, recursive=True)
        for end, a in (("raw", v.astype(width)), ("unit", unit(v).astype("<f4")), ("starts", starts.astype("<i8")), ("near", near.astype("<i8")), ("rep", np.asarray(table.column("rep"))[order].astype("<i8")), ("copies", np.asarray(table.column("copies"))[order].astype("<i8"))):
            with fs.open_output_stream(f"{base}/{name}.{end}") as f:
                f.write(a.tobytes())
        return pa.table({"label": table.column("label").slice(0, 1), "dim": table.column("dim").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "name": pa.array([f"{root}/{name}"])})

    names = shared.stored(whole.groupBy("label", "dim", "chunk").applyInArrow(write, "label string, dim int, chunk long, name string"), "files")
    index: dict = {key: {"n": n, "chunk": CHUNK, "width": width, "files": [], "medoids": []} for key, n in counts.items()}
    for r in sorted(names.collect(), key=lambda r: r["chunk"]):  # a row for each chunk
        index[r["label"], r["dim"]]["files"].append(r["name"])
    for r in medoids:
        index[r["label"], r["dim"]]["medoids"].append(r["medoid"])
    return nodes, index


def link(nodes: DataFrame, index: dict, least: float = LEAST_COSINE) -> DataFrame:
    """(label, dim, node, n_links, partners): verified links of each node, and a forest of its batch's links."""
    spark = nodes.sparkSession
    held = spark.sparkContext.broadcast(index)  # names of chunks and medoids, not vectors
    opened: dict = {}

    def run(batches):
        for b in batches:
            for job in b.to_pylist():
                key = job["label"], job["dim"]
                if key not in opened:
                    opened.clear()
                    f, n = held.value[key]["files"], held.value[key]["n"]
                    opened[key] = [Flat([f"{x}.{end}" for x in f], kind, w, held.value[key]["chunk"], n) for end, kind, w in (("raw", held.value[key]["width"], key[1]), ("unit", "<f4", key[1]), ("rep", "<i8", 0), ("copies", "<i8", 0))]
                    opened[key].append(Lists([f"{x}.starts" for x in f], [f"{x}.near" for x in f], held.value[key]["chunk"]))
                raw, x, rep, copies, table = opened[key]
                medoids = np.unique(np.array(held.value[key]["medoids"], np.int64))
                mid = x[medoids]
                for lo in range(job["lo"], job["hi"], QUERY_BATCH):
                    nodes_ = np.arange(lo, min(lo + QUERY_BATCH, job["hi"]))
                    q = x[nodes_]
                    nearest = medoids[np.argsort(-(q @ mid.T), 1, kind="stable")[:, :4]]
                    start = np.concatenate([nodes_[:, None], nearest], 1)  # a node's own list is a start as well
                    _, found = beam_search(x, table, start, q, in_range=least - SLACK)
                    out = {"node": [], "n_links": [], "rep": [], "partners": []}
                    parent: dict[int, int] = {}

                    def root(i):
                        while parent.setdefault(i, i) != i:
                            parent[i] = parent[parent[i]]
                            i = parent[i]
                        return i

                    for i, ids in zip(nodes_, found):
                        ids = ids[ids != i]
                        if len(ids):
                            ids = ids[unit(raw[ids]) @ unit(raw[np.array([i])])[0] >= least]
                        partners = []
                        for j in ids.tolist():
                            a, z = root(int(i)), root(j)
                            if a != z:
                                parent[z] = a
                                partners.append(int(rep[j]))
                        out["node"].append(int(i))
                        out["n_links"].append(int(copies[ids].sum()) + int(copies[i]) - 1 if len(ids) else int(copies[i]) - 1)
                        out["rep"].append(int(rep[i]))
                        out["partners"].append(partners)
                    yield pa.record_batch([pa.array([key[0]] * len(nodes_), pa.string()), pa.array([key[1]] * len(nodes_), pa.int32()), pa.array(out["node"], pa.int64()), pa.array(out["n_links"], pa.int64()), pa.array(out["rep"], pa.int64()), pa.array(out["partners"], pa.list_(pa.int64()))], names=["label", "dim", "node", "n_links", "rep", "partners"])

    sizes = spark.createDataFrame([(*key, x["n"]) for key, x in index.items()], "label string, dim int, n long")  # a row for each label
    jobs = sizes.select("label", "dim", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(2048).cast("long"))).alias("lo")).withColumn("hi", F.least(F.col("lo") + 2048, "n"))
    tasks = sum(-(-x["n"] // 2048) for x in index.values())
    jobs = jobs.select("label", "dim", "lo", "hi").repartition(max(1, min(tasks, 4096)))
    return jobs.mapInArrow(run, "label string, dim int, node long, n_links long, rep long, partners array<long>")


def recount(nodes: DataFrame, index: dict, least: float = LEAST_COSINE) -> DataFrame:
    """(label, dim, node, n_links) of nodes (label, dim, node, component_id) of components with two nodes or more: each
    node is compared with all of its component, so that counts are whole and symmetric. Members are dealt to blocks of
    some `AGAINST` by a hash; a row is a block against a block, so no row or task holds a component and no pair is a row."""
    keys = ["label", "dim", "component_id"]
    sizes = nodes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    dealt = nodes.join(sizes, keys).withColumn("blocks", F.ceil(F.col("n") / AGAINST)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    blocks = shared.stored(dealt.groupBy(*keys, "block", "blocks").agg(F.collect_list("node").alias("members")), "blocks")
    mine = blocks.select(*keys, F.col("members").alias("some"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    work = mine.join(blocks.select(*keys, "block", "members"), [*keys, "block"]).select("label", "dim", "some", "members")
    held = nodes.sparkSession.sparkContext.broadcast(index)
    opened: dict = {}

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                key = b.column("label")[k].as_py(), b.column("dim")[k].as_py()
                mine, members = (np.asarray(b.column(c)[k].values) for c in ("some", "members"))
                if key not in opened:
                    opened.clear()
                    f, n = held.value[key]["files"], held.value[key]["n"]
                    opened[key] = [Flat([f"{x}.{end}" for x in f], kind, w, held.value[key]["chunk"], n) for end, kind, w in (("raw", held.value[key]["width"], key[1]), ("copies", "<i8", 0))]
                raw, copies = opened[key]
                against, weight = unit(raw[members]).T, np.asarray(copies[members])
                for lo in range(0, len(mine), COMPARED):
                    some = mine[lo : lo + COMPARED]
                    sims = unit(raw[some]) @ against
                    sims[some[:, None] == members] = 1
                    n = (sims >= least) @ weight - np.isin(some, members)  # a node is near itself
                    yield pa.record_batch([pa.array([key[0]] * len(some), pa.string()), pa.array([key[1]] * len(some), pa.int32()), pa.array(some, pa.int64()), pa.array(n, pa.int64())], names=["label", "dim", "node", "n_links"])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = work.repartition(parts).mapInArrow(run, "label string, dim int, node long, n_links long")
    return counted.groupBy("label", "dim", "node").agg(F.sum("n_links").alias("n_links"))


def near_duplicates(rows: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for vectors (vec_id, embedding, label)."""
    rows = rows.select("vec_id", "embedding", "label")
    nodes, index = build_index(rows)
    alone = (F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not index:
        return rows.select("vec_id", *alone)
    linked = shared.stored(link(nodes, index, least), "linked")
    roots = components(linked.select(F.col("rep").alias("a"), F.explode("partners").alias("b")))
    linked = linked.join(roots, linked["rep"] == roots["node"], "left").select("label", "dim", linked["node"], "n_links", F.coalesce("root", "rep").alias("component_id"))
    linked = shared.stored(linked, "rooted")
    whole = recount(linked, index, least).withColumnRenamed("n_links", "whole")
    linked = linked.join(whole, ["label", "dim", "node"], "left").withColumn("n_links", F.coalesce("whole", "n_links")).drop("whole")
    classes = nodes.select("label", "dim", "k1", "k2", "node").join(linked, ["label", "dim", "node"]).select("label", "dim", "k1", "k2", "n_links", "component_id")
    able = usable(rows).select("vec_id", "label", "dim", "k1", "k2").join(classes, ["label", "dim", "k1", "k2"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    keys = F.struct("vec_id", F.col("label").cast("string"), F.xxhash64("embedding", F.lit(1)), F.xxhash64("embedding", F.lit(2)))
    good = usable(rows).select(F.struct("vec_id", "label", "k1", "k2").alias("__key")).distinct()
    rest = rows.withColumn("__key", keys).join(good, "__key", "left_anti")
    return able.unionByName(rest.select("vec_id", *alone))


def audit(rows: DataFrame, found: DataFrame, least: float = LEAST_COSINE, every: int = 20) -> float:
    """Recall: links found over links by brute force, of the vectors whose vec_id is divisible by `every`."""
    nodes = usable(rows)
    queries = nodes.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe"), "label", "dim")
    dot = F.expr("aggregate(zip_with(embedding, qe, (x, y) -> double(x) * double(y)), 0D, (s, v) -> s + v)")
    norm = lambda c: F.expr(f"sqrt(aggregate({c}, 0D, (s, v) -> s + double(v) * double(v)))")
    true = queries.join(nodes, ["label", "dim"]).where("q <> vec_id").where(dot / (norm("embedding") * norm("qe")) >= least).groupBy("q").agg(F.count("*").alias("n"))
    both = true.join(found.select(F.col("vec_id").alias("q"), "n_links"), "q").agg(F.sum("n").alias("n"), F.sum(F.least("n", "n_links")).alias("got")).first()
    return 1.0 if not both["n"] else both["got"] / both["n"]


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT DISTINCT a AS n, a AS m FROM link UNION SELECT r.n, l.b FROM reach r JOIN link l ON l.a = r.m
), low AS (SELECT n, min(m) AS c FROM reach GROUP BY n), deg AS (SELECT a, count(*) AS k FROM link GROUP BY a)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN deg ON a = vec_id LEFT JOIN low ON n = vec_id
"""
