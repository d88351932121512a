"""Operator 1: token-id files, and the piece-cached encoder that operators 1 and 2 use.

A BPE tokenizer never merges across the pieces that its pre-tokenizer cuts. So a text is cut at ASCII white space
into chunks which hold whole pieces, each distinct chunk is encoded once by the tokenizers library and the ids of a
text are the ids of its chunks. Texts where that cut is not provably the pre-tokenizer's (they hold white space
outside ASCII, the separators U+001C to U+001F, or the string of a token added to the vocabulary, such as an end mark,
which the library gives that token's id) are encoded whole.

Texts are encoded where they are read; only their ids are shuffled into the order of doc_id, to ranges whose bounds are
quantiles of doc_id.

Results in special cases. Null and empty texts give the end id alone. A null doc_id sorts first and comes back as
null. Rows with equal doc_id are kept, ordered by their ids. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm import shared

ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: How a text's UTF-8 bytes are cut. "byte": one space may lead a chunk, runs of white space stand alone but for their
#: last character, as the byte-level pre-tokenizer has it. "word": white space only parts the chunks, and A-Z are
#: lowered first, as that tokenizer does. In both, a run of letters and digits whose last is ASCII ends a chunk.
CHUNKS = {
    "byte": re.compile(rb" ?[0-9A-Za-z\x80-\xff]*[0-9A-Za-z](?![0-9A-Za-z\x80-\xff])| ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]").findall,
    "word": re.compile(rb"[0-9A-Za-z\x80-\xff]*[0-9A-Za-z](?![0-9A-Za-z\x80-\xff])|[^\t-\r ]+").findall,
}
NULL_ID = -(1 << 63)
#: The printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stands for itself, the other
#: bytes in order for U+0100 and up.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: b if b in _PRINTABLE else 0x100 + i for i, b in enumerate([*_PRINTABLE, *sorted({*range(256)} - {*_PRINTABLE})], -len(_PRINTABLE))}


class PieceEncoder(dict):
    """Encodes texts to little-endian unsigned ids. The dict holds the ids of chunks seen before, in two generations:
    once the young one is full it becomes the old one, and what is then used again comes back."""

    def __init__(self, path: str, style: str, keep: int = 150_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added), re.IGNORECASE).search if added else lambda text: None
        self.style, self.cut, self.keep = style, CHUNKS[style], keep
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.old: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            text = chunk.decode()
            if self.style == "word":
                text = text.lower()
            letters = text[1:] if text[0] == " " else text
            if letters.isalpha() and max(letters) < "\u0250":  # one piece, in normal form: the model's part alone
                stand_ins = text.encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = np.array([t.id for t in self.model.tokenize(stand_ins)], self.dtype).tobytes()
            else:
                ids = self.whole(chunk.decode())
        self[chunk] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of self.dtype."""
        cut, get, lower, out = self.cut, self.__getitem__, self.style == "word", []
        for t in texts:
            if len(self) > self.keep:
                self.old = dict(self)
                self.clear()
            raw = (t or "").encode()
            out.append(self.whole(t) if t and (ODD_SPACE.search(t) or self.added(t)) else b"".join(map(get, cut(raw.lower() if lower else raw))))
        return out


_encoders: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, style: str) -> PieceEncoder:
    """One encoder for each Python worker; workers outlive tasks, and so does the cache."""
    if (path, style) not in _encoders:
        _encoders[path, style] = PieceEncoder(path, style)
    return _encoders[path, style]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str = "byte_bpe_50k.json", style: str = "byte", end_id: int = 2) -> DataFrame:
    """Encode documents (doc_id, text) in ascending doc_id order into files under `path`; return their manifest.

    Each partition writes three flat little-endian files: `.ids` (unsigned ids of the narrowest of 16 and 32 bits
    that holds the vocabulary), `.off` (n + 1 unsigned 64-bit offsets of its documents in `.ids`) and `.doc` (signed
    64-bit doc_ids). The manifest has a row per partition: part, file, width, n_docs, n_tokens and base, the ids in
    all earlier partitions, a prefix sum over the partitions' totals. A task that is run again writes files of
    another name; only files of tasks whose row was committed are in the manifest."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx("doc_id", [k / tasks for k in range(1, tasks)] or [0.5], 100 * tasks)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    def encode(batches):
        enc = encoder(tokenizer_path(tokenizer), style)
        for b in batches:
            at = np.searchsorted(bounds, np.asarray(b.column("doc_id").fill_null(NULL_ID)), "left")
            yield {"part": at, "doc_id": b.column("doc_id"), "ids": enc.encode(b.column("text").to_pylist()), "width": [enc.dtype.itemsize] * b.num_rows}

    def write(batches):
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, base = shared.open_fs(path)
        total = n = width = 0
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{name}.ids") as ids, fs.open_output_stream(f"{base}/{name}.off") as off, fs.open_output_stream(f"{base}/{name}.doc") as doc:
            off.write(np.zeros(1, "<u8").tobytes())
            for b in shared.small_batches(batches, "ids"):
                if not b.num_rows:
                    continue
                width = b.column("width")[0].as_py()
                end = np.array([end_id], f"<u{width}").tobytes()
                found = b.column("ids").to_pylist()
                ids.write(b"".join(x for f in found for x in (f, end)))
                sizes = np.array([len(f) // width + 1 for f in found], np.int64)
                off.write((total + np.cumsum(sizes)).astype("<u8").tobytes())
                doc.write(np.asarray(b.column("doc_id").fill_null(NULL_ID)).astype("<i8").tobytes())
                total, n = total + int(sizes.sum()), n + len(sizes)
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "width": pa.array([width], pa.int32()), "n_docs": [n], "n_tokens": [total]})

    encoded = shared.map_texts(docs.select("doc_id", "text"), encode, "part int, doc_id long, ids binary, width int")
    ordered = encoded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids").select("doc_id", "ids", "width")
    parts = shared.stored(ordered.mapInArrow(write, "part int, file string, width int, n_docs long, n_tokens long"), "parts")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition, not for each document
    manifest = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def mapped(uri: str, dtype: str):
    """A flat file as an array: memory-mapped where the store is a mounted file system, else read."""
    fs, path = shared.open_fs(uri)
    if fs.type_name == "local":
        return np.memmap(path, dtype, "r") if fs.get_file_info(path).size else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """Read the files of `path` back: doc_id, start, n_tokens, ids_crc32, and the ids themselves on request."""
    manifest = spark.read.parquet(f"{path}/manifest")
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                stem = f"{path}/{row['file']}"
                ids, off, doc = mapped(f"{stem}.ids", f"<u{row['width']}"), mapped(f"{stem}.off", "<u8").astype(np.int64), mapped(f"{stem}.doc", "<i8")
                for at in range(0, row["n_docs"], 1024):
                    cut = off[at : min(at + 1025, row["n_docs"] + 1)]
                    wide = [np.asarray(ids[a:z]).astype("<u4") for a, z in zip(cut, cut[1:])]
                    names = np.asarray(doc[at : at + len(wide)])
                    out = [pa.array(names, pa.int64(), mask=names == NULL_ID), pa.array(cut[:-1] + row["base"]), pa.array(np.diff(cut)), pa.array([zlib.crc32(x.tobytes()) for x in wide], pa.int64())]
                    if with_ids:
                        out.append(pa.array([x.astype(np.int32) for x in wide], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(out, names=[k.split()[0] for k in kinds.split(", ")])

    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), manifest.count()))
    return manifest.repartition(tasks).mapInArrow(read, kinds)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.scratch(spark, "tokens")
    write_token_files(shared.table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
