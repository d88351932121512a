"""Helpers that the training-data operators share: the shared folder, written tables, text normal forms."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F become spaces, A-Z become a-z: split() then yields the alphanumeric words.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only a single-process local session may lack that setting; it then gets a folder of its own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        found = sc._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lectern-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


#: The lists of paths of the open `discarded` blocks, the innermost last.
_open: list[list[str]] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_root(spark)}/lectern-{tag}-{uuid.uuid4().hex}"
    for paths in _open[-1:]:
        paths.append(path)
    return path


@contextmanager
def discarded(spark: SparkSession) -> Iterator[list[str]]:
    """Tables and files made in the block go at its end, also after a failure. What is to outlive the block must have
    been written outside its paths by then, as a frame that still reads them could not."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield paths
    finally:
        _open[:] = [p for p in _open if p is not paths]
        for path in paths:
            remove(spark, path)


def stored(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write a table in the shared folder and reread it. This cuts the lineage: a lost executor costs only tasks."""
    path = path or scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's file systems."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI of the shared folder, for code that runs in Python on an executor."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_arrays(uri: str, arrays: dict) -> None:
    """Flat arrays in one file: the length of a JSON header, the header, the arrays from multiples of 8 bytes on."""
    places, at = {}, 0
    for name, a in arrays.items():
        places[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(places).encode()
    head += b" " * (-len(head) % 8)
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


def read_arrays(uri: str) -> dict:
    """The arrays of a file of write_arrays: memory-mapped where the store is a mounted file system, else read."""
    fs, path = open_fs(uri)
    if fs.type_name == "local":
        raw = np.memmap(path, np.uint8, "r")
    else:
        with fs.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    base = 8 + int.from_bytes(raw[:8].tobytes(), "little")
    places = json.loads(raw[8:base].tobytes())
    return {name: raw[base + at : base + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, at) in places.items()}


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of one text column, and one row at least."""
    for batch in batches:
        at, n = 0, batch.num_rows
        per = max(1, int(n * limit / max(1, batch.column(column).nbytes))) if n else 1
        while at < n:
            yield batch.slice(at, per)
            at += per


def map_texts(df: DataFrame, make: Callable, schema: str, limit: int = 1 << 20) -> DataFrame:
    """mapInArrow over batches of about `limit` bytes of text. make(batches) yields dicts of columns or record batches."""
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches):
        for out in make(small_batches(batches, limit=limit)):
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield pa.record_batch([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def ascii_lower(c):
    """A-Z to a-z; no other letter changes."""
    return F.translate(c, UPPER, LOWER)


def id_hash(c):
    """Unsigned crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
