"""What the operators share: tables, stored intermediate results, slices of Arrow batches, words and hashes."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds as arrays at a time.
SLICE_BYTES = 2 << 20
#: Bytes of text in a block and for a bucket of postings, about.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which all executors and the driver share. Where it
    names none, a temporary one if all runs in one process; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='barloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: a short lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Deletes what stored() wrote for frames that nothing reads any more."""
    for df in dfs:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles whose results are stored and whose frames are gone: it does so when the
    driver collects its garbage, which may be long after a large shuffle."""
    for _ in range(2):  # the driver learns of what Python has dropped after a moment
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def bucket_count(docs: DataFrame, text_col: str = "text") -> int:
    """How many buckets postings of the texts are dealt to: as many as there are shuffle partitions, and so many more
    that a bucket stands for BUCKET_BYTES of text at most."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // BUCKET_BYTES))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as compressed bytes, each number's bytes in planes."""
    return zstandard.compress(b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in columns), 3)


def unpack(raw: bytes, *kinds) -> list[np.ndarray]:
    """The columns that pack() was given, of these kinds."""
    plain = np.frombuffer(zstandard.decompress(raw), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(plain) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(plain[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def cuts(values: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each run of equal values."""
    c = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]]).tolist()
    return [(a, b) for a, b in zip(c, c[1:]) if b > a]


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([batch_of(rows, schema)])


def ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def in_blocks(docs: DataFrame, build: Callable[[int, pa.Table], tuple], schema: pa.Schema, ddl: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """A row of schema for each block of rows of docs (doc_id, text) with about limit bytes of text, by build(number of
    the block, its rows). The numbers are unique; a text over limit is a block of its own or ends one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        parts, size = [], 0
        for part in slices(batches):
            parts.append(part)
            size += pc.sum(pc.binary_length(part["text"])).as_py() or 0
            if size >= limit:
                yield batch_of([build(number, pa.Table.from_batches(parts).combine_chunks())], schema)
                number, parts, size = number + 1, [], 0
        if parts:
            yield batch_of([build(number, pa.Table.from_batches(parts).combine_chunks())], schema)

    return docs.mapInArrow(run, ddl)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts have about limit bytes; one longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, batch.num_rows)):
            yield batch.slice(a, b - a)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts in a row, and where each text begins (one more than texts); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(size, out=start[1:])
    joined = b"".join(texts.cast(pa.large_binary()).to_pylist())
    return np.frombuffer(joined, np.uint8), start


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def words(texts: pa.Array, blank: np.ndarray = _BLANK, lower: bool = True) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+, or runs of bytes that blank[byte] doesn't mark, with A-Z in lower case unless told
    otherwise: a code for each word in order, the distinct words, and where each text's words begin (one more than
    texts). Null counts as empty."""
    raw, start = text_bytes(texts)
    inside = ~blank[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = start[:-1][np.diff(start) > 0]
    first[edge] = inside[edge]
    at = np.flatnonzero(first)
    kept = _LOWER[raw[inside]] if lower else raw[inside]
    offset = np.append(np.cumsum(inside)[at] - 1, len(kept)).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offset), pa.py_buffer(kept)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), np.searchsorted(at, start)


def hash64(texts: list[str], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in texts), np.uint64, len(texts))


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of counts, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
