"""Helpers that the text operators share: scratch tables, vectorised words, packed shuffles."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20  # text worked on at once inside a task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that the session names; a temporary one only where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, quick: bool = False) -> DataFrame:
    """The frame written to the shared folder and read again: its lineage ends here. quick: less CPU for more disk, for a wide table of values that seldom repeat."""
    spark = df.sparkSession
    path = scratch(spark)
    w = df.write.option("compression", "snappy").option("parquet.enable.dictionary", "false") if quick else df.write.option("compression", "zstd")
    w.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes the tables of frames that `stored` gave and that no later result reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores after it as long as the frame has such a column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def bounded_broadcast(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """Broadcast hint for a narrow frame of a counted size; beyond the bound the join shuffles."""
    return F.broadcast(df) if rows <= most else df


def crc_mod(id_col: Column, n: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % n


def input_mb(df: DataFrame) -> float:
    """Bytes of the frame's input as the optimizer estimates them, in MB."""
    return float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString()) / 1e6


# ---- words of many texts at once ------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _byte_values(fold: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if fold:
        v[65:91] = v[97:123]
    return v


def separators(extra: bytes = b"") -> np.ndarray:
    sep = np.zeros(256, bool)
    sep[[0x20, *range(0x09, 0x0E), *extra]] = True
    return sep


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _CACHE.get("pow")
    if have is None or len(have[0]) < n:
        m = max(n, CHUNK_BYTES + 1)
        p, q = np.full(m, _P, np.uint64), np.full(m, _PINV, np.uint64)
        p[0] = q[0] = 1
        have = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
        if m <= 4 * CHUNK_BYTES:
            _CACHE["pow"] = have
    return have


_CACHE: dict = {}


class Words:
    """Words of a run of texts. hash: 64 bits a word; bounds: word index at which each text begins (n + 1 entries)."""

    def __init__(self, texts: pa.Array, fold: bool = True, extra: bytes = b""):
        self.bytes, self.offsets = utf8(texts)
        b, off = self.bytes, self.offsets
        n = len(b)
        sep = separators(extra)[b]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.ones(n + 1, bool)
        before[1:] = sep
        before |= edge
        self.starts = np.flatnonzero(~sep & before[:-1])
        after = np.ones(n + 1, bool)
        after[:-1] = sep
        after |= edge
        self.ends = np.flatnonzero(~sep & after[1:]) + 1
        p, q = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_byte_values(fold)[b] * p[:n], out=total[1:])
        self.hash = mix((total[self.ends] - total[self.starts]) * q[self.starts])
        self.bounds = np.searchsorted(self.starts, off)

    def shingles(self, k: int) -> list[np.ndarray]:
        """For each text its distinct k-word shingles, sorted; a shorter text is one shingle; no word, none."""
        w, b = self.hash, self.bounds
        h = np.full(max(0, len(w) - k + 1), k, np.uint64)
        for i in range(k):
            h = mix(h * np.uint64(_P) + w[i : i + len(h)])
        return [np.unique(h[b[i] : b[i + 1] - k + 1]) if b[i + 1] - b[i] >= k else shingle_hashes(w[b[i] : b[i + 1]], k) for i in range(len(b) - 1)]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and where each begins; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    off = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return all_bytes[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about `most` bytes of text, one text at least; no text is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def shingle_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingles of one text, sorted; a shorter text is one shingle; no word, none."""
    n = len(w)
    if not n:
        return w[:0]
    m = n - k + 1
    if m <= 0:
        k, m = n, 1
    h = np.full(m, k, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(_P) + w[i : i + m])
    return np.unique(h)


# ---- shuffles of packed arrays ---------------------------------------------------------------


def pack_columns(records: np.ndarray) -> bytes:
    """Field after field, so that a compressor finds the runs of sorted fields."""
    return b"".join(records[f].tobytes() for f in records.dtype.names)


def unpack_columns(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    out = np.empty(sum(len(b) for b in blobs) // dtype.itemsize, dtype)
    at = 0
    for b in blobs:
        n, skip = len(b) // dtype.itemsize, 0
        for f in dtype.names:
            out[f][at : at + n] = np.frombuffer(b, dtype[f], n, skip)
            skip += n * dtype[f].itemsize
        at += n
    return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys // np.uint64((1 << 64) // shards + 1)).astype(np.int32)


def packed_pieces(at: np.ndarray, records: np.ndarray, shards: int) -> pa.RecordBatch:
    """One row (shard, data) for each shard that has records."""
    order = np.argsort(at, kind="stable")
    records = records[order]
    cut = np.searchsorted(at[order], np.arange(shards + 1))
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_pydict({"shard": pa.array(full, pa.int32()), "data": pa.array([pack_columns(records[cut[i] : cut[i + 1]]) for i in full], pa.binary())})


def packed_reduce(df: DataFrame, pack: Callable, merge: Callable, schema: str, shards: int, numbers: int = 0) -> DataFrame:
    """Shuffles packed arrays instead of one Spark row for each record.

    pack(batches) yields (shard of each record, records); the records of one shard become one row. Shards are
    numbered below `numbers`, which is `shards` if not given.
    merge(shard, records' bytes) yields Arrow batches of `schema`, one at least. pack sums a key's records beforehand, so
    that a hot key brings one record from each task.
    """

    def out(batches):
        for at, records in pack(batches):
            yield packed_pieces(at, records, numbers or shards)

    def one(key, rows):
        return pa.Table.from_batches(merge(key[0].as_py(), rows.column("data").to_pylist()))

    return df.mapInArrow(out, "shard int, data binary").groupBy("shard").applyInArrow(one, schema)


def local_path(uri: str) -> str | None:
    """The path of a file URI; None for another store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def put_bytes(uri: str, data: bytes | memoryview) -> None:
    """Written beside and then moved: a task that runs twice leaves one whole file."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    with where.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
        f.write(data)
    where.move(part, path)


def mapped(uri: str, dtype) -> np.ndarray:
    """A memory-mapped array of the shared folder; from a store without local paths it is fetched first."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        where, there = fs.FileSystem.from_uri(uri)
        with where.open_input_stream(there) as f, tempfile.NamedTemporaryFile() as t:
            while block := f.read(1 << 22):
                t.write(block)
            t.flush()
            return np.memmap(t.name, dtype, "r") if os.path.getsize(t.name) else np.zeros(0, dtype)
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
