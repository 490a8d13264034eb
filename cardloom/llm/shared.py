"""Written intermediate tables, and word hashing in numpy over Arrow buffers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_MADE: list[str] = []  # folders that this process has made, as long as they are there


def workspace(spark: SparkSession) -> str:
    """A new folder name under the shared folder of the cluster (spark.checkpoint.dir).

    A folder of this machine is used only where the session names none and runs on this machine alone, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cardloom-"))
        base = spark.sparkContext.getCheckpointDir()
    _MADE.append(f"{base.rstrip('/')}/cardloom-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Delete the folders and tables of all operators that this process has run, unless keep reads one of their files.

    Results that weren't written elsewhere can't be read afterwards.
    """
    read = keep.inputFiles() if keep is not None else []
    for folder in list(_MADE):
        name = folder.rsplit("/", 1)[1]
        if not any(name in f for f in read):
            drop_path(spark, folder)
            _MADE.remove(folder)
            for table in spark.sql("SHOW TABLES").where(F.col("tableName").endswith(name.removeprefix("cardloom-"))).collect():
                spark.sql(f"DROP TABLE IF EXISTS {table.tableName}")


def table_of(folder: str, kind: str) -> str:
    """The name of a table in a workspace; clear() knows it by the folder's number."""
    return f"cardloom_{kind}_{folder.rsplit('-', 1)[1]}"


def written(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table at path, read again: a lost executor then costs a read, not the whole lineage."""
    spark = df.sparkSession
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of finished steps; it acts when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table by way of Spark's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def trimmed(run):
    """A function over batches that gives a worker's free memory back when it ends; the next stage may need it."""

    def work(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return work


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- hashing

U = np.uint64
BYTE_BASE, WORD_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)  # odd, so that they have an inverse modulo 2**64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    had = _POWERS.get(int(base))
    if had is None or len(had[0]) < n:
        n = max(n, 1 << 16)
        n = 1 << (n - 1).bit_length()
        inverse = U(pow(int(base), -1, 1 << 64))
        up, down = np.full(n, base, U), np.full(n, inverse, U)
        up[0] = down[0] = 1
        had = _POWERS[int(base)] = (np.cumprod(up), np.cumprod(down))
    return had


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def prefix_sums(h: np.ndarray, base: np.uint64) -> np.ndarray:
    """sums[j] - sums[i], times base**-i, identifies h[i:j]."""
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * powers(base, len(h) + 1)[0][: len(h)], out=sums[1:])
    return sums


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """A 64-bit hash of each h[start:end] below the prefix sums; the length is part of it."""
    down = powers(base, len(sums))[1]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of some texts: where they stand in data, their hashes, and the first word of each text."""

    __slots__ = ("data", "start", "end", "hash", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        if lower:
            data = LOWER[data]
        space = SPACES[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # texts stand side by side without a gap
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:] = space[:-1] | edge[1:-1]
        after[:-1] = space[1:] | edge[1:-1]
        if len(data):
            before[0] = after[-1] = True
        self.data = data
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        sums = prefix_sums(data.astype(U) + U(1), BYTE_BASE)
        self.hash = spans(sums, self.start, self.end, BYTE_BASE)
        self.first = np.searchsorted(self.start, offsets)

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all k consecutive words, also across texts; see texts()."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, U)
        i = np.arange(n)
        return spans(prefix_sums(self.hash, WORD_BASE), i, i + k, WORD_BASE)

    def texts(self) -> np.ndarray:
        """The number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of texts of about ``most`` bytes each, so that temporary arrays stay in the caches."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed byte planes."""
    n = len(arrays[0])
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(n, a.itemsize).T.tobytes() for a in arrays)
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, found = len(planes) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        found.append(np.ascontiguousarray(planes[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return found


def runs(*keys: np.ndarray) -> np.ndarray:
    """True where sorted keys differ from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new
