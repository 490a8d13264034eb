"""Sharding by a keyed permutation of global row numbers.

Rows get numbers 0 .. N-1 in the order of doc_id. A Feistel network over a rectangle a * b >= N permutes the numbers;
values that fall outside 0 .. N-1 are fed in again (cycle walking), which keeps it a permutation of 0 .. N-1. The
image p of a row gives its place: shard = p mod S, slot = p div S. Anyone who knows (seed, N, S) can compute the place
of a row from its number, or by the inverse network the row at a place, without reading the data.

Counts of shards differ by one at most and slots have no gaps, as p runs through 0 .. N-1.

Row numbers need no global sort into one task: ids are dealt by range, each range is numbered by itself, and the
counts of the ranges (one row for each partition) give its first number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shuffle_partitions, workspace, written

ROUNDS = 6


def _round(r: np.ndarray, key: int, size: int) -> np.ndarray:
    """A pseudo-random value below size of each r; r is below 2**31."""
    h = r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return (h % np.uint64(size)).astype(np.int64)


def _sides(n: int) -> tuple[int, int]:
    a = max(1, int(np.ceil(np.sqrt(n))))
    while a * a < n:
        a += 1
    return a, max(1, -(-n // a))


def _keys(seed: int) -> list[int]:
    state, keys = seed & (2**64 - 1), []
    for _ in range(ROUNDS):
        state = (state + 0x9E3779B97F4A7C15) & (2**64 - 1)
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        keys.append(((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1))
    return keys


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The image of each x in 0 .. n-1; a permutation of 0 .. n-1."""
    a, b = _sides(n)

    def network(v: np.ndarray) -> np.ndarray:
        left, right = v // b, v % b  # left < a, right < b
        for i, key in enumerate(_keys(seed)):
            if i % 2 == 0:
                left = (left + _round(right, key, a)) % a
            else:
                right = (right + _round(left, key, b)) % b
        return left * b + right

    return _walk(network, x, n)


def unpermute(y: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The inverse of permute."""
    a, b = _sides(n)

    def network(v: np.ndarray) -> np.ndarray:
        left, right = v // b, v % b
        for i, key in reversed(list(enumerate(_keys(seed)))):
            if i % 2 == 0:
                left = (left - _round(right, key, a)) % a
            else:
                right = (right - _round(left, key, b)) % b
        return left * b + right

    return _walk(network, y, n)


def _walk(network, x: np.ndarray, n: int) -> np.ndarray:
    found = network(np.asarray(x, np.int64))
    while (out := found >= n).any():
        found[out] = network(found[out])
    return found


def row_numbers(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """df with numbers 0 .. N-1 in the given order, and N as ``n_rows``.

    The order must decide between all different rows; equal rows may swap, which no result can show. df is dealt by
    range and written once, so that a repeated task sees the same ranges.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, workspace(spark))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each partition: at most as many as there are shuffle partitions
    first = counts.select(
        "_part",
        F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"),
        F.sum("_n").over(Window.partitionBy()).alias("n_rows"),
    )
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_at", within).join(F.broadcast(first), "_part").withColumn(name, (F.col("_first") + F.col("_at")).cast("long")).drop("_part", "_at", "_first")


def shard(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, row_no, shard and slot of every row; extra columns are left out.

    A null text has size 16 and the checksum of the empty text. A null doc_id comes first in the order. Rows that
    agree in doc_id are ordered by text and stay separate rows. No rows give no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered = row_numbers(slim, [F.col("doc_id"), F.col("size"), F.col("text_crc32")])

    @F.pandas_udf("long")
    def place(row_no: pd.Series, n_rows: pd.Series) -> pd.Series:
        if not len(row_no):
            return row_no
        return pd.Series(permute(row_no.to_numpy(), int(n_rows.iloc[0]), seed))

    at = numbered.withColumn("_place", place("row_no", "n_rows"))
    return at.select("doc_id", "size", "text_crc32", "row_no", (F.col("_place") % shards).cast("int").alias("shard"), F.floor(F.col("_place") / shards).cast("long").alias("slot"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")
