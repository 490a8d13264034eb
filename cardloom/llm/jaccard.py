"""Exact n-gram Jaccard join with set-relation skipping.

Sets of shingles are held as sorted 64-bit hashes. A class is all documents with one set. The join works on classes:

1. Sieve. In the order of hashes each set's prefix of n - ceil(t n) + l tokens must share l tokens with the prefix of
   any set that it links with (t the threshold, l a tenth of the set). Classes that share fewer with all others
   together are out. Counts suffice for this: tokens common in a task are counted there and leave a mark only.
2. Index. Over what is left, tokens that HOT sets or more hold go to the end of the order, and new prefixes make lists
   of (token, set, size, position). Lists of fewer than HOT sets give pairs directly. A pair is skipped if its sizes or
   positions rule it out, or if it shares fewer than l prefix tokens over all its lists (if it shares a hot token, the
   long lists answer for it).
3. Long lists. Each round compares a list's sets with one hub. By the triangle inequality of Jaccard distance a set
   within the threshold of the hub (its ball) links with none further than twice the threshold distance. Sets that
   are further, but share much with the hub (its ring, RING per cent and more), are answered incrementally from what is known about the hub: |x & z| follows from the
   differences x - h, h - x, z - h, h - z alone. The ball then leaves the list, and ring members need no more
   comparisons with each other.
4. Combinations. What is left after ROUNDS rounds are sets of the same common passages in other mixes. Tokens that
   the same sets hold make a group, so a set is a few weighted groups. Of groups in one order, from rare to common,
   a set's prefix of level r is the shortest that weighs more than the set may lose even if its r - 1 heaviest groups
   are shared: sets that link share r groups of both prefixes. Lists of combinations of r groups are short where lists
   of tokens are long. A set's own level is the highest with MOST combinations or fewer; a pair meets at the lower one
   of its two levels. Pairs that earlier links join already are left out.

Sets are sent to comparisons only, once for each hub or partner; hot hubs are salted.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import U, Words, drop_path, mix, pack, release, runs, shuffle_partitions, slices, table_of, text_buffers, trimmed, unpack, workspace, written

SHINGLE, THRESHOLD = 4, 85  # words; per cent
HOT, ROUNDS, FLUSH = 32, 8, 1 << 19
SPLIT = 4  # buckets that a task works on, one after the other
MOST_BROADCAST = 2_000_000  # rows of 24 bytes; more are joined by a shuffle
BLOCK, TARGETS = 500, 8000  # sets that are compared with one hub in one task; targets of a ring's task
RING = 40  # per cent: sets as similar to a hub as this are answered from their differences to it
LEVEL, MOST = 5, 128  # groups in a combination, and combinations of a set's own level, at most


def least_overlap(n):
    """ceil(t n), the least overlap of a set of n with any set that it links with."""
    return (THRESHOLD * n + 99) // 100


def prefix_length(n, extra):
    return n - least_overlap(n) + extra


def extra_of(n):
    return np.maximum(1, n // 10)


def shingle_sets(words: Words, k: int):
    """The sorted distinct shingle hashes of all texts one after the other, and where each text's begin."""
    n_texts = len(words.first) - 1
    text = words.texts()
    count = np.diff(words.first)
    parts, owners = [], []
    g = words.grams(k)
    if len(g):
        inside = text[: len(g)] == text[k - 1 :]
        parts.append(g[inside])
        owners.append(text[: len(g)][inside])
    for m in range(1, k):  # fewer words than k: the whole sequence is the one shingle
        short = np.flatnonzero(count == m)
        if len(short):
            parts.append(words.grams(m)[words.first[short]])
            owners.append(short)
    if not parts:
        return np.zeros(0, U), np.zeros(n_texts + 1, np.int64)
    h, own = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = runs(h, own)
    h, own = h[new], own[new]
    return h, np.searchsorted(own, np.arange(n_texts + 1))


def set_ids(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set: a sum of mixed tokens, mixed with the size. 0 for the empty set."""
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)), out=sums[1:])
    n = np.diff(edge)
    ids = mix(sums[edge[1:]] - sums[edge[:-1]] + n.astype(U) * U(0x9E3779B97F4A7C15))
    ids[n == 0] = 0
    return ids


def _ranks(edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and position of each token."""
    n = np.diff(edge)
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(edge[-1]) - edge[own] if len(own) else np.zeros(0, np.int64)


def _sets_of(batch: pa.RecordBatch, at: int, k: int):
    data, offsets = text_buffers(batch.column(at))
    for i, j in slices(offsets):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], True)
        yield i, j, *shingle_sets(words, k)


def _bucket(token: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(token.copy()) % U(buckets)).astype(np.int64)


def _blobs(bucket: np.ndarray, *cols):
    order = np.argsort(bucket, kind="stable")
    bucket, cols = bucket[order], [c[order] for c in cols]
    start = np.flatnonzero(runs(bucket)) if len(bucket) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(bucket))
    return bucket[start], [pack(*[c[i:j] for c in cols]) for i, j in zip(start, end, strict=True)]


def _by_bucket(rows: DataFrame, buckets: int, kinds: tuple, out, schema: str) -> DataFrame:
    """out(columns of the bucket, its marks) for each bucket; rows: bucket, blob, mark (one of the two null)."""

    def run(batches):
        bucket, blobs, marks = None, [], []

        def done():
            if blobs:
                yield from out([np.concatenate(c) for c in zip(*[unpack(b, *kinds) for b in blobs], strict=True)], np.array(sorted(set(marks)), np.int64).view(U))

        for b in batches:
            for k, blob, mark in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if k != bucket:
                    yield from done()
                    bucket, blobs, marks = k, [], []
                blobs.append(blob) if blob is not None else marks.append(mark)
        yield from done()

    return rows.select("bucket", "blob", "mark").repartition(buckets // SPLIT, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(run), schema)


def _part(sid: np.ndarray, parts: int) -> np.ndarray:
    return (mix(sid ^ U(0x632BE59BD9B4E019)) % U(parts)).astype(np.int64)


def _with_part(parts: int):
    """Rows that begin with sid, with the number of their part before it."""

    def run(batches):
        for b in batches:
            part = _part(b.column(0).to_numpy().view(U), parts)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *b.columns], names=["part", *b.schema.names])

    return run


def _record(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(cols)


class JaccardJoin:
    """Links between the documents of one table; see link_classes()."""

    def __init__(self, docs: DataFrame, k: int = SHINGLE):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.k, self.parts, self.folder, self.steps = k, shuffle_partitions(self.spark), workspace(docs.sparkSession), 0
        self.buckets = SPLIT * self.parts

    def _write(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self.steps += 1
        return written(df, f"{self.folder}/{self.steps}", partition_by)

    def _drop(self, *steps: int | str) -> None:
        """Delete written steps that nothing reads any more."""
        for step in steps:
            drop_path(self.spark, f"{self.folder}/{step}")

    # ------------------------------------------------------------ 1. sieve

    def sieve(self) -> tuple[DataFrame, DataFrame]:
        """documents (doc_id, n, sid) and the classes that are left (sid, n, rep, pri)."""
        k, buckets = self.k, self.buckets
        schema = "kind int, doc_id long, n int, sid long, bucket int, mark long, blob binary"

        def row(kind, size, /, **have):
            kinds = {"kind": pa.int32(), "doc_id": pa.int64(), "n": pa.int32(), "sid": pa.int64(), "bucket": pa.int32(), "mark": pa.int64(), "blob": pa.binary()}
            have["kind"] = np.full(size, kind, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(have[c], t) if c in have else pa.nulls(size, t) for c, t in kinds.items()], names=list(kinds))

        def scan(batches):
            parts, size = [], 0

            def flush():
                token, sid = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.lexsort((sid, token))
                token, sid = token[order], sid[order]
                new = runs(token, sid)  # equal sets of a task count once
                token, sid = token[new], sid[new]
                start = np.flatnonzero(runs(token))
                many = np.repeat(np.diff(np.append(start, len(token))) >= HOT, np.diff(np.append(start, len(token))))
                if many.any():
                    marks = np.unique(token[many])
                    yield row(2, len(marks), bucket=_bucket(marks, buckets).astype(np.int32), mark=marks.view(np.int64))
                    ids, n = np.unique(sid[many], return_counts=True)
                    yield row(3, len(ids), sid=ids.view(np.int64), n=n.astype(np.int32))
                    token, sid = token[~many], sid[~many]
                bucket, blobs = _blobs(_bucket(token, buckets), token, sid)
                yield row(1, len(blobs), bucket=bucket.astype(np.int32), blob=blobs)

            for b in batches:
                for i, j, h, edge in _sets_of(b, 1, k):
                    n, sid = np.diff(edge), set_ids(h, edge)
                    yield row(0, j - i, doc_id=b.column(0).slice(i, j - i), n=n.astype(np.int32), sid=sid.view(np.int64))
                    own, pos = _ranks(edge)
                    inside = pos < prefix_length(n, extra_of(n))[own]
                    parts.append((h[inside], sid[own[inside]]))
                    size += int(inside.sum())
                    if size >= FLUSH:
                        yield from flush()
                        parts, size = [], 0
            if size:
                yield from flush()

        made = self._write(self.docs.mapInArrow(trimmed(scan), schema), "kind")
        own = made.where("kind = 0").select("doc_id", "n", "sid")

        def count(cols, marks):
            token, sid = cols
            order = np.lexsort((sid, token))
            token, sid = token[order], sid[order]
            new = runs(token, sid)
            token, sid = token[new], sid[new]
            start = np.flatnonzero(runs(token))
            size = np.diff(np.append(start, len(token)))
            shared = np.repeat((size > 1) | np.isin(token[start], marks), size)
            ids, n = np.unique(sid[shared], return_counts=True)
            if len(ids):
                yield _record(sid=pa.array(ids.view(np.int64)), n=pa.array(n.astype(np.int32)))

        counts = _by_bucket(made.where("kind in (1, 2)"), buckets, ("<u8", "<u8"), count, "sid long, n int")
        counts = counts.unionByName(made.where("kind = 3").select("sid", "n")).groupBy("sid").agg(F.sum("n").alias("shared"))
        classes = own.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
        least = F.expr(f"greatest(1, (({THRESHOLD} * n + 99) div 100) div 10)")
        left = self._write(classes.join(counts, "sid").where(F.col("shared") >= least).select("sid", "n", "rep", "shared"))
        self._drop("1/kind=1", "1/kind=2", "1/kind=3")
        return own, left

    # ------------------------------------------------------------ 2. index

    def sets(self, left: DataFrame) -> DataFrame:
        """sid, n, shared and tokens of the classes that are left, one row each, bucketed by sid.

        The texts are read again. The classes' ids are broadcast if they are MOST_BROADCAST or fewer, so that the other
        texts aren't shuffled; more are joined by a shuffle.
        """
        k = self.k
        reps = left.select("rep", F.col("sid").alias("_sid"), "shared")
        reps = F.broadcast(reps) if reps.count() <= MOST_BROADCAST else reps
        # a class's texts are those of its representative; rows that share its doc_id but not its set are left out
        hits = self.docs.join(reps, F.col("doc_id") == F.col("rep")).select("text", "_sid", "shared")

        def run(batches):
            seen = set()  # repeated rows of a task give one set
            for b in batches:
                want, shared = b.column(1).to_numpy(), b.column(2).to_numpy()
                for i, j, h, edge in _sets_of(b, 0, k):
                    sid, new = set_ids(h, edge).view(np.int64), []
                    for x in np.flatnonzero(sid == want[i:j]).tolist():
                        if (s := int(sid[x])) not in seen:
                            seen.add(s)
                            new.append(x)
                    yield _record(sid=pa.array(sid[new], pa.int64()), n=pa.array(np.diff(edge)[new].astype(np.int32)), shared=pa.array(shared[i:j][new]), tokens=pa.array([h[edge[x] : edge[x + 1]].tobytes() for x in new], pa.binary()))

        made = hits.mapInArrow(trimmed(run), "sid long, n int, shared long, tokens binary")
        self.table = table_of(self.folder, "sets")
        made = made.repartition(self.parts, "sid").dropDuplicates(["sid"])
        made.write.bucketBy(self.parts, "sid").option("compression", "zstd").option("path", f"{self.folder}/sets").saveAsTable(self.table)
        release(self.spark)
        return self.spark.table(self.table)

    def _by_token(self, sets: DataFrame, out, schema: str) -> DataFrame:
        """out(tokens and sids of a bucket) for each bucket of tokens; sets: sid, n, tokens."""
        buckets = self.buckets

        def scan(batches):
            parts, size = [], 0

            def flush():
                token, sid = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.argsort(token)
                token, sid = token[order], sid[order]
                bucket, blobs = _blobs(_bucket(token, buckets), token, sid)
                yield _record(bucket=pa.array(bucket.astype(np.int32)), blob=pa.array(blobs, pa.binary()), mark=pa.nulls(len(blobs), pa.int64()))

            for b in batches:
                sid = b.column(0).to_numpy().view(U)
                data, offsets = _binary(b.column(2))
                for i, j in slices(offsets, 8 * FLUSH):
                    parts.append((data[offsets[i] : offsets[j]].view(U), np.repeat(sid[i:j], np.diff(offsets[i : j + 1]) // 8)))
                    size += len(parts[-1][0])
                    if size >= FLUSH:
                        yield from flush()
                        parts, size = [], 0
            if size:
                yield from flush()

        flat = sets.select("sid", "n", "tokens").mapInArrow(trimmed(scan), "bucket int, blob binary, mark long")
        return _by_bucket(flat, buckets, ("<u8", "<u8"), out, schema)

    def lists(self, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs from short lists (a, b) and the entries of long ones (token, sid, n, pri)."""
        buckets, parts = self.buckets, self.parts

        def hot(cols, marks):
            token, sid = cols
            order = np.lexsort((sid, token))
            token, sid = token[order], sid[order]
            start = np.flatnonzero(runs(token))
            size = np.diff(np.append(start, len(token)))
            df = np.repeat(size, size)
            at = df >= HOT
            if at.any():
                # a blob for each part of the sets, not a row for each set: a bucket's answer is as many rows at most
                to, blobs = _blobs(_part(sid[at], parts), token[at], sid[at], np.log2(df[at]).astype(np.uint8))
                yield _record(part=pa.array(to.astype(np.int32)), blob=pa.array(blobs, pa.binary()))

        common = self._write(self._by_token(sets, hot, "part int, blob binary"))
        own = sets.select("sid", "n", "tokens", "shared").mapInArrow(_with_part(parts), "part int, sid long, n int, tokens binary, shared long")
        rows = common.select("part", F.lit(0).alias("role"), "blob", *[F.lit(None).cast(t).alias(c) for c, t in (("sid", "long"), ("n", "int"), ("shared", "long"))])
        rows = rows.unionByName(own.select("part", F.lit(1).alias("role"), F.col("tokens").alias("blob"), "sid", "n", "shared"))
        rows = rows.repartition(parts, "part").sortWithinPartitions("part", "role").select("part", "role", "blob", "sid", "n", "shared")

        def index(batches):
            cols, size, at, gathered, known = [], 0, None, [], None
            none = np.zeros(0, U)

            def flush():
                token, sid, n, pos = (np.concatenate(c) for c in zip(*cols, strict=True))
                bucket, blobs = _blobs(_bucket(token, buckets), token, sid, n, pos)
                yield _record(bucket=pa.array(bucket.astype(np.int32)), blob=pa.array(blobs, pa.binary()), token=pa.nulls(len(blobs), pa.int64()), sid=pa.nulls(len(blobs), pa.int64()), n=pa.nulls(len(blobs), pa.int32()), pri=pa.nulls(len(blobs), pa.int64()))

            def by_set():
                if not gathered:
                    return none, none, np.zeros(0, np.uint8)
                token, sid, level = (np.concatenate(c) for c in zip(*[unpack(x, "<u8", "<u8", "u1") for x in gathered], strict=True))
                order = np.lexsort((token, sid))
                return token[order], sid[order], level[order]

            for b in batches:
                hot_out = [[], [], [], []]
                for part, role, blob, sid, n, shared in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                    if part != at:
                        at, gathered, known = part, [], None
                    if not role:
                        gathered.append(blob)
                        continue
                    if known is None:
                        known, gathered = by_set(), []
                    token = np.frombuffer(blob, U)
                    p = int(prefix_length(n, int(extra_of(n))))
                    level = np.zeros(n, np.uint8)
                    me = np.int64(sid).view(U)
                    i, j = np.searchsorted(known[1], me), np.searchsorted(known[1], me, side="right")
                    level[np.searchsorted(token, known[0][i:j])] = known[2][i:j]
                    order = np.lexsort((token, level))[:p]
                    cold = order[level[order] == 0]
                    cols.append((token[cold], np.full(len(cold), me), np.full(len(cold), n, np.uint32), np.arange(len(cold), dtype=np.uint32)))
                    size += len(cold)
                    warm = order[level[order] > 0]
                    hot_out[0].append(token[warm])
                    hot_out[1].append(np.full(len(warm), sid, np.int64))
                    hot_out[2].append(np.full(len(warm), n, np.int32))
                    hot_out[3].append(np.full(len(warm), 1000 * shared // p, np.int64))
                    if size >= FLUSH:
                        yield from flush()
                        cols, size = [], 0
                if hot_out[0] and sum(map(len, hot_out[0])):
                    t, s, n, pri = map(np.concatenate, hot_out)
                    yield _record(bucket=pa.nulls(len(t), pa.int32()), blob=pa.nulls(len(t), pa.binary()), token=pa.array(t.view(np.int64)), sid=pa.array(s), n=pa.array(n), pri=pa.array(pri))
            if size:
                yield from flush()

        made = self._write(rows.mapInArrow(trimmed(index), "bucket int, blob binary, token long, sid long, n int, pri long"))
        self._drop(self.steps - 1)

        def pairs(cols, marks):
            token, sid, n, pos = cols
            order = np.lexsort((sid, pos, token))
            token, sid, n, pos = token[order], sid[order].view(np.int64), n[order].astype(np.int64), pos[order].astype(np.int64)
            found, i, d = [], np.arange(len(token)), 0
            # Each list is ordered by position. A partner whose token stands further than reach behind shares too little
            # of what comes before, and so do all after it: the rest of the list is skipped.
            reach = pos + (100 - THRESHOLD) * n // THRESHOLD
            while True:
                d += 1
                i = i[i + d < len(token)]
                i = i[(token[i] == token[i + d]) & (pos[i + d] <= reach[i])]
                if not len(i):
                    break
                j = i + d
                # sizes: within the threshold of each other; positions: what may still be shared before and after this token
                most = pos[i] + 1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1
                ok = (100 * np.minimum(n[i], n[j]) >= THRESHOLD * np.maximum(n[i], n[j])) & ((100 + THRESHOLD) * most >= THRESHOLD * (n[i] + n[j]))
                x, y = i[ok], j[ok]
                found.append((np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y]), np.minimum(extra_of(n[x]), extra_of(n[y]))))
            if found:
                a, b, need = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((b, a))
                a, b, need = a[order], b[order], need[order]
                start = np.flatnonzero(runs(a, b)) if len(a) else np.zeros(0, np.int64)
                yield _record(a=pa.array(a[start]), b=pa.array(b[start]), need=pa.array(need[start]), n=pa.array(np.diff(np.append(start, len(a)))))

        direct = _by_bucket(made.where("blob is not null").withColumn("mark", F.lit(None).cast("long")), buckets, ("<u8", "<u8", "<u4", "<u4"), pairs, "a long, b long, need long, n long")
        direct = direct.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("need").alias("need")).where("n >= need").select("a", "b")
        return direct, made.where("token is not null").select("token", "sid", "n", "pri")

    # ------------------------------------------------------------ comparisons

    def compared(self, pairs: DataFrame, sets: DataFrame, differences: bool) -> DataFrame:
        """hub, sid, nh, n and inter of each pair (hub, sid), and its differences if asked for."""
        pairs = self._write(pairs)
        blocks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        members = pairs.join(sets.select("sid", "n", "tokens"), "sid").join(blocks, "hub").select("hub", "sid", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"), "tokens")
        hubs = blocks.join(sets.select(F.col("sid").alias("hub"), "tokens"), "hub").select("hub", F.col("hub").alias("sid"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), "tokens")
        rows = members.unionByName(hubs).repartition(self.parts, "hub", "block").sortWithinPartitions("hub", "block", "role")

        def run(batches):
            hub, h = None, np.zeros(0, U)
            for b in batches:
                out = [[] for _ in range(7)]
                tokens = b.column(4)
                for x, (at, sid, role) in enumerate(zip(*[b.column(i).to_pylist() for i in (0, 1, 3)], strict=True)):
                    mine = np.frombuffer(tokens[x].as_py(), U)
                    if role == 0:
                        hub, h = at, mine
                        continue
                    place = np.searchsorted(h, mine)
                    place[place == len(h)] = 0
                    same = h[place] == mine if len(h) else np.zeros(len(mine), bool)
                    inter = int(same.sum())
                    near = differences and 100 * inter >= RING * (len(h) + len(mine) - inter)
                    missing = np.ones(len(h), bool)
                    missing[place[same]] = False
                    for o, v in zip(out, (hub, sid, len(h), len(mine), inter, mine[~same].tobytes() if near else None, h[missing].tobytes() if near else None), strict=True):
                        o.append(v)
                yield _record(hub=pa.array(out[0], pa.int64()), sid=pa.array(out[1], pa.int64()), nh=pa.array(out[2], pa.int32()), n=pa.array(out[3], pa.int32()), inter=pa.array(out[4], pa.int32()), more=pa.array(out[5], pa.binary()), less=pa.array(out[6], pa.binary()))

        met = self._write(rows.mapInArrow(trimmed(run), "hub long, sid long, nh int, n int, inter int, more binary, less binary"))
        self._drop(self.steps - 1)
        return met

    def _linked(self, met: DataFrame) -> DataFrame:
        return met.where(f"100 * inter >= {THRESHOLD} * (nh + n - inter)").select(F.col("hub").alias("a"), F.col("sid").alias("b"))

    def rings(self, met: DataFrame) -> DataFrame:
        """Links (a, b) between the sets near one hub, from their differences to it; met: what compared() gave."""
        near = met.where("more is not null").withColumn("ball", F.expr(f"100 * inter >= {THRESHOLD} * (nh + n - inter)"))
        sizes = near.groupBy("hub").agg(F.count_if(~F.col("ball")).alias("ring"), F.count("*").alias("all")).where("ring > 0")
        sizes = sizes.select("hub", F.ceil(F.col("ring") / BLOCK).cast("int").alias("q"), F.ceil(F.col("all") / TARGETS).cast("int").alias("t"))
        near = near.join(sizes, "hub")
        cut = lambda of: F.pmod(F.xxhash64("sid"), F.col(of)).cast("int")
        each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        cols = ["hub", "sid", "nh", "n", "more", "less", "ball"]
        targets = near.select(*cols, cut("t").alias("ti"), each("q").alias("qi"), F.lit(0).alias("role"))
        askers = near.where(~F.col("ball")).select(*cols, cut("q").alias("qi"), each("t").alias("ti"), F.lit(1).alias("role"))
        rows = targets.unionByName(askers).repartition(self.parts, "hub", "qi", "ti").sortWithinPartitions("hub", "qi", "ti", "role").select(*cols, "qi", "ti", "role")

        def answer(targets, askers):
            if not askers or not targets:
                return
            ids, n = np.array([t[1] for t in targets], np.int64), np.array([t[3] for t in targets], np.int64)
            nh, ball, every = targets[0][2], np.array([t[6] for t in targets]), np.arange(len(targets))
            sides = []
            for at in (4, 5):
                arrays = [np.frombuffer(t[at], U) for t in targets]
                token, own = np.concatenate(arrays), np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
                order = np.argsort(token, kind="stable")
                token, own = token[order], own[order]
                start = np.flatnonzero(runs(token)) if len(token) else np.zeros(0, np.int64)
                size = np.diff(np.append(start, len(token)))
                usual = 2 * size > len(ids)  # of differences that most targets have, those without are listed instead
                without = {int(token[i]): np.setdiff1d(every, own[i : i + m]) for i, m in zip(start[usual], size[usual], strict=True)}
                few = ~np.repeat(usual, size)
                sides.append((token[few], own[few], without))
            gone = np.array([len(t[5]) // 8 for t in targets], np.int64)
            joined: dict[int, int] = {}

            def root(x):
                while joined.get(x, x) != x:
                    x = joined[x]
                return x

            a, b = [], []
            for z in askers:
                inter = nh - gone - len(z[5]) // 8
                for (token, own, without), at in zip(sides, (4, 5), strict=True):
                    mine = np.frombuffer(z[at], U)
                    lacking = [without[t] for t in mine.tolist() if t in without] if without else []
                    if lacking:
                        inter = inter + len(lacking) - np.bincount(np.concatenate(lacking), minlength=len(ids))
                    lo, hi = np.searchsorted(token, mine), np.searchsorted(token, mine, side="right")
                    spans_ = [own[i:j] for i, j in zip(lo, hi, strict=True) if j > i]
                    if spans_:
                        inter = inter + np.bincount(np.concatenate(spans_), minlength=len(ids))
                linked = np.flatnonzero((100 * inter >= THRESHOLD * (n + z[3] - inter)) & (ids != z[1]))
                hub = targets[0][0]
                for x in linked:
                    one, two = root(hub if ball[x] else int(ids[x])), root(z[1])  # the ball hangs together by the hub
                    if one != two:
                        joined[one] = two
                        a.append(int(ids[x]))
                        b.append(z[1])
            if a:
                yield _record(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

        def run(batches):
            key, targets, askers = None, [], []
            for batch in batches:
                for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if (r[0], r[7], r[8]) != key:
                        yield from answer(targets, askers)
                        key, targets, askers = (r[0], r[7], r[8]), [], []
                    (askers if r[9] else targets).append(r)
            yield from answer(targets, askers)

        return rows.mapInArrow(trimmed(run), "a long, b long")

    # ------------------------------------------------------------ 3. long lists

    def long_lists(self, entries: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
        """links and those that the lists of hot tokens give; entries (token, sid, n, pri).

        A round compares each list with one hub. The ball is done with; the ring is answered within itself and with the
        ball, and marked with the hub. A list is done when all that is left of it bears one mark. Hubs are chosen among
        sets without a mark first.
        """
        entries = entries.withColumn("mark", F.lit(None).cast("long"))
        for k in range(ROUNDS + 1):
            hubs = entries.groupBy("token").agg(F.max(F.struct(F.col("mark").isNull().alias("fresh"), "pri", "sid", "n")).alias("hub"), F.count("*").alias("size"), F.count_if(F.col("mark").isNull()).alias("fresh"), F.min("mark").alias("low"), F.max("mark").alias("high"))
            hubs = self._write(hubs.where("size > 1 and (fresh > 0 or low <> high)").select("token", F.col("hub.sid").alias("hub"), F.col("hub.n").alias("nh")))
            if hubs.isEmpty():
                break
            if k == ROUNDS:
                rest = entries.join(hubs.select("token"), "token", "left_semi").select("sid").distinct()
                found = self._linked(self.compared(self.combined(rest, sets, links), sets, False))
                links = links.unionByName(found)
                break
            fits = F.expr(f"100 * least(n, nh) >= {RING} * greatest(n, nh)")
            met = self.compared(entries.join(hubs, "token").where((F.col("sid") != F.col("hub")) & fits).select("hub", "sid").distinct(), sets, True)
            near = met.where("more is not null").select("hub", "sid", F.expr(f"100 * inter >= {THRESHOLD} * (nh + n - inter)").alias("ball"))
            left = entries.join(hubs.select("token", "hub"), "token").where("sid <> hub").join(near, ["hub", "sid"], "left").where("not coalesce(ball, false)")
            entries = self._write(left.select("token", "sid", "n", "pri", F.when(F.col("ball").isNotNull(), F.col("hub")).otherwise(F.col("mark")).alias("mark")))
            links = links.unionByName(self._linked(met)).unionByName(self._write(self.rings(met)))
        return links

    # ------------------------------------------------------------ 4. combinations

    def combined(self, sids: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
        """Pairs (hub, sid) among the sets sids that may link and that links don't join already; see 4 above."""
        buckets = self.buckets
        joined = components(links).withColumnRenamed("node", "sid")
        sids = sids.join(joined, "sid", "left").select("sid", F.coalesce("component", "sid").alias("joined"))

        def group(cols, marks):
            token, sid = cols
            order = np.lexsort((sid, token))
            token, sid = token[order], sid[order]
            new = runs(token, sid)
            token, sid = token[new], sid[new]
            start = np.flatnonzero(runs(token))
            end = np.append(start[1:], len(token))
            sums = np.zeros(len(token) + 1, U)
            np.cumsum(mix(sid ^ U(0x2545F4914F6CDD1D)), out=sums[1:])
            size = end - start
            name = np.repeat(mix(sums[end] - sums[start] + size.astype(U) * U(0x9E3779B97F4A7C15)), size)
            held = np.repeat(size, size).astype(np.uint32)
            order = np.lexsort((name, sid))
            sid, name, held = sid[order], name[order], held[order]
            start = np.flatnonzero(runs(sid, name)) if len(sid) else np.zeros(0, np.int64)
            weight = np.diff(np.append(start, len(sid))).astype(np.uint32)
            sid, name, held = sid[start], name[start], held[start]
            start = np.flatnonzero(runs(sid)) if len(sid) else np.zeros(0, np.int64)
            end = np.append(start[1:], len(sid))
            yield _record(sid=pa.array(sid[start].view(np.int64)), part=pa.array([pack(name[i:j], held[i:j], weight[i:j]) for i, j in zip(start, end, strict=True)], pa.binary()))

        mine = self._write(sets.join(sids, "sid").select("sid", "n", "tokens", "joined"))
        parts = self._by_token(mine, group, "sid long, part binary").groupBy("sid").agg(F.collect_list("part").alias("parts"))  # one for each bucket at most

        def prefix(weight, r, loss):
            """Length of the shortest prefix that weighs more than loss without its r - 1 heaviest; None if there is none."""
            heaviest, rest = [], 0
            for k, w in enumerate(weight):
                heapq.heappush(heaviest, w)
                if len(heaviest) >= r:
                    rest += heapq.heappop(heaviest)
                if rest > loss:
                    return k + 1
            return None

        def keys(batches):
            chosen = {}  # few, as MOST bounds them
            for b in batches:
                cols = [[np.zeros(0, t)] for t in (U, U, U, np.uint32, np.uint8)]
                for sid, n, blobs, joined in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                    name, held, weight = (np.concatenate(c) for c in zip(*[unpack(x, "<u8", "<u4", "<u4") for x in blobs], strict=True))
                    order = np.argsort(name, kind="stable")
                    start = np.flatnonzero(runs(name[order]))
                    weight = np.add.reduceat(weight[order].astype(np.int64), start)
                    name, held = name[order][start], held[order][start]
                    order = np.lexsort((name, held))
                    alone = int((held == 1).sum())
                    loss = n - int(least_overlap(n)) - int(weight[held == 1].sum())
                    name, weight = name[order][alone:], weight[order][alone:].tolist()
                    levels = []
                    for r in range(1, LEVEL + 1):
                        p = prefix(weight, r, loss) if loss >= 0 else None
                        if p is None or (r > 1 and math.comb(p, r) > MOST):
                            break
                        levels.append((r, p))
                    for r, p in levels:
                        if r == 1:
                            at = np.arange(p).reshape(-1, 1)
                        else:
                            if (p, r) not in chosen:
                                chosen[p, r] = np.array(list(itertools.combinations(range(p), r)), np.int64)
                            at = chosen[p, r]
                        key = np.full(len(at), r, U)
                        for c in range(r):
                            key = mix(key + name[at[:, c]])
                        for have, x in zip(cols, (key, np.full(len(at), sid, np.int64).view(U), np.full(len(at), joined, np.int64).view(U), np.full(len(at), n, np.uint32), np.full(len(at), r == levels[-1][0], np.uint8)), strict=True):
                            have.append(x)
                cols = [np.concatenate(c) for c in cols]
                bucket, blobs = _blobs(_bucket(cols[0], buckets), *cols)
                yield _record(bucket=pa.array(bucket.astype(np.int32)), blob=pa.array(blobs, pa.binary()), mark=pa.nulls(len(blobs), pa.int64()))

        def pairs(cols, marks):
            key, sid, joined, n, own = cols
            order = np.lexsort((sid, n, key))
            key, sid, joined, n, own = key[order], sid[order].view(np.int64), joined[order], n[order].astype(np.int64), own[order] > 0
            i, d = np.arange(len(key)), 0
            while len(i):  # partners d places on in the same list, while the sizes allow a link
                d += 1
                i = i[i + d < len(key)]
                i = i[(key[i] == key[i + d]) & (100 * n[i] >= THRESHOLD * n[i + d])]
                j = i + d
                ok = (own[i] | own[j]) & (joined[i] != joined[j])
                if ok.any():
                    yield _record(hub=pa.array(np.minimum(sid[i[ok]], sid[j[ok]])), sid=pa.array(np.maximum(sid[i[ok]], sid[j[ok]])))

        rows = mine.select("sid", "n", "joined").join(parts, "sid").select("sid", "n", "parts", "joined").mapInArrow(trimmed(keys), "bucket int, blob binary, mark long")
        return _by_bucket(rows, buckets, ("<u8", "<u8", "<u8", "<u4", "u1"), pairs, "hub long, sid long").distinct()

    def links(self) -> tuple[DataFrame, DataFrame]:
        """documents (doc_id, n, sid), and links between classes (a, b) that join what belongs together."""
        own, left = self.sieve()
        sets = self.sets(left)
        direct, entries = self.lists(sets)
        links = self._linked(self.compared(direct.select(F.col("a").alias("hub"), F.col("b").alias("sid")), sets, False))
        links = self._write(self.long_lists(entries, sets, links))
        self.spark.sql(f"DROP TABLE {self.table}")
        self._drop("sets", *range(2, self.steps))
        return own, links


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy(), offsets - offsets[0]


def link_classes(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Words are lower-cased (A-Z); a document with fewer than k words has its whole sequence as its one shingle. Without
    words (null or empty text) the set is empty and linked with nothing: component_id is the doc_id. Documents with
    equal sets are linked. A null doc_id counts as the smallest number there is inside, and is null in the result where
    it is the smallest of its component. Repeated rows give repeated rows. No rows give no rows.
    """
    lowest = -(1 << 63)
    join = JaccardJoin(docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest))), k)
    own, links = join.links()
    classes = own.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    joined = components(links).withColumnRenamed("node", "sid")
    joined = joined.join(classes, "sid")
    firsts = joined.groupBy("component").agg(F.min("least").alias("first"))
    by_class = classes.join(joined.select("sid", "component").join(firsts, "component"), "sid", "left").select("sid", F.coalesce("first", "least").alias("_component"))
    # a class may hold a third of all rows: its id is joined to partial rows, which adaptive execution splits
    out = own.join(by_class, "sid", "left")
    named = lambda c: F.when(c != lowest, c)
    return out.select(named(F.col("doc_id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), named(F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("_component"))).alias("component_id"))


def op8(spark, sf_dir: str) -> DataFrame:
    return link_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1) + 1))) AS s FROM d),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 3], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {THRESHOLD} * (x.n + y.n - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT x, b FROM reach JOIN links ON y = a),
least_ AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN least_ ON x = d.doc_id
"""
