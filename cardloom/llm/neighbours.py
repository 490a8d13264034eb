"""Approximate nearest neighbours by NN-descent and greedy search of the graph.

Equal vectors are one node; a node keeps its WANTED + 1 smallest ids, which is all that a result can name of it. Nodes
go to parts by their hash, of PART nodes at most, and each part has a graph of its own, which one task builds in arrays:
vectors travel to their part once, and not to their neighbours in every round. A graph starts from blocks of vectors that
lie side by side on a few seeded random projections. Each round joins every node with its neighbours and those it is a
neighbour of, compares them with each other (neighbours of neighbours), and keeps the DEGREE nearest of each node, until
a round changes less than the share CHANGED of all edges. Pairs that were compared in an earlier round aren't compared
again. Every query searches every part, so no part is left out: a search keeps a pool of the POOL nearest nodes seen and
expands what it has not expanded, until nothing new comes near; the pool is not a limit on results but the width of the
search, and recall is measured.

Distances are Euclidean, in double precision, on the vectors as given; vectors of floats travel as floats, and graphs are
built and searched on them moved to the median of their part. All indexing covers all vectors; nothing is fitted on a sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_path, trimmed, workspace, written

DEGREE, REVERSE, CHANGED, PROJECTIONS, BLOCK = 32, 32, 0.001, 3, 64
POOL, WANTED, ENTRIES, SEED = 288, 10, 1024, 11
WAYS_BACK = 96  # of the edges that lead to a node, so many of the shortest are walked the other way by a search
PART, LEAST_PART, PARTS = 1 << 17, 1 << 13, 6  # nodes of a part at most; small tables have up to PARTS parts of LEAST_PART nodes or more
AT_ONCE, SLICE = 1 << 21, 1 << 14  # compared pairs that are held at once; nodes whose edges are sorted at once
QUERIES = 1 << 16  # queries that are sent to all parts at once
STRIDE, TOGETHER, EXPAND = 512, 64, 16  # nodes of a step of a round; queries that are searched together, and nodes that each expands at once
NONE = np.uint64(2**64 - 1)
FAR = 1e15  # beyond it squares of floats could overflow
PACKED = "n int, ids binary, hashes binary, vecs binary, edges binary, d binary, fresh binary, has long, brought long"


def valid(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """key and vec (array of double) of the rows that take part; lengths other than the commonest do not."""
    v = F.col(column)
    fine = v.isNotNull() & F.col(key).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), (v if vectors.schema[column].dataType.elementType.typeName() == "float" else v.cast("array<double>")).alias("vec")).where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").limit(1)
    first = sizes.first()
    return rows.where(F.size("vec") == (first["size"] if first else 0))


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def _high(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64) << np.uint64(32)


def _bits(d: np.ndarray) -> np.ndarray:
    """Numbers in the order of squared distances."""
    return np.ascontiguousarray(d, np.float32).view(np.uint32).astype(np.uint64)


def _places(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    """The place of each key among its equals."""
    return np.arange(len(sorted_keys)) - np.searchsorted(sorted_keys, np.arange(n))[sorted_keys]


class Part:
    """The graph of one part in arrays: x are its vectors, and to, d and fresh have a row of up to DEGREE edges for each, -1 where there is none."""

    def __init__(self, vecs: np.ndarray, edges=None):
        self.n, self.kind = len(vecs), vecs.dtype
        self.unit = float(np.median(np.abs(vecs).max(1))) if self.n else 1.0  # above 0, as no vector is zero
        x = vecs / np.float64(self.unit)
        self.middle = np.median(x, 0)
        self.x = self._moved(x)
        self.squares = np.einsum("ij,ij->i", self.x, self.x)
        self.to, self.d, self.fresh = edges or (np.full((self.n, DEGREE), -1, np.int32), np.full((self.n, DEGREE), np.inf, np.float32), np.zeros((self.n, DEGREE), bool))

    def _moved(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x - self.middle, -FAR, FAR).astype(self.kind)

    def keep(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        """The DEGREE nearest of each node, of its edges and those given; what is new is fresh."""
        for i in range(0, self.n, SLICE):
            own = (a >= i) & (a < i + SLICE)
            self._keep(slice(i, min(self.n, i + SLICE)), a[own] - i, b[own], d[own])

    def _keep(self, part: slice, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        n, has = part.stop - part.start, self.to[part].ravel() >= 0
        key = np.concatenate([_high(np.repeat(np.arange(n), DEGREE)[has]) | self.to[part].ravel()[has].astype(np.uint64), _high(a) | b.astype(np.uint64)])
        far, fresh = np.concatenate([self.d[part].ravel()[has], d.astype(np.float32)]), np.concatenate([self.fresh[part].ravel()[has], np.ones(len(a), bool)])
        order = np.argsort(key, kind="stable")  # an edge that is there stands before those found again
        key = key[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        order, key = order[first], key[first]
        far, fresh = far[order], fresh[order]
        order = np.argsort((key & ~np.uint64(2**32 - 1)) | _bits(far), kind="stable")
        key, far, fresh = key[order], far[order], fresh[order]
        a = (key >> np.uint64(32)).astype(np.int64)
        at = _places(a, n)
        fits = at < DEGREE
        a, at = a[fits] + part.start, at[fits]
        self.to[part], self.d[part], self.fresh[part] = -1, np.inf, False
        self.to[a, at], self.d[a, at], self.fresh[a, at] = key[fits].astype(np.uint32).astype(np.int32), far[fits], fresh[fits]

    def back(self, most: int, of: np.ndarray) -> np.ndarray:
        """The nodes from which the shortest of the edges ``of`` lead to each node, -1 behind them."""
        flat = np.flatnonzero((of & (self.to >= 0)).ravel())
        b = self.to.ravel()[flat]
        order = np.argsort(_high(b) | _bits(self.d.ravel()[flat]), kind="stable")
        b, flat = b[order].astype(np.int64), flat[order]
        at = _places(b, self.n)
        fits = at < most
        found = np.full((self.n, most), -1, np.int32)
        found[b[fits], at[fits]] = flat[fits] // DEGREE
        return found

    def around(self, most: int, of: np.ndarray) -> np.ndarray:
        """The other ends of the edges ``of`` from and to each node, each once, -1 behind them."""
        found = np.sort(np.concatenate([np.where(of, self.to, -1), self.back(most, of)], 1), 1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found = np.sort(found, 1)[:, ::-1]
        return found[:, : max(1, int((found >= 0).sum(1).max(initial=0)))]

    def start(self) -> None:
        """Edges inside blocks of neighbours on random lines."""
        size = min(self.n, 2 * BLOCK)
        k = min(DEGREE, size - 1)
        if k < 1:
            return
        for p in range(PROJECTIONS):
            line = np.argsort(self.x @ np.random.default_rng(SEED + p).standard_normal(self.x.shape[1]).astype(self.x.dtype), kind="stable")
            first = np.unique(np.append(np.arange(0, self.n - size, size), self.n - size))
            found = []
            for i in range(0, len(first), 64):
                ids = line[first[i : i + 64, None] + np.arange(size)]
                x, own = self.x[ids], self.squares[ids]
                d = own[:, :, None] + own[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
                d[:, np.arange(size), np.arange(size)] = np.inf
                near = np.argpartition(d, k - 1, axis=2)[:, :, :k]
                found.append((np.repeat(ids.ravel(), k), ids[np.arange(len(ids))[:, None, None], near].ravel(), np.maximum(np.take_along_axis(d, near, 2).ravel(), 0)))
            self.keep(*map(np.concatenate, zip(*found, strict=True)))

    def descend(self) -> None:
        """One round: neighbours of neighbours; the edges it brought are fresh."""
        new, old = self.around(REVERSE, self.fresh), self.around(REVERSE, ~self.fresh)
        n_new, n_old = (new >= 0).sum(1), (old >= 0).sum(1)
        order = np.lexsort((n_old, n_new))  # nodes with about as many are worked on together
        order = order[n_new[order] > 0]
        self.fresh[:] = False
        worst, held, count = self.d[:, -1].copy(), [], 0
        for i in range(0, len(order), STRIDE):
            v = order[i : i + STRIDE]
            wide = n_new[v].max()
            left = new[v, :wide]
            right = np.concatenate([left, old[v, : n_old[v].max()]], 1)
            d = self.x[left] @ self.x[right].transpose(0, 2, 1)
            d *= -2
            d += self.squares[left][:, :, None]
            d += self.squares[right][:, None, :]
            d[left < 0] = np.inf
            d.transpose(0, 2, 1)[right < 0] = np.inf
            for other in (False, True):
                z, p, q = np.nonzero(d < (worst[right][:, None, :] if other else worst[left][:, :, None]))
                a, b, near = left[z, p], right[z, q], d[z, p, q]
                fits = (a != b) & ((q >= wide) | (not other))  # pairs of two new ones are there both ways
                a, b, near = a[fits], b[fits], np.maximum(near[fits], 0)
                held.append((b, a, near) if other else (a, b, near))
                count += len(a)
            if count > AT_ONCE or i + STRIDE >= len(order):
                self.keep(*map(np.concatenate, zip(*held, strict=True)))
                worst, held, count = self.d[:, -1].copy(), [], 0

    def brought(self) -> float:
        """The share of edges that the last round brought."""
        return int(self.fresh.sum()) / max(1, int((self.to >= 0).sum()))

    def build(self) -> Part:
        self.start()
        self.fresh = self.to >= 0
        while self.brought() > CHANGED:
            self.descend()
        return self

    def search(self, queries: np.ndarray) -> np.ndarray:
        """The nodes of each query's pool, nearest first, -1 behind them."""
        ways = self.around(WAYS_BACK, self.to >= 0)
        ways = np.where(ways < 0, self.n, ways)  # a node that all have seen
        q = self._moved(queries / np.float64(self.unit))
        return np.concatenate([np.zeros((0, POOL), np.int64), *[self._pools(q[i : i + TOGETHER], ways) for i in range(0, len(q), TOGETHER)]])

    def _pools(self, q: np.ndarray, ways: np.ndarray) -> np.ndarray:
        # a pool holds distance, node and whether it has been expanded in one number, in order
        n, m, most = self.n + 1, len(q), np.uint64(2**32 - 1)
        own = np.einsum("ij,ij->i", q, q)
        seen = np.zeros((m, n), bool)
        seen[:, -1] = True
        seen[:, :ENTRIES] = True  # nodes are in the order of a hash
        flat = seen.ravel()
        d = np.maximum(own[:, None] + self.squares[:ENTRIES] - 2 * (q @ self.x[:ENTRIES].T), 0)
        pool = np.sort((_bits(d) << np.uint64(32)) | (np.arange(d.shape[1], dtype=np.uint64) << np.uint64(1)), 1)[:, :POOL]
        pool = np.concatenate([pool, np.full((m, POOL - pool.shape[1]), NONE)], 1)
        open_, room = np.arange(m), np.empty((0, q.shape[1]), self.kind)
        while len(open_):
            some = pool[open_]
            todo = (some & np.uint64(1)) == 0
            todo &= np.cumsum(todo, 1) <= EXPAND
            r, c = np.nonzero(todo)
            if not len(r):
                break
            at = ways[((some[r, c] & most) >> np.uint64(1)).astype(np.int64)] + (open_[r] * n)[:, None]
            some[r, c] |= np.uint64(1)
            pool[open_] = some
            at = at.ravel()
            at = np.sort(at[~flat[at]])
            once = np.ones(len(at), bool)
            once[1:] = at[1:] != at[:-1]
            at = at[once]
            flat[at] = True
            edges = np.searchsorted(at, np.arange(m + 1) * n)
            rows = np.repeat(np.arange(m), np.diff(edges))
            at -= rows * n
            if len(at) > len(room):
                room = np.empty((2 * len(at), self.x.shape[1]), self.kind)
            x, d = np.take(self.x, at, 0, room[: len(at)], "clip"), np.empty(len(at), self.kind)
            for i in np.flatnonzero(np.diff(edges)):
                np.dot(x[edges[i] : edges[i + 1]], q[i], out=d[edges[i] : edges[i + 1]])
            d *= -2
            d += self.squares[at]
            d += own[rows]
            d = _bits(np.maximum(d, 0))
            near = d <= (pool[:, -1] >> np.uint64(32))[rows]
            rows, at, d = rows[near], at[near], d[near]
            if len(rows):
                counts = np.bincount(rows, minlength=m)
                more = np.full((m, counts.max()), NONE)
                more[rows, np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]] = (d << np.uint64(32)) | (at.astype(np.uint64) << np.uint64(1))
                has = np.flatnonzero(counts)
                pool[has] = np.sort(np.concatenate([pool[has], more[has]], 1), 1)[:, :POOL]
            open_ = open_[((pool[open_] & np.uint64(1)) == 0).any(1)]
        return np.where(pool == NONE, -1, ((pool & most) >> np.uint64(1)).astype(np.int64))


def _packed(ids: np.ndarray, hashes: np.ndarray, vecs: np.ndarray, part: Part) -> pa.RecordBatch:
    blobs = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (ids, hashes, vecs, part.to, part.d, np.packbits(part.fresh))]
    counts = [pa.array([int(x.sum())], pa.int64()) for x in (part.to >= 0, part.fresh)]
    return pa.RecordBatch.from_arrays([pa.array([part.n], pa.int32()), *blobs, *counts], names=["n", "ids", "hashes", "vecs", "edges", "d", "fresh", "has", "brought"])


def _unpacked(batches, kind):
    """Of each row its place in its batch, the ids and hashes of the nodes, their vectors, and their graph."""
    for b in batches:
        for i in range(b.num_rows):
            n, ids, hashes, vecs, edges, d, fresh = (c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py() for c in b.columns[:7])
            vecs = np.frombuffer(vecs, kind).reshape(n, -1)
            fresh = np.unpackbits(np.frombuffer(fresh, np.uint8), count=n * DEGREE).astype(bool)
            edges = np.frombuffer(edges, np.int32).copy(), np.frombuffer(d, np.float32).copy(), fresh
            yield b, i, np.frombuffer(ids, np.int64), np.frombuffer(hashes, np.int64), vecs, Part(vecs, tuple(x.reshape(n, DEGREE) for x in edges))


class Graph:
    """Packed graphs of the parts of an index, and members (node, hash, id) of its nodes."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", column: str = "embedding"):
        self.spark, self.folder, self.steps = vectors.sparkSession, workspace(vectors.sparkSession), 0
        self.rows = valid(vectors, key, column)
        self.vec = self.rows.schema["vec"].dataType.simpleString()
        self.kind = np.float32 if self.vec == "array<float>" else np.float64
        # equal vectors are told by 128 bits of hashes
        self.hashed = self.rows.withColumns({"hash": F.xxhash64("vec"), "hash2": F.xxhash64(F.lit(SEED), "vec")})
        same = Window.partitionBy("hash", "hash2")
        ids = self.hashed.select("id", "hash", "hash2").withColumn("_n", F.row_number().over(same.orderBy("id"))).where(F.col("_n") <= WANTED + 1)
        self.members = self._write(ids.select(F.min("id").over(same).alias("node"), "hash", "id", "_n"))
        self.parts = max(1, min(PARTS, (n := self.members.where("_n = 1").count()) // LEAST_PART), -(-n // PART))
        self.graphs = None

    def _write(self, df: DataFrame) -> DataFrame:
        self.steps += 1
        return written(df, f"{self.folder}/{self.steps}")

    def build(self) -> Graph:
        kind, parts = self.kind, self.parts

        def least(id_, hash_, hash2):
            """The places of the smallest id of each vector."""
            order = np.lexsort((id_, hash2, hash_))
            first = np.ones(len(order), bool)
            first[1:] = (hash_[order][1:] != hash_[order][:-1]) | (hash2[order][1:] != hash2[order][:-1])
            return order[first]

        def few(batches):  # a vector that many rows share comes from each batch once
            for b in batches:
                yield b.take(pa.array(least(*(b.column(i).to_numpy() for i in range(3)))))

        def local(batches):
            ids, vecs = [], []
            for b in batches:
                ids.append(np.stack([b.column(i).to_numpy() for i in range(3)]))
                vecs.append(_matrix(b.column(3), kind))
            if sum(map(len, vecs)):
                ids, vecs = np.concatenate(ids, 1), np.concatenate([x for x in vecs if len(x)])
                order = least(*ids)
                ids, vecs = ids[:, order], vecs[order]
                yield _packed(ids[0], ids[1], vecs, Part(vecs).build())

        rows = self.hashed.select("id", "hash", "hash2", "vec")
        dealt = rows.mapInArrow(few, rows.schema).repartitionById(parts, F.pmod("hash2", F.lit(parts)).cast("int"))
        self.graphs = self._write(dealt.mapInArrow(trimmed(local), PACKED))
        return self

    def descend(self) -> None:
        """One round more in every part; the edges it brought are fresh."""
        kind = self.kind

        def local(batches):
            for _, _, ids, hashes, vecs, part in _unpacked(batches, kind):
                part.descend()
                yield _packed(ids, hashes, vecs, part)

        self.graphs = self._write(self.graphs.mapInArrow(trimmed(local), PACKED))
        drop_path(self.spark, f"{self.folder}/{self.steps - 1}")

    def changed(self) -> float:
        """The share of edges that the last round brought."""
        has, brought = self.graphs.agg(F.sum("has"), F.sum("brought")).first()
        return brought / has if has else 0.0

    def search(self, queries: DataFrame, wanted: int = WANTED) -> DataFrame:
        """query_id, rank, vec_id and score of each query's nearest rows other than itself; queries: id, vec."""
        if wanted > WANTED:
            raise ValueError(f"an index built for {WANTED} results can't give {wanted}")
        kind = self.kind

        def pack(t: pa.Table) -> pa.Table:
            blobs = [t["q"].to_numpy().astype(np.int64), _matrix(t["qvec"].combine_chunks(), kind)]
            return pa.table({"turn": t["turn"].slice(0, 1), "qs": pa.array([blobs[0].tobytes()], pa.binary()), "qvecs": pa.array([blobs[1].tobytes()], pa.binary())})

        def local(batches):
            for b, i, ids, hashes, vecs, part in _unpacked(batches, kind):
                qs, qvecs = np.frombuffer(b["qs"][i].as_buffer(), np.int64), np.frombuffer(b["qvecs"][i].as_buffer(), kind)
                qvecs = qvecs.reshape(len(qs), -1)
                pools = part.search(qvecs)[:, : 4 * (WANTED + 1)]
                for at in range(0, len(qs), 4096):
                    r, c = np.nonzero(pools[at : at + 4096] >= 0)
                    node = pools[at : at + 4096][r, c]
                    r += at
                    d = np.zeros(len(r))
                    for x, y in zip(vecs.T, qvecs.T, strict=True):  # summed in the order of components
                        d += (x[node].astype(np.float64) - y[r]) ** 2
                    order = np.lexsort((ids[node], d, r))
                    r, node, d = r[order], node[order], d[order]
                    fits = _places(r - at, min(4096, len(qs) - at)) <= WANTED
                    r, node, d = r[fits], node[fits], d[fits]
                    yield pa.RecordBatch.from_arrays([pa.array(qs[r]), pa.array(ids[node]), pa.array(hashes[node]), pa.array(np.sqrt(d))], names=["q", "node", "hash", "d"])

        queries = self._write(queries.select(F.col("id").alias("q"), F.col("vec").cast(self.vec).alias("qvec")))
        turns = max(1, -(-queries.count() // QUERIES))
        turn = F.pmod(F.xxhash64("q"), F.lit(turns)).cast("int").alias("turn")
        packed = self._write(queries.select(turn, "q", "qvec").groupBy("turn").applyInArrow(pack, "turn int, qs binary, qvecs binary"))
        near = F.row_number().over(Window.partitionBy("q").orderBy("d", "node", "hash"))
        found = None
        for i in range(turns):  # one row of queries at a time is sent to all parts
            met = self.graphs.crossJoin(F.broadcast(packed.where(F.col("turn") == i).select("qs", "qvecs"))).mapInArrow(trimmed(local), "q long, node long, hash long, d double")
            part = self._write(met.withColumn("_n", near).where(F.col("_n") <= WANTED + 1).drop("_n"))
            found = part if found is None else found.unionByName(part)
        found = found.join(self.members.drop("_n"), ["node", "hash"]).where(F.col("id") != F.col("q"))
        rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
        return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= wanted).select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("d").alias("score"))


def search_table(vectors: DataFrame, every: int = 100, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Neighbours of the rows whose key is divisible by ``every``, among all rows but themselves.

    Vectors that are null, zero, or hold null or non-finite components take no part, neither as queries nor as
    candidates, and a vector whose length isn't the commonest doesn't. Ties go to the smaller id; equal vectors are
    ordinary neighbours at distance 0. Fewer candidates than wanted give all of them. No rows give no rows.
    """
    graph = Graph(vectors, key, column).build()
    return graph.search(graph.rows.where(F.col("id") % every == 0).select("id", "vec").dropDuplicates(["id"]))


def op6(spark, sf_dir: str) -> DataFrame:
    return search_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
