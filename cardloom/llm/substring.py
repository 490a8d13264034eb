"""Substring dedup over a log-structured index of window fingerprints.

A window is ``width`` consecutive words. Windows that stand one after the other and share their least ``GRAM``-word
hash (the anchor) form a group, about one for each seven words; equal windows have equal anchors in equal places, so
they meet in groups with the same anchor. The index keeps groups, not windows:

* A batch of documents becomes runs: rows of (bucket, block of groups sorted by anchor and content). Inside a run an
  equal group is kept once; the later ones are already known to be repeats. So a passage that stands in a third of all
  documents reaches a bucket once for each run.
* The new runs are merge-joined bucket by bucket with the historical runs, which are immutable tables. A group whose
  content (64-bit hash under the same 64-bit anchor) was there before is a repeat as a whole. Groups that share an
  anchor but differ in content may share some of their windows: they are contended. An anchor that had very many
  contents in one run has its groups dealt by content and a mark in its own bucket; marks stay in the index, and when
  such an anchor comes again, its earlier groups are contended from wherever they were dealt to.
* Contended groups are verified window by window: the texts are read again, their windows' hashes go the same way
  (runs, buckets, first of each stays), and what isn't first is a repeat.
* New groups become one more run of the index. When more than ``fanout`` runs have gathered they are compacted into
  one sorted run without the rows that later runs made superfluous.

Texts lie in a table bucketed by row id, so reading some of them again needs no shuffle of texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import U, WORD_BASE, Words, mix, pack, prefix_sums, release, runs, shuffle_partitions, slices, spans, table_of, text_buffers, trimmed, unpack, workspace, written

WIDTH, GRAM, FANOUT, BATCHES = 20, 8, 2, 3
RUN_ROWS = 1 << 20  # groups that a task gathers before it writes them out as a run
HOT = 64  # different contents of one anchor in a run, from which its rows are dealt by content as well
LAST_ID = (1 << 63) - 1
KINDS = ("<u8", "<u8", "<i8", "<i8", "<u4", "<u2", "<u2")  # anchor, content, doc_id, rid, first window, windows - 1, batch
SCHEMA = "kind int, bucket int, rid long, first int, last int, anchor long, blob binary"
RUN, REPEAT, CONTENDED, MARK, OLD_MARK, DEALT, WOKEN = range(7)


def anchors(g: np.ndarray, n: int) -> np.ndarray:
    """For each i the leftmost place of the least of g[i : i + n]."""
    at, size = np.arange(len(g)), 1
    while size < n:
        step = min(size, n - size)
        a, b = at[:-step], at[step:]
        at = np.where(g[b] < g[a], b, a)
        size += step
    return at


def groups(words: Words, width: int, gram: int):
    """anchor, content, text number, first window (from the text's first word) and windows - 1 of all groups."""
    n = len(words.hash) - width + 1
    if n <= 0:
        return [np.zeros(0, U), np.zeros(0, U), *[np.zeros(0, np.int64)] * 3]
    text = words.texts()
    g = words.grams(gram)
    at = anchors(g, width - gram + 1)[:n]
    inside = np.flatnonzero(text[:n] == text[width - 1 :])
    if not len(inside):
        return [np.zeros(0, U), np.zeros(0, U), *[np.zeros(0, np.int64)] * 3]
    own = at[inside]
    new = runs(own, text[inside])
    new[1:] |= inside[1:] != inside[:-1] + 1
    start = np.flatnonzero(new)
    s1, s2 = inside[start], inside[np.append(start[1:], len(inside)) - 1]
    content = mix(spans(prefix_sums(words.hash, WORD_BASE), s1, s2 + width, WORD_BASE) ^ (own[start] - s1).astype(U))
    return [g[own[start]], content, text[s1], s1 - words.first[text[s1]], s2 - s1]


def _merge(rid: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Ranges joined where they touch or overlap within a row."""
    order = np.lexsort((a, rid))
    rid, a, b = rid[order], a[order].astype(np.int64), b[order].astype(np.int64)
    if not len(rid):
        return rid, a, b
    # ends so far, counted within the row: rows are shifted apart
    shift = np.cumsum(runs(rid)) * (int(b.max()) + 2)
    reach = np.maximum.accumulate(b + shift)
    new = np.ones(len(rid), bool)
    new[1:] = a[1:] + shift[1:] > reach[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(rid)) - 1
    return rid[start], a[start], reach[end] - shift[end]


def _rows(kind: int, n: int, **have) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "bucket": pa.int32(), "rid": pa.int64(), "first": pa.int32(), "last": pa.int32(), "anchor": pa.int64(), "blob": pa.binary()}
    have["kind"] = np.full(n, kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(have[k], t) if k in have else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))


def _sort(cols):
    """By anchor and content, and the earliest first: batch, doc_id, rid, place."""
    anchor, content, doc, rid, first, more, batch = cols
    order = np.lexsort((first, rid, doc, batch, content, anchor))
    return [c[order] for c in cols]


class _Runs:
    """Gathers groups (or windows) in a task and gives runs out."""

    def __init__(self, buckets: int, width: int):
        self.buckets, self.width, self.parts, self.n = buckets, width, [], 0

    def add(self, *cols):
        self.parts.append([np.asarray(c).astype(k) for c, k in zip(cols, KINDS, strict=True)])
        self.n += len(cols[0])
        if self.n >= RUN_ROWS:
            yield from self.flush()

    def flush(self):
        if not self.n:
            return
        cols = _sort([np.concatenate(c) for c in zip(*self.parts, strict=True)])
        self.parts, self.n = [], 0
        lead = runs(cols[0], cols[1])
        again = ~lead
        if again.any():
            rid, a, b = _merge(cols[3][again], cols[4][again], cols[4][again].astype(np.int64) + cols[5][again] + self.width)
            yield _rows(REPEAT, len(rid), rid=rid, first=a, last=b)
        cols = [c[lead] for c in cols]
        bucket = (mix(cols[0].copy()) % U(self.buckets)).astype(np.int64)
        # an anchor with many contents would fill one bucket: deal it by content, and leave a mark where it belongs
        start = np.flatnonzero(runs(cols[0]))
        size = np.diff(np.append(start, len(cols[0])))
        hot = np.repeat(size >= HOT, size)
        if hot.any():
            marks = cols[0][start[size >= HOT]]
            at = bucket[start[size >= HOT]]
            bucket[hot] = (mix(cols[1][hot].copy()) % U(self.buckets)).astype(np.int64)
            yield _rows(MARK, len(marks), bucket=at, anchor=marks.view(np.int64))
            yield _rows(CONTENDED, int(hot.sum()), rid=cols[3][hot], first=cols[4][hot].astype(np.int32), last=cols[5][hot].astype(np.int32), anchor=cols[0][hot].view(np.int64))
        order = np.argsort(bucket, kind="stable")
        cols, bucket = [c[order] for c in cols], bucket[order]
        start = np.flatnonzero(runs(bucket))
        end = np.append(start[1:], len(bucket))
        blobs = [pack(*[c[i:j] for c in cols]) for i, j in zip(start, end, strict=True)]
        yield _rows(RUN, len(blobs), bucket=bucket[start], blob=blobs)


def _away(cols, bucket: int, buckets: int) -> pa.RecordBatch:
    """Where the groups of a bucket stand that were dealt to it from the bucket of their anchor."""
    away = (mix(cols[0].copy()) % U(buckets)).astype(np.int64) != bucket
    anchor, _, _, rid, first, more, _ = (c[away] for c in cols)
    return _rows(DEALT, len(rid), rid=rid, first=first.astype(np.int32), last=more.astype(np.int32), anchor=anchor.view(np.int64))


def _merged(table: DataFrame, history: DataFrame | None, buckets: int, batch: int, width: int, contend: bool) -> DataFrame:
    """The merge-join: new runs (and marks) against historical ones, bucket by bucket."""
    cols = ["bucket", "kind", "anchor", "blob"]
    rows = table.where(F.col("kind").isin(RUN, MARK)).select(*cols)
    if history is not None:
        kind = F.when(F.col("kind") == MARK, OLD_MARK).otherwise(F.col("kind")).alias("kind")
        rows = rows.unionByName(history.where(F.col("kind").isin(RUN, MARK)).select("bucket", kind, "anchor", "blob"))
    rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    def bucket_out(bucket, blobs, marks, old):
        if not (blobs or marks):
            return
        parts = [unpack(b, *KINDS) for b in blobs] or [[np.zeros(0, k) for k in KINDS]]
        cols = _sort([np.concatenate(c) for c in zip(*parts, strict=True)])
        lead = runs(cols[0], cols[1])
        now = cols[6] == batch
        again = ~lead & now
        if again.any():
            rid, a, b = _merge(cols[3][again], cols[4][again], cols[4][again].astype(np.int64) + cols[5][again] + width)
            yield _rows(REPEAT, len(rid), rid=rid, first=a, last=b)
        cols, now = [c[lead] for c in cols], now[lead]
        if contend:
            start = np.flatnonzero(runs(cols[0]))
            size = np.diff(np.append(start, len(cols[0])))
            marks, old = np.unique(np.array(marks, np.int64).view(U)), np.unique(np.array(old, np.int64).view(U))
            anchor = cols[0][start]
            # a mark of this batch stands for new groups that were dealt to other buckets
            fresh = np.isin(anchor, marks)
            if len(start):
                fresh |= np.add.reduceat(now.astype(np.int64), start) > 0
            open_ = np.repeat(((size > 1) | np.isin(anchor, marks) | np.isin(anchor, old)) & fresh, size)
            if open_.any():
                yield _rows(CONTENDED, int(open_.sum()), rid=cols[3][open_], first=cols[4][open_].astype(np.int32), last=cols[5][open_].astype(np.int32), anchor=cols[0][open_].view(np.int64))
            if now.any():
                new = [c[now] for c in cols]
                yield _rows(RUN, 1, bucket=[bucket], blob=[pack(*new)])
                yield _away(new, bucket, buckets)
            unmarked = np.setdiff1d(marks, old)
            yield _rows(MARK, len(unmarked), bucket=np.full(len(unmarked), bucket), anchor=unmarked.view(np.int64))
            woken = np.intersect1d(old, np.union1d(marks, anchor[fresh]))
            yield _rows(WOKEN, len(woken), anchor=woken.view(np.int64))

    def run(batches):
        bucket, blobs, marks, old = None, [], [], []
        for batch_ in batches:
            for b, kind, anchor, blob in zip(*[batch_.column(i).to_pylist() for i in range(4)], strict=True):
                if b != bucket:
                    yield from bucket_out(bucket, blobs, marks, old)
                    bucket, blobs, marks, old = b, [], [], []
                if kind == RUN:
                    blobs.append(blob)
                else:
                    (marks if kind == MARK else old).append(anchor)
        yield from bucket_out(bucket, blobs, marks, old)

    return rows.mapInArrow(trimmed(run), SCHEMA)


class SubstringIndex:
    """Finds the words of new documents that repeat windows of earlier ones.

    Batches count as earlier in the order they come; within a batch the order is doc_id (null last), then the row.
    """

    def __init__(self, spark: SparkSession, width: int = WIDTH, fanout: int = FANOUT, buckets: int | None = None):
        if width < GRAM:
            raise ValueError(f"width must be {GRAM} or more")
        self.spark, self.width, self.fanout = spark, width, fanout
        self.buckets = buckets or shuffle_partitions(spark)
        self.folder, self.steps, self.batch = workspace(spark), 0, 0
        self.table = table_of(self.folder, "texts")
        self.runs: list[DataFrame] = []
        self.repeats: list[DataFrame] = []

    def _write(self, df: DataFrame) -> DataFrame:
        self.steps += 1
        return written(df, f"{self.folder}/{self.steps}")

    def store(self, docs: DataFrame, batch) -> DataFrame:
        """Write docs (doc_id, text and any others) as the table of texts, bucketed by a row id, with a batch number."""
        # a scan deals the same rows to the same tasks each time, so that the ids are stable when a task is repeated
        kept = docs.withColumn("_rid", F.monotonically_increasing_id()).withColumn("_batch", batch)
        kept.repartition(self.buckets, "_rid").write.bucketBy(self.buckets, "_rid").option("compression", "zstd").option("path", f"{self.folder}/texts").mode("append").saveAsTable(self.table)
        release(self.spark)
        return self.spark.table(self.table)

    def add(self, batch: int) -> None:
        """Index the stored documents of one batch, and note what they repeat."""
        width, buckets = self.width, self.buckets
        texts = self.spark.table(self.table)

        def to_runs(batches):
            gathered = _Runs(buckets, width)
            for b in batches:
                doc = b.column(0).fill_null(LAST_ID).to_numpy()
                rid = b.column(1).to_numpy()
                data, offsets = text_buffers(b.column(2))
                for i, j in slices(offsets):
                    anchor, content, text, first, more = groups(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], False), width, GRAM)
                    yield from gathered.add(anchor, content, doc[i:j][text], rid[i:j][text], first, more, np.full(len(first), batch))
            yield from gathered.flush()

        own = texts.where(F.col("_batch") == batch).select(F.col("doc_id").cast("long"), "_rid", F.col("text").cast("string"))
        made = self._write(own.mapInArrow(trimmed(to_runs), SCHEMA))
        history = None
        for run in self.runs:
            history = run if history is None else history.unionByName(run)
        merged = self._write(_merged(made, history, buckets, batch, width, True))
        self.runs.append(merged.where(F.col("kind").isin(RUN, MARK, DEALT)))
        self.repeats += [x.where(F.col("kind") == REPEAT).select("rid", "first", "last") for x in (made, merged)]
        both = made.where(F.col("kind") == CONTENDED).unionByName(merged.where(F.col("kind") == CONTENDED)).select("rid", "first", "last", "anchor")
        if history is not None:
            # each woken anchor has HOT dealt groups or more, so a row for each part of them is no more than those
            part = F.explode(F.sequence(F.lit(0), F.lit(HOT - 1))).alias("part")
            woken = merged.where(F.col("kind") == WOKEN).select("anchor", part)
            dealt = history.where(F.col("kind") == DEALT).withColumn("part", F.pmod(F.xxhash64("rid", "first"), F.lit(HOT)).cast("int"))
            both = both.unionByName(dealt.join(woken, ["anchor", "part"]).select("rid", "first", "last", "anchor"))
        self.repeats.append(self._verified(both, texts, batch))

    def _verified(self, contended: DataFrame, texts: DataFrame, batch: int) -> DataFrame:
        """The windows of contended groups that aren't the first of their kind, as ranges of words."""
        width, buckets = self.width, self.buckets
        by_row = contended.groupBy(F.col("rid").alias("_rid")).agg(F.array_sort(F.collect_set(F.struct("first", "last", "anchor"))).alias("groups"))  # at most one entry for each seven words
        hits = texts.select(F.col("doc_id").cast("long"), "_rid", F.col("text").cast("string"), F.col("_batch").cast("int")).join(by_row.hint("shuffle_hash"), "_rid")

        def windows(batches):
            gathered = _Runs(buckets, width)
            for b in batches:
                rid, doc, of = b.column(0).to_numpy(), b.column(1).fill_null(LAST_ID).to_numpy(), b.column(3).to_numpy()
                data, offsets = text_buffers(b.column(2))
                lists = b.column(4)
                flat, edges = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                first, more, anchor = (flat.field(k).to_numpy() for k in range(3))
                for i, j in slices(offsets):
                    words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], False)
                    own = slice(edges[i], edges[j])
                    row = np.repeat(np.arange(j - i), np.diff(edges[i : j + 1]))
                    n = more[own].astype(np.int64) + 1
                    which = np.repeat(np.arange(len(n)), n)
                    place = first[own][which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row = row[which]
                    at = words.first[row] + place
                    content = spans(prefix_sums(words.hash, WORD_BASE), at, at + width, WORD_BASE)
                    yield from gathered.add(mix(anchor[own].astype(np.int64).view(U)[which] ^ content), content, doc[i:j][row], rid[i:j][row], place, np.zeros(len(at)), of[i:j][row])
            yield from gathered.flush()

        made = self._write(hits.mapInArrow(trimmed(windows), SCHEMA))
        merged = self._write(_merged(made, None, buckets, batch, width, False))
        return made.unionByName(merged).where(F.col("kind") == REPEAT).select("rid", "first", "last")

    def compact(self, least: int | None = None) -> None:
        """Merge the runs into one when there are more than the fanout allows."""
        if len(self.runs) < max(2, self.fanout if least is None else least):
            return
        every = self.runs[0]
        for run in self.runs[1:]:
            every = every.unionByName(run)
        buckets = self.buckets
        rows = every.where(F.col("kind").isin(RUN, MARK)).select("bucket", "blob", "anchor").repartition(buckets, "bucket").sortWithinPartitions("bucket")

        def out(bucket, blobs, marks):
            marks = np.unique(np.array(marks, np.int64))
            yield _rows(MARK, len(marks), bucket=np.full(len(marks), bucket), anchor=marks)
            if blobs:
                cols = _sort([np.concatenate(c) for c in zip(*[unpack(b, *KINDS) for b in blobs], strict=True)])
                lead = runs(cols[0], cols[1])
                cols = [c[lead] for c in cols]
                yield _rows(RUN, 1, bucket=[bucket], blob=[pack(*cols)])
                yield _away(cols, bucket, buckets)

        def run(batches):
            bucket, blobs, marks = None, [], []
            for b in batches:
                for k, blob, anchor in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                    if k != bucket:
                        yield from out(bucket, blobs, marks)
                        bucket, blobs, marks = k, [], []
                    marks.append(anchor) if blob is None else blobs.append(blob)
            yield from out(bucket, blobs, marks)

        self.runs = [self._write(rows.mapInArrow(trimmed(run), SCHEMA))]

    def removed(self) -> DataFrame:
        """_rid and the sorted ranges of its repeated words, for rows that have any."""
        every = self.repeats[0]
        for x in self.repeats[1:]:
            every = every.unionByName(x)
        return every.groupBy(F.col("rid").alias("_rid")).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("_ranges"))

    def result(self, with_text: bool) -> DataFrame:
        """The stored rows with n_words, n_removed, kept_sha256 and, if asked, the kept words as kept_text."""
        texts = self.spark.table(self.table)
        joined = texts.join(self.removed().hint("shuffle_hash"), "_rid", "left").drop("_rid", "_batch")
        names = [c for c in joined.columns if c not in ("_ranges", "text", "n_words", "n_removed", "kept_sha256", "kept_text")]
        joined = joined.select(*names, F.col("text").cast("string").alias("text"), "_ranges")
        n_own = len(names)

        def run(batches):
            for b in batches:
                out = [[] for _ in range(4)]
                for text, ranges in zip(b.column(n_own), b.column(n_own + 1), strict=True):
                    words = (text.as_py() or "").encode("utf-8").split()  # bytes.split splits at exactly the six ASCII spaces
                    n = len(words)
                    ranges = ranges.as_py()
                    if ranges:
                        kept, at = [], 0
                        for r in ranges:
                            if r["first"] > at:
                                kept += words[at : r["first"]]
                            at = max(at, r["last"])
                        words = kept + words[at:]
                    joined_ = b" ".join(words)
                    out[0].append(n)
                    out[1].append(n - len(words))
                    out[2].append(hashlib.sha256(joined_).hexdigest())
                    if with_text:
                        out[3].append(joined_)
                cols = [*b.columns[:n_own], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
                if with_text:
                    cols.append(pa.array(out[3], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

        fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in joined.schema if f.name in names)
        return joined.mapInArrow(run, f"{fields}n_words long, n_removed long, kept_sha256 string{', kept_text string' * with_text}")


def dedup(docs: DataFrame, width: int = WIDTH, batches: int = BATCHES, fanout: int = FANOUT, with_text: bool = True) -> DataFrame:
    """All columns of docs but text, with n_words, n_removed, kept_sha256 and kept_text.

    A word goes if a window of ``width`` words covers it whose word sequence also starts earlier (smaller doc_id, or
    earlier in the same document); windows are judged on the input. Null and empty texts have no words and keep
    nothing; texts shorter than a window keep everything. A null doc_id counts as last; rows that agree in doc_id
    follow each other in the order of the input. No rows give no rows. Columns named like results are replaced.

    The documents are indexed in ``batches`` ranges of doc_id, one after the other.
    """
    spark = docs.sparkSession
    index = SubstringIndex(spark, width, fanout)
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "kept_text", "_rid", "_batch", "_ranges")
    low, high = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
    step = max(1, -(-(high - low + 1) // batches)) if low is not None else 1
    batch = F.coalesce(F.floor((F.col("doc_id").cast("long") - F.lit(low)) / F.lit(step)).cast("int"), F.lit(batches - 1))
    index.store(docs, batch)
    for k in range(batches):
        index.add(k)
        if k < batches - 1:
            index.compact()
    return index.result(with_text)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs.select("doc_id", "text"), with_text=False)


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WIDTH - 2})) AS s FROM d),
w AS (SELECT doc_id, s, array_to_string(ws[s:s + {WIDTH - 1}], ' ') AS k FROM p),
r AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WIDTH})) AS i FROM r),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM x ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
