"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams (1 to 3 characters; ASCII letters lower-cased, other ASCII characters folded to a
space) of each language in one pass over the training rows; each task sends one row of counts for each language it met,
and these are added up in two levels. The model is a matrix of log probabilities (languages x buckets) of CELLS cells
at most whatever the corpus, and is broadcast: with very many languages there are fewer buckets. Scoring turns each text
into a sparse count vector and multiplies it with the matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, text_buffers, trimmed

BUCKETS = 1 << 14
CELLS = 1 << 23  # bound of the broadcast matrix: 32 MB, 512 languages at 2**14 buckets
SALTS = 64  # parts in which a language's counts are added up first
SMOOTH = 0.5

# Code points: A-Z fold to a-z, other ASCII that is no letter to a space; those above 127 stay.
FOLD = np.full(128, 32, np.uint64)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)


def gram_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram inside a text, and the number of its text; buckets is a power of two."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # characters before each byte
    b = np.where(points < 128, FOLD[np.minimum(points, 127)], points.astype(np.uint64))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first[offsets]))
    found, rows = [], []
    code, space, shift = np.zeros(len(b), np.uint64), b == 32, np.uint64(64 - (buckets.bit_length() - 1))
    for n in (1, 2, 3):
        m = len(b) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint64(21)) + b[n - 1 :] + np.uint64(1)  # a code point has 21 bits at most
        inside = row[:m] == row[n - 1 :]
        if n == 2:
            inside &= ~(space[:m] & space[1:])
        elif n == 3:
            inside &= ~space[1 : m + 1] | ~(space[:m] | space[2:])
        h = code[inside]
        h ^= h >> np.uint64(31)
        found.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64))
        rows.append(row[:m][inside])
    return (np.concatenate(found), np.concatenate(rows)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def train(rows: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log P(bucket | language), learned from all rows with a text and a language.

    Priors are uniform: how often a language was crawled says nothing about one text. No rows give no languages.
    There are ``buckets`` buckets (a power of two), or as many fewer as keep the matrix within CELLS cells.
    """

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            which = {x: i for i, x in enumerate(names)}
            of = np.array([which[x] for x in langs], np.int64)
            data, offsets = text_buffers(batch.column(0))
            for i, j in slices(offsets):
                h, r = gram_buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)
                counts = np.bincount(of[i:j][r] * buckets + h, minlength=len(names) * buckets).reshape(len(names), buckets)
                for k in np.unique(of[i:j]):
                    totals[names[k]] = totals.get(names[k], 0) + counts[k]
        if totals:
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(totals), pa.string()), "counts": pa.array([v.astype("<i8").tobytes() for v in totals.values()], pa.binary())})

    known = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).cast("string"), F.col(lang).cast("string"))
    n = rows.where(F.col(text).isNotNull()).agg(F.count_distinct(F.col(lang).cast("string"))).first()[0]
    while buckets > 2 and n * buckets > CELLS:
        buckets //= 2
    parts = known.mapInArrow(trimmed(count), "lang string, counts binary")

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[name] = sums.get(name, 0) + np.frombuffer(blob, "<i8")
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "counts": pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())})

    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")
    for keys in ((F.col("lang"), salt), (F.col("lang"),)):  # a row of each language is left, which the driver collects
        parts = parts.repartition(*keys).mapInArrow(add, "lang string, counts binary")
    total = {r["lang"]: np.frombuffer(r["counts"], "<i8") for r in parts.collect()}
    names = sorted(total)
    if not names:
        return [], np.zeros((0, buckets), np.float32)
    counts = np.stack([total[x] for x in names]).astype(np.float64) + SMOOTH
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the posterior of the predicted language.

    ``und`` and 0 where the text is null or has no letter, or the model knows no language. Ties go to the first
    language by name. A column named lang_pred or score is replaced.
    """
    names, matrix = model
    sent = docs.sparkSession.sparkContext.broadcast((names, np.ascontiguousarray(matrix.T)))
    buckets = matrix.shape[1]
    kept = docs.drop("lang_pred", "score")
    at = kept.columns.index(text)

    def run(batches):
        names, weights = sent.value
        for batch in batches:
            column = batch.column(at)
            data, offsets = text_buffers(column)
            scores = np.zeros((len(column), max(1, len(names))))
            for i, j in slices(offsets):
                h, r = gram_buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)
                if not len(h) or not names:
                    continue
                cells = np.bincount(r * buckets + h, minlength=0) if (j - i) * buckets <= 1 << 23 else None
                if cells is not None:
                    keys = np.flatnonzero(cells)
                    n = cells[keys]
                else:
                    keys, n = np.unique(r * buckets + h, return_counts=True)
                part = weights[keys % buckets] * n[:, None]
                rows = keys // buckets
                starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                scores[i + rows[starts]] = np.add.reduceat(part.astype(np.float64), starts, axis=0)
            best = scores.argmax(axis=1)
            top = scores.max(axis=1, keepdims=True)
            p = 1.0 / np.exp(scores - top).sum(axis=1)
            letters = np.array([bool(names) and x is not None and _has_letter(x) for x in _heads(column)], bool) if len(column) else np.zeros(0, bool)
            pred = [names[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            cols = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            yield pa.RecordBatch.from_pydict(cols | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(np.where(letters, p, 0.0), pa.float64())})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(trimmed(run), f"{fields}, lang_pred string, score double")


def _heads(column):
    for x in column:
        yield x.as_py()


def _has_letter(s: str) -> bool:
    return any(c.isalpha() for c in s)


def held_out(key: str = "doc_id"):
    """The fifth of the rows that training never sees."""
    return (F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0) & F.col(key).isNotNull()


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return train(docs.where(~held_out()))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learned(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
