"""Byte-level BPE by dynamic programming over prefixes.

For a fixed vocabulary every byte prefix of a piece has exactly one valid encoding, and so exactly one valid last
token. The table of these last tokens, one entry a byte, is all the state there is:

* encode: fill the table from left to right. At each end, of the tokens that end there, take the one whose left
  neighbour (the last token of the prefix before it) may stand beside it. Whether a pair may stand together is told by
  undoing the merges next to the border, latest first: at no stage may the two parts that touch merge before the merge
  just undone. Answers are kept.
* append: go on filling. Nothing to the left changes, as an entry depends on its own prefix alone.
* edit: fill again from the first changed byte. Bytes before it keep their entries.

Texts are split by the pretokenizer's pattern first; each match is a piece of its own. The distinct pieces of some texts
are encoded in sorted order, so that each is an append to the prefix it shares with the one before.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import trimmed

KEEP_PIECES = 250_000  # a worker remembers as many pieces that came lately, and the like before; results don't depend on it
GROUP = 1 << 20  # code points of the texts that are split and encoded together


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PrefixBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}  # what a token was merged from last; itself for a byte
        self.reached = {token: rank for token, rank in ranks.items() if self._parts(rank)}
        lengths: dict[bytes, set[int]] = {}  # of the tokens that end in the same three bytes (or are shorter)
        for token in self.reached:
            lengths.setdefault(token[-3:], set()).add(len(token))
        self.lengths = {}
        for tail, own in lengths.items():
            every = own.union(*[lengths.get(tail[k:], ()) for k in range(1, len(tail))])
            self.lengths[tail] = tuple(sorted(every, reverse=True))
        self.pairs: dict[int, bool] = {}

    def _merged(self, piece: bytes, below: int) -> list[bytes]:
        """The tokens that repeated merging of the lowest rank leaves, with ranks under ``below`` alone."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            least, at = below, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and rank < least:
                    least, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge into this one, (token, token) for a byte; None if merging doesn't reach it."""
        if token not in self.parts:
            piece = self.bytes_of[token]
            found = self._merged(piece, token)
            two = len(found) == 2 and all(p in self.ranks and self._parts(self.ranks[p]) for p in found)
            self.parts[token] = (self.ranks[found[0]], self.ranks[found[1]]) if two else (token, token) if len(piece) == 1 else None
        return self.parts[token]

    def _beside(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives both again; both are tokens that merging reaches."""
        ranks, bytes_of = self.ranks, self.bytes_of
        undone = len(bytes_of) + 1 << 20  # the rank of the merge undone last; equal ranks go from left to right
        while True:
            rank = ranks.get(bytes_of[left] + bytes_of[right])
            if rank is not None and rank < undone:
                return False
            inner, outer = self.parts[left][1], self.parts[right][0]
            if inner != left and (left > right or outer == right):
                undone, left = left, inner
            elif outer != right:
                undone, right = right + 1, outer
            else:
                return True

    def extend(self, piece: bytes, last: list[int], start: int = 0) -> list[int]:
        """The table of piece, given that last[:start] is right for its first start bytes."""
        del last[start:]
        token_of, lengths, pairs = self.reached.get, self.lengths.get, self.pairs
        for end in range(start + 1, len(piece) + 1):
            # of the tokens with the last three bytes in common (or fewer, if no token has three), the longest first
            for n in lengths(piece[end - 3 if end > 3 else 0 : end]) or lengths(piece[max(0, end - 2) : end]) or (1,):
                if n >= end:
                    token = token_of(piece[:end]) if n == end else None
                    if token is None:
                        continue
                    last.append(token)
                    break
                token = token_of(piece[end - n : end])
                if token is None:
                    continue
                pair = last[end - n - 1] << 32 | token
                ok = pairs.get(pair)
                if ok is None:
                    if len(pairs) > 1_000_000:
                        pairs.clear()
                    ok = pairs[pair] = self._beside(pair >> 32, token)
                if ok:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return last

    def read_back(self, last: list[int]) -> list[int]:
        """The ids of a table, from its end to its start."""
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= len(self.bytes_of[last[at - 1]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        token = self.reached.get(piece)
        if token is not None:
            return [token]
        return self.read_back(self.extend(piece, []))

    def encode_sorted(self, pieces: list[bytes]):
        """The ids of each piece; sorted pieces share prefixes, and so the tables of these."""
        before, last = b"", []
        for piece in pieces:
            token = self.reached.get(piece)
            if token is not None:
                yield [token]
                continue
            same, most = 0, min(len(before), len(piece))
            while same < most and before[same] == piece[same]:
                same += 1
            before, last = piece, self.extend(piece, last, same)
            yield self.read_back(last)

    def edit(self, old: bytes, last: list[int], new: bytes) -> list[int]:
        """The table of new from that of old: entries before the first changed byte stay."""
        same = next((i for i, (a, b) in enumerate(zip(old, new, strict=False)) if a != b), min(len(old), len(new)))
        return self.extend(new, list(last[:same]), same)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes_of[i] for i in ids)


class TextCodec:
    """Encodes whole texts; pieces that come again are looked up."""

    def __init__(self, vocabulary: PrefixBPE, pattern: str):
        self.bpe, self.split = vocabulary, regex.compile(pattern).findall
        self.decimal = {rank: str(rank).encode() for rank in vocabulary.bytes_of}
        self.kept, self.older = ({}, {}), ({}, {})  # of pieces: the ids in decimals, and the bytes that the ids give

    def texts(self, texts: list[str]):
        """Of each text: its ids in decimals, joined by one space, and the bytes that the ids give."""
        split = list(map(self.split, texts))
        if len(self.kept[0]) > KEEP_PIECES:
            self.kept, self.older = ({}, {}), self.kept
        decimals, given = self.kept
        new = []
        for p in set().union(*split).difference(decimals):
            if p in self.older[0]:
                decimals[p], given[p] = self.older[0][p], self.older[1][p]
            else:
                new.append((p.encode("utf-8"), p))
        new.sort()
        decimal, bytes_of = self.decimal, self.bpe.bytes_of
        for (_, p), ids in zip(new, self.bpe.encode_sorted([b for b, _ in new]), strict=True):
            decimals[p], given[p] = b" ".join([decimal[i] for i in ids]), b"".join([bytes_of[i] for i in ids])
        for pieces in split:
            yield b" ".join(map(decimals.__getitem__, pieces)), b"".join(map(given.__getitem__, pieces))

    def ids(self, text: str) -> list[int]:
        return [int(i) for decimals, _ in self.texts([text]) for i in decimals.split()]


def _groups(column: pa.Array):
    """Texts of a column, nulls as empty ones, about GROUP code points together, one text at least."""
    group, size = [], 0
    for text in column:
        group.append(text.as_py() or "")
        size += len(group[-1])
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


_CODEC: dict[str, TextCodec] = {}  # of a Python worker: the codec of the last run, with the pieces it has met


def _codec(run_id: str, vocabulary: PrefixBPE, pattern: str) -> TextCodec:
    if run_id not in _CODEC:
        _CODEC.clear()
        _CODEC[run_id] = TextCodec(vocabulary, pattern)
    return _CODEC[run_id]


def _parts(edges: np.ndarray, most: int = 1 << 24):
    """Ranges of texts with about ``most`` ids at most, one text at least."""
    i, n = 0, len(edges) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + most, side="right")) - 1)
        yield i, j
        i = j


def encode(docs: DataFrame, ranks_path: str, pattern: str, column: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """key, n_tokens, ids (unless with_ids is false), ids_sha256 and decoded_sha256 of every row.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the bytes that the ids give. A null text
    counts as empty: no tokens, and the digests of nothing. Repeated rows give repeated results; other columns are
    left out. The vocabulary is read and prepared by the driver and broadcast (some 3 MB for 50,000 tokens).
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(PrefixBPE(read_ranks(ranks_path)))
    kind, run_id = docs.schema[key].dataType.simpleString(), uuid.uuid4().hex

    def run(batches):
        codec = _codec(run_id, vocabulary.value, pattern)
        for batch in batches:
            n, ids, shas, backs = [], [], [], []
            for group in _groups(batch.column(1)):
                for decimals, given in codec.texts(group):
                    n.append(decimals.count(b" ") + 1 if decimals else 0)
                    shas.append(hashlib.sha256(decimals).hexdigest())
                    backs.append(hashlib.sha256(given).hexdigest())
                    if with_ids:
                        ids.append(np.array(decimals.split(), np.int32).tobytes())
            out = {key: batch.column(0), "n_tokens": pa.array(n, pa.int64())}
            if with_ids:
                edges = np.cumsum([0, *n])
                for a, b in _parts(edges):  # a batch holds fewer ids than a list's offsets can count
                    flat = pa.array(np.frombuffer(b"".join(ids[a:b]), np.int32))
                    part = {"ids": pa.ListArray.from_arrays(pa.array((edges[a : b + 1] - edges[a]).astype(np.int32)), flat)}
                    rest = {"ids_sha256": pa.array(shas[a:b], pa.string()), "decoded_sha256": pa.array(backs[a:b], pa.string())}
                    yield pa.RecordBatch.from_pydict({key: batch.column(0).slice(a, b - a), "n_tokens": pa.array(n[a:b], pa.int64())} | part | rest)
                continue
            yield pa.RecordBatch.from_pydict(out | {"ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(backs, pa.string())})

    schema = f"{key} {kind}, n_tokens long{', ids array<int>' if with_ids else ''}, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(key), F.col(column).cast("string")).mapInArrow(trimmed(run), schema)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """encoded with the column ``bytes`` that its ids stand for; null ids give null."""
    table = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf("binary")
    def back(column):
        bytes_of = {rank: token for token, rank in table.value.items()}
        return column.map(lambda x: None if x is None else b"".join(bytes_of[i] for i in x))

    return encoded.withColumn("bytes", back(ids))


def op4(spark, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
