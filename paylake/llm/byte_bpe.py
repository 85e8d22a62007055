"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte positions. Every adjacent pair with a merge rank waits in the
bucket of that rank; a two-level bitmap over the ranks (words in use, ranks in use within a word)
gives the lowest rank in use by two find-first-set steps, whatever the length. The positions of that
bucket are merged leftmost first; entries whose pair has changed meanwhile are stale and skipped. So
a pre-token of n bytes costs O(n log n) at most, also when it is megabytes long. The new pre-tokens
of many texts lie end to end and share one queue, so a rank is found once for all of them.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes.
Rows are independent of each other, so ties and repeated rows need no rule. Input columns named as
an output column are replaced.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import PieceEncoder
from .shared import bounded, release, without

RANKS = "byte_bpe_50k.tiktoken"


WIDTH = 8  # a word of the lower bitmap has 2 ** WIDTH ranks
BIT = [1 << k for k in range(1 << WIDTH)]
MASK = (1 << WIDTH) - 1
MOST_KNOWN = 120_000
LONG = 1 << 20  # bytes from which the lists of positions are packed arrays


class RankQueue:
    """Buckets of positions by rank under a two-level bitmap."""

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}  # ranks in use, by word
        self.top = 0  # words in use

    def open(self, rank: int, positions: list[int]) -> None:
        """Puts a bucket into use."""
        self.buckets[rank] = positions
        w = rank >> WIDTH
        if w in self.low:
            self.low[w] |= BIT[rank & MASK]
        else:
            self.low[w] = BIT[rank & MASK]
            self.top |= 1 << w

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank in use and its positions, leftmost first."""
        w = (self.top & -self.top).bit_length() - 1
        x = self.low[w]
        rank = (w << WIDTH) + (x & -x).bit_length() - 1
        if x := x & (x - 1):
            self.low[w] = x
        else:
            del self.low[w]
            self.top &= self.top - 1
        b = self.buckets.pop(rank)
        b.sort()
        return rank, b


def merge(pieces: list[bytes], ranks: dict[bytes, int], bytes_id: np.ndarray, pairs: np.ndarray) -> list[bytes]:
    """Ids of each pre-token (none empty), as little-endian 32-bit integers. The pre-tokens lie end to end and share
    one queue; they do not touch each other, so each sees its own pairs in order of rank."""
    get = ranks.get
    data = b"".join(pieces)
    n = len(data)
    ends = np.cumsum([len(p) for p in pieces])
    first = bytearray(n + 1)  # 1 where a pre-token starts
    np.frombuffer(first, np.uint8)[np.r_[0, ends]] = 1
    code = np.frombuffer(data, np.uint8)
    ids = bytes_id[code]
    rank = np.full(n, -1, np.int32)
    rank[:-1] = pairs[code[:-1].astype(np.int32) << 8 | code[1:]]
    rank[ends - 1] = -1
    hold = np.ndarray.tolist if n < LONG else lambda x: array("i", x.astype(np.int32).tobytes())
    end, prev, rank_at, id_at = hold(np.arange(1, n + 1)), hold(np.arange(-1, n - 1)), hold(rank), hold(ids)
    alive = bytearray(b"\1") * n
    queue = RankQueue()
    order = np.argsort(rank, kind="stable")
    order = order[np.searchsorted(rank[order], 0) :]
    cuts = np.flatnonzero(np.diff(rank[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        queue.open(int(rank[part[0]]), part.tolist())
    buckets = queue.buckets
    while queue.top:
        now, bucket = queue.pop()
        for k, i in enumerate(bucket):
            if rank_at[i] != now:
                continue  # stale
            j = end[i]
            end[i] = e = end[j]
            rank_at[j] = -1
            alive[j] = 0
            id_at[i] = now
            if first[e]:
                r = -1
            else:
                prev[e] = i
                r = get(data[i : end[e]], -1)
            rank_at[i] = r
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    queue.open(r, [i])
            s = -1
            if not first[i]:
                p = prev[i]
                s = get(data[p:e], -1)
                if s >= 0 and rank_at[p] != s:
                    if s in buckets:
                        buckets[s].append(p)
                    else:
                        queue.open(s, [p])
                rank_at[p] = s
            if 0 <= r < now or 0 <= s < now:  # a lower rank came up: it goes before the rest of this bucket
                if k + 1 < len(bucket):
                    queue.open(now, bucket[k + 1 :])
                break
    live = np.frombuffer(alive, np.uint8)
    out = np.array(id_at, np.int32)[live == 1].astype("<i4").tobytes()
    upto = (np.cumsum(live, dtype=np.int64)[ends - 1] * 4).tolist()
    return [out[a:z] for a, z in zip([0, *upto], upto)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """Rank of each pair of bytes, -1 for none; index: first byte * 256 + second byte."""
    out = np.full(65536, -1, np.int32)
    for k, r in ranks.items():
        if len(k) == 2:
            out[k[0] << 8 | k[1]] = r
    return out


@functools.lru_cache(2)
def _encoder(path: str, pattern: str) -> tuple[PieceEncoder, pa.Array]:
    ranks, cut = load_ranks(path), regex.compile(pattern)
    pairs, bytes_id = byte_pairs(ranks), np.array([ranks[bytes([k])] for k in range(256)], np.int32)
    vocab = [b""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        vocab[v] = k
    known: dict[str, bytes] = {}  # pieces met lately, for texts that are not cut at blanks

    def ids(text: str) -> np.ndarray:
        found = cut.findall(text)
        own, new, pieces = {}, [], []
        for p in set(found):
            if p in known:
                own[p] = known[p]
            elif (whole := ranks.get(b := p.encode("utf-8", "surrogatepass"))) is not None:
                own[p] = whole.to_bytes(4, "little")
            else:
                new.append(p)
                pieces.append(b)
        if new:
            own.update(zip(new, merge(pieces, ranks, bytes_id, pairs)))
        if len(known) > MOST_KNOWN:
            known.clear()
        known.update(own)
        return np.frombuffer(b"".join([own[p] for p in found]), "<i4")

    return PieceEncoder(ids, np.array([len(x) for x in vocab])), pa.array(vocab, pa.binary())


def _lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _bytes_of(lists: pa.Array, vocab: pa.Array) -> pa.Array:
    """What each list of ids stands for: the tokens lie end to end, so a document is a cut of them."""
    tokens = vocab.take(lists.flatten())
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
    at = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset + ends]
    return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at.tobytes()), tokens.buffers()[2]])


def encode(docs: DataFrame, text_col: str = "text", out: str = "ids", path: str | None = None, pattern: str | None = None, decoded: str | None = None, drop_text: bool = False) -> DataFrame:
    """Adds the token ids of ``text_col`` (array of int), and what they decode to as column
    ``decoded`` if that is named. Runs where the rows are; no shuffle."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    bounded(docs.sparkSession)
    docs = without(docs, out, *[decoded] * bool(decoded))
    t = docs.columns.index(text_col)
    keep = [k for k in range(len(docs.columns)) if not (drop_text and k == t)]
    schema = T.StructType([*[docs.schema.fields[k] for k in keep], T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    if decoded:
        schema = schema.add(decoded, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, vocab = _encoder(path, pattern)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                ids = _lists(enc.texts(b.column(t).cast(pa.string())))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], ids, *[_bytes_of(ids, vocab)] * bool(decoded)], names=schema.names)
                del ids, b
            del whole
            release()

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the bytes that the ids of ``ids_col`` stand for; null ids count as none."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    bounded(tokens.sparkSession)
    tokens = without(tokens, out)
    c = tokens.columns.index(ids_col)
    schema = T.StructType([*tokens.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, vocab = _encoder(path, pattern)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([*b.columns, _bytes_of(b.column(c), vocab)], names=schema.names)

    return tokens.mapInArrow(run, schema)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ids`` and ``decoded`` of each document, in one pass."""
    return encode(docs.select(id_col, text_col), text_col, decoded="decoded", drop_text=True)


def digests(tokens: DataFrame) -> DataFrame:
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
