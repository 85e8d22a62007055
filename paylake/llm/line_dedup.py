"""Line dedup by a sharded minimal perfect hash over distinct line hashes.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased. Keys
are known by 128 bits of hash. One aggregation counts the documents of each key; keys in two or
more documents are dealt to shards by hash, and each shard becomes a minimal perfect hash (levels
of bit arrays with ranks) that indexes three arrays: a 64-bit fingerprint, the number of
documents, and the largest id holding the line. The shards are files in the shared folder.

The documents' line hashes (never lines or texts) are dealt to the shards and probe the arrays there: a task
reads one shard after another, each once, and a shard with a very common line is several tasks. Only the
places of lines that go come back, as one file for each partition of the documents, which are then read again
in place: texts are not shuffled. A key that no shard holds meets a foreign fingerprint and is left alone.

Defined results: a null or empty text has one empty line; a text of any length is taken whole. Each row is a
document of its own, so rows that repeat a doc_id each count; all rows with the largest doc_id keep the line. A null
doc_id never holds a line but counts as a document. An empty table gives an empty table. Input
columns named as an output column are replaced.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import FileCache, new_name, open_fs, read_file, release, save, scratch, shared_folder, without, write_file

STRIP = " \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
KEYS_PER_SHARD = 1 << 18
LEAST_SHARDS = 16
PROBES = 1 << 21  # of a shard in one task
LEVELS = 40


def line_keys(text: str, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, 16 bytes of key hash) of the lines long enough to be dropped."""
    out = []
    for i, line in enumerate(text.split("\n")):
        if len(line) >= min_chars and len(key := line.strip(STRIP)) >= min_chars:
            out.append((i, xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").translate(LOWER))))
    return out


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys; keys that do not settle (equal in all 64 bits)
    go to a short list searched exactly by fingerprint."""

    def __init__(self, words, ranks, starts, fp, count, holder, odd):
        self.words, self.ranks, self.starts, self.fp, self.count, self.holder, self.odd = words, ranks, starts, fp, count, holder, odd

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, holder: np.ndarray, gamma: float = 1.7) -> PerfectHash:
        left = np.arange(len(h1))
        words, starts, order = [], [0], []
        for level in range(LEVELS):
            if not len(left):
                break
            m = max(64, -(-int(len(left) * gamma) // 64) * 64)
            at = (_mix(h1[left], level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m)[at] == 1
            bits = np.zeros(m, np.uint8)
            bits[at[alone]] = 1
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            starts.append(starts[-1] + m // 64)
            order.append(left[alone][np.argsort(at[alone])])
            left = left[~alone]
        w = np.concatenate(words) if words else np.zeros(0, "<u8")
        n = np.bitwise_count(w).astype(np.int64)
        o = np.concatenate([*order, left]).astype(np.int64) if len(h1) else np.zeros(0, np.int64)
        return cls(w, (np.cumsum(n) - n).astype("<u4"), np.array(starts, "<i8"), h2[o].astype("<u8"), np.minimum(count[o], 0xFFFFFFFF).astype("<u4"), holder[o].astype("<i8"), len(left))

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Index of each key, -1 for keys that are not held."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level in range(len(self.starts) - 1):
            if not len(left):
                break
            lo, hi = int(self.starts[level]), int(self.starts[level + 1])
            at = _mix(h1[left], level) % np.uint64((hi - lo) * 64)
            word, bit = lo + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            w = self.words[word]
            hit = (w >> bit) & np.uint64(1) == 1
            k = left[hit]
            below = np.bitwise_count(w[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            i = self.ranks[word[hit]].astype(np.int64) + below
            out[k] = np.where(self.fp[i] == h2[k], i, -1)
            left = left[~hit]
        n = len(self.fp)
        for j in range(n - self.odd, n):
            out[left[h2[left] == self.fp[j]]] = j
        return out

    def to_bytes(self) -> bytes:
        parts = [self.words, self.ranks, self.starts, self.fp, self.count, self.holder]
        head = json.dumps({"odd": self.odd, "parts": [[p.dtype.str, len(p)] for p in parts]}).encode()
        head += b" " * (-(len(head) + 8) % 8)
        return b"".join([struct.pack("<q", len(head)), head, *(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)])

    @classmethod
    def from_bytes(cls, buf) -> PerfectHash:
        n = struct.unpack_from("<q", buf)[0]
        head, at, parts = json.loads(bytes(buf[8 : 8 + n])), 8 + n, []
        for kind, size in head["parts"]:
            parts.append(a := np.frombuffer(buf, kind, size, at))
            at += a.nbytes + -a.nbytes % 8
        return cls(*parts, head["odd"])


def line_hashes(docs: DataFrame, id_col: str, text_col: str, row_col: str, min_chars: int) -> DataFrame:
    """A row for each line long enough to be dropped: h1, h2, id, row, line and first (of its key in the document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for z in range(0, whole.num_rows, 1000):
                b = whole.slice(z, 1000)
                keys, lines, first, lens = [], [], [], []
                for text in b.column(2).to_pylist():
                    own, seen = line_keys(text, min_chars) if text else [], set()
                    for i, k in own:
                        lines.append(i)
                        keys.append(k)
                        first.append(k not in seen)
                        seen.add(k)
                    lens.append(len(own))
                if keys:
                    h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                    at = pa.array(np.repeat(np.arange(b.num_rows), lens))
                    yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), b.column(0).take(at), b.column(1).take(at), pa.array(lines, pa.int32()), pa.array(first)], names=["h1", "h2", "id", "row", "line", "first"])
        release()

    return docs.select(F.col(id_col).cast("long"), row_col, F.col(text_col).cast("string")).mapInArrow(run, "h1 long, h2 long, id long, row long, line int, first boolean")


def line_index(spark: SparkSession, lines: DataFrame) -> dict:
    """Builds the shards over ``line_hashes``; returns their folder, number, and the tasks that probing each needs."""
    often = lines.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max(F.coalesce("id", F.lit(-(2**63)))).alias("holder")).where("n >= 2")
    often = save(spark, often, "line-keys")
    shards = max(LEAST_SHARDS, -(-often.count() // KEYS_PER_SHARD))
    folder = shared_folder(spark, "line-index")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        s, h1, h2, n, holder = (t.column(i).to_numpy() for i in range(5))
        for shard in np.unique(s):
            k = s == shard
            data = PerfectHash.build(h1[k].view(np.uint64), h2[k].view(np.uint64), n[k], holder[k]).to_bytes()
            write_file(f"{folder}/{shard}", data)
            yield pa.RecordBatch.from_arrays([pa.array([int(shard)], pa.int32()), pa.array([int(k.sum())]), pa.array([int(n[k].sum())]), pa.array([len(data)])], names=["shard", "keys", "lines", "bytes"])

    dealt = often.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1", "h2", "n", "holder").repartition(shards, "shard")
    built = save(spark, dealt.mapInArrow(build, "shard int, keys long, lines long, bytes long"), "line-shards")  # one row a shard
    return {"folder": folder, "shards": shards, "built": built}


def dropped(spark: SparkSession, lines: DataFrame, index: dict, min_docs: int) -> DataFrame:
    """row and line of the lines that go."""
    folder, shards = index["folder"], index["shards"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = FileCache(lambda uri: PerfectHash.from_bytes(read_file(uri)), 2)
        for b in batches:
            shard, h1, h2, row, line = (b.column(k).to_numpy() for k in range(5))
            ids = b.column(5).fill_null(0).to_numpy(zero_copy_only=False)
            known = np.asarray(b.column(5).is_valid())
            gone = np.zeros(len(row), bool)
            for s in np.unique(shard):
                k = np.flatnonzero(shard == s)
                x = cache.get(f"{folder}/{s}")
                at = x.find(h1[k].view(np.uint64), h2[k].view(np.uint64))
                k, at = k[at >= 0], at[at >= 0]
                gone[k] = (x.count[at] >= min_docs) & ~(known[k] & (x.holder[at] == ids[k]))
            if gone.any():
                yield pa.RecordBatch.from_arrays([pa.array(row[gone]), pa.array(line[gone])], names=["row", "line"])
        release()

    tasks = index["built"].select("shard", F.ceil(F.col("lines") / PROBES).alias("tasks"))  # shards without keys are not probed
    many = max(shards, tasks.agg(F.coalesce(F.sum("tasks"), F.lit(1))).first()[0])
    routed = lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).join(F.broadcast(tasks), "shard").withColumn("task", F.pmod(F.xxhash64("row"), F.col("tasks")))
    routed = routed.repartition(many, "shard", "task").sortWithinPartitions("shard")
    return routed.select("shard", "h1", "h2", "row", "line", "id").mapInArrow(probe, "row long, line int")


def line_dedup(spark: SparkSession, docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines found in ``min_docs`` or more documents, except where the largest id holds
    them, and with ``n_lines`` (before) and ``n_dropped``."""
    docs = without(docs, "n_lines", "n_dropped")
    row_col = new_name(docs, "row_of_docs")
    rows = save(spark, docs.withColumn(row_col, F.monotonically_increasing_id()), "documents")
    folder = shared_folder(spark, "dropped")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def close() -> pa.RecordBatch:
            row, line = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            order = np.lexsort((line, row))
            write_file(f"{folder}/{part}", np.array([len(row)], "<i8").tobytes() + row[order].astype("<i8").tobytes() + line[order].astype("<i4").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64())], names=["part"])

        for b in batches:
            parts, row, line = (b.column(k).to_numpy() for k in range(3))
            for p in np.unique(parts):
                if p != part and held:
                    yield close()
                    held = []
                part, k = int(p), parts == p
                held.append((row[k], line[k]))
        if held:
            yield close()

    # rows of one partition of the documents have equal upper bits, so a group is as bounded as a partition
    with scratch(spark):
        lines = save(spark, line_hashes(rows, id_col, text_col, row_col, min_chars), "lines")
        gone = dropped(spark, lines, line_index(spark, lines), min_docs).withColumn("part", F.shiftright("row", 33))
        gone.select("part", "row", "line").repartition("part").sortWithinPartitions("part").mapInArrow(collect, "part long").write.format("noop").mode("overwrite").save()

    t, at = rows.columns.index(text_col), rows.columns.index(row_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def load(uri: str):
        fs, path = open_fs(uri)
        if not fs.get_file_info(path).is_file:
            return np.empty(0, "<i8"), np.empty(0, "<i4")
        data = read_file(uri)
        n = int(np.frombuffer(data, "<i8", 1)[0])
        return np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<i4", n, 8 + 8 * n)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = FileCache(load, 4)
        for whole in batches:
            for z in range(0, whole.num_rows, 1000):
                b = whole.slice(z, 1000)
                texts, row = b.column(t).cast(pa.string()).to_pylist(), b.column(at).to_numpy()
                n_dropped = np.zeros(len(row), np.int64)
                n_lines = [x.count("\n") + 1 if x else 1 for x in texts]
                for p in np.unique(row >> 33):
                    rows_gone, lines_gone = cache.get(f"{folder}/{p}")
                    k = np.flatnonzero(row >> 33 == p)
                    lo, hi = np.searchsorted(rows_gone, row[k]), np.searchsorted(rows_gone, row[k], "right")
                    for j, a, e in zip(k[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                        off = set(lines_gone[a:e].tolist())
                        n_dropped[j] = len(off)
                        texts[j] = "\n".join(x for n, x in enumerate(texts[j].split("\n")) if n not in off)
                cols = [pa.array(texts, b.column(t).type) if k == t else b.column(k) for k in range(b.num_columns) if k != at]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped)], names=schema.names)
                del b, texts, cols
            release()

    return rows.mapInArrow(cut, schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(spark, docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], min_docs: int = 5, min_chars: int = 40) -> list[tuple[int, int, int, str]]:
    """The same by dictionaries of whole lines, for tests."""

    def key(line: str) -> str:
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(STRIP))

    held: dict[str, list] = {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held.setdefault(k, []).append(-(2**63) if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(k := key(x)) < min_chars or len(held[k]) < min_docs or max(held[k]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
lines AS (
  SELECT row, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM d),
keyed AS (
  SELECT row, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
counts AS (
  SELECT k, count(DISTINCT row) AS n, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT row) >= 5)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE n IS NOT NULL AND holder IS DISTINCT FROM doc_id))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE n IS NULL OR holder = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN counts USING (k) GROUP BY row, doc_id
"""
