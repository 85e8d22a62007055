"""SimHash near-dedup with pigeonring filtering.

A document's 64-bit fingerprint has a bit set where over half of its word-shingle hashes (XXH64,
seed 42) have it. Equal fingerprints are one class. Fingerprints within ``BITS`` = 2 bits are found
on a ring of four segments of 16 bits: if the whole differs in at most 2 bits, some segment starts a
chain whose first l segments differ in at most l * 2 / 4 bits for every l, that is 0, 1, 1, 2. Such a
chain has two equal segments, so each of the six pairs of segments is a join key of 32 bits. Of the
pairs that meet, only those with a chain get the full Hamming check.

A key shared by more than ``CROWD`` distinct fingerprints is split: the bits outside it still differ in
at most 2, so of three parts of them one is equal and joins the key. This is repeated until no key is
crowded or at most ``LEAST_REST`` bits are left, of which there are no more values than ``CROWD``. So
no group is large and no pair is lost, whatever the crowd. Links go to connected components; copies
are never expanded into pairs.

Defined results: null or wordless texts have fingerprint zero and link like any other; a text with
fewer words than a shingle is one shingle; texts of any length are taken whole, ``STEP`` shingles at a
time. Rows are deduplicated by nothing: repeated rows each get their row. A null doc_id is nobody's
smallest id; where a component has no other, component_id is null. An empty table gives an empty
table. Other columns of the input, whatever their names, play no part and are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import join_hot, release, save, scratch

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORDS, SEED, BITS = 3, 42, 2
SEGMENTS, WIDTH = 4, 16
CROWD, LEAST_REST = 256, 8
STEP = 1 << 15  # shingles hashed at a time


def fingerprint(text: str | None, words: int = WORDS) -> int:
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(found) <= words:
        return h64(b" ".join(found), SEED)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(found) - words + 1
    ones = np.zeros(64, np.int64)
    for k in range(0, n, STEP):
        z = min(n, k + STEP)
        h = np.array([h64(joined[a:e], SEED) for a, e in zip(starts[k:z].tolist(), ends[k + words - 1 : z + words - 1].tolist())], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed integer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, words) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _ring_masks() -> list[int]:
    """The six pairs of segments."""
    part = [((1 << WIDTH) - 1) << (WIDTH * i) for i in range(SEGMENTS)]
    return [part[i] | part[j] for i in range(SEGMENTS) for j in range(i)]


def _narrower(mask: int) -> list[int]:
    """``mask`` with each third of the bits outside it; none if few are left."""
    rest = [b for b in range(64) if not mask >> b & 1]
    if len(rest) <= LEAST_REST:
        return []
    cuts = [len(rest) * k // (BITS + 1) for k in range(BITS + 2)]
    return [mask | sum(1 << b for b in rest[a:z]) for a, z in zip(cuts, cuts[1:])]


def has_chain(differ: Column) -> Column:
    """True if some segment of the ring starts a chain within the proportional budgets."""
    d = [F.bit_count(F.shiftrightunsigned(differ, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1))) for i in range(SEGMENTS)]
    out = F.lit(False)
    for i in range(SEGMENTS):
        sums, ok = F.lit(0), F.lit(True)
        for n in range(SEGMENTS):
            sums = sums + d[(i + n) % SEGMENTS]
            ok = ok & (sums <= (n + 1) * BITS // SEGMENTS)
        out = out | ok
    return out


def links(spark: SparkSession, distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """All pairs a < b of distinct fingerprints (column fp) within two bits."""
    masks, found = _ring_masks(), None
    keyed = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    while masks:
        keyed = keyed.withColumn("val", F.col("fp").bitwiseAND(F.col("mask")))
        counted = keyed.groupBy("mask", "val").agg(F.count("*").alias("n")).where("n >= 2")
        shared = save(spark, keyed.join(counted, ["mask", "val"]), "segments")
        children = {m: _narrower(m) for m in masks}
        last = F.col("mask").isin([_signed(m) for m, c in children.items() if not c])
        few = shared.where((F.col("n") <= crowd) | last)
        x, y = few.select("mask", "val", F.col("fp").alias("a")), few.select("mask", "val", F.col("fp").alias("b"))
        differ = F.col("a").bitwiseXOR(F.col("b"))
        near = x.join(y, ["mask", "val"]).where((F.col("a") < F.col("b")) & has_chain(differ) & (F.bit_count(differ) <= BITS)).select("a", "b")
        found = near if found is None else found.unionAll(near)
        many = shared.where((F.col("n") > crowd) & ~last)
        masks = sorted({c for cs in children.values() for c in cs})
        if not masks or many.isEmpty():
            break
        narrower = F.create_map(*[x for m, cs in children.items() if cs for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in cs]))])
        keyed = many.select("fp", F.explode(narrower[F.col("mask")]).alias("mask")).distinct()
    return found.distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    fps = save(spark, fingerprints(docs, id_col, text_col, words), "fingerprints")
    with scratch(spark):
        distinct = save(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct")
        comp = connected_components(spark, links(spark, distinct, crowd))
        labelled = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("component"))
        least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
        of_fp = save(spark, labelled.join(least, "component").select("fp", "n", "component_id"), "labels", keep=True)
    return join_hot(fps, of_fp, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, str, int]]:
    """All pairs, for tests."""
    fps = [(i, fingerprint(t)) for i, t in rows]
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, f) in enumerate(fps):
        for j, g in fps[:k]:
            if (f ^ g).bit_count() <= BITS:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, f"{f:016x}", find(i)) for i, f in fps]
