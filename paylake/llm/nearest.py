"""Approximate nearest neighbours by inner product over robust-pruned directed graphs.

Vectors are dealt to shards by hash. Each shard becomes one graph: every vector gets one more
component so that all have the same length (the largest inner product is then the nearest vector),
batches of vectors search the graph so far for neighbours, and pruning relaxed by alpha keeps
diverse ones. An audit of each shard compares a sample of its own vectors with brute force and
widens that shard's beam until ``AUDIT`` of their neighbours are found. Queries come in blocks;
every block searches every shard by beam search, candidates are scored again in double precision on
the original vectors, and the best 20 of all shards remain: first of those that a task searches, then of
all. Shards and blocks are files in the shared folder; a task holds one shard and one block at a time.

Equal vectors are one node that carries its smallest ids, so a vector with very many copies neither
fills the beams nor one task.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor
those of another dimension than most of ``vectors`` have, be they queries or candidates, nor null ids. Rows that repeat a vec_id count once (the
least vector). Other columns, whatever their names, play no part. Ties go to the smaller vec_id. With fewer candidates than 20 all found are returned;
an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graphs import Vamana, packed, unpacked
from .shared import FileCache, read_file, save, shared_folder, write_file

TOP = 20
SHARD, LEAST_SHARDS = 1 << 15, 12
BLOCK, LEAST_BLOCKS = 1024, 2
LEAST_TASKS, MOST_MERGED = 64, 32  # a task searches several shards for a block, so many as leave LEAST_TASKS tasks
WIDTH, AUDIT, AUDITED = 64, 0.97, 64
MOST_TASKS = 20_000


def is_usable(vec_col: str = "embedding") -> Column:
    """True for vectors that are not null or zero and hold finite components only."""
    v = F.col(vec_col)
    ok = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return F.coalesce(ok, F.lit(False))


def dimension(df: DataFrame, vec_col: str = "embedding") -> int:
    """The commonest number of components of usable vectors (of equally common ones the least); 0 if there is none."""
    dims = df.where(is_usable(vec_col)).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return dims.d if dims else 0


def usable(df: DataFrame, dim: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The rows that take part, by the rules above."""
    good = df.where(F.col(id_col).isNotNull())
    return good.where(is_usable(vec_col) & (F.size(vec_col) == (dimension(good, vec_col) if dim is None else dim)))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as (rows x dimensions)."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision."""
    return (a.astype(np.float64) * b.astype(np.float64)).sum(-1)


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    rows = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(rows).combine_chunks() if rows else None


def build_shards(spark: SparkSession, classes: DataFrame, shards: int, folder: str, top: int, width: int) -> list[int]:
    """``classes``: ids (smallest ids, ascending), embedding. Returns the numbers of the shards that hold vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (t := _table(batches)) is None:
            return
        shard, ids, v = t.column(0).to_numpy(), t.column(1).to_pylist(), matrix(t.column(2).combine_chunks())
        for s in np.unique(shard):
            k = np.flatnonzero(shard == s)
            own = np.full((len(k), top + 1), -1, np.int64)
            for r, j in enumerate(k):
                own[r, : len(ids[j])] = ids[j]
            o = np.argsort(own[:, 0])
            k, own = k[o], own[o]
            size = np.sqrt(exact(v[k], v[k]))
            x = np.c_[v[k], np.sqrt(np.maximum(size.max() ** 2 - size**2, 0))] / size.max()
            g = Vamana.build(x.astype(np.float32))
            sample = np.random.default_rng(1).choice(len(k), min(AUDITED, len(k)), replace=False)
            q = np.c_[v[k[sample]] / size[sample, None], np.zeros(len(sample))].astype(np.float32)
            want = np.argsort(-(q @ g.x.T), axis=1, kind="stable")[:, :top]
            wide = width
            while wide < len(k):
                got, _ = g.search(q, wide)
                if np.mean([len(np.intersect1d(a, b)) / len(a) for a, b in zip(want, got)]) >= AUDIT:
                    break
                wide *= 2
            write_file(f"{folder}/{s}", packed(x=g.x, adj=g.adj, entry=np.array(g.entry), ids=own, v=v[k], wide=np.array(wide)))
            yield pa.RecordBatch.from_arrays([pa.array([int(s)]), pa.array([len(k)])], names=["shard", "n"])

    dealt = classes.select(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int").alias("shard"), "ids", "embedding").repartition(shards, "shard")
    return sorted(r.shard for r in dealt.mapInArrow(run, "shard long, n long").collect())  # one row a shard


def write_blocks(queries: DataFrame, blocks: int, folder: str) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (t := _table(batches)) is None:
            return
        block, ids, v = t.column(0).to_numpy(), t.column(1).to_numpy(), matrix(t.column(2).combine_chunks())
        for b in np.unique(block):
            k = np.flatnonzero(block == b)
            write_file(f"{folder}/{b}", packed(ids=ids[k], v=v[k]))
            yield pa.RecordBatch.from_arrays([pa.array([int(b)]), pa.array([len(k)])], names=["block", "n"])

    dealt = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "embedding").repartition(blocks, "block")
    return sorted(r.block for r in dealt.mapInArrow(run, "block long, n long").collect())


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, top: int = TOP, shard: int = SHARD, width: int = WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` found for each query among the vectors of other ids.
    Both have vec_id and embedding."""
    dim = dimension(vectors.where("vec_id is not null"))
    once = lambda df: usable(df.select("vec_id", "embedding"), dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # rank limits are applied before and after the shuffle: a vector's copies never meet in one task
    w = Window.partitionBy("embedding").orderBy("vec_id")
    least = once(vectors).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top + 1)
    classes = save(spark, least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    asked = save(spark, once(queries), "queries")
    shards = max(LEAST_SHARDS, -(-classes.count() // shard))
    blocks = max(LEAST_BLOCKS, -(-asked.count() // BLOCK))
    at, ask = shared_folder(spark, "graphs"), shared_folder(spark, "blocks")
    have, want = build_shards(spark, classes, shards, at, top, width), write_blocks(asked, blocks, ask)
    if not have or not want:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    merged = max(1, min(MOST_MERGED, len(have) * len(want) // LEAST_TASKS))
    groups = -(-len(have) // merged)
    n = groups * len(want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = FileCache(lambda uri: unpacked(read_file(uri)), 1)
        for b in batches:
            for k in b.column(0).to_pylist():
                q = unpacked(read_file(f"{ask}/{want[k // groups]}"))
                ids, unit = q["ids"], q["v"] / np.sqrt(exact(q["v"], q["v"]))[:, None]
                unit = np.c_[unit, np.zeros(len(ids))].astype(np.float32)
                rows, other, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
                for name in have[(k % groups) * merged : (k % groups + 1) * merged]:
                    s = files.get(f"{at}/{name}")
                    g = Vamana(s["x"], s["adj"], int(s["entry"]))
                    for a in range(0, len(ids), 256):
                        found, _ = g.search(unit[a : a + 256], int(s["wide"]))
                        r = np.repeat(np.arange(a, a + len(found)), found.shape[1] * (top + 1))
                        o = s["ids"][np.maximum(found, 0)].reshape(-1)
                        p = np.repeat(exact(s["v"][np.maximum(found, 0)], q["v"][a : a + 256, None, :]).ravel(), top + 1)
                        ok = (o >= 0) & np.repeat(found.ravel() >= 0, top + 1) & (o != ids[r])
                        rows, other, score = np.r_[rows, r[ok]], np.r_[other, o[ok]], np.r_[score, p[ok]]
                    o = np.lexsort((other, -score, rows))
                    rows, other, score = rows[o], other[o], score[o]
                    best = np.arange(len(rows)) - np.searchsorted(rows, rows) < top
                    rows, other, score = rows[best], other[best], score[best]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(other), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = spark.range(0, n, 1, min(n, MOST_TASKS)).mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(spark, vectors, vectors.where("vec_id % 20 = 0"))


def brute_force(ids: np.ndarray, v: np.ndarray, queries: np.ndarray, top: int = TOP) -> dict[int, list[tuple[int, float]]]:
    """The exact answer, for tests and recall."""
    out = {}
    for q in queries:
        s = exact(v, v[np.flatnonzero(ids == q)[0]][None])
        o = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:top]
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in o]
    return out
