"""Embedding near-dedup: links of cosine 0.93 or more between vectors of one label.

Equal vectors of a label are one class. The classes of a label are dealt to shards of about
``SHARD`` by hash; each shard becomes a hierarchical navigable small-world graph, a file in the
shared folder. Every pair of shards of a label is a task: the vectors of one search the graph of the
other, and what is found counts for both sides. Found pairs are a bit matrix, of a size that the
shards bound, whatever the number of links.

The beam of a task is the least at which an audit passes: ``AUDITED`` of its queries are compared with
brute force, and ``AUDIT`` of their ``AUDIT_TOP`` nearest and of their links must be found. Every query has
nearest vectors, so an audit is never passed on no evidence. From a query whose whole beam links the search
goes on over the edges between linking vectors, however many there are. A task whose audit fails even
with a beam of half the graph is compared by brute force. Cosines are verified in double precision.

Tasks return, for each class with links, how many vectors it links to and the smallest class it
reaches within the task; pairs are never written out. Components are united over these.

Defined results: one row per row of the table; rows that repeat a vec_id are vectors of their own.
Vectors that are null, zero, hold null or non-finite components or have another dimension than most, and vectors of
null label, link with nothing and are their own component. A null vec_id is nobody's smallest: its
component_id is the smallest of the others, else null, and it is kept only where there are no others. An empty
table gives an empty table. Other columns, whatever their names, play no part and are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .graphs import HNSW, labels_of, packed, unpacked
from .nearest import dimension, exact, is_usable, matrix
from .shared import FileCache, join_hot, read_file, release, save, shared_folder, write_file

COSINE = 0.93
SHARD = 1 << 14
WIDTH, AUDIT, AUDITED, AUDIT_TOP = 48, 0.99, 128, 10
AT_ONCE = 256  # queries searched together
MOST_TASKS = 20_000
SLACK = 1e-4  # single-precision products this much below the threshold are verified too


def audited(g: HNSW, q: np.ndarray, own: np.ndarray | None, threshold: float, width: int = WIDTH) -> int:
    """The least beam, doubling from ``width``, that passes the audit on a sample of the queries; 0 if none up to
    half of the graph's vectors does. ``own``: the nodes that the queries are, if they are of this graph."""
    n = len(g.x)
    sample = np.random.default_rng(2).choice(len(q), min(AUDITED, len(q)), replace=False)
    sims = q[sample] @ g.x.T
    near = np.argsort(-sims, axis=1, kind="stable")[:, : min(AUDIT_TOP, n)]
    linked = sims >= threshold
    while True:
        got = np.zeros_like(linked)
        ids, _ = g.search(q[sample], width, None if own is None else own[sample])
        r, k = np.nonzero(ids >= 0)
        got[r, ids[r, k]] = True
        fit = linked.sum(1) < width  # the others are searched beyond their beams
        if np.take_along_axis(got, near, 1).mean() >= AUDIT and (linked & got)[fit].sum() >= AUDIT * linked[fit].sum():
            return width
        width *= 2
        if 2 * width > n:
            return 0


def candidates(g: HNSW, q: np.ndarray, own: np.ndarray | None, width: int, threshold: float) -> np.ndarray:
    """(queries x nodes) bits of all pairs found with at least the threshold, less the slack. ``width`` 0: brute force."""
    low, n = threshold - SLACK, len(g.x)
    out = np.zeros((len(q), -(-n // 8)), np.uint8)
    for a in range(0, len(q), AT_ONCE):
        t = q[a : a + AT_ONCE]
        if width:
            found = np.zeros((len(t), n), bool)
            ids, sims = g.search(t, width, None if own is None else own[a : a + AT_ONCE])
            full = sims[:, -1] >= low  # more may link than the beam holds
            r, k = np.nonzero((sims >= low) & (ids >= 0) & ~full[:, None])
            found[r, ids[r, k]] = True
            if full.any():
                found[full] = g.within(t[full], ids[full], sims[full], low)
        else:
            found = t @ g.x.T >= low
        out[a : a + AT_ONCE] = np.packbits(found, axis=1)
    return out


def class_links(spark: SparkSession, classes: DataFrame, threshold: float = COSINE, shard: int = SHARD) -> DataFrame:
    """``classes``: label, rep, n, embedding, shards -> rep, links (vectors of other classes), root."""
    folder = shared_folder(spark, "hnsw")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).combine_chunks()
        label, part, rep, n = (t.column(i).to_numpy() for i in range(4))
        v = matrix(t.column(4).combine_chunks())
        keys = np.unique(np.c_[label, part], axis=0)
        made = []
        for lab, s in keys.tolist():
            k = np.flatnonzero((label == lab) & (part == s))
            k = k[np.argsort(rep[k])]
            own = v[k].astype(np.float64)
            g = HNSW.build((own / np.sqrt(exact(own, own))[:, None]).astype(np.float32))
            layers = {f"layer{i}": a for i, a in enumerate(g.layers)}
            write_file(f"{folder}/{lab}_{s}", packed(x=g.x, entry=np.array(g.entry), v=v[k], rep=rep[k], n=n[k], **layers))
            made.append((lab, s, len(k)))
        del t, v
        release()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in range(3)], names=["label", "shard", "size"])

    parts = max(16, classes.select("label", "shards").distinct().agg(F.sum("shards")).first()[0] or 0)
    dealt = classes.select(F.col("label").cast("long"), F.pmod(F.xxhash64("rep"), F.col("shards")).cast("long").alias("shard"), "rep", "n", "embedding").repartition(parts, "label", "shard")
    shards = save(spark, dealt.mapInArrow(build, "label long, shard long, size long"), "shards")
    pairs = shards.select("label", F.col("shard").alias("i")).join(shards.select("label", F.col("shard").alias("j")), "label").where("i <= j")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = FileCache(lambda uri: unpacked(read_file(uri)), 2)
        for b in batches:
            for lab, i, j in zip(*[c.to_pylist() for c in b.columns]):
                s, q = files.get(f"{folder}/{lab}_{i}"), files.get(f"{folder}/{lab}_{j}")
                g = HNSW(s["x"], [s[f"layer{k}"] for k in range(sum(x.startswith("layer") for x in s))], int(s["entry"]))
                n, m = len(g.x), len(q["x"])
                own = np.arange(m) if i == j else None
                bits = candidates(g, q["x"], own, audited(g, q["x"], own, threshold), threshold)
                links_q, links_s = np.zeros(m, np.int64), np.zeros(n, np.int64)
                lab_of = np.arange(m if i == j else m + n)
                for a in range(0, m, AT_ONCE):
                    found = np.unpackbits(bits[a : a + AT_ONCE], axis=1, count=n).view(bool)
                    if i == j:  # one of both finds the other
                        z = min(m, a + AT_ONCE)
                        found |= np.unpackbits(bits[:, a // 8 : -(-z // 8)], axis=1, count=z - a).view(bool).T
                        found[np.arange(z - a), np.arange(a, z)] = False
                    r, c = np.nonzero(found)
                    for k in range(0, len(r), 1 << 16):
                        x, y = q["v"][a + r[k : k + (1 << 16)]], s["v"][c[k : k + (1 << 16)]]
                        bad = exact(x, y) / (np.sqrt(exact(x, x)) * np.sqrt(exact(y, y))) < threshold
                        found[r[k : k + (1 << 16)][bad], c[k : k + (1 << 16)][bad]] = False
                    r, c = np.nonzero(found)
                    links_q[a : a + len(found)] += np.bincount(r, s["n"][c], len(found)).astype(np.int64)
                    if i != j:
                        links_s += np.bincount(c, q["n"][a + r], n).astype(np.int64)
                    known = np.flatnonzero(lab_of != np.arange(len(lab_of)))
                    lab_of = labels_of(len(lab_of), np.r_[known, a + r], np.r_[lab_of[known], c if i == j else m + c])
                rep, links = (q["rep"], links_q) if i == j else (np.r_[q["rep"], s["rep"]], np.r_[links_q, links_s])
                if len(k := np.flatnonzero(links)):
                    least = np.full(len(rep), np.iinfo(np.int64).max)
                    np.minimum.at(least, lab_of, rep)
                    yield pa.RecordBatch.from_arrays([pa.array(rep[k]), pa.array(links[k]), pa.array(least[lab_of[k]])], names=["rep", "links", "root"])
        release()

    tasks = max(16, min(pairs.count(), MOST_TASKS))  # a stated number is not coalesced: the pairs are few rows but much work
    return pairs.select("label", "i", "j").repartition(tasks, "label", "i", "j").mapInArrow(search, "rep long, links long, root long")


def embedding_dedup(spark: SparkSession, vectors: DataFrame, threshold: float = COSINE, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector (vec_id, embedding, label)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    ok = F.col("label").isNotNull() & is_usable() & (F.size("embedding") == dimension(v.where("label is not null")))
    keys = {"k1": F.xxhash64("label", "embedding"), "k2": F.xxhash64(F.lit(1), "label", "embedding")}
    classes = v.where(ok).withColumns(keys | {"row": F.monotonically_increasing_id()}).groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.min("row").alias("rep"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = save(spark, classes, "classes")
    sizes = classes.groupBy("label").agg(F.ceil(F.count("*") / shard).alias("shards"))
    found = save(spark, class_links(spark, classes.join(F.broadcast(sizes) if sizes.count() < 100_000 else sizes, "label"), threshold, shard), "links")
    comp = connected_components(spark, found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of_class = (
        classes.select("k1", "k2", "rep", "id", "n")
        .join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", "n", "id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    of_class = save(spark, of_class, "labels")
    least = of_class.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = save(spark, of_class.join(least, "component").select("k1", "k2", "n", "n_links", "component_id"), "components")
    ids = save(spark, v.select("vec_id", *[F.when(ok, k).alias(n) for n, k in keys.items()]), "ids")
    linked = join_hot(ids.where("k1 is not null"), of_class, ["k1", "k2"], "n").select("vec_id", "n_links", "component_id")
    alone = ids.where("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.c, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = e.vec_id
"""
