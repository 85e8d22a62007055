"""Toxicity by a classifier chain.

Categories are predicted one after another (here: low quality, then toxic). Each link is a sparse
logistic regression on hashed words of the whole text and on their beginnings (``STEM`` letters; languages with many
endings have few words that come twice), and sees, besides these, the
probabilities of the links before it. Those are out-of-fold: training documents are dealt to
``FOLDS`` by family, and the probability a document passes on comes from a model that has not seen
its fold; so a later link trains on what it will meet. The decision threshold of the last category
is chosen on its out-of-fold predictions, and is at least a half. Weights are learned by FTRL-proximal with an
elastic net. The folds of a link are fitted as tasks of one job.

Fitted on at most ``MOST_ROWS`` labelled documents (by hash of doc_id, about evenly by label), one
of each family of near copies (Jaccard similarity of their buckets of ``ALIKE`` or more); predictions cover every
document.

Defined results: null or wordless texts are not toxic and have score 0. Texts of any length are taken whole. With no
labels, or only one value of a label, that category's probability is its constant share. Repeated rows are predicted
alike; a doc_id with several labels counts as positive if any is. Null labels are not learned from. Equal scores are decided alike.
An empty table gives an empty table. Input columns named toxic, score or p_<category> are replaced; others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .language_id import ftrl
from .shared import bounded, save, without

BUCKETS = 1 << 17
MOST_ROWS = 12_000
FOLDS, EPOCHS = 4, 3
L1, L2, ALPHA = 2.0, 0.002, 0.3
WORD = re.compile(rb"[a-z\x80-\xff]+")
STEM = 4
ALIKE = 0.7
LEAST_FAMILIES = 4  # families a bucket must be found in to be learned from
LEAST_THRESHOLD = 0.5  # labels have errors; a document that is more likely clean stays clean


def buckets(text: str | None) -> np.ndarray:
    """Distinct buckets of a whole text: of its words, and of the beginnings of longer ones."""
    found = set(WORD.findall((text or "").lower().encode("utf-8", "surrogatepass")))
    h = xxhash.xxh32_intdigest
    out = [h(w) for w in found]
    out += [h(w, 1) for w in {w.decode("utf-8", "replace")[:STEM] for w in found if len(w) > STEM}]
    return np.unique(np.array(out, np.int64) & (BUCKETS - 1))


class Link:
    """Logistic regression of one category on presence of buckets and earlier probabilities."""

    def __init__(self, w: np.ndarray, bias: float):
        self.w, self.bias = w, bias

    def prob(self, at: np.ndarray, before: list[float]) -> float:
        z = self.w[at].sum() + self.bias
        for k, p in enumerate(before):
            z += self.w[BUCKETS + k] * p
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit_link(x: list[np.ndarray], before: np.ndarray, y: np.ndarray) -> Link:
    size = BUCKETS + before.shape[1]
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
        return Link(np.zeros(size), float(np.log(share / (1 - share))))
    rows = [(np.r_[at, np.arange(BUCKETS, size)], np.r_[np.ones(len(at)), before[j]]) for j, at in enumerate(x)]
    w, bias = ftrl(rows, y, 2, size, EPOCHS, ALPHA, 1.0, L1, L2)
    return Link(w[:, 1] - w[:, 0], float(bias[1] - bias[0]))


def link_jobs(spark: SparkSession, x: list[np.ndarray], before: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[Link, np.ndarray]:
    """The link fitted on all rows, and the out-of-fold probabilities: ``FOLDS`` + 1 fits, a task each."""
    data = spark.sparkContext.broadcast((x, before, y, fold))  # MOST_ROWS documents at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, before, y, fold = data.value
        for b in batches:
            for f in b.column(0).to_pylist():
                own = fold == f
                link = fit_link([a for a, o in zip(x, own) if not o], before[~own], y[~own])
                p = np.array([link.prob(x[j], before[j].tolist()) for j in np.flatnonzero(own)])
                k = np.flatnonzero(link.w) if f == FOLDS else np.empty(0, np.int64)
                cols = [pa.array([f], pa.int64()), *[pa.array([v.astype(t).tobytes()], pa.binary()) for v, t in ((p, "<f8"), (k, "<i8"), (link.w[k], "<f8"))], pa.array([link.bias])]
                yield pa.RecordBatch.from_arrays(cols, names=["fold", "probs", "at", "w", "bias"])

    oof, whole = np.zeros(len(x)), None
    for r in spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(run, "fold long, probs binary, at binary, w binary, bias double").collect():
        if r.fold == FOLDS:
            w = np.zeros(BUCKETS + before.shape[1])
            w[np.frombuffer(r["at"], "<i8")] = np.frombuffer(r.w, "<f8")
            whole = Link(w, r.bias)
        else:
            oof[fold == r.fold] = np.frombuffer(r.probs, "<f8")
    return whole, oof


class Chain:
    def __init__(self, names: list[str], links: list[Link], threshold: float):
        self.names, self.links, self.threshold = names, links, threshold

    @classmethod
    def fit(cls, spark: SparkSession, names: list[str], x: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> Chain:
        links, before = [], np.zeros((len(x), 0))
        for k in range(len(names)):
            link, oof = link_jobs(spark, x, before, y[:, k], fold)
            links.append(link)
            before = np.c_[before, oof]
        return cls(names, links, max(LEAST_THRESHOLD, best_threshold(before[:, -1], y[:, -1])))

    def probs(self, at: np.ndarray) -> list[float]:
        out: list[float] = []
        for link in self.links:
            out.append(link.prob(at, out))
        return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of best F1 (the middle between neighbouring probabilities)."""
    if not y.any() or y.all():
        return 0.5
    o = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[o])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[o][:-1] == p[o][1:]] = 0
    k = int(f1.argmax())
    return float((p[o[k]] + (p[o[k + 1]] if k + 1 < len(p) else 0)) / 2)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, names: list[str], most_rows: int = MOST_ROWS) -> Chain | None:
    """``labels``: doc_id and a 0/1 column per category, in chain order. None without labels.

    The labelled rows to fit on are picked from the labels alone, so only their ids (``most_rows`` at
    most) are sent to the documents; texts are not shuffled.
    """
    bounded(spark)
    clean = labels.where(F.col("doc_id").isNotNull()).dropna(subset=names).groupBy("doc_id").agg(*[F.max(F.col(n).cast("int")).alias(n) for n in names])
    clean = save(spark, clean, "labels")
    last = names[-1]
    size = {r[last]: r["count"] for r in clean.groupBy(last).count().collect()}  # at most two rows
    if not size:
        return None
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    h = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    rate = F.when(F.col(last) > 0, min(1.0, most_rows / 2 / size.get(1, 1))).otherwise(min(1.0, most_rows / 2 / size.get(0, 1)))
    picked = clean.withColumn("h", h).where(F.col("h") < rate * (1 << 30)).orderBy("h", "doc_id").limit(most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [buckets(t).astype("<i4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(at, pa.binary())], names=["doc_id", "h", *names, "at"])

    both = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "h", *names)
    rows = both.mapInArrow(run, "doc_id long, h long, " + ", ".join(f"{n} int" for n in names) + ", at binary")
    got = rows.orderBy("h", "doc_id", "at").limit(most_rows).collect()  # a doc_id may have several rows
    return fit(spark, names, [np.frombuffer(r["at"], "<i4") for r in got], np.array([[r[n] for n in names] for r in got]).reshape(-1, len(names)))


def families(x: list[np.ndarray]) -> np.ndarray:
    """The number of the first member of each document's family. Near copies share one of eight bands of two
    min-hashes; a document joins the first one of a band that it is ``ALIKE``."""
    odd = np.random.default_rng(3).integers(0, 2**31, 16, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    first, met = np.arange(len(x)), {}
    for j, at in enumerate(x):
        low = (((at.astype(np.uint64) + np.uint64(1))[:, None] * odd) & np.uint64(0xFFFFFFFF)).min(0) if len(at) else np.zeros(16, np.uint64)
        keys = [(k, int(low[2 * k]), int(low[2 * k + 1])) for k in range(8)]
        for i in dict.fromkeys(i for k in keys for i in met.get(k, ())):
            both = len(np.intersect1d(at, x[i], assume_unique=True))
            if both >= ALIKE * (len(at) + len(x[i]) - both):
                first[j] = first[i]
                break
        else:
            for k in keys:
                met.setdefault(k, []).append(j)
    return first


def fit(spark: SparkSession, names: list[str], x: list[np.ndarray], y: np.ndarray) -> Chain:
    """A chain over one document of each family, so that a text with many copies counts once and its
    copies do not meet in different folds; buckets of fewer than ``LEAST_FAMILIES`` are left out."""
    rows = np.unique(families(x))
    count = np.zeros(BUCKETS, np.int64)
    for j in rows:
        count[x[j]] += 1
    use = count >= LEAST_FAMILIES
    return Chain.fit(spark, names, [x[j][use[x[j]]] for j in rows], y[rows], np.arange(len(rows)) % FOLDS)


def predict(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """``docs`` with score (probability of the last category), toxic, and the earlier probabilities."""
    names = chain.names[:-1] if chain else []
    docs = without(docs, "toxic", "score", *[f"p_{n}" for n in names])
    t = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxic", T.BooleanType()), T.StructField("score", T.DoubleType()), *[T.StructField(f"p_{n}", T.DoubleType()) for n in names]])
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # of a fixed size: BUCKETS weights a link

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            found = [buckets(x) for x in b.column(t).to_pylist()]
            p = [c.probs(at) if c and len(at) else [0.0] * (len(names) + 1) for at in found]
            toxic = [bool(c and len(at) and x[-1] >= c.threshold) for x, at in zip(p, found)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(toxic, pa.bool_()), pa.array([x[-1] for x in p], pa.float64()), *[pa.array([x[k] for x in p], pa.float64()) for k in range(len(names))]], names=schema.names)

    return docs.mapInArrow(run, schema)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels``: doc_id, quality and toxic (0/1)."""
    chain = train(spark, docs, labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), ["low_quality", "toxic"])
    return predict(docs, chain)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")
