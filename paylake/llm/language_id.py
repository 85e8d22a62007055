"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1-, 2- and 3-grams of the lower-cased text's code points, hashed to ``BUCKETS``;
a document's value is the share of its n-grams in a bucket (term frequency over the whole text)
times the inverse document frequency of the bucket over all labelled training documents. Weights are
learned by follow-the-regularised-leader with an elastic net (L1 and L2) on at most ``MOST_ROWS``
training documents, about evenly by language: each language's rows of least hash, so that none is left
out. Near copies of one document (``family``) are either learned from or kept for the temperature, never
both: a fifth of the families is kept from the weights to fit one temperature that calibrates the
probabilities.

A prediction is linear in n-gram counts, so it is one pass of table look-ups over whole texts, with a
model of a fixed size. Only text and non-null lang of documents with crc32(doc_id) mod 4 <> 2 are
learned from; a prediction sees the text alone.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text when
no labelled document exists. One known language is predicted with score 1. Ties go to the language
first in code-point order. Repeated rows are predicted alike. Null doc_ids are learned from. A text of any
length is taken whole, ``STEP`` code points at a time. An empty table gives an empty table. Input columns
named lang_pred or score are replaced; others are kept. All values of lang are learned; the model has a weight for each
language and bucket, so it grows with the number of languages (4 MB for 30).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded, release, without

BUCKETS = 1 << 15
MOST_ROWS = 3000  # labelled rows that the weights and the temperature are fitted on
LEAST_ROWS = 8  # of a language, of those that it has; with more than MOST_ROWS / LEAST_ROWS languages the bound is LEAST_ROWS a language
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
SCALE = 100.0  # of the values; steadies the step sizes
STEP = 1 << 18  # code points hashed at a time
UND = "und"


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every n-gram, in blocks; n-grams do not cross rows."""
    rows, k = [], 0
    while k < len(texts):
        size, a = 0, k
        while k < len(texts) and (size < STEP or a == k):
            size += len(texts[k])
            k += 1
        low = [t.lower() for t in texts[a:k]]
        code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
        row = np.repeat(np.arange(a, k, dtype=np.int32), [len(t) for t in low])
        for z in range(0, len(code), STEP):
            # blocks overlap by two, so no n-gram is lost or doubled
            c, r = code[z : z + STEP + 2], row[z : z + STEP + 2]
            n = min(STEP, len(c))
            h = c * np.uint32(0x9E3779B1)
            yield r[:n], ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))[:n]
            for g in (1, 2):
                h = (h[:-1] ^ (h[:-1] >> np.uint32(13))) * np.uint32(0x85EBCA6B) + c[g:] * np.uint32(0x9E3779B1)
                m = min(n, len(h))
                same = r[:m] == r[g : g + m]
                x = ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))[:m]
                yield r[:m][same], x[same]


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    n = np.zeros(BUCKETS, np.int64)
    for _, x in ngrams([text]):
        n += np.bincount(x, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at.astype(np.int32), n[at]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def document_frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    """Documents of each bucket, over all training documents, and their number. Tasks send one row a
    bucket; the result has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                for _, x in ngrams([text]) if len(text) <= STEP else [(None, counts(text)[0])]:
                    seen[x] = True
                df += seen
                seen[:] = False
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[df[at], n])], names=["bucket", "n"])
        release()

    seen = np.zeros(BUCKETS, bool)
    got = training.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(BUCKETS, np.int64), 0
    for r in got:
        if r.bucket < 0:
            n = r.n
        else:
            df[r.bucket] = r.n
    return df, n


class Model:
    """Weights (bucket x language, idf and scale folded in), bias, temperature and languages."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.table, self.bias, self.temperature = langs, table, bias, temperature

    def logits(self, texts: list[str]) -> np.ndarray:
        z = np.zeros((len(texts), len(self.langs)))
        n = np.zeros(len(texts))
        for r, x in ngrams(texts):
            if len(r):
                first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                z[r[first]] += np.add.reduceat(self.table[x], first, axis=0, dtype=np.float64)
                n[r[first]] += np.diff(np.r_[first, len(r)])
        return z / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        p = _softmax(self.logits(texts) / self.temperature)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, size: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader (proximal, per coordinate). rows: (indices, values); index
    ``size`` is the bias, which is not penalised. Returns weights (size x k) and bias."""
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(at):
        zi, ni = z[at], n[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        return w

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for j in order.permutation(len(rows)):
            at, x = rows[j]
            at, x = np.r_[at, size], np.r_[x, 1.0]
            w = weights(at)
            p = _softmax(x @ w)
            p[y[j]] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:size], w[size]


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss (golden-section search over its logarithm)."""
    if not len(y):
        return 1.0

    def loss(t):
        p = _softmax(z / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, most_rows: int = MOST_ROWS) -> Model | None:
    """``docs``: doc_id, text, lang. None if nothing is labelled."""
    bounded(docs.sparkSession)
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.coalesce(~held_out(F.col("doc_id")), F.lit(True)))
    sizes = labelled.groupBy("lang").count()
    langs = sorted(r.lang for r in sizes.collect())  # one row a language, as in the model
    if not langs:
        return None
    if len(langs) == 1:
        return Model(langs, np.zeros((BUCKETS, 1)), np.zeros(1), 1.0)
    df, n = document_frequencies(labelled)
    idf = np.log((1 + n) / (1 + df)) + 1
    # few rows of a frequent language get as far as the ranking: four times as many as are wanted
    most = max(LEAST_ROWS, most_rows // len(langs))
    h = F.xxhash64(F.col("doc_id"), F.lit("language"), F.col("text"))
    some = labelled.join(F.broadcast(sizes), "lang").withColumn("h", h).where(F.pmod("h", F.lit(1 << 30)) < F.lit(4.0 * most * (1 << 30)) / F.col("count"))
    picked = some.select("text", "lang", "h").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counts(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array([x[0].tobytes() for x in found]), pa.array([(x[1] / max(1, x[1].sum())).astype("<f4").tobytes() for x in found])], names=["lang", "h", "at", "x"]
            )

    rows = picked.select("text", "lang", "h").mapInArrow(run, "lang string, h long, at binary, x binary").collect()
    rows.sort(key=lambda r: (r.h, r.lang, r["at"], r["x"]))
    x = [((at := np.frombuffer(r["at"], "<i4")), np.frombuffer(r["x"], "<f4") * idf[at] * SCALE) for r in rows]
    index = {lang: k for k, lang in enumerate(langs)}
    y = np.array([index[r.lang] for r in rows])
    rest = np.array([family(at) % 5 == 0 for at, _ in x], bool)
    if len(set(y[~rest])) < len(langs):  # a language whose few documents are all of kept families
        rest[:] = False
    w, bias = ftrl([v for v, r in zip(x, rest) if not r], y[~rest], len(langs), BUCKETS)
    z = np.array([v @ w[at] + bias for (at, v), r in zip(x, rest) if r]).reshape(-1, len(langs))
    del rows, x
    release()  # of the driver
    return Model(langs, w * idf[:, None] * SCALE, bias, fit_temperature(z, y[rest]))


def family(at: np.ndarray) -> int:
    """The least of the mixed buckets: near copies of a document mostly have the same."""
    h = at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)).min()) if len(at) else 0


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score. The model (a few MB at most: BUCKETS x languages) is broadcast."""
    docs = without(docs, "lang_pred", "score")
    t = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.langs, model.table.astype(np.float32), model.bias, model.temperature))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value and Model(*shared.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                col = b.column(t).cast(pa.string())
                has = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_pylist()
                texts = col.to_pylist()
                lang, score = [UND] * len(texts), [0.0] * len(texts)
                if m and (on := [j for j, ok in enumerate(has) if ok]):
                    best, p = m.predict([texts[j] for j in on])
                    for j, i, s in zip(on, best.tolist(), p.tolist()):
                        lang[j], score[j] = m.langs[i], min(1.0, s)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang), pa.array(score)], names=schema.names)
            del whole, b, col, texts
            release()

    return docs.mapInArrow(run, schema)


def language_id(docs: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``docs`` (doc_id, text, lang and more) with lang_pred and score."""
    return predict(docs, train(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), most_rows))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
