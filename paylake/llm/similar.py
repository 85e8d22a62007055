"""Documents of like wording: SimHash over five-word shingles at a similarity of 0.8, checked exactly.

A document is its set of word shingles (XXH64, as in ``simhash``). Its fingerprint has 128 bits, the
votes of the hashes and of a mix of them. Two documents are linked if the Jaccard similarity of their
sets is ``similarity`` at least.

At a similarity of 0.8 about 19 of 128 bits differ (standard deviation 4), so the Hamming budget is
``BITS`` = 32. So wide a budget leaves pigeonring without a key to join on: no chain has an equal
segment of more than a few bits. Candidates are therefore the documents that share a band of min-hashes
(``BANDS`` bands of ``ROWS``: a pair at exactly 0.8 shares none with a chance of 1.6 in 1,000, one at 0.9 of 8 in a million), and the
ring prunes them: some segment must start a chain whose first l segments differ in at most
l * bits / segments bits for every l; then come the full Hamming check and the exact check.

Equal sets are one node. First each node of a band meets one pivot of it, which links most of a large
group of near copies. Then all pairs of a band that still lie in different components are compared in tasks that
hold ``GROUP`` nodes, or two times as many, and send back a forest of links and no candidates: a band of up to
``GROUP`` nodes is one task, a larger one is dealt to blocks (files in the shared folder) whose pairs are tasks. So
no candidate is lost, and neither a large group of copies nor one of documents just below the
similarity is expanded into its pairs.

Defined results: wordless texts are one node; a text with fewer words than a shingle is one shingle; texts
of any length are taken whole; repeated rows are rows of their own, and one of them is kept. Null
doc_ids are nobody's smallest id; they are kept only where a component has no other, the first row of
it. An empty table gives an empty table. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import FileCache, join_hot, read_file, release, save, shared_folder, write_file
from .simhash import LOWER, SEED

WORDS, SIMILARITY, BITS, SEGMENTS = 5, 0.8, 32, 8
BANDS, ROWS = 9, 3
GROUP = 1024
MOST_TASKS = 20_000
SALTED = 4096  # pairs of a node that are checked in one task
SMALL = 1_000_000  # so many keys of rows (8 bytes each) are broadcast; more are joined
STEP = 1 << 14  # shingles min-hashed at a time


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    h64, joined = xxhash.xxh64_intdigest, b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(found) - words + 1)
    return np.unique(np.fromiter((h64(joined[a:e], SEED) for a, e in zip(starts[:n].tolist(), ends[-n:].tolist())), np.uint64, n))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(h: np.ndarray) -> tuple[int, int]:
    """Two words of 64 bits."""
    out = []
    for x in (h, _mix(h)):
        ones = np.zeros(64, np.int64)
        for k in range(0, len(x), 1 << 15):
            ones += np.unpackbits(x[k : k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(ones * 2 > len(x), bitorder="little").tobytes(), "little"))
    return out[0], out[1]


_ODD = np.random.default_rng(5).integers(0, 2**63, BANDS * ROWS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def bands(h: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes; none for an empty set."""
    if not len(h):
        return np.empty(0, np.int64)
    low = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    x = _mix(h ^ np.uint64(0x9E3779B97F4A7C15))
    for k in range(0, len(x), STEP):
        low = np.minimum(low, (x[k : k + STEP, None] * _ODD).min(0))
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), k) for k, row in enumerate(low.astype("<u8").reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def node_of(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.astype("<u8").tobytes())).astype(np.int64))


def _lists(found: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate(found).view(np.int64)))


def _nodes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row, node, size, f0, f1, bands of (doc_id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                rows, keys = np.zeros((b.num_rows, 4), np.uint64), []
                for j, x in enumerate(b.column(2)):
                    h = shingles(x.as_py(), words)
                    rows[j, 0], rows[j, 1] = np.int64(node_of(h)).astype(np.uint64), len(h)
                    rows[j, 2], rows[j, 3] = map(np.uint64, fingerprint(h))
                    keys.append(bands(h))
                cols = [pa.array(np.ascontiguousarray(rows[:, c]).view(np.int64)) for c in range(4)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, _lists(keys)], names=["doc_id", "row", "node", "size", "f0", "f1", "bands"])
        release()

    return docs.mapInArrow(run, "doc_id long, row long, node long, size long, f0 long, f1 long, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """row, hashes of (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingles(x.as_py(), words) for x in b.column(1)])], names=["row", "hashes"])
        release()

    return docs.mapInArrow(run, "row long, hashes array<long>")


def may_be_similar(a: str, b: str, bits: int, similarity: float) -> Column:
    """Of two struct columns (node, size, f0, f1): sizes fit, the ring has a chain, and the whole differs in
    at most ``bits`` bits."""
    differ = [F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}")) for f in ("f0", "f1")]
    width = 128 // SEGMENTS
    d = [F.bit_count(F.shiftrightunsigned(w, width * i).bitwiseAND(F.lit((1 << width) - 1))) for w in differ for i in range(64 // width)]
    chain = F.lit(False)
    for i in range(SEGMENTS):
        sums, ok = F.lit(0), F.lit(True)
        for n in range(SEGMENTS):
            sums = sums + d[(i + n) % SEGMENTS]
            ok = ok & (sums <= (n + 1) * bits // SEGMENTS)
        chain = chain | ok
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    whole = F.bit_count(differ[0]) + F.bit_count(differ[1]) <= bits
    return (F.least(x, y) >= similarity * F.greatest(x, y) - 1e-6) & chain & whole


def _pivot_pairs(shared: DataFrame, bits: int, similarity: float) -> DataFrame:
    """Each node of a band with its pivot, the least node."""
    pivots = shared.groupBy("band").agg(F.min("x").alias("y"))
    met = shared.join(pivots, "band").where((F.col("x.node") != F.col("y.node")) & may_be_similar("x", "y", bits, similarity))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


class Block:
    """Nodes with their sets."""

    def __init__(self, t: pa.Table):
        self.node, self.comp, self.size, f0, f1 = (t.column(c).to_numpy() for c in ("node", "comp", "size", "f0", "f1"))
        self.f = np.stack([f0, f1], 1).view(np.uint64)
        self.bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        lists = t.column("hashes").combine_chunks()
        self.values, self.at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()

    def set_of(self, k: int) -> np.ndarray:
        return self.values[self.at[k] : self.at[k + 1]]


def _forest(a: Block, b: Block, band: int, bits: int, similarity: float) -> list[tuple[int, int]]:
    """A forest of the links between nodes of different components in two blocks (or in one). Of the bands that
    two nodes share only the first one compares them."""
    root = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    part = np.dtype(f"<u{16 // SEGMENTS}")
    ring_b = np.ascontiguousarray(b.f.view(part))
    out = []
    for k in range(0, len(a.node), 64):
        z = min(len(a.node), k + 64)
        fit = (a.comp[k:z, None] != b.comp) & (np.minimum(a.size[k:z, None], b.size) >= similarity * np.maximum(a.size[k:z, None], b.size) - 1e-6)
        if a is b:
            fit &= np.arange(k, z)[:, None] < np.arange(len(b.node))
        x, y = np.nonzero(fit)
        d = np.bitwise_count(np.ascontiguousarray(a.f[k:z].view(part))[x] ^ ring_b[y]).astype(np.int16)
        twice = np.cumsum(np.c_[d, d[:, :-1]], axis=1)  # a chain from each segment, around the ring
        before = np.c_[np.zeros(len(d), np.int16), twice]
        budget = (np.arange(1, SEGMENTS + 1) * bits) // SEGMENTS
        chain = np.zeros(len(d), bool)
        for s in range(SEGMENTS):
            chain |= (before[:, s + 1 : s + 1 + SEGMENTS] - before[:, s, None] <= budget).all(1)
        x, y = x[chain] + k, y[chain]
        near = np.bitwise_count(a.f[x] ^ b.f[y]).sum(1) <= bits
        x, y = x[near], y[near]
        same = a.bands[x] == b.bands[y]
        first = a.bands[x, same.argmax(1)] == band
        for i, j in zip(x[first].tolist(), y[first].tolist()):
            p, q = find(int(a.comp[i])), find(int(b.comp[j]))
            if p != q:
                both = len(np.intersect1d(a.set_of(i), b.set_of(j), assume_unique=True))
                if both >= similarity * (a.size[i] + b.size[j] - both) - 1e-6:
                    root[max(p, q)] = min(p, q)
                    out.append((int(a.node[i]), int(b.node[j])))
    return out


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _all_links(spark: SparkSession, opened: DataFrame, bits: int, similarity: float, group: int) -> DataFrame:
    """a, b: what links the components of each band. ``opened``: band, n (its nodes), node, comp, size, f0, f1, bands, hashes."""
    few, many = opened.where(F.col("n") <= group), opened.where(F.col("n") > group)

    def small(t: pa.Table) -> pa.Table:
        block = Block(t)
        return _links(_forest(block, block, t.column("band")[0].as_py(), bits, similarity))

    found = save(spark, few.groupBy("band").applyInArrow(small, "a long, b long"), "links")
    if many.isEmpty():
        return found
    folder = shared_folder(spark, "blocks")

    def write(t: pa.Table) -> pa.Table:
        band, block = t.column("band")[0].as_py(), t.column("block")[0].as_py()
        sink = io.BytesIO()
        with pa.ipc.new_file(sink, t.schema) as f:
            f.write_table(t.combine_chunks())
        write_file(f"{folder}/{band}_{block}", sink.getvalue())
        return pa.table({"band": pa.array([band], pa.int64()), "block": pa.array([block], pa.int64())})

    dealt = many.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / group)))
    made = save(spark, dealt.groupBy("band", "block").applyInArrow(write, "band long, block long"), "blocks")
    pairs = save(spark, made.join(made.withColumnRenamed("block", "other"), "band").where("block <= other"), "pairs")

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = FileCache(lambda uri: Block(pa.ipc.open_file(pa.py_buffer(bytes(read_file(uri)))).read_all()), 2)
        for b in batches:
            for band, i, j in zip(*[c.to_pylist() for c in b.columns]):
                yield from _links(_forest(cache.get(f"{folder}/{band}_{i}"), cache.get(f"{folder}/{band}_{j}"), band, bits, similarity)).to_batches()
        release()

    tasks = max(16, min(pairs.count(), MOST_TASKS))
    return found.unionAll(save(spark, pairs.select("band", "block", "other").repartition(tasks, "band", "block", "other").mapInArrow(large, "a long, b long"), "links"))


def near_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, bits: int = BITS, row_col: str | None = None, group: int = GROUP) -> DataFrame:
    """doc_id, row, fingerprint (32 hex digits), component_id and kept of every document. ``row_col``: a
    column that numbers the rows; without it they are numbered here. Kept is one row of each component,
    that of the smallest doc_id."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(row_col).alias("row") if row_col else F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    if not row_col:
        texts = save(spark, texts, "texts")
    rows = save(spark, _nodes(texts, words), "nodes")
    first = lambda *names: [F.first(n).alias(n) for n in names]
    nodes = save(spark, rows.groupBy("node").agg(*first("size", "f0", "f1", "bands"), F.min("row").alias("row"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "distinct")
    banded = nodes.select(F.struct("node", "size", "f0", "f1").alias("x"), F.explode("bands").alias("band"))
    often = banded.groupBy("band").agg(F.count("*").alias("n")).where("n >= 2")
    shared = save(spark, banded.join(often, "band"), "bands")

    def sets_of(some: DataFrame) -> DataFrame:
        """node, hashes of the nodes (column node), from the first row of each."""
        wanted = save(spark, nodes.select("node", "row").join(some, "node", "left_semi"), "wanted")
        only = wanted.select("row")
        sets = _sets(texts.select("row", "text").join(F.broadcast(only) if only.count() <= SMALL else only, "row", "left_semi"), words)
        return save(spark, wanted.join(sets, "row").select("node", "hashes"), "sets")

    def check(found: DataFrame) -> DataFrame:
        """The candidates that are similar."""
        found = save(spark, found, "candidates")
        ends = found.select(F.col("a").alias("node")).unionAll(found.select("b")).groupBy("node").agg(F.count("*").alias("n"))
        ends = save(spark, ends.select("node", F.ceil(F.col("n") / SALTED).alias("salts")), "ends")
        sets = ends.join(sets_of(ends), "node")
        # a node of many pairs is sent to several tasks
        for end, other in (("a", "b"), ("b", "a")):
            found = found.join(ends.select(F.col("node").alias(end), F.col("salts").alias(f"s{end}")), end).withColumn(f"s{end}", F.pmod(F.xxhash64(other), F.col(f"s{end}")))
        of = lambda end: sets.select(F.col("node").alias(end), F.col("hashes").alias(f"h{end}"), F.explode(F.expr("sequence(0L, salts - 1)")).alias(f"s{end}"))
        both = F.size(F.array_intersect("ha", "hb"))
        of_all = F.size("ha") + F.size("hb") - both
        return save(spark, found.join(of("a"), ["a", "sa"]).join(of("b"), ["b", "sb"]).where(both >= F.lit(similarity) * of_all - 1e-6).select("a", "b"), "similar")

    edges = check(_pivot_pairs(shared, bits, similarity))
    comp = connected_components(spark, edges)
    labelled = nodes.select("node", "size", "f0", "f1", "bands").join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    placed = save(spark, shared.select("band", "n", F.col("x.node").alias("node")).join(labelled, "node"), "placed")
    several = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    opened = save(spark, placed.join(several, "band"), "opened")
    opened = opened.join(sets_of(opened.select("node").distinct()), "node")
    comp = connected_components(spark, edges.unionAll(_all_links(spark, opened, bits, similarity, group)))
    labelled = nodes.join(comp, "node", "left").select("node", "n", "doc_id", F.coalesce("component", "node").alias("component"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = save(spark, labelled.join(least, "component").select("node", "n", "component", "component_id"), "labels")
    digits = F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("f1", "f0")])
    out = join_hot(rows.select("doc_id", "row", "node", "f0", "f1"), of_node, ["node"], "n")
    firsts = out.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m"), F.count("*").alias("n")).select("component", "n", F.col("m.row").alias("first"))
    kept = save(spark, firsts, "kept")
    return join_hot(out, kept, ["component"], "n").select("doc_id", "row", F.lower(digits).alias("fingerprint"), "component_id", (F.col("row") == F.col("first")).alias("kept"))
