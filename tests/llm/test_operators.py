import base64
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paylake.llm import embedding_dedup, language_id, line_dedup, mixing, nearest, similar, simhash, toxicity, warc
from paylake.llm.components import connected_components
from paylake.llm.graphs import HNSW

SF = "/root/testdata/sf0.001"
L = "A Line of Text that is Long Enough to Count, " * 2


def docs_of(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


def test_line_dedup(spark):
    rows = [(k, f"own {k}\n {L}\t\n\n{L.lower()}x") for k in range(6)] + [(9, None), (10, ""), (11, L), (12, L + "\r\n" + "y" * 50_000)]
    rows += [(k, "four have this line, which is also long enough to be seen") for k in range(20, 24)]
    rows += [(30, "one doc_id in five rows has this line twice and no other has it\n" * 2)] * 5 + [(None, L), (None, None)]
    docs = docs_of(spark, [(*r, 1) for r in rows], ", n_dropped int")
    got = line_dedup.line_dedup(spark, docs).collect()
    have = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got]
    order = lambda r: (r[0] is None, r)
    assert sorted(have, key=order) == sorted(line_dedup.brute_force(rows), key=order)
    assert line_dedup.line_dedup(spark, docs.limit(0)).collect() == []


def test_perfect_hash():
    h = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    x = line_dedup.PerfectHash.from_bytes(line_dedup.PerfectHash.build(h, h ^ np.uint64(7), np.ones(len(h), int), np.arange(len(h))).to_bytes())
    at = x.find(h, h ^ np.uint64(7))
    assert sorted(at) == list(range(len(h))) and (x.holder[at] == np.arange(len(h))).all()
    assert (x.find(h + np.uint64(1), h) == -1).all()


def test_simhash_against_all_pairs(spark):
    base = " ".join(f"w{k}" for k in range(400))
    rows = [(k, base if k % 3 else base.replace("w7 ", f"v{k} ")) for k in range(40)] + [(50, None), (51, ""), (52, "one"), (53, "ONE"), (54, "a b"), (55, "x " * 30_000)]
    docs = docs_of(spark, rows)
    want = sorted(simhash.brute_force(rows))
    for crowd in (simhash.CROWD, 1):  # a crowded segment takes the other way
        assert sorted(tuple(r) for r in simhash.near_duplicates(spark, docs, crowd=crowd).collect()) == want
    assert simhash.near_duplicates(spark, docs.limit(0)).collect() == []


def test_simhash_links_of_near_fingerprints(spark):
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 30)}
    for f in list(fps):
        for _ in range(3):
            g = f & (2**64 - 1)
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                g ^= 1 << int(b)
            fps.add(g - (1 << 64) if g >> 63 else g)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    near = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    for crowd in (simhash.CROWD, 1):  # 1: every shared key is split as far as it goes
        assert {(r.a, r.b) for r in simhash.links(spark, df, crowd).collect()} == near


def test_simhash_crowd_of_near_fingerprints(spark):
    """All at most three bits from one, so all keys are crowded."""
    rng = np.random.default_rng(4)
    fps = {0} | {sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 4), replace=False)) for _ in range(900)}
    near = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    got = [(r.a, r.b) for r in simhash.links(spark, spark.createDataFrame([(f,) for f in fps], "fp long"), 16).collect()]
    assert set(got) == near and len(got) == len(near)


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, 2), (2, 1), (3, 3), (None, 4), (7, 5), (5, 9)]
    got = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {1: 1, 2: 1, 5: 5, 7: 5, 9: 5}


def test_mixing(spark):
    rows = [(k, "word " * (k % 50 + 1), "abc"[k % 7 % 3] if k % 11 else None) for k in range(3000)] + [(5000, None, "a"), (5001, " \n", "b")]
    docs = docs_of(spark, rows, ", source string")
    got = mixing.mix(spark, docs).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        x = by.setdefault(r.source_size, [r.target, 0, 0])
        x[1] += r.taken
        x[2] += r.size
        assert 0 <= r.taken <= 2 * r.size
    assert abs(sum(x[0] for x in by.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(x[1] - x[0]) <= 0.02 * x[0] and x[0] <= 2 * n + 1e-6 for n, x in by.items())
    again = {(r.doc_id, r.taken) for r in mixing.mix(spark, docs).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mixing.mix(spark, docs.limit(0)).collect() == []
    zero = mixing.mix(spark, docs_of(spark, [(1, None, "a")], ", source string")).first()
    assert (zero.size, zero.taken, zero.target) == (0, 0, 0.0)


def test_apportionment_against_a_heap(spark):
    rng = np.random.default_rng(3)
    cases = [([1000.0] + [0.4] * 500, 1200, [10**9] * 501), ([1.0] * 300, 1000, [10] * 300), (rng.uniform(0, 100, 400).tolist(), 5000, rng.integers(0, 40, 400).tolist())]
    cases += [([5.0, 0.0, 3.0], 7, [2, 5, 3]), ([1e6, 1.0, 2.0], 2_000_000, [2_000_000, 2, 4]), ([3.0, 7.0], 0, [5, 5]), ([0.0], 3, [4])]
    rows = [(c, i, float(w), q, int(m)) for c, (ws, q, ms) in enumerate(cases) for i, (w, m) in enumerate(zip(ws, ms))]
    df = spark.createDataFrame(rows, "c int, i int, w double, q long, m long")
    by = lambda df, ranked: {(r.c, r.i): r.seats for r in mixing.apportion(spark, df, ["c"], "i", F.col("w"), F.col("q"), F.col("m"), "seats", ranked).collect()}
    got = by(df, False)
    for c, case in enumerate(cases):
        assert [got[c, i] for i in range(len(case[0]))] == mixing.highest_quotients(*case)
    assert by(df.where("c = 2"), True) == {k: v for k, v in got.items() if k[0] == 2}


def test_targets_against_plain_resharing(spark):
    sizes = {f"s{k:03}": n for k, n in enumerate(np.random.default_rng(6).integers(0, 5000, 60).tolist())} | {"t": 10**6, None: 300}
    docs = spark.createDataFrame(list(sizes.items()), "source string, size long")
    names = sorted(k for k in sizes if k) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    stopped: set = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in stopped)
        target = {s: 2 * sizes[s] if s in stopped else left * weight[s] / sum(w for x, w in weight.items() if x not in stopped) for s in names}
        if not (over := {s for s in names if target[s] > 2 * sizes[s]}):
            break
        stopped |= over
    got = {r.source: r.target for r in mixing.source_targets(spark, docs).collect()}
    assert got == pytest.approx(target)


def test_taken_text_has_the_words_taken(spark):
    docs = docs_of(spark, [(k, " ".join(f"d{k}w{j}" for j in range(k % 90 + 1)), "ab"[k % 2]) for k in range(400)], ", source string")
    plan = mixing.mix(spark, docs).where("size > 0").withColumn("cuts", mixing.cuts()).join(docs, "doc_id")
    for r in plan.select("taken", mixing.taken_text().alias("out")).collect():
        assert len((r.out or "").split()) == r.taken


def test_language_id_on_held_out_documents(spark):
    got = language_id.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 0
    docs = docs_of(spark, [(1, None, None), (2, "12 !?", None), (3, "word", None)], ", lang string")
    assert [(r.lang_pred, r.score) for r in language_id.language_id(docs).collect()] == [("und", 0.0)] * 3
    one = docs_of(spark, [(k, "some text", "en") for k in range(9)], ", lang string")
    assert {(r.lang_pred, r.score) for r in language_id.language_id(one).collect()} == {("en", 1.0)}
    assert language_id.language_id(one.limit(0)).collect() == []


def test_language_id_learns_every_language(spark, monkeypatch):
    """More languages than the bound on rows would leave one row each; the rare ones are learned too."""
    monkeypatch.setattr(language_id, "MOST_ROWS", 40)
    words = lambda k, j: " ".join(chr(97 + k) * 2 + chr(97 + (k * 7 + i * (j + 2)) % 26) for i in range(30))
    rows = [(k * 100 + j, words(k, j), f"l{k:02}") for k in range(20) for j in range(40 if k == 0 else 6)] + [(9000, words(3, 1), None), (None, words(4, 1), "l04"), (9001, "", "l05"), (9002, "x " * 60_000, None)]
    docs = docs_of(spark, rows, ", lang string").withColumn("SCORE", F.lit("x"))
    got = language_id.language_id(docs, 40).collect()
    assert len(got) == len(rows) and np.mean([r.lang == r.lang_pred for r in got if r.lang and r.text]) >= 0.95
    assert {r.lang_pred for r in got if r.doc_id == 9001} == {"und"}
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score"}


def test_language_id_is_calibrated(spark):
    """Scores of held-out documents are about as high as they are often right."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    rows = language_id.op3_language_id(spark, "/root/testdata/sf0.1").where("held_out").join(docs, "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    right = np.array([r.lang == r.lang_pred for r in rows])
    score = np.array([r.score for r in rows])
    assert abs(score.mean() - right.mean()) <= 0.02
    edges = np.quantile(score, [0, 0.1, 0.5, 1])
    gap = [abs(score[k].mean() - right[k].mean()) for a, z in zip(edges, edges[1:]) if (k := (score >= a) & (score <= z)).any()]
    assert max(gap) <= 0.1, gap


def test_temperature_and_blocks_of_ngrams():
    z = np.random.default_rng(1).normal(size=(400, 3)) * 5
    y = np.array([np.random.default_rng(k).choice(3, p=language_id._softmax(z[k] / 4)) for k in range(400)])
    assert 2.5 < language_id.fit_temperature(z, y) < 6
    text = "abcdefg" * 60_000  # longer than a block
    at, n = language_id.counts(text)
    assert n.sum() == 3 * len(text) - 3


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.toxicity(spark, docs, labels.where("doc_id % 5 <> 0")).select("doc_id", F.col("toxic").alias("pred"))
    n = {(r.pred, r.toxic): r["count"] for r in out.join(labels.where("doc_id % 5 = 0"), "doc_id").groupBy("pred", "toxic").count().collect()}
    assert n.get((True, 0), 0) <= 0.01 * n[(False, 0)]
    assert n[(True, 1)] >= 0.6 * (n[(True, 1)] + n[(False, 1)])  # some labels are wrong
    lang = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    by = {r.lang: r for r in out.join(labels.where("doc_id % 5 = 0 and toxic = 1"), "doc_id").join(lang, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if("pred").alias("hit")).collect()}
    assert all(r.hit >= 0.4 * r.n for r in by.values() if r.n >= 8), by
    none = toxicity.toxicity(spark, docs.limit(3), labels.limit(0)).collect()
    assert [(r.toxic, r.score) for r in none] == [(False, 0.0)] * 3


def vectors_of(spark, x, label=None):
    return spark.createDataFrame([(k, None if v is None else [float(e) for e in v], None if label is None else label[k]) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")


def test_nearest_recall(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = nearest.usable(d).collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32)
    want = nearest.brute_force(ids, v, ids[ids % 20 == 0])
    got = {}
    for r in nearest.op7_nearest(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = [len({x for x, _ in got[q]} & {x for x, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hit) >= 0.97 and all(len(got[q]) == len(want[q]) for q in want)


def test_nearest_odd_vectors(spark):
    x = [[1, 0], [1, 0], [0, 1], None, [0, 0], [float("nan"), 1], [float("inf"), 0], [2, 2]]
    v = vectors_of(spark, x)
    got = sorted(tuple(r) for r in nearest.nearest(spark, v, v.where("vec_id = 0")).collect())
    assert got == [(0, 1, 7, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 0.0)]
    assert nearest.nearest(spark, v.limit(0), v.limit(0)).collect() == []
    # queries of another dimension than most vectors have take no part
    mixed = vectors_of(spark, [[1, 0], [0, 1], [1, 1], [1, 0, 0]])
    assert nearest.nearest(spark, mixed, mixed.where("vec_id = 3")).collect() == []
    again = v.unionAll(v.where("vec_id in (0, 1)")).unionAll(v.where("vec_id = 7").withColumn("vec_id", F.lit(None).cast("long"))).withColumn("score", F.lit(1))
    assert sorted(tuple(r) for r in nearest.nearest(spark, again, again.where("vec_id = 0")).collect()) == got


def links_and_components(rows):
    """{vec_id: (links, component)} by all pairs of (vec_id, vector, label)."""
    unit = {k: e / np.sqrt(e @ e) for k, e, lab in rows if lab is not None and e is not None and np.isfinite(e).all() and e.any()}
    lab = {k: t for k, _, t in rows}
    near = {k: [] for k, _, _ in rows}
    for t in set(lab.values()):
        ids = [k for k in unit if lab[k] == t]
        x = np.array([unit[k] for k in ids])
        for i, j in zip(*np.nonzero(x @ x.T >= 0.93 if len(ids) else np.zeros((0, 0)))):
            if i != j:
                near[ids[i]].append(ids[j])
    comp = {}
    for k in sorted(near):
        todo = [k] if k not in comp else []
        while todo:
            if (j := todo.pop()) not in comp:
                comp[j] = k
                todo += near[j]
    return {k: (len(n), comp[k]) for k, n in near.items()}


def read_vectors(v):
    return [(r.vec_id, None if r.embedding is None else np.array(r.embedding), r.label) for r in v.collect()]


@pytest.mark.parametrize("shard", [1 << 14, 60])
def test_embedding_dedup_against_all_pairs(spark, shard):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    x = [*(base[rng.integers(60, size=240)] + 0.12 * rng.normal(size=(240, 16))), base[0], base[0], None, np.zeros(16), [float("nan")] * 16, [1.0] * 3]
    label = [None if k % 40 == 7 else k % 2 for k in range(len(x))]
    v = vectors_of(spark, x, label)
    want = links_and_components([r for r in read_vectors(v) if r[0] != len(x) - 1]) | {len(x) - 1: (0, len(x) - 1)}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(spark, v.withColumn("REP", F.lit(1)), shard=shard).collect()}
    assert got == {k: (n, c, c == k) for k, (n, c) in want.items()}
    assert embedding_dedup.embedding_dedup(spark, v.limit(0)).collect() == []


def test_embedding_dedup_keeps_every_row(spark):
    rows = [(None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.1], 1), (7, [1.0, 0.0], None), (None, None, 2), (3, [1.0, 0.0], 2)]
    got = embedding_dedup.embedding_dedup(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(((-1 if r.vec_id is None else r.vec_id), r.n_links, r.component_id, r.kept) for r in got if r.component_id is not None) == [(-1, 2, 5, False), (3, 0, 3, True), (5, 2, 5, True), (5, 2, 5, True), (7, 0, 7, True)]
    assert [(r.vec_id, r.n_links, r.kept) for r in got if r.component_id is None] == [(None, 0, True)] * 2


def test_embedding_dedup_through_graphs_far_above_the_beam(spark, monkeypatch):
    """Groups of 2 to 300 vectors; every task searches a graph, and none is compared by brute force."""
    rng = np.random.default_rng(8)
    groups = np.repeat(np.arange(700), np.r_[300, 150, np.full(698, 5)])
    x = (rng.normal(size=(700, 32))[groups] + 0.15 * rng.normal(size=(len(groups), 32))).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = HNSW.build(unit)
    beam = embedding_dedup.audited(g, unit, np.arange(len(x)), 0.93)
    assert 0 < beam * 8 < len(x)
    true = unit @ unit.T >= 0.93
    got = np.unpackbits(embedding_dedup.candidates(g, unit, np.arange(len(x)), beam, 0.93), axis=1, count=len(x)).view(bool)
    assert (got & true).sum() >= 0.99 * true.sum()
    other = (x + 0.01).astype(np.float32)
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    beam = embedding_dedup.audited(g, other, None, 0.93)
    true = other @ unit.T >= 0.93
    got = np.unpackbits(embedding_dedup.candidates(g, other, None, beam, 0.93), axis=1, count=len(x)).view(bool)
    assert 0 < beam * 8 < len(x) and (got & true).sum() >= 0.98 * true.sum()
    v = vectors_of(spark, x, [0] * len(x))
    want = links_and_components(read_vectors(v))
    rows = embedding_dedup.embedding_dedup(spark, v, shard=2000).collect()
    assert sum(r.n_links for r in rows) >= 0.99 * sum(n for n, _ in want.values())
    assert np.mean([r.component_id == want[r.vec_id][1] for r in rows]) >= 0.99


def test_nearest_recall_in_graphs_far_above_the_beam(spark):
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(400, 24))[rng.integers(400, size=6000)] + 0.4 * rng.normal(size=(6000, 24))).astype(np.float32)
    v = vectors_of(spark, x)
    got = {}
    for r in nearest.nearest(spark, v, v.where("vec_id % 40 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = nearest.brute_force(np.arange(6000), x, np.arange(0, 6000, 40))
    assert np.mean([len(got[q] & {i for i, _ in w}) / len(w) for q, w in want.items()]) >= 0.95


def test_warc_round_trip(spark, tmp_path):
    rows = [(k, f"http://x/{k}", h) for k, h in enumerate(["<p>a</p>", "<p>a</p>", None, "", "é" * 70_000, "x" * 32_768, "\r\n\r\n0\r\n\r\n", "<p>a</p>", "é" * 70_000])]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int")
    m = warc.write_archives(spark, pages, f"file://{tmp_path}", file_bytes=1 << 10)
    got = warc.read_archives(m, payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=lambda r: r[0]) == warc.brute_force([(k, h) for k, _, h in rows])
    assert {bytes(r.payload) for r in got if r.payload is not None} == {(h or "").encode() for _, _, h in rows}
    some = next(f for f in tmp_path.iterdir() if f.name.endswith(".warc.gz"))
    assert gzip.decompress(some.read_bytes()).startswith(b"WARC/1.1\r\n")  # a member for each record, not packed twice
    (tmp_path / "e").mkdir()
    assert warc.read_archives(warc.write_archives(spark, pages.limit(0), f"file://{tmp_path}/e")).collect() == []
    # of segments that are records written twice, two rows
    twice = pages.where("page_id = 4").unionAll(pages.where("page_id = 4")).unionAll(pages.where("page_id = 8"))
    (tmp_path / "t").mkdir()
    got = warc.read_archives(warc.write_archives(spark, twice, f"file://{tmp_path}/t")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(4, "response", None), (4, "response", None), (8, "revisit", 4)]
    assert warc.digest(b"") == base64.b32encode(hashlib.sha1(b"").digest()).decode()


def test_warc_of_others(spark, tmp_path):
    """An archive with other kinds of records, no private headers, plain and chunked bodies, and revisits."""
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    first = warc.record("response", "urn:uuid:a", http + b"hello", Payload_Digest="sha1:" + warc.digest(b"hello"))
    bare = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:r>\r\nContent-Type: text/plain\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = [warc.record("warcinfo", "urn:uuid:w", b"software: x\r\n"), first, warc.record("request", "urn:uuid:q", b"GET / HTTP/1.1\r\n\r\n"), warc.record("revisit", "urn:uuid:v", http, Refers_To="<urn:uuid:a>", Payload_Digest="sha1:" + warc.digest(b"hello"))]
    data += [warc.record("revisit", "urn:uuid:u", http, Refers_To="<urn:uuid:gone>"), warc.record("metadata", "urn:uuid:m", b"x: y"), gzip.compress(bare), warc.record("response", "urn:uuid:b", http + b"bye", Payload_Digest="sha256:xyz")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(data))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")
    got = {r.id.strip("<>")[9:]: (r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to_id) for r in warc.read_archives(manifest).collect()}
    hello, bye = warc.digest(b"hello"), warc.digest(b"bye")
    assert got == {"a": (None, "response", 5, hello, None), "v": (None, "revisit", 5, hello, "<urn:uuid:a>"), "u": (None, "revisit", None, None, "<urn:uuid:gone>"), "b": (None, "response", 3, bye, None)}
    more = {r.record_type: bytes(r.payload) for r in warc.read_archives(manifest, payloads=True, other_kinds=True).collect() if r.payload is not None and r.record_type not in ("response", "request")}
    assert more == {"warcinfo": b"software: x\r\n", "metadata": b"x: y", "resource": b"abc"}


def test_warc_faults():
    parts = [(2, 4, b"cd"), (1, None, b"ab")]
    assert warc.reassemble(parts) == b"abcd"
    for bad in ([(1, None, b"ab"), (3, 4, b"cd")], [(1, None, b"ab"), (2, 5, b"cd")], [(1, None, b"ab"), (2, None, b"cd")], [(1, None, b"a"), (1, None, b"a"), (2, 2, b"")]):
        with pytest.raises(warc.WarcError):
            warc.reassemble(bad)
    assert warc.unchunked(warc.chunked(b"x" * 20_000, 999)) == b"x" * 20_000
    for bad in (b"5\r\nab", b"zz\r\n", b"2\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            warc.unchunked(bad)


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_similar_documents_stay_once(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = []
    for g in range(40):
        base = [f"w{x}" for x in rng.integers(0, 4000, rng.integers(6, 400))]
        for _ in range(3):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, max(2, len(copy) // 25))):
                copy[at] = f"v{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE two"), (None, rows[0][1]), (5, rows[9][1])]
    sets = [set(similar.shingles(t).tolist()) for _, t in rows]
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    least = {c: min((i for (i, _), k in zip(rows, comp) if k == c and i is not None), default=None) for c in comp}
    want = sorted(((-1 if i is None else i), least[c]) for (i, _), c in zip(rows, comp))
    docs = docs_of(spark, rows)
    for group, salted, small in ((similar.GROUP, similar.SALTED, similar.SMALL), (1, 2, 5)):  # 1: every band is dealt to blocks
        monkeypatch.setattr(similar, "SALTED", salted)
        monkeypatch.setattr(similar, "SMALL", small)
        got = similar.near_documents(spark, docs, group=group).collect()
        assert sorted(((-1 if r.doc_id is None else r.doc_id), r.component_id) for r in got) == want
        kept = sorted(-1 if r.doc_id is None else r.doc_id for r in got if r.kept)
        assert len(kept) == len(set(comp)) and {k for k in kept} == {-1 if v is None else v for v in least.values()}
    assert similar.near_documents(spark, docs.limit(0)).collect() == []


def test_pipeline_drops_similar_documents(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(300)]
    docs = docs_of(spark, [(1, " ".join(words)), (2, " ".join("v" if k in (40, 150, 260) else w for k, w in enumerate(words))), (3, " ".join(words[::-1]))])
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, SF).collect()) == [1, 3]


def test_mixing_small_sources_beside_a_huge_one(spark):
    sizes = {"a": 20, "b": 60, "c": 100, "d": 400}
    rows = [(k, "w " * 10, s) for s, n in sizes.items() for k in range(ord(s) * 1000, ord(s) * 1000 + n // 10)]
    docs = docs_of(spark, rows, ", source string").unionAll(spark.range(1700).select("id", F.expr("repeat('w ', 10000)"), F.lit("z")))
    by = {r.source_size: r for r in mixing.mix(spark, docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()}
    assert sum(by) > mixing.BLOCK_WORDS * mixing.BLOCKS
    assert all(abs(by[n].taken - by[n].target) <= 1 and by[n].target == 2 * n for n in sizes.values())
    assert abs(by[17_000_000].taken - by[17_000_000].target) <= 0.002 * by[17_000_000].target


def test_pipeline_mixes_null_and_repeated_ids(spark):
    import corpus_pipeline

    rows = [(None if k % 5 == 0 else k // 2, " ".join(f"d{k}w{j}" for j in range(k % 90 + 1)), "ab"[k % 2]) for k in range(400)]
    docs = docs_of(spark, rows, ", source string")
    got = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    whole = {t.split()[0].split("w")[0]: (i, t.split(), s) for i, t, s in rows}
    seen, taken = set(), {"a": 0, "b": 0}
    for r in got:
        words = r.text.split()
        key = words[0].split("w")[0]
        i, all_words, s = whole[key]
        assert (r.doc_id, r.source) == (i, s) and set(words) <= set(all_words) and key not in seen
        seen.add(key)
        taken[s] += len(words)
    target = {r.source_size: r.target for r in mixing.mix(spark, docs).select("source_size", "target").distinct().collect()}
    for s in "ab":
        want = target[sum(len(t.split()) for _, t, x in rows if x == s)]
        assert abs(taken[s] - want) <= 0.02 * want


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, an empty table, and columns whose names the stages use themselves."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    odd = spark.createDataFrame([(None, None, "en", None, 0), (None, "", "en", "a", 0), (7, " \n\t", "de", None, 3), (8, "12 34", None, "b", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionAll(odd).unionAll(docs.where("doc_id in (3, 4)")).unionAll(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.select(*docs.columns, *[F.lit(1).alias(n) for n in ("row", "node", "size", "TAKEN", "cuts_of_docs", "row_of_docs", "score", "n_lines")])
    n = docs.count()
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count() <= n
        assert function(spark, docs.limit(0), SF).collect() == []
        out = function(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    ids = [r.doc_id for r in docs.collect()]
    assert len({i for i in ids if i is not None}) >= 0.5 * len(ids) and ids.count(3) <= 1
    assert corpus_pipeline.tokenize(spark, docs, SF).count() == len(ids)
