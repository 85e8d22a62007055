import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paylake.llm import byte_bpe, token_files

TEXTS = [
    "", None, "a", " a", "\n", "\n\n", "a\n\nb", "\n\n\nx", "\n  a\t b", "The cat, the dog.", "don't won't I'LL", "x  y", "trailing ", " ", "tab\t.", "\tfoo. bar", "a b c d",
    "naïve façade — ñandú 東京 \U0001f600\U0001f600", "12345 abc123", "\x01first \x01second", "<|endoftext|> is text", "a" * 5000, "ab" * 3000, "!?" * 500 + " end", "one\n two\nthree.", "\r\nwin\r\n", "\x00\x1f", "same text", "same text",
]


@pytest.fixture(scope="module")
def truth():
    ranks = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts):
    enc, _ = byte_bpe._encoder(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    return [np.frombuffer(x, "<i4").tolist() for x in enc.texts(texts)]


def test_ids_are_those_of_the_library(truth):
    assert ids_of(TEXTS) == [truth.encode_ordinary(t or "") for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab. ,\n\t'sé1!\x01 ") | st.characters(codec="utf-8"), max_size=40), max_size=5))
def test_any_text(truth, texts):
    want = [truth.encode_ordinary(t) for t in texts]
    assert ids_of(texts) == want
    assert ids_of(texts) == want  # from what is remembered


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=30), min_size=1, max_size=6), st.randoms())
def test_queue_with_any_ranks(pieces, random):
    """A rank table in which a merge can bring up a lower rank than its own, against the plain rule."""
    ranks = {bytes([k]): k for k in range(256)}
    parts = {p[a:z] for p in pieces for a in range(len(p)) for z in range(a + 2, min(len(p), a + 5) + 1)}
    for k, p in enumerate(random.sample(sorted(parts), len(parts))):
        ranks[p] = 256 + k

    def plain(piece):
        at = [piece[k : k + 1] for k in range(len(piece))]
        while pairs := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(at, at[1:])) if a + b in ranks]:
            k = min(pairs)[1]
            at[k : k + 2] = [at[k] + at[k + 1]]
        return [ranks[x] for x in at]

    got = byte_bpe.merge(pieces, ranks, np.arange(256, dtype=np.int32), byte_bpe.byte_pairs(ranks))
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == [plain(p) for p in pieces]


def test_very_long_pre_token(truth):
    text = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(1_200_000))
    (got,) = ids_of([text])
    assert got == truth.encode_ordinary(text)


def test_round_trip_and_columns(spark, truth):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, IDS string")
    got = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(docs)).collect()}
    assert all(bytes(got[k].decoded) == (t or "").encode() for k, t in enumerate(TEXTS))
    assert all(got[k].ids == truth.encode_ordinary(t or "") for k, t in enumerate(TEXTS))
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(byte_bpe.decode(none).first().decoded) == b""
    assert byte_bpe.digests(byte_bpe.encode_decode(docs.limit(0))).collect() == []


def test_op2_digests(spark, truth, tmp_path):
    spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in byte_bpe.op2_byte_bpe(spark, str(tmp_path)).collect():
        ids = truth.encode_ordinary(TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, tmp_path, encoding):
    t = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    docs = spark.createDataFrame([(k * 3 % 50, x, 1) for k, x in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(token_files.token_rows(docs), path, encoding)
    want = {k * 3 % 50: [*t.encode(x or "", add_special_tokens=False).ids, 0] for k, x in enumerate(TEXTS)}
    rows = {r.doc_id: r for r in spark.read.parquet(path).collect()}
    assert {k: r.ids for k, r in rows.items()} == want
    at = 0
    crc = {r.doc_id: r.ids_crc32 for r in token_files.checksums(spark, path).collect()}
    for r in sorted(token_files.read_metadata(spark, path).collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens) == (at, len(want[r.doc_id]))
        assert crc[r.doc_id] == zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes())
        at += r.n_tokens
    assert [r.ids for r in token_files.read_documents(spark, path, [3]).collect()] == [want[3]]


def test_token_files_empty_and_repeated(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert token_files.op4_token_files(spark, str(tmp_path)).collect() == []
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b c")], "doc_id long, text string")
    token_files.write_tokens(token_files.token_rows(docs), f"{tmp_path}/t")
    got = sorted((r.start, r.n_tokens) for r in token_files.read_metadata(spark, f"{tmp_path}/t").collect())
    assert got == [(0, 3), (3, 2), (5, 2)]
    # rows of one doc_id with texts of different lengths: starts follow the order in the files
    texts = ["a", "b c", "d e f", "g h i j", "k l m n o"]
    docs = spark.createDataFrame([(7, x) for x in texts] + [(9, "z"), (3, "y " * 50_000)], "doc_id long, text string")
    for file_bytes in (1 << 20, 8):
        path = f"{tmp_path}/v{file_bytes}"
        token_files.write_tokens(token_files.token_rows(docs, file_bytes=file_bytes), path)
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: (r.part, r.ndx))
        assert [r.doc_id for r in rows] == [3] + [7] * 5 + [9]
        stored = sorted(token_files.read_metadata(spark, path).collect(), key=lambda r: r.start)
        assert [(r.start, r.n_tokens) for r in stored] == [(sum(x.n_tokens for x in rows[:k]), r.n_tokens) for k, r in enumerate(rows)]
    with pytest.raises(ValueError):
        token_files.write_tokens(token_files.token_rows(docs), f"{tmp_path}/u", "other")
