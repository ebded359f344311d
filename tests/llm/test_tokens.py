from __future__ import annotations

import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from jobtrail.llm import byte_bpe, token_counts
from jobtrail.llm.queries import QUERIES

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = [
    None, "", " ", "a", "  two  spaces ", "tab\tline\n\n end\r\n ", "I'm you'll we've it's 'S", "naïve café ÉÉÉ ß", "日本語 テキスト",
    "a b  c  d", "x\x1cy \x1d z\x85 q", "é café", "́ start", "emoji 👩‍👩‍👧 🏳️‍🌈", "<|endoftext|> a<|startoftext|>b",
    "1234567 ½ ²", "under_score__ a_b", "z" * 5000, "%$#" * 3000, "İstanbul ǅ ﬁ", "﻿bom ​ zero", "a" + " " * 3000 + "b",
    "Ⅷ ① ٣ x٣", "don't DON'T o'clock", "\x00\x01 nul", "ị̇ q̣̇",
]


def texts(n=400):
    rng = random.Random(7)
    alphabet = "aabcde  \n\t'sTé日 .,%12_́🏳" + "\x1f "
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(docs, library):
    given = dict(enumerate(texts()))
    encoded = byte_bpe.encode(docs(*given.items()), RANKS, P.PATTERN)
    got = {r.doc_id: r for r in encoded.collect()}
    assert set(got) == set(given)
    for i, t in given.items():
        want = library.encode_ordinary(t or "")
        assert bytes(got[i].ids) == struct.pack(f"<{len(want)}I", *want), repr(t)
        assert got[i].n_tokens == len(want)
    for r in byte_bpe.decode(encoded, RANKS).collect():
        assert bytes(r.decoded) == (given[r.doc_id] or "").encode()


def test_bpe_of_a_vocabulary_whose_merges_do_not_reach_a_token(docs):
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abcd"]
    assert byte_bpe.Encoder(tokens, r"\S+|\s+").encode(["abcd abcdd bc"])[0] == struct.pack("<8I", 257, 32, 97, 256, 100, 100, 32, 256)


def test_bpe_query(spark, library):
    rows = {r.doc_id: r for r in QUERIES["op1_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode_ordinary(d.text or "")
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_counts_equal_the_library(docs, spark):
    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    given = dict(enumerate(texts()))
    for r in token_counts.count_tokens(docs(*given.items()), path).collect():
        t = given[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(whole.encode(t, add_special_tokens=False).ids)), repr(t)
    found = QUERIES["op3_token_counts"](spark, "/root/testdata/sf0.001").collect()
    texts_by_id = {d.doc_id: d.text for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(found) == len(texts_by_id)
    for r in found:
        n = len(whole.encode(texts_by_id[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit) == (n, n > 2048)


def test_empty_tables(docs):
    assert byte_bpe.digests(docs(), RANKS, P.PATTERN).count() == 0
    assert token_counts.count_tokens(docs(), P.path("word_bpe_49k.json")).count() == 0


def test_repeated_rows_and_clashing_columns(docs):
    from pyspark.sql import functions as F

    rows = docs((1, "a b"), (1, "a b")).withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit(9)).withColumn("piece", F.lit(1))
    assert [r.n_tokens for r in byte_bpe.digests(rows, RANKS, P.PATTERN).collect()] == [2, 2]
    assert [r.n_tokens for r in token_counts.count_tokens(rows, P.path("word_bpe_49k.json")).collect()] == [2, 2]
