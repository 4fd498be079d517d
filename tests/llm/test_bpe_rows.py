"""Encoding of rows that repeat and of tables with further columns."""

import hashlib

import public_tokenizers as P
import tiktoken

from lesionflow.llm import bpe


def test_repeated_rows_and_further_columns(spark):
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    rows = [(1, "the cat sat", "x", 3), (1, "the cat sat", "x", 3), (1, "another  text", "y", 4), (None, "the cat sat", None, None), (2, None, "z", 5), (3, "", "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int")
    reference = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def expected(text):
        ids = reference.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, ranks, P.PATTERN).collect()]
    assert sorted(map(repr, got)) == sorted(repr((k, *expected(text))) for k, text, *_ in rows)
    assert bpe.round_trip(docs.limit(0), ranks, P.PATTERN).count() == 0
