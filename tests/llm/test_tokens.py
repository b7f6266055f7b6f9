import base64
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from strataloom.llm import mixing, tokens


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.WORDS.pattern, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "\n\n\t  x", "Hello world's end, they're 1234567 done", "aaaaaaa aaaa aa", "<|endoftext|> x", "日本語のテキスト🙂🙂 ü", "x" * 3000, "ab" * 700, "=" * 999 + "\n" * 501,
    "naïve café ​﻿", "\x00\x01", "mississippi banana bookkeeper " * 50, "".join(random.Random(3).choice("abcdefghij") for _ in range(5000)),
]


def test_encoding_equals_the_public_encoder(spark):
    ref = reference()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    rows = tokens.encode(df, "text").collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.ids == ref.encode_ordinary(TEXTS[r.doc_id] or ""), TEXTS[r.doc_id]


def test_round_trip_and_whole_table(spark):
    ref = reference()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in tokens.encode(rows, "text").collect()}
    assert len(got) == rows.count()
    for r in got.values():
        assert r.ids == ref.encode_ordinary(r.text or "")
        assert ref.decode(r.ids) == (r.text or "")


def test_contraction_of_long_words_is_the_same(monkeypatch):
    enc = tokens.Encoder(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    rng = random.Random(1)
    words = ["".join(rng.choice("aabcde") for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    by_query = enc.encode(words)
    for w, ids in zip(words, by_query, strict=True):
        assert tokens.contract_long([enc.bytes[b] for b in w.encode()], enc.merges) == ids


def test_cache_is_emptied_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 2)
    enc = tokens.Encoder(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    first = enc.encode(["one two three", "four"])
    assert enc.encode(["one two three", "four"]) == first
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string"), "text").collect() == []


def sizes_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


TARGETS = [("m", "a", 0.5, 3), ("m", "b", 0.3, 2), ("m", "none", 0.2, 5), ("one", "a", 1.0, 1)]


def test_mix_against_a_plain_count(spark):
    rng = random.Random(4)
    sizes = sizes_of(spark, [(i, "a" if i % 3 == 0 else "b" if i % 9 else None, rng.randrange(50)) for i in range(600)])
    targets = spark.createDataFrame(TARGETS, "mix_name string, source string, target_share double, max_repeats int")
    planned = mixing.plan(sizes, targets)
    rows = mixing.mix(sizes, planned, "doc_id").collect()
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    by = {(p.mix_name, p.source): p for p in planned.collect()}
    for (m, s), p in by.items():
        mine = [r.copies for r in rows if (r.mix_name, r.source) == (m, s)]
        expected = float(p.expected_copies)
        assert abs(sum(mine) - expected * p.n_documents) < 1 + 1e-6
        assert all(c <= p.max_repeats and abs(c - expected) < 1 for c in mine)
    report = {(r.mix_name, r.source): r for r in mixing.report(mixing.mix(sizes, planned, "doc_id"), planned).collect()}
    assert report["m", "none"].falls_short and report["m", "none"].tokens == 0
    assert sum(r.actual_share for (m, _), r in report.items() if m == "m") == pytest.approx(1)
    assert report["one", "a"].copies == report["one", "a"].n_documents == 200
    again = mixing.mix(sizes.repartition(3), planned, "doc_id").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame(TARGETS, "mix_name string, source string, target_share double, max_repeats int")
    planned = mixing.plan(sizes_of(spark, []), targets)
    assert mixing.mix(sizes_of(spark, []), planned, "doc_id").collect() == []
    assert all(r.tokens == 0 and r.actual_share is None for r in mixing.report(mixing.mix(sizes_of(spark, []), planned, "doc_id"), planned).collect())


def test_source_names(spark):
    df = spark.createDataFrame([(" Pull Request ",), ("PULL_REQUEST",), ("pull-request",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(mixing.source_name(F.col("s"))).collect()] == ["pull_request"] * 3 + [None, None]
