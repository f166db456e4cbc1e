"""Packing: every token in one part, sequences without gaps or padding, ids as the tokenizers library has them, the mix against its histogram."""

import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twintrack.llm import packing

SF = "/root/testdata/sf0.001"
DEFINITION, RANKS, PATTERN = packing.default_tokenizer()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(DEFINITION)


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(open(DEFINITION, encoding="utf-8").read(), open(RANKS, "rb").read(), PATTERN)


def expected_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END]


def check(rows, texts, tokenizer, window=packing.WINDOW):
    """rows: (key of the document, start, length, crc, doc_tokens, sequence, offset)."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r[0], []).append(r)
        seqs.setdefault(r[5], []).append(r)
    assert docs.keys() == texts.keys()
    for key, parts in docs.items():
        ids = np.array(expected_ids(tokenizer, texts[key]), "<u4")
        at = 0
        for _, start, length, crc, total, _, _ in sorted(parts, key=lambda r: r[1]):
            assert start == at and length > 0 and total == len(ids)
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    assert sorted(seqs) == list(range(len(seqs)))
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at <= window and at & (at - 1) == 0
    return seqs


def test_query_packs_all_documents(spark, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = packing.query(spark, SF).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    seqs = check(rows, docs, tokenizer)
    total = sum(len(expected_ids(tokenizer, t)) for t in docs.values())
    assert len(seqs) == total // packing.WINDOW + bin(total % packing.WINDOW).count("1")


def test_edges(spark, tokenizer):
    long = " ".join(f"w{k}" for k in range(9000))
    texts = [None, "", " ", "\n\n ", "a" * 5000, long, long, "copy", "copy", "x<|endoftext|> y", "日本 語 a b", "word " * 4095]
    rows = [(None if k == 7 else min(k, 8), t, k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int").withColumns({"uid": F.lit("u"), "cut": F.lit(1), "ids": F.lit("i"), "length": F.lit(2)})
    cut, parts = packing.packed(docs.withColumn("doc_id", F.col("k")))
    got = packing.sequences(cut, parts).collect()
    check([(r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in got], dict(enumerate(texts)), tokenizer)
    cut, parts = packing.packed(docs)
    assert sorted(str(r.doc_id) for r in cut.select("doc_id").distinct().collect()) == sorted(map(str, [*range(7), 8, None]))
    assert parts.agg(F.sum("size")).first()[0] == sum(len(expected_ids(tokenizer, t)) for t in texts)


def test_no_documents(spark):
    cut, parts = packing.packed(spark.createDataFrame([], "doc_id long, text string"))
    assert cut.collect() == [] and parts.collect() == []


def test_one_length_for_all_is_dealt_out(spark):
    """Ranks within one length don't need its pieces in one task."""
    docs = spark.range(3000, numPartitions=4).select(F.col("id").alias("doc_id"), F.lit("same text here").alias("text"))
    cut, parts = packing.packed(docs)
    assert parts.select("sequence_id", "offset").distinct().count() == parts.count()
    assert parts.agg(F.sum("size")).first()[0] == cut.agg(F.sum("length")).first()[0]
    assert parts.where("size < length").count() <= cut.agg(F.sum("length")).first()[0] / packing.WINDOW + 11


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\t\r\x0b\x1c\x85\xa0 　abcé's1,.!?日本’<|>")), max_size=40), max_size=5))
def test_units_give_the_tokenizers_ids(texts):
    encoder, tokenizer = test_units_give_the_tokenizers_ids.kept
    got = encoder.ids([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


test_units_give_the_tokenizers_ids.kept = (packing.Encoder(open(DEFINITION, encoding="utf-8").read(), open(RANKS, "rb").read(), PATTERN), Tokenizer.from_file(DEFINITION))


@pytest.mark.parametrize("span", [30, 1 << 22])
def test_spans_and_added_tokens(encoder, tokenizer, monkeypatch, span):
    monkeypatch.setattr(packing, "_SPAN", span)
    monkeypatch.setattr(packing, "_KEEP", 20)
    r = random.Random(3)
    texts = [" ".join(r.choice(["it's", "", "\n", "word<|endoftext|>", "don't", "x ", "\xa0 y", "1990s", "--'s", "...", "long" * 30]) for _ in range(30)) for _ in range(300)]
    got = encoder.ids([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    alone = packing.Encoder(json.dumps(json.load(open(DEFINITION, encoding="utf-8"))))
    assert alone.ids([t.encode() for t in texts[:20]]) == got[:20]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([8, 16, 64]), st.integers(1, 4), st.integers(0, 300))
def test_mix_places_every_piece_once(seed, window, depth, pieces):
    r = np.random.default_rng(seed)
    hist = np.bincount(np.minimum(r.geometric(r.uniform(0.02, 0.9), pieces), window), minlength=window + 1)
    mix = packing.Mix(hist, window, depth)
    length = np.repeat(np.arange(window + 1), hist)
    rank = np.concatenate([np.arange(n) for n in hist] or [np.zeros(0)]).astype(np.int64)
    row, cut, size, seq, off = mix.place(length, rank)
    assert np.array_equal(np.bincount(row, size, len(length)), length)
    taken = sorted((s, o, n) for s, o, n in zip(seq.tolist(), off.tolist(), size.tolist()))
    filled = {}
    for s, o, n in taken:
        assert filled.get(s, 0) == o
        filled[s] = o + n
    assert sorted(filled) == list(range(len(filled)))
    assert all(n == window or n & (n - 1) == 0 for n in filled.values())


def test_combinations_fill_the_window():
    there = np.ones(25, bool)
    got = packing.combinations(there, 24, 3)
    assert set(map(tuple, got.tolist())) == {(a, b, c) for a in range(25) for b in range(a + 1) for c in range(b + 1) if a + b + c == 24 and (b or not c) and a}
    there[7] = False
    assert not (packing.combinations(there, 24, 3) == 7).any()


def test_least_squares_come_near_a_histogram_that_can_be_met():
    r = np.random.default_rng(2)
    columns = packing.combinations(np.ones(65, bool), 64, 3)
    hist = np.zeros(65, np.int64)
    for k in r.choice(len(columns), 12, replace=False):
        np.add.at(hist, columns[k][columns[k] > 0], 500)
    mix = packing.Mix(hist, 64, 3)
    assert mix.used.sum() >= 0.97 * hist.sum()
