"""Pieces against the whole-text tokenizer, and the mixture."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lattica.llm import packing


def check(docs, pieces, window=1024):
    tok = Tokenizer.from_file(packing.default_tokenizer())
    by_doc = {}
    for p in sorted(pieces, key=lambda p: p.start):
        by_doc.setdefault(p.doc_id, []).append(p)
    for d in docs:
        ids = np.array([*tok.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in by_doc[d.doc_id]:
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    place = 0
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.sequence_id * window + p.offset == place and p.offset + p.length <= window
        place += p.length


@pytest.mark.parametrize("shard_tokens", [4_000_000, 20_000])
def test_pieces(spark, small, shard_tokens):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(docs.collect(), packing.pack(docs, shard_tokens=shard_tokens).collect())


def test_parts_give_the_same_ids():
    tok, enc = Tokenizer.from_file(packing.default_tokenizer()), packing.encoder(packing.default_tokenizer())
    for t in ["", " ", "a  b", "a.\n\n b . c", "x ", "é. ü, 1. 2,", ".. a..", "<|endoftext|> a <|endoftext|>b.", "a\t b  c", "日本. z 😀", "!!. ?", "don't. 's.", "  nbsp  em"]:
        assert np.frombuffer(enc.encode([t])[0], enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_windows_hold_the_mixture():
    n = np.full(900, 700)
    queue = np.repeat([0, 1, 2], [450, 270, 180])
    shares = np.array([0.5, 0.3, 0.2])
    deficit = np.zeros(3)
    got = list(packing.served(["a", "b", "c"], n, queue, shares, deficit, 0))
    window = np.zeros((900 * 700 // 1024 + 1, 3))
    for row, _, length, place in got:
        window[place // 1024, queue[row]] += length
    served = window.cumsum(axis=0)[:-1]
    assert np.abs(served - served.sum(axis=1)[:, None] * shares).max() < 1024
    assert abs(deficit).max() < 1


def test_deficits_continue_from_shard_to_shard(spark):
    docs = spark.createDataFrame([(i, "word " * 150, "en", "abc"[i % 3 if i % 2 else 0], 0) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    pieces = packing.pack(docs, shard_tokens=8000, with_ids=True).collect()
    check(docs.collect(), pieces)
    assert all(len(p.ids) == p.length for p in pieces)
    total = sum(p.length for p in pieces)
    share = {s: sum(p.length for p in pieces if p.source == s) / total for s in "abc"}
    half = [p for p in pieces if p.sequence_id * 1024 + p.offset < total / 2]
    for s in "abc":
        assert sum(p.length for p in half if p.source == s) / (total / 2) == pytest.approx(share[s], abs=0.1)


def test_given_weights(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(docs.collect(), packing.pack(docs, weights={"src0": 3.0, "src1": 1.0}).collect())


def test_defined_cases(spark, awkward, empty):
    pieces = packing.pack(awkward).collect()
    assert packing.pack(empty).count() == 0
    place = 0
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.sequence_id * 1024 + p.offset == place
        place += p.length
    assert sum(p.start == 0 for p in pieces) == awkward.count()
    assert [p.length for p in pieces if p.doc_id == 2] == [1]


def test_parts_give_the_tokenizers_ids():
    enc = packing.PartEncoder(packing.default_tokenizer())
    rng = random.Random(1)
    bits = ["a", "Z", "é", "ñ", "1", ".", " ", " ", "  ", "\n", "\n", "\n\n", "\t", "'s", "'ll", "'", "###", "<|endoftext|>", "<|", "|>", "endoftext", "_", "́", " ", "　", "😀", "中", "\x1c", "\r\n", "½", "٣", "the", "\x85", " ", "!", "​"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(5000)]
    want = [x.ids for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, enc.dtype).tolist() for at in range(0, len(texts), 100) for x in enc.encode(texts[at : at + 100])]
    assert got == want


def test_null_source_has_its_own_queue(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, "c d", ""), (3, "e f", "=")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.source) for r in packing.pack(docs).collect()} == {(1, None), (2, ""), (3, "=")}


def test_columns_give_the_tokenizers_ids():
    enc = packing.PartEncoder(packing.default_tokenizer())
    rng = random.Random(2)
    bits = ["a", "Zb", "é", "×", "ñ", "1", ".", ",", " ", " ", " ", "\n", "\n", "\t", "'s", "'", "###", "<|endoftext|>", "_", "́", " ", " ", "　", " ", "᠎", "\u0085", " ", "’", "​", "😀", "中", "か", "\x1c", "\r\n", "½", "٣", "the", "\x00"]
    texts = [None if rng.random() < 0.02 else "".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(20_000)]
    want = [[*x.ids, 0] for x in enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    column = pa.array(texts)
    for at, n in ((0, 1), (1, 4000), (4001, 7999), (12_000, 8000)):
        got = enc.encode_column(column.slice(at, n), np.zeros(1, enc.dtype).tobytes()).to_pylist()
        assert [np.frombuffer(x, enc.dtype).tolist() for x in got] == want[at : at + n]
    assert enc.encode_column(column[:0]).to_pylist() == []
    assert [len(enc.encode_column(pa.array(t, pa.string()))) for t in ([None], ["", ""], [None, "a"])] == [1, 2, 2]


def test_parts_that_differ_in_symbols_and_lines_are_held_once():
    enc = packing.PartEncoder(packing.default_tokenizer())
    enc.encode([f"x a{end}b{i} " for end in (".", ",\n", "###", "?\nThe ", "\n") for i in range(200)])
    assert sum(k.strip(" ").startswith("a") for k in enc.known) == 1


def test_little_is_remembered():
    enc = packing.PartEncoder(packing.default_tokenizer())
    for k in range(10):
        enc.encode([" ".join(f"{i:08d}" for i in range(k * 80_000, (k + 1) * 80_000))])
        assert sum(map(len, enc.known)) + sum(map(len, enc.old)) < 6_000_000
