"""Boundaries, and removal against brute force."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from plain_python import without_repeats

from lattica.llm import line_chunks as lines


def test_boundaries_resist_shifts():
    rng = random.Random(2)
    own = [f"line {rng.random()}" for _ in range(400)]
    whole = {"\n".join(own[a:b]) for a, b, _ in lines.chunks(own)}
    shifted = ["new first line", *own[:200], "inserted", *own[200:]]
    again = {"\n".join(shifted[a:b]) for a, b, _ in lines.chunks(shifted)}
    assert len(whole & again) > 0.95 * len(whole)
    assert [x for a, b, _ in lines.chunks(own) for x in own[a:b]] == own


def test_no_line_of_a_chunk_stands_alone():
    rng = random.Random(3)
    own = [f"line {rng.random()}" for _ in range(400)]
    assert all(b - a >= lines.MIN_LINES for a, b, _ in lines.chunks(own))
    blank = [x for line in own for x in (line, " ")]
    assert sum(b - a for a, b, _, _ in lines.repeatable("\n".join(blank))) >= len(blank) - 1


def test_a_long_repeated_run_goes_but_for_its_ends(spark):
    rng = random.Random(4)
    own = [f"line {rng.random()}" for _ in range(300)]
    docs = [(1, "\n".join(["first", *own, "end"])), (2, "\n".join(["other a", "other b", *own, "other c", "other d"])), (3, "\n".join(own))]
    got = {r.doc_id: r.text for r in lines.cleaned(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == docs[0][1]
    for doc in (2, 3):
        assert len(set(got[doc].split("\n")) & set(own)) <= 12


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = without_repeats(rows)
    got = {r.doc_id: r.text for r in lines.cleaned(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == want
    assert any(want[d] != t for d, t in rows)


def test_filter_and_hash(spark):
    h = [1, -1, 1 << 62, -(1 << 63), 12345]
    bits = lines.bit_filter(spark.createDataFrame([(x,) for x in h], "h long"))
    at = [(x & lines._MASK) >> (64 - lines.FILTER_BITS) for x in h]
    assert all(int(bits[i >> 6]) >> (i & 63) & 1 for i in at)
    assert int(np.bitwise_count(bits.view(np.uint64)).sum()) == len(set(at))
    assert spark.sql("SELECT xxhash64('añb')").first()[0] == lines.own_hash("añb")
    assert xxhash.xxh64_intdigest(b"x") >= 0


def test_repeats_between_and_within_documents(spark):
    text = "one two\nthree four\n" * 6
    other = "five six\nseven eight\n" * 6
    docs = spark.createDataFrame([(1, text), (2, text), (3, other)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.cleaned(docs).collect()}
    assert got == without_repeats([(1, text), (2, text), (3, other)])


def test_defined_cases(spark, awkward, empty):
    out = lines.line_stage(spark, awkward, "")
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert out.filter("doc_id = 2 and text is null").count() == 1
    assert out.filter("doc_id = 3 and text = ''").count() == 1
    twice = [r.text for r in out.filter("doc_id = 1").collect()]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert lines.cleaned(empty).count() == 0
    assert lines.cleaned(awkward.select("doc_id", "text")).count() == awkward.count()
