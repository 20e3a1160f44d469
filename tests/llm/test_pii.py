"""Base spans against the plain patterns, the field against exact sums, and consistency of repeated tokens."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np

from lattica.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    def passes(k, s):
        digits = re.sub("[^0-9]", "", s)
        return [True, k != 1 or all(int(p) <= 255 for p in s.split(".")), 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15][k]

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if passes(k, m[0]))


def test_base_spans(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rng = random.Random(1)
    texts += ["".join(rng.choice("0123456789..@+- ()ab%é") for _ in range(80)) for _ in range(3000)]
    texts += ["", "@", "a@b", "a@b.c@d.e", "x@y.z.@q.r", "1.2.3.4.5.6.7.8", "256.1.1.1", "00256.1.1.1", "0000.0001.2.3", "4" * 900, "1." * 900, "a" * 900 + "@", "+1" * 900]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t[:80]


def test_long_runs_take_linear_time():
    for t in ("4" * 200_000, "1." * 100_000, "a" * 200_000, "a" * 200_000 + "@", "+1" * 100_000):
        assert len(pii.base_spans(t)) < 30_000


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(3)
    m = len(pii.LABELS)
    f = pii.Field(rng.normal(size=(len(pii.FEATURES), m)), rng.normal(size=(m, m)), rng.normal(size=(m, m)))
    x = rng.random((4, len(pii.FEATURES)))
    chain, skip = np.array([[0, 1], [1, 2]]), np.array([[1, 3]])
    nodes, joint = f.infer(x, chain, skip, 60)
    want, pair = np.zeros((4, m)), np.zeros((m, m))
    for y in itertools.product(range(m), repeat=4):
        w = np.exp(sum((x @ f.unary)[i, y[i]] for i in range(4)) + f.chain[y[0], y[1]] + f.chain[y[1], y[2]] + f.skip[y[1], y[3]])
        for i in range(4):
            want[i, y[i]] += w
        pair[y[1], y[3]] += w
    assert np.allclose(nodes, want / want.sum(axis=1, keepdims=True), atol=1e-4)
    assert np.allclose(joint[2], pair / pair.sum(), atol=1e-4)


def test_repeats_are_labelled_alike():
    lines = [f"write to anna.{i}@mail{i}.example.com now, anna.{i} said {i + 11} times" for i in range(60)]
    field = pii.train([pii.tokens(t, pii.base_spans(t)) for t in lines])
    text = "mail bert.77@mail3.example.com today. " + "filler words here " * 40 + "then bert.77 came, and carl.88 too"
    base, every = pii.analysed([text], field)[0]
    at = text.rindex("bert.77")
    assert (at, 0, at + 7) in every and set(base) <= set(every)
    assert all(not text[a:b].startswith("carl") for a, _, b in every)


def test_repeats_without_a_digit_are_labelled():
    lines = [f"write to anna.{i}@mail{i}.example.com now, anna.{i} said {i + 11} times" for i in range(60)]
    field = pii.train([pii.tokens(t, pii.base_spans(t)) for t in lines])
    for address in ("maria.lopez@example.com", "<mailto:maria.lopez@example.com>"):
        text = f"mail {address} today. " + "filler words here " * 40 + "then Maria.Lopez came, and carla.ruiz too"
        base, every = pii.analysed([text], field)[0]
        at = text.rindex("Maria.Lopez")
        assert [x for x in every if x not in base] == [(at, 0, at + 11)]
        assert len(pii.tokens(text, base)) == 2


def test_parts_of_an_address_are_names_wherever_they_repeat():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    lines = []
    for i in range(80):
        a, b = word(), word()
        lines.append(f"{a.title()} {b.title()} wrote to {a}.{b}@mail{i}.example.com, {b.title()} said {i + 11} times. Then {word().title()} left")
    field = pii.train([pii.tokens(t, pii.base_spans(t)) for t in lines])
    text = "Maria Lopez <maria.lopez@example.com> met Carla. " + "filler words here " * 60 + "then Lopez came in 2021, with Maria; a lopez too"
    _, every = pii.analysed([text], field)[0]
    assert sorted(text[a:b] for a, k, b in every if pii.ALL_KINDS[k] == "name") == ["Lopez", "Lopez", "Maria", "Maria"]
    cut = pii.Field(field.unary, field.chain, 0 * field.skip)
    loose = "The Vgadbei code " + "word " * 50
    assert pii.analysed([loose], cut)[0] == ([], [])


def test_the_field_finds_secrets_in_the_corpus(spark):
    """Held-out documents: those with a key have an added span there, and few others have one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").filter("text is not null")
    field = pii.fit(docs.filter("doc_id % 2 = 0"))
    rows = docs.filter("doc_id % 2 = 1").collect()
    key = re.compile(r"AKIA[A-Z0-9]{16}|[0-9a-f]{32,}")
    with_key = [r.text for r in rows if key.search(r.text)]
    for text, (base, every) in zip(with_key, pii.analysed(with_key, field), strict=True):
        assert any(a <= m.start() < b for m in key.finditer(text) for a, _, b in every if (a, _, b) not in base)
    clean = [r.text for r in rows if not key.search(r.text) and not pii.base_spans(r.text)]
    wrong = sum(len(every) > len(base) for base, every in pii.analysed(clean, field))
    assert with_key and wrong <= 0.001 * len(clean)


def test_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in pii.op6_pii(spark, small).collect():
        spans = plain(texts[r.doc_id])
        written = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))


def test_masking():
    assert pii.masked("a 1.2.3.4 b", [(2, 1, 9)]) == "a <IP> b"
    assert pii.masked("abcdef", [(1, 0, 3), (2, 1, 5)]) == "a<EMAIL>f"


def test_defined_cases(spark, awkward, empty):
    field = pii.fit(awkward)
    out = pii.found(awkward, field)
    assert out.count() == awkward.count()
    nothing = out.filter("doc_id = 2").first()
    assert (nothing.spans, nothing.base_sha256) == ("", hashlib.sha256(b"").hexdigest())
    stage = pii.pii_stage(spark, awkward, "")
    assert stage.columns == awkward.columns and stage.count() == awkward.count()
    assert stage.filter("doc_id = 2 and text is null").count() == 1
    assert pii.found(empty, pii.fit(empty)).count() == 0
