"""Perspectives, SentencePiece, Kneser-Ney, the pipeline and the registered SQL."""

from __future__ import annotations

import re
import struct
import zlib

import duckdb
import numpy as np
import plain_python
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lattica.llm import decision_rules, kneser_ney, packing, perspectives, pii, queries
from lattica.llm import sentencepieces as sp

# perspectives


def test_perspectives_as_sql(spark, small):
    own = perspectives.op8_perspectives(spark, small)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    sql = con.sql(queries.ORACLES["op8_perspectives"])
    assert own.columns == sql.columns
    assert sorted(map(tuple, own.collect()), key=repr) == sorted(sql.fetchall(), key=repr)


def test_perspectives_cases(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "who"), (1, 4, "", "<|end|>"), (2, 0, "system", "alone"), (None, None, "ann", "x"), (None, None, "ann", "x"), (None, 1, "system", "y")]
    df = spark.createDataFrame(rows, schema)
    frame = perspectives.rotated(df)
    out = frame.collect()
    assert {(r.conv_id, r.perspective) for r in out} == {(1, "ann"), (1, "bob"), (1, None), (1, ""), (None, "ann")}
    ann = sorted((r for r in out if r.conv_id == 1 and r.perspective == "ann"), key=lambda r: r.char_start)
    text = "".join(r.segment for r in ann)
    assert text == "<|system|>\nrules<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|user name=|>\nwho<|end|>\n<|user name=|>\n<\\|end|><|end|>\n"
    assert all(text[r.char_start :].startswith(r.segment) for r in ann)
    assert [text[r.train_start : r.train_end] for r in ann if r.trained] == ["hi<|end|>"]
    assert [r.trained for r in ann] == [False, True, False, False, False]
    assert [(r.char_start, r.train_start) for r in out if r.conv_id is None] == [(0, 14), (0, 14)]
    assert perspectives.rotated(df.limit(0)).count() == 0
    duck = duckdb.connect()
    duck.register("conversations", df.toPandas().astype({"turn": "Int64", "conv_id": "Int64"}))
    assert sorted(map(tuple, out), key=repr) == sorted(duck.sql(f"SELECT {', '.join(frame.columns)} FROM ({queries.ORACLES['op8_perspectives']})").fetchall(), key=repr)
    clash = df.selectExpr("*", *[f"1 AS {c}" for c in ("seat", "own", "perspective", "head", "segment", "char_start", "trained", "seat_conv")])
    assert sorted(map(tuple, perspectives.rotated(clash).collect()), key=repr) == sorted(map(tuple, out), key=repr)


def make_docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# sentencepieces


def test_parity(spark, small):
    with open(sp.default_model(), "rb") as f:
        data = f.read()
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts += ["", " ", "  a  b ", "\n\n x", "日本語 🎉🎉", "a▁b ▁ c", "\t tab", "<s> </s> <unk> <0x41>", "x" * 500, "a\u0000b", "naïve ﬁ"]
    assert sp.parity(data, texts) == []


def varint(n):
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def unigram_model(pieces, collapse, fallback=True):
    """A model file by hand: scores are given, nothing is trained."""
    body = b""
    for text, score, kind in pieces:
        own = b"\x0a" + varint(len(text.encode())) + text.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + varint(kind)
        body += b"\x0a" + varint(len(own)) + own
    trainer = b"\x18\x01" + b"\x98\x02" + bytes([fallback])  # unigram
    normalizer = b"\x0a\x08identity" + b"\x18\x01" + b"\x20" + bytes([collapse]) + b"\x28\x01"
    return body + b"\x12" + varint(len(trainer)) + trainer + b"\x1a" + varint(len(normalizer)) + normalizer


@pytest.mark.parametrize("collapse", [0, 1])
def test_unigram_parity(collapse):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", -9.0, 6) for b in range(256)]]
    pieces += [("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -3.1, 1), ("▁ab", -3.3, 1), ("ba", -4.0, 1), ("▁a", -4.1, 1), ("aba", -5.2, 1)]
    data = unigram_model(pieces, collapse)
    assert sentencepiece.SentencePieceProcessor(model_proto=data).get_piece_size() == len(pieces)
    texts = ["ab aba", "abba baab", "a  b", " ab ", "", "zé ab", "ababababa", "aaaa bbbb"]
    assert sp.parity(data, texts) == []
    assert sp.Model.parse(data).kind == sp.UNIGRAM


@pytest.mark.parametrize("fallback", [True, False])
def test_pieces_that_match_no_text(fallback):
    """Control, byte and unused pieces stand in texts as ordinary characters."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *([(f"<0x{b:02X}>", -9.0, 6) for b in range(256)] if fallback else [])]
    pieces += [("▁", -2.0, 1), *[(c, -3.0 - k / 7, 1) for k, c in enumerate("abhetx<>/s04")], ("the", -4.0, 5), ("▁ab", -3.3, 1), ("ab", -3.1, 1), ("abba", -0.5, 5), ("<s", -4.0, 1)]
    data = unigram_model(pieces, 0, fallback)
    rng = np.random.default_rng(3)
    bits = ["a", "b", " ", "<s>", "</s>", "<0x41>", "the", "abba", "é", "😀", "<", "1>", "x", "<unk>", "s", "  "]
    texts = ["a <s> b", "x <0x41> y", "the </s>", *["".join(rng.choice(bits, rng.integers(0, 9))) for _ in range(500)]]
    texts = [t for t in texts if "<unk>" not in t]  # the library spells it as the unknown piece
    assert sp.parity(data, texts) == []


def test_bpe_cut_between_bytes_that_no_piece_joins():
    with open(sp.default_model(), "rb") as f:
        data = f.read()
    own = sp.Pieces(data)
    rng = np.random.default_rng(4)
    bits = ["a", "the", "Zb", "é", "ñ", "1", ".", ",", " ", " ", "  ", "\n", "\n\n", "\t", "'s", "###", "<s>", "<0x0A>", "▁", "\u0301", "\u00a0", "’", "😀", "中", "か", "\r\n", "½", "\x00", "ing", "tion"]
    assert sp.parity(data, ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(5000)]) == []
    own.encode([f"x a{end}b{i} " for end in ("\n", "\n\n", "\nThe ", "###\n") for i in range(200)])
    assert [k for k in own.known if k.startswith("▁a")] == ["▁a"]


def test_bpe_with_unused_pieces_is_refused():
    with open(sp.default_model(), "rb") as f:
        model = sp.Model.parse(f.read())
    model.pieces[-1] = (*model.pieces[-1][:2], sp.UNUSED)
    with pytest.raises(ValueError):
        sp.rebuilt(model)


def test_sentencepiece_cases(spark, awkward, empty):
    with open(sp.default_model(), "rb") as f:
        data = f.read()
    out = sp.digests(awkward, data).collect()
    assert len(out) == awkward.count() and all(r.round_trip for r in out)
    assert [r.n_ids for r in out if r.doc_id == 2] == [0]
    assert sp.digests(empty, data).count() == 0
    many = make_docs(spark, [f"naïve {i} <s> café {i}" for i in range(3000)])
    assert {r.parity for r in sp.digests(many, data).collect()} == {True, None}
    ids = sp.encoded(awkward.filter("doc_id = 6"), data).first().ids
    assert sentencepiece.SentencePieceProcessor(model_proto=data).encode("naïve café 😀 text") == ids


def test_every_document_is_held_against_the_library(spark):
    with open(sp.default_model(), "rb") as f:
        data = f.read()
    texts = [f"word {i} naïve" for i in range(600)]
    out = sp.digests(make_docs(spark, texts), data).collect()
    assert [r.as_library for r in out] == [True] * 600
    own, lib = sp.Pieces(data), sp.library(data)
    ids = own.encode(texts)
    back = own.decode(ids)
    ids[77], back[300] = ids[78], back[301]
    assert [i for i, x in enumerate(sp.agreement(lib, texts, ids, back)) if not x] == [77, 300]


# kneser_ney


def brute_model(texts, order):
    counts = {}
    for t in texts:
        b = b"\0" * (order - 1) + t.encode()
        for i in range(len(b) - order + 1):
            counts[b[i : i + order]] = counts.get(b[i : i + order], 0) + 1
    return brute_probabilities(counts, order)


def brute_probabilities(counts, order):
    """Interpolated modified Kneser-Ney probabilities in plain Python."""
    grams = {order: counts}
    for n in range(order - 1, 0, -1):
        grams[n] = {}
        for g in grams[n + 1]:
            grams[n][g[1:]] = grams[n].get(g[1:], 0) + 1
    cut, after = {}, {}
    for n, c in grams.items():
        n1, n2, n3, n4 = (sum(x == k for x in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0
        cut[n] = [min(max(k - (k + 1) * y * b / a, 0), k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))] if n1 and n2 and n3 and n4 else [0.5, 0.75, 0.9]
        for g, v in c.items():
            after.setdefault(g[:-1], {})[g] = v

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 256
        own = after.get(g[:-1], {})
        if not own:
            return p(g[1:])
        d, s = cut[n], sum(own.values())
        c = own.get(g, 0)
        free = sum(d[min(v, 3) - 1] for v in own.values())
        return (c - d[min(c, 3) - 1] if c else 0) / s + free / s * p(g[1:])

    return p


def test_probabilities(spark, monkeypatch):
    texts = ["the cat sat on the mat", "the cat ate the rat", "a rat sat on a cat", "that is that"] * 2 + ["mats and cats"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    p = brute_model(texts, 4)
    tests = ["the cat sat", "zebra", "on that mat", "é", "", "the cat sat on the mat" * 40]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(tests)], "doc_id long, lang string, text string")
    for size in (kneser_ney.BATCH_BYTES, 7):
        monkeypatch.setattr(kneser_ney, "BATCH_BYTES", size)
        for r in kneser_ney.scored(docs.repartition(3), df, 4).collect():
            b = b"\0\0\0" + tests[r.doc_id].encode()
            want = np.exp(-np.mean([np.log(p(b[i : i + 4])) for i in range(len(b) - 3)])) if tests[r.doc_id] else None
            assert r.perplexity == (want and pytest.approx(want, rel=1e-9))


def test_portions():
    texts = [b"", b"abc", b"x" * 50, b"de"]
    old, kneser_ney.BATCH_BYTES = kneser_ney.BATCH_BYTES, 7
    try:
        got = {i: [] for i in range(4)}
        for rows, parts in kneser_ney.portions(texts, 3):
            assert sum(len(p) - 2 for p in parts) < 14
            for i, p in zip(rows, parts, strict=True):
                got[i] += kneser_ney.ngrams([p], 3).tolist()
            assert kneser_ney.ngrams(parts, 3).tolist() == [g for p in parts for g in kneser_ney.ngrams([p], 3).tolist()]
    finally:
        kneser_ney.BATCH_BYTES = old
    for i, t in enumerate(texts):
        assert got[i] == [int.from_bytes((b"\0\0" + t)[k : k + 3], "big") for k in range(len(t))]


def test_query_against_brute_force(spark, tmp_path):
    """Every perplexity, threshold and verdict of the query on 300 documents, order 3."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).toPandas()
    rng = np.random.default_rng(14)
    labels = [(int(d), int(rng.random() < 0.7), int(rng.random() < 0.1)) for d in docs.doc_id[:250]]
    out = kneser_ney.judged(spark.createDataFrame(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 3).toPandas()
    trusted = {d for d, q, t in labels if q and not t}
    held = {r.doc_id for r in spark.createDataFrame([(d,) for d in trusted], "doc_id long").filter(F.pmod(F.xxhash64("doc_id"), F.lit(kneser_ney.HELD)) == 0).collect()}
    texts = {d: (t or "").encode() for d, t in zip(docs.doc_id, docs.text, strict=True)}
    counts = {}
    for d in trusted - held:
        b = b"\0\0" + texts[d]
        for i in range(len(b) - 2):
            counts[b[i : i + 3]] = counts.get(b[i : i + 3], 0) + 1
    p, known = brute_probabilities(counts, 3), {}
    want = {}
    for d, t in texts.items():
        b = b"\0\0" + t
        logs = []
        for i in range(len(t)):
            g = b[i : i + 3]
            if g not in known:
                known[g] = np.log(p(g))
            logs.append(known[g])
        want[d] = float(np.exp(-np.mean(logs))) if t else None
    assert len(out) == 300
    rank = lambda ids, q: (own := np.sort([want[d] for d in ids if want[d]]))[max(0, int(np.ceil(q * len(own))) - 1)]
    for r in out.itertuples():
        if want[r.doc_id] is None:
            assert np.isnan(r.perplexity) and not r.kept
            continue
        assert r.perplexity == pytest.approx(want[r.doc_id], rel=1e-9)
        assert (r.low, r.high) == pytest.approx((rank(trusted, kneser_ney.LOW), rank(held, kneser_ney.HIGH)), rel=1e-9)
        assert r.kept == (r.low <= r.perplexity <= r.high)


def test_verdicts(spark):
    sf = "/root/testdata/sf0.01"
    out = kneser_ney.op1_kneser_ney(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("toxic = 0")
    good, bad = out.filter("quality = 1"), out.filter("quality = 0")
    assert good.filter("kept").count() >= 0.98 * good.count()
    assert bad.filter("not kept").count() >= 0.9 * bad.count()


def test_kneser_ney_cases(spark, awkward, empty, labels):
    out = kneser_ney.judged(awkward, labels)
    assert out.count() == awkward.count()
    assert out.filter("doc_id = 2 and perplexity is null and not kept").count() == 1
    assert kneser_ney.judged(empty, labels).count() == 0
    flat = kneser_ney.judged(awkward, labels.limit(0))
    assert flat.filter("n_bytes > 0 and not kept").count() == 0
    assert flat.filter("doc_id = 5").first().perplexity == pytest.approx(256)


# pipeline


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "stage")
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] == sizes[4]
    kept = docs.select("doc_id").distinct().count()
    assert kept == sizes[4]


def test_pipeline_in_plain_python(spark, small):
    """Every stage's rows, each from those of the stage before."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = decision_rules.fit(docs, spark.read.parquet(f"{small}/labels.parquet"), after_base=False)
    texts = {r.doc_id: r.text for r in docs.collect()}
    results, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.written(stage(spark, at, small), "stage")
        results[name] = at
    rows = {k: {r.doc_id: r.text for r in v.collect()} for k, v in results.items() if k != "packing"}
    assert rows["quality rules"] == {d: t for d, t in texts.items() if plain_python.counts(t)[0] and plain_python.first_rule(found, t) is None}
    assert rows["line dedup"] == plain_python.without_repeats(list(rows["quality rules"].items()))
    ids = sorted(rows["line dedup"])
    groups = plain_python.similar_groups([rows["line dedup"][d] for d in ids])
    assert sorted(rows["near-duplicates"]) == sorted(ids[min(g)] for g in groups)
    assert all(rows["near-duplicates"][d] == rows["line dedup"][d] for d in rows["near-duplicates"])
    masked = rows["personal data"]
    assert set(masked) == set(rows["near-duplicates"])
    for d, t in masked.items():
        assert not pii.base_spans(t)
        own = re.sub("<(EMAIL|IP|CARD|PHONE|SECRET|NAME)>", "", t)
        assert t == rows["near-duplicates"][d] or len(own) < len(rows["near-duplicates"][d])
        if not re.search("[0-9@]", rows["near-duplicates"][d]):
            assert t == rows["near-duplicates"][d]
    tok = Tokenizer.from_file(packing.default_tokenizer())
    pieces = results["packing"].orderBy("sequence_id", "offset").collect()
    whole = {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in masked.items()}
    seen = {d: 0 for d in whole}
    for r in sorted(pieces, key=lambda r: r.start):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(whole[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] += r.length
    assert all(seen[d] == len(x) for d, x in whole.items())
    place = 0
    for r in pieces:
        assert r.sequence_id * 1024 + r.offset == place and r.offset + r.length <= 1024
        place += r.length


def test_pipeline_cases(spark, awkward, empty, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for docs in (awkward, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, folder), "stage")
        assert "sequence_id" in docs.columns


def test_all_ten_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
