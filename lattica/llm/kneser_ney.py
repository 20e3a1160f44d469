"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte n-grams.

The model is trained on trusted texts (labelled good and not toxic), of which one id in ``HELD`` is held out. Tasks
count n-grams before anything is shuffled; lower orders hold continuation counts, discounts come from the counts of
counts of each order.

Scoring is joins of counts, sharded by n-gram: each partition of the documents asks for its distinct n-grams; those of
all partitions, and their suffixes, meet the count tables order by order, which gives the interpolated probability of
each; the answers go back to the partitions that asked, where they meet the documents and are summed. A task holds the
answers of one partition, a bounded portion of its texts' n-grams, and never the model. Verdicts compare a document's
perplexity for a byte with quantiles of the trusted documents of its language: the lower bound is one of all of them,
the upper one of those held out.

Defined cases: null and empty texts have no perplexity and are not kept; a null language is a language of its own; a
language with fewer than ``FEW`` held-out documents uses the quantiles of all languages, and where none is held out
the upper bound is one of all trusted documents; rows without doc_id and repeated rows are scored like any others; without trusted texts every byte is equally
likely and every non-empty text is kept; texts of any length are taken in portions; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm._common import settled, slices, table, written

ORDER = 5
#: n-grams that a task holds before it hands them on.
DISTINCT = 4_000_000
#: Trusted ids that are broadcast (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Quantile of all trusted documents below which texts are too even, and of those held out above which they are odd.
LOW, HIGH, FEW, HELD = 0.001, 0.99, 50, 5
#: Bytes of texts whose n-grams are held at once.
BATCH_BYTES = 2 << 20


def portions(texts: list[bytes], order: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """(rows, parts): texts in portions of about BATCH_BYTES, each part led in by the order - 1 bytes before it."""
    rows, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), BATCH_BYTES):
            part = t[at : at + BATCH_BYTES]
            rows.append(i)
            parts.append((t[at - order + 1 : at] if at else b"\0" * (order - 1)) + part)
            size += len(part)
            if size >= BATCH_BYTES:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def ngrams(parts: list[bytes], order: int) -> np.ndarray:
    """Codes of the n-grams within each part, one after another; a code holds its newest byte lowest."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    codes = np.zeros(len(raw) - order + 1, np.int64)
    for k in range(order):
        codes |= raw[order - 1 - k : len(raw) - k].astype(np.int64) << (8 * k)
    keep = np.ones(len(codes), bool)
    for e in np.cumsum([len(p) for p in parts])[:-1]:
        keep[e - order + 1 : e] = False
    return codes[keep]


def _raw(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def ngram_counts(texts: DataFrame, order: int) -> DataFrame:
    """(g, c): the n-grams of the column ``text`` and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            where, codes = pd.factorize(np.concatenate([g for g, _ in held]))
            return codes, np.bincount(where, np.concatenate([c for _, c in held]), len(codes)).astype(np.int64)

        def out(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1])], ["g", "c"])

        for b in slices(batches, "text"):
            for _, parts in portions(_raw(b.column(0)), order):
                where, codes = pd.factorize(ngrams(parts, order))
                held.append((codes, np.bincount(where, minlength=len(codes))))
                if sum(len(g) for g, _ in held) > DISTINCT:
                    held[:] = [merged()]
                    if len(held[0][0]) > DISTINCT // 2:
                        yield out(held.pop())
        if held:
            yield out(merged())

    return texts.select("text").mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def asked(docs: DataFrame, order: int) -> DataFrame:
    """(block, g): the n-grams of the column ``text`` in each partition, whose number ``block`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, block = np.zeros(0, np.int64), [], None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(held), block, np.int32)), pa.array(held)], ["block", "g"])

        for b in slices(batches, "text"):
            block = b.column(0)[0].as_py()  # all rows of a partition bear its number
            for _, parts in portions(_raw(b.column(1)), order):
                fresh.append(pd.unique(ngrams(parts, order)))
                if sum(map(len, fresh)) > DISTINCT // 4:
                    held, fresh = pd.unique(np.concatenate([held, *fresh])), []
                    if len(held) > DISTINCT:
                        yield out()
                        held = held[:0]
        held = pd.unique(np.concatenate([held, *fresh]))
        if len(held):
            yield out()

    return docs.select("block", "text").mapInArrow(run, "block int, g long")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the counts of counts."""
    n1, n2, n3, n4 = counts.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def log_probs(grams: DataFrame, texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, logp): the logarithm of the interpolated probability of each of the n-grams in the column g, by joins."""
    counts, wanted = {order: written(ngram_counts(texts, order), f"counts{order}")}, {order: written(grams.select("g").distinct(), f"grams{order}")}
    for n in range(order - 1, 0, -1):
        suffix = F.col("g").bitwiseAND(F.lit((1 << (8 * n)) - 1)).alias("g")
        counts[n] = written(counts[n + 1].groupBy(suffix).agg(F.count(F.lit(1)).alias("c")), f"counts{n}")
        wanted[n] = written(wanted[n + 1].select(suffix).distinct(), f"grams{n}")
    lower = None
    for n in range(1, order + 1):
        d1, d2, d3 = discounts(counts[n])
        paid = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        h = F.shiftright("g", 8).alias("h")
        histories = counts[n].select(h, "c").groupBy("h").agg(F.sum("c").alias("s"), (F.sum(paid) / F.sum("c")).alias("w"))
        own = wanted[n].select("g", h, F.col("g").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1)).alias("suffix"))
        own = own.join(counts[n], "g", "left").join(histories, "h", "left")
        if lower is None:
            own = own.withColumn("below", F.lit(1 / 256))
        else:
            own = own.join(lower.select(F.col("g").alias("suffix"), F.col("p").alias("below")), "suffix")
        seen = F.coalesce((F.col("c") - paid) / F.col("s"), F.lit(0.0)) + F.col("w") * F.col("below")
        lower = written(own.select("g", F.when(F.col("s").isNull(), F.col("below")).otherwise(seen).alias("p")), f"probs{n}")
    return lower.select("g", F.log(F.greatest("p", F.lit(1e-300))).alias("logp"))


def scored(docs: DataFrame, texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity) of every row under the model of ``texts``."""
    # computed twice, so its partitions have to come out alike
    own = settled(docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")))
    own = own.withColumn("block", F.spark_partition_id())
    asks = written(asked(own, order), "asks")
    answers = asks.join(log_probs(asks, texts, order), "g").select("block", F.lit(0).alias("kind"), "g", "logp")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1)
        for b in slices(batches, "text"):
            raw = _raw(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(0), b.column(1), pa.array(map(len, raw), pa.int64()), pa.array([press.compress(t) for t in raw], pa.binary())], ["block", "doc_id", "lang", "n_bytes", "z"])

    texts_of = own.mapInArrow(packed, "block int, doc_id long, lang string, n_bytes long, z binary").withColumn("kind", F.lit(1))
    names = ["block", "kind", "g", "logp", "doc_id", "lang", "n_bytes", "z"]
    both = answers.unionByName(texts_of, allowMissingColumns=True).select(names).repartition("block").sortWithinPartitions("block", "kind", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, logs, press = None, [], np.zeros(0), zstandard.ZstdDecompressor()
        keys = np.zeros(0, np.int64)
        for whole in batches:
            block, kind = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            cut = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(block)], strict=True):
                if s == e:
                    continue
                if block[s] != now:
                    now, held, keys = block[s], [], np.zeros(0, np.int64)
                if kind[s] == 0:
                    held.append((whole.column(2).slice(s, e - s).to_numpy().copy(), whole.column(3).slice(s, e - s).to_numpy().copy()))
                    continue
                if held:
                    keys, logs = (np.concatenate(c) for c in zip(*held, strict=True))
                    held = []
                for b in slices(iter([whole.slice(s, e - s)]), "z", size=BATCH_BYTES // 4):
                    raw, total = [press.decompress(z) for z in b.column(7).to_pylist()], np.zeros(b.num_rows)
                    for rows, parts in portions(raw, order):
                        where, codes = pd.factorize(ngrams(parts, order))
                        codes = np.asarray(codes, np.int64)
                        at = np.searchsorted(keys, codes)
                        if len(keys) <= at.max(initial=0) or (keys[at] != codes).any():
                            raise RuntimeError("partitions of the documents changed while they were scored")
                        each = np.concatenate(([0.0], np.cumsum(logs[at][where])))
                        sizes = np.array([len(p) - order + 1 for p in parts])
                        ends = np.cumsum(sizes)
                        np.add.at(total, rows, each[ends] - each[ends - sizes])
                    n = b.column(6).to_numpy()
                    with np.errstate(divide="ignore", invalid="ignore"):
                        ppl = np.exp(-total / n)
                    yield pa.RecordBatch.from_arrays([b.column(4), b.column(5), b.column(6), pa.array(ppl, mask=n == 0)], ["doc_id", "lang", "n_bytes", "perplexity"])

    return both.mapInArrow(run, "doc_id long, lang string, n_bytes long, perplexity double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, held): ids of trusted documents, and whether they are held out."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    own = good.filter("q = 1 and coalesce(t, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id"))
    return own.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0)


def judged(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, low, high, kept)."""
    good = written(trusted_ids(labels), "trusted")
    good = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    own = docs.join(good.filter("not held"), "doc_id", "left_semi").select(F.col("text").cast("string").alias("text"))
    rows = written(scored(docs, own, order), "scored")
    trusted = rows.join(good, "doc_id").filter("perplexity is not null")
    cut = lambda c, q: F.percentile_approx(c, F.lit(q), F.lit(100_000))
    held = F.when(F.col("held"), F.col("perplexity"))
    cuts = [F.count(held).alias("n"), cut(F.col("perplexity"), LOW).alias("_low"), F.coalesce(cut(held, HIGH), cut(F.col("perplexity"), HIGH)).alias("_high")]
    whole = trusted.agg(*cuts).first()
    by_lang = trusted.groupBy(F.col("lang").alias("_lang")).agg(*cuts).filter(F.col("n") >= FEW)
    out = rows.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    rest = [0.0, float("inf")] if whole["_low"] is None else [whole["_low"], whole["_high"]]
    out = out.withColumns({"low": F.coalesce("_low", F.lit(float(rest[0]))), "high": F.coalesce("_high", F.lit(float(rest[1])))})
    return out.select("doc_id", "lang", "n_bytes", "perplexity", "low", "high", F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(False)).alias("kept"))


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
