"""Removal of repeated multi-line chunks with content-defined boundaries.

A rolling hash runs over the hashes of a document's lines; a chunk ends after a line whose window hash falls into a
fixed residue class, unless fewer than ``MIN_LINES`` lines with words would stand in the chunk or be left after it.
Only lines in that class right after one another depend on where the last chunk ended; boundaries meet again at the
next line outside it, so that an inserted or lost line shifts no later chunk.
Chunks with ``MIN_LINES`` lines or more that hold words are counted over the whole corpus by hash; the texts of chunks
whose hash repeats are then compared byte for byte, and all but the first occurrence (smallest doc_id, then smallest
position) are removed.

Only hashes are gathered from all chunks. A bit filter of a fixed size (8 MB) lets the texts of possible repeats
through; its false hits cost a little traffic and change nothing.

Defined cases: null texts stay null and empty ones empty; rows that bear one doc_id are one document, so that repeated
rows are treated alike; rows without doc_id count as occurrences but are left as they are; blank lines belong to chunks
but don't count towards ``MIN_LINES``; an empty table stays empty; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm._common import slices, table, written

WINDOW, ONE_IN, MIN_LINES = 2, 2, 2
FILTER_BITS = 26
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_OUT = pow(_BASE, WINDOW, 1 << 64)


def chunks(lines: list[str]) -> list[tuple[int, int, int]]:
    """(first line, line after the last, hash) of each chunk."""
    out, start, roll, whole = [], 0, 0, xxhash.xxh64(seed=1)
    worded = [bool(x.strip(" \t\n\x0b\f\r")) for x in lines]
    held, left = 0, sum(worded)
    last: list[int] = [0] * WINDOW
    for i, line in enumerate(lines):
        b = line.encode("utf-8", "surrogatepass")
        h = xxhash.xxh64_intdigest(b)
        roll = (roll * _BASE + h - last[i % WINDOW] * _OUT) & _MASK
        last[i % WINDOW] = h
        whole.update(b)
        whole.update(b"\n")
        held, left = held + worded[i], left - worded[i]
        if ((roll >> 32) % ONE_IN == 0 and held >= MIN_LINES and (left >= MIN_LINES or not left)) or i + 1 == len(lines):
            out.append((start, i + 1, whole.intdigest()))
            start, whole, held = i + 1, xxhash.xxh64(seed=1), 0
    return out


def repeatable(text: str | None) -> list[tuple[int, int, int, str]]:
    """(first line, line after the last, hash as a signed long, text) of the chunks that may be removed."""
    if not text or "\n" not in text:
        return []
    lines = text.split("\n")
    out = []
    for a, b, h in chunks(lines):
        part = lines[a:b]
        if b - a >= MIN_LINES and sum(bool(x.strip(" \t\n\x0b\f\r")) for x in part) >= MIN_LINES:
            out.append((a, b, h - (1 << 64) if h >> 63 else h, "\n".join(part)))
    return out


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array([h for t in b.column(0) for _, _, h, _ in repeatable(t.as_py())], pa.int64())], ["h"])


def bit_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """2**bits bits, of which those of the hashes are set; gathered as at most 2**(bits - 6) words."""
    at = F.shiftrightunsigned("h", 64 - bits)
    rows = hashes.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(h, %d) & 63 as int))" % (64 - bits))).alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy()
    return out


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end): line ranges to remove from the rows with this id and text."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    again = written(own.select("text").mapInArrow(_hashes, "h long").groupBy("h").count().filter("count > 1").select("h"), "repeats")
    bits = spark.sparkContext.broadcast(bit_filter(again))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names = bits.value, ["doc_id", "text_hash", "start", "end", "h", "nth", "chunk"]
        for b in slices(batches, "text"):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen: dict[str, int] = {}
                whole = None
                for start, end, h, chunk in repeatable(text):
                    at = (h & _MASK) >> (64 - FILTER_BITS)
                    if int(words[at >> 6]) >> (at & 63) & 1:
                        whole = own_hash(text) if whole is None else whole
                        rows.append((doc, whole, start, end, h, nth := seen.get(chunk, 0), chunk))
                        seen[chunk] = nth + 1
            if not rows:
                continue
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 6 else pa.int64()) for k, c in enumerate(cols)], names)

    found = own.mapInArrow(texts, "doc_id long, text_hash long, start long, end long, h long, nth long, chunk string")
    held = written(found.join(again, "h", "left_semi"), "chunks")
    # equal hash and equal bytes: one class; the hash keeps the comparison of the long strings rare
    # written, so that the join below has plain exchanges on both sides and Spark can split a chunk that very many hold
    classes = written(held.groupBy("h", "chunk").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null"), "classes")
    later = held.join(classes, ["h", "chunk"]).filter("doc_id <> first or nth > 0")
    return later.select("doc_id", "text_hash", "start", "end").distinct()


def own_hash(text: str) -> int:
    """What F.xxhash64 gives for the text."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def without(text: str, spans: list[dict]) -> str:
    lines, out, at = text.split("\n"), [], 0
    for span in spans:
        out += lines[at : span["start"]]
        at = span["end"]
    return "\n".join(out + lines[at:])


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with text and, if present, n_chars as they are without the repeated chunks; further column ``removed_lines``."""
    docs = docs.drop("removed_lines")
    spans = removals(docs).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    joined = docs.join(spans, (docs["doc_id"] == F.col("_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_hash")), "left").drop("_id", "_hash")
    names, kept = [*docs.columns, "removed_lines"], docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            spans = b.column(b.num_columns - 1).to_pylist()
            cols, k = b.columns[:-1], b.schema.get_field_index("text")
            new = [t if not s else without(t, s) for t, s in zip(cols[k].to_pylist(), spans, strict=True)]
            cols[k] = pa.array(new, cols[k].type)
            if "n_chars" in names:
                n = names.index("n_chars")
                cols[n] = pa.array([None if t is None else len(t) for t in new], cols[n].type)
            lines = pa.array([sum(x["end"] - x["start"] for x in s or []) for s in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([*cols, lines], names)

    return joined.mapInArrow(run, T.StructType([*kept.fields, T.StructField("removed_lines", T.LongType())]))


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row: doc_id, lines removed, characters left, and digest of the text that is left."""
    out = cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "removed_lines", F.length("text").cast("long").alias("chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated chunks go from the texts; every document stays."""
    kept = cleaned(docs.withColumnRenamed("removed_lines", "_removed_lines"))
    return kept.drop("removed_lines").withColumnRenamed("_removed_lines", "removed_lines").select(*docs.columns)
