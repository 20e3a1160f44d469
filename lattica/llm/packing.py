"""Mixture-controlled packing of token streams into sequences by deficit round-robin.

Every source is a queue of documents. A window (one sequence) adds ``share * tokens`` to each source's deficit; the
source with the largest deficit gives the next piece, at least ``piece`` tokens unless its document or the window ends
first, and pays for it. What a window leaves over or short is carried to the next.

The corpus is dealt into shards by a hash of each row and its place in the table's partitions. A shard's opening
deficits and its place in the global token stream follow from the token totals of the shards before it, so that shards
are packed independently and yet continue each other:
a sequence may begin in one shard and end in the next, positions have no gaps, and only the last sequence is padded.

Defined cases: null or empty texts are documents of the end id alone; a null source is a source of its own; rows
without doc_id and repeated rows are packed like any others; an empty table gives no pieces; further columns are
ignored. Ids of a text are those of the tokenizers library for the whole text: texts are cut only where the
pre-tokenizer always cuts (see ``starts``), equal parts of a batch are told apart by arrow, and each is encoded once and
remembered for a while. Texts with a special token are encoded whole.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from string import ascii_letters, punctuation

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm._common import library_threads, slices, table, written

WINDOW, PIECE, END_ID = 1024, 256, 0
#: Tokens of a shard (8 MB of ids), and characters of the parts that a worker remembers.
SHARD_TOKENS, REMEMBERED = 4_000_000, 4_000_000
#: Rows, and bytes of texts, whose words are told apart at once.
AT_ONCE = 1 << 16, 8 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Spaces, line ends and ASCII symbols: a text may be cut before them, which depends on the byte before.
_CUTS = np.isin(np.arange(256), np.frombuffer(f" \n{punctuation}".encode(), np.uint8))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(punctuation.encode(), np.uint8))
_LETTER = np.isin(np.arange(256), np.frombuffer(ascii_letters.encode(), np.uint8))
_SEEN = (np.arange(256) > 32) & (np.arange(256) < 127)


def starts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the parts of texts start, given their bytes and where each of them starts.

    Texts are cut before a space or line end that follows a visible character, after such a line end if a visible one
    follows, and before a symbol that follows a letter. No pre-token spans these places, and none depends on what stands
    beyond them.
    """
    at = np.flatnonzero(_CUTS[raw])
    at = at[at > 0]
    now, before = raw[at], raw[at - 1]
    symbol, wide = _SYMBOL[now], before > 127
    good = np.where(symbol, _LETTER[before], _SEEN[before])
    far = np.flatnonzero(wide)
    # bytes of the character before; where they belong to a text before, the cut is a text's start anyway
    a, b, c = before[far], raw[np.maximum(at[far] - 2, 0)], raw[np.maximum(at[far] - 3, 0)]
    blank = (b == 0xC2) | (c == 0xE1) | (c == 0xE2) & ((b == 0x80) & ((a < 0x90) | (a > 0xA7)) | (b == 0x81)) | (c == 0xE3) & (b == 0x80)
    letter = (b == 0xC3) & (a != 0x97) & (a != 0xB7)
    good[far] = np.where(symbol[far], letter, ~blank)
    cut = np.zeros(len(raw) + 1, bool)
    cut[at[good]] = True
    after = at[good & (now == 10)] + 1
    after = after[after < len(raw)]
    cut[after[_SEEN[raw[after]]]] = True
    cut[bounds] = True
    return np.flatnonzero(cut[:-1])


class PartEncoder:
    """Encodes texts by parts, with a bounded memory of parts already seen. Arrow tells equal parts of a batch apart."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a byte-level vocabulary spells each byte as one character
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # parts of the time before, those that occur again come back
        self.held = 0
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = "|".join(map(re.escape, added))
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of unsigned numbers."""
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """Ids of each text (null: empty) as bytes of unsigned numbers, with ``end`` after each."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        # a special token may hold letters and symbols: texts with one are encoded whole
        whole = np.flatnonzero(pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)).tolist() if self.added else []
        joined = [self._bytes(self.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts.take(pa.array(whole, pa.int64())).to_pylist()]
        if whole:
            texts = pc.if_else(pa.array(np.isin(np.arange(len(texts)), whole)), "", texts)
        edges = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        part = starts(raw, edges)
        places = pa.py_buffer(np.append(part, len(raw)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.string(), len(part), [None, places, pa.py_buffer(raw)]).dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self._meet(words)
        ends = np.searchsorted(part, edges[1:])
        codes = np.insert(codes, ends, len(words))
        ends += np.arange(1, len(ends) + 1)
        for k, own in enumerate(whole):
            codes[ends[own] - 1] = len(words) + 1 + k
        ids = pa.array([*map(self.known.__getitem__, words), end, *[x + end for x in joined]], pa.binary()).take(pa.array(codes))
        offsets = np.frombuffer(ids.buffers()[1], np.int32)[np.append(0, ends)]
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), ids.buffers()[2]])

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype is np.uint16 else "I", ids).tobytes()

    def _meet(self, parts: list[str]) -> None:
        """Have the ids of all these parts, which differ, in ``known``."""
        if self.held > REMEMBERED // 2:
            self.old, self.known, self.held = self.known, {}, 0
        known, old = self.known, self.old
        new = [p for p in parts if p not in known]
        self.held += sum(map(len, new))
        if old:
            again = [p for p in new if p in old]
            new = [p for p in new if p not in old]
            known.update(zip(again, map(old.__getitem__, again), strict=True))
        spaced = [p[:1] == " " and not p[1:2].isspace() and not p[-1].isspace() for p in new]
        self._learn([p for p, x in zip(new, spaced, strict=True) if x], "")
        self._learn([p for p, x in zip(new, spaced, strict=True) if not x and _SEEN[min(ord(p[0]), 255)] and not p[-1].isspace()], "\n")
        self._alone([p for p, x in zip(new, spaced, strict=True) if not x and p not in known])

    def _learn(self, parts: list[str], lead: str) -> None:
        """Encode parts, most of them many to a text, with ``lead`` before each: tokens end where parts do, so that byte lengths tell them apart."""
        width = np.dtype(self.dtype).itemsize
        groups = [parts[at : at + 256] for at in range(0, len(parts), 256)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([lead + lead.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids)
            ends, sizes = np.cumsum(self.lengths[ids]), np.cumsum([len(p.encode()) + len(lead) for p in group])
            cut = np.searchsorted(ends, sizes) + 1
            if cut[-1] != len(ids) or (ends[cut - 1] != sizes).any() or lead and (self.lengths[ids[np.append(0, cut[:-1])]] != 1).any():
                self._alone(group)
                continue
            raw, start, skip = ids.astype(self.dtype).tobytes(), 0, len(lead) * width
            for part, end in zip(group, (cut * width).tolist(), strict=True):
                self.known[part] = raw[start + skip : end]
                start = end

    def _alone(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            for part, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[part] = self._bytes(found.ids)


_encoders: dict[str, PartEncoder] = {}


def encoder(path: str) -> PartEncoder:
    """The worker's encoder; its memory lasts from task to task."""
    if path not in _encoders:
        _encoders[path] = PartEncoder(path)
    return _encoders[path]


def queue(source: Column) -> Column:
    """Name of a source's queue: never null, and a null source's differs from all others."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, source's queue, deal, n, ids): ids are the bytes of unsigned 32-bit or, for small vocabularies, 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_threads()
        enc = encoder(path)
        end, width = np.array([end_id], enc.dtype).tobytes(), np.dtype(enc.dtype).itemsize
        for part in slices(batches, "text", *AT_ONCE):
            ids = enc.encode_column(part.column(3), end)
            n = pc.divide(pc.binary_length(ids).cast(pa.int64()), width)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), n, ids], ["doc_id", "source", "deal", "n", "ids"])

    # a number of its own for each row, so that repeats of one row are dealt to all shards
    deal = F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("deal")
    wanted = docs.select(F.col("doc_id").cast("long"), queue(F.col("source").cast("string")).alias("source"), deal, F.col("text").cast("string"))
    return wanted.mapInArrow(run, "doc_id long, source string, deal long, n long, ids binary")


def served(sources: list[str], n: np.ndarray, queue: np.ndarray, shares: np.ndarray, deficit: np.ndarray, place: int, window: int = WINDOW, piece: int = PIECE) -> Iterator[tuple[int, int, int, int]]:
    """(row, start, length, place) of each piece in order, for rows of n tokens in queues numbered by ``queue``.

    ``deficit`` is changed in place; ``place`` is the position of the first token in the stream of all shards.
    """
    rows = [np.flatnonzero(queue == s).tolist() for s in range(len(sources))]
    at, start, left, sizes = [0] * len(sources), [0] * len(sources), int(n.sum()), n.tolist()
    share, owed = shares.tolist(), deficit.tolist()
    open_ = [s for s, r in enumerate(rows) if r]
    room = window - place % window
    owed = [d + x * min(room, left) for d, x in zip(owed, share, strict=True)]
    while left:
        s = max(open_, key=owed.__getitem__)
        row = rows[s][at[s]]
        take = min(sizes[row] - start[s], room, max(piece, int(owed[s])))
        yield row, start[s], take, place
        owed[s] -= take
        place, room, left, start[s] = place + take, room - take, left - take, start[s] + take
        if start[s] == sizes[row]:
            at[s], start[s] = at[s] + 1, 0
            if at[s] == len(rows[s]):
                open_.remove(s)
        if not room:
            room = window
            owed = [d + x * min(room, left) for d, x in zip(owed, share, strict=True)]
    deficit[:] = owed


def pack(docs: DataFrame, tokenizer: str | None = None, weights: dict[str, float] | None = None, window: int = WINDOW, piece: int = PIECE, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: columns PIECES and, on request, ``ids``.

    ``weights`` are the target proportions of the sources (else their shares of all tokens). As every document is
    packed once, a source that is scarcer than its target runs dry within a shard; the others go on without it.
    """
    path = tokenizer or default_tokenizer()
    tokens = written(tokenized(docs, path, end_id), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    dealt = tokens.withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(shards)).cast("long"))
    # a row for each shard and source that it holds: opening deficit and place, from the totals of the shards before
    counts = dealt.groupBy("shard", "source").agg(F.sum("n").alias("n"))
    of_source = counts.groupBy("source").agg(F.sum("n").alias("all"))
    if weights is None:
        share = of_source.select("source", (F.col("all") / F.lit(max(total, 1))).alias("share"))
    else:
        given = of_source.sparkSession.createDataFrame([(f"={k}", float(v)) for k, v in weights.items()], "source string, w double")
        share = of_source.join(F.broadcast(given), "source", "left").select("source", (F.coalesce("w", F.lit(0.0)) / F.lit(sum(weights.values()) or 1.0)).alias("share"))
    places = counts.groupBy("shard").agg(F.sum("n").alias("tokens")).withColumn("place", F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = counts.withColumn("before", before).join(places.select("shard", "place"), "shard").join(share, "source")
    opening = written(grid.select("shard", "source", "share", "place", (F.col("share") * F.col("place") - F.col("before")).alias("deficit")), "opening")
    wide = encoder(path).dtype

    def run(key: tuple, rows: pd.DataFrame, opened: pd.DataFrame) -> pd.DataFrame:
        opened = opened.sort_values("source", ignore_index=True)
        rows = rows.sort_values(["deal", "doc_id"], ignore_index=True)
        number = {s: i for i, s in enumerate(opened["source"])}
        n, ids = rows["n"].to_numpy(), [np.frombuffer(x, wide).astype("<u4") for x in rows["ids"]]
        queue = rows["source"].map(number).to_numpy() if len(rows) else np.zeros(0, int)
        pieces = list(served(list(number), n, queue, opened["share"].to_numpy(), opened["deficit"].to_numpy().copy(), int(opened["place"].iloc[0]) if len(opened) else 0, window, piece))
        row, start, length, place = (np.array([p[k] for p in pieces], np.int64) for k in range(4))
        crc = [zlib.crc32(ids[r][a : a + m]) for r, a, m, _ in pieces]
        out = {"doc_id": rows["doc_id"].astype("Int64").to_numpy()[row] if len(rows) else [], "start": start, "length": length, "ids_crc32": np.array(crc, np.int64), "doc_tokens": n[row], "sequence_id": place // window, "offset": place % window, "source": rows["source"].map(lambda x: x[1:] or ("" if x else None)).to_numpy()[row]}
        if with_ids:
            out["ids"] = [ids[r][a : a + m].astype(np.int64) for r, a, m, _ in pieces]
        return pd.DataFrame(out)

    return dealt.groupBy("shard").cogroup(opening.groupBy("shard")).applyInPandas(run, PIECES + (", ids array<long>" if with_ids else ""))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the pieces."""
    return pack(docs)
