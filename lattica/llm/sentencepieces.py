"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here; normaliser, metaspace marker, scores and byte fallback are rebuilt as a tokenizer of
that library. Unigram models keep their scores; for BPE models the merges follow from the pieces, ordered by score.
Only normal and user-defined pieces match text: control, byte and unused ones are left out of a unigram vocabulary, and
what it can't spell is turned into bytes here. A BPE model with unused pieces is refused, as the library can't undo
merges.

Texts are cut before a marker that follows another character, where no piece of the vocabulary can span (the parser
checks this; a vocabulary with such a piece is encoded whole). With a BPE model whose byte pieces spell all else, they
are cut between any two bytes that stand side by side in no piece, as no merge joins these, and arrow tells equal parts
apart. Parts are encoded in batches with a thread for each core
of the task, each part once while a bounded memory lasts. Parity with the sentencepiece library is verified by tests,
by ``parity``, and by ``digests`` for every document as a whole.

Defined cases: null and empty texts have no ids and decode to the empty text; lone surrogates can't occur in Spark
strings; rows without doc_id and repeated rows are treated like any others; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm._common import library_threads, slices, table

MARK = "▁"
#: Piece kinds and model kinds of the model format. Fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters of the parts that a worker remembers, and parts that are encoded as one text.
REMEMBERED, TOGETHER = 10_000_000, 256
#: Rows whose parts are told apart at once, if their texts are small enough.
AT_ONCE = 4096
#: ``parity`` repeats ``as_library`` for one document in so many, chosen by its ids.
VERIFIED = 256


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; messages and texts come as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            shift += 7
            at += 1
            if data[at - 1] < 0x80:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse_spaces: bool = True
    escape_spaces: bool = True
    unknown_surface: str = " \u2047 "
    pieces: list[tuple[str, float, int]] = field(default_factory=list)

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                out.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(fields(value))
                out.kind, out.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
                out.unknown_surface = own[44].decode() if 44 in own else out.unknown_surface
            elif number == 3:
                own = dict(fields(value))
                out.charsmap = own.get(2, b"")
                out.dummy_prefix, out.collapse_spaces, out.escape_spaces = (bool(own.get(k, 1)) for k in (3, 4, 5))
        return out

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def pairs(self) -> np.ndarray:
        """Of each two bytes, at 256 times the first and the second, whether no text may be cut between them.

        The marker counts as a space, and the bytes of one character stay together.
        """
        out = np.zeros((256, 256), bool)
        out[:, 0x80:0xC0] = True
        for p, _, kind in self.pieces:
            if kind in (NORMAL, USER_DEFINED):
                raw = np.frombuffer(p.replace(MARK, " ").encode(), np.uint8)
                out[raw[:-1], raw[1:]] = True
        return out.ravel()

    def cuts_at_marks(self) -> bool:
        """No piece holds a marker after another character."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def matchable(model: Model) -> list[int]:
    """Ids of the unknown piece, which comes first, and of those that match text: the vocabulary of a unigram model."""
    return [model.unknown, *[i for i, p in enumerate(model.pieces) if p[2] in (NORMAL, USER_DEFINED)]]


def rebuilt(model: Model):
    """The tokenizer for normalised parts: normaliser and decoder included, dummy prefix left to the caller."""
    from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    if model.kind == UNIGRAM:
        core = models.Unigram([(model.pieces[i][0], model.pieces[i][1]) for i in matchable(model)], 0, False)
    elif model.kind == BPE:
        if any(kind == UNUSED for _, _, kind in model.pieces):
            raise ValueError("a BPE model with unused pieces has no counterpart")
        real = {p for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
        merges = []
        for p, score, kind in model.pieces:
            if kind in (NORMAL, USER_DEFINED) and len(p) > 1:
                merges += [(-score, vocab[p], vocab[p[:k]], vocab[p[k:]]) for k in range(1, len(p)) if p[:k] in real and p[k:] in real]
        merges.sort()
        core = models.BPE(vocab, [(model.pieces[a][0], model.pieces[b][0]) for _, _, a, b in merges], unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model kind {model.kind} has no counterpart")
    tok = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.collapse_spaces:
        from tokenizers import Regex

        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tok.normalizer = normalizers.Sequence(steps)
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    if own := [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]:
        tok.add_tokens(own)
    return tok


class Pieces:
    """Encoder and decoder for one model file's bytes."""

    def __init__(self, data: bytes):
        self.model = Model.parse(data)
        self.tokenizer = rebuilt(self.model)
        self.normalize = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        from tokenizers import normalizers

        self.tokenizer.normalizer = normalizers.Sequence([])  # texts come normalised
        pieces = self.model.pieces
        self.split = re.compile(f"(?<=[^{MARK}])(?={MARK})") if self.model.cuts_at_marks() and not any(k == USER_DEFINED for _, _, k in pieces) else None
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        self.texts = np.array(["" if kind == CONTROL else self.model.unknown_surface if kind == UNKNOWN else p.replace(MARK, " ") for p, _, kind in pieces], object)
        self.plain = not self.model.charsmap and not self.model.collapse_spaces and self.model.escape_spaces
        # bytes of text that an id stands for; an unknown one stands for any number
        self.lengths = np.array([1 if kind == BYTE else len(p.encode()) for p, _, kind in pieces], np.int64)
        self.unknown = self.model.unknown
        self.ids = np.array(matchable(self.model), np.uint32) if self.model.kind == UNIGRAM else None
        self.bytes = {bytes([int(p[3:-1], 16)]): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        spelt = self.model.kind == BPE and self.model.byte_fallback and len(self.bytes) == 256
        self.pairs = self.model.pairs() if spelt and self.plain and self.split else None
        # a line end that no piece holds keeps parts apart that are encoded as one text
        self.apart = "\n" if self.pairs is not None and not any("\n" in p for p, _, _ in pieces) else None

    def parts(self, text: str) -> list[str]:
        text = text.replace(" ", MARK) if self.plain else self.normalize(text)
        if self.model.dummy_prefix and text:
            text = MARK + text
        return [] if not text else self.split.split(text) if self.split else [text]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.pairs is not None:
            return self._by_pairs(pa.array(texts, pa.string()))
        cut = [self.parts(t) for t in texts]
        self._meet(set().union(*cut))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, x)), "<u4") for x in cut]

    def _by_pairs(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.replace_substring(texts, MARK, " ")
        if self.model.dummy_prefix:
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        edges = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        cut = np.ones(len(raw) + 1, bool)
        cut[1:-1] = ~self.pairs[raw[:-1].astype(np.uint16) << 8 | raw[1:]]
        cut[edges] = True
        starts = np.flatnonzero(cut[:-1])
        places = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.string(), len(starts), [None, places, pa.py_buffer(raw)]).dictionary_encode()
        words = [w.replace(" ", MARK) for w in coded.dictionary.to_pylist()]
        self._meet(set(words))
        ids = pa.array(map(self.known.__getitem__, words), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)[np.searchsorted(starts, edges)] // 4 if len(ids) else np.zeros(len(edges), np.int64)
        every = np.frombuffer(ids.buffers()[2] or b"", "<u4") if len(ids) else np.zeros(0, "<u4")
        return [every[s:e] for s, e in zip(ends.tolist(), ends[1:].tolist(), strict=False)]

    def _meet(self, parts: set[str]) -> None:
        """Have the ids of all these parts in ``known``."""
        new = parts.difference(self.known)
        size = sum(map(len, new))
        if self.held + size > REMEMBERED:
            self.known, self.held, new = {}, 0, parts
            size = sum(map(len, new))
        self.held += size
        self._learn(list(new))

    def _learn(self, new: list[str]) -> None:
        """Encode parts; where texts are cut at marks, many to a text, as no token crosses a cut and lengths tell."""
        fit = [p for p in new if self.split and p[0] == MARK and p[-1] != MARK]
        alone = list(set(new).difference(fit))
        if self.apart:
            alone = self._together(alone, self.apart)
        alone += self._together(fit, "")
        for at in range(0, len(alone), 4096):
            some = alone[at : at + 4096]
            for part, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                ids = array("I", found.ids)
                self.known[part] = ids.tobytes() if self.ids is None else self._spelt(part, self.ids[ids])

    def _together(self, parts: list[str], lead: str) -> list[str]:
        """Encode many parts to a text, with ``lead``, which is none or a byte, before each; those that lengths don't tell apart are returned."""
        alone = []
        groups = [parts[at : at + TOGETHER] for at in range(0, len(parts), TOGETHER)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([lead + lead.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            ids = ids if self.ids is None else self.ids[ids]
            ends, sizes = np.cumsum(self.lengths[ids]), np.cumsum([len(p.encode()) + len(lead) for p in group])
            cut = np.searchsorted(ends, sizes) + 1
            if (ids == self.unknown).any() or cut[-1] > len(ids) or (ends[cut - 1] != sizes).any() or lead and (self.lengths[ids[np.append(0, cut[:-1])]] != 1).any():
                alone += group
                continue
            raw, start = ids.tobytes(), 0
            for part, end in zip(group, (cut * 4).tolist(), strict=True):
                self.known[part] = raw[start + 4 * len(lead) : end]
                start = end
        return alone

    def _spelt(self, part: str, ids: np.ndarray) -> bytes:
        """Ids of a unigram model with each unknown stretch, if the model falls back to bytes, as its bytes."""
        if not self.model.byte_fallback or not (ids == self.unknown).any():
            return ids.tobytes()
        out: list[int] = []
        for i, (a, b) in zip(ids.tolist(), self.tokenizer.encode(part, add_special_tokens=False).offsets, strict=True):
            out += [self.bytes[bytes([x])] for x in part[a:b].encode()] if i == self.unknown else [i]
        return np.array(out, np.uint32).tobytes()

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids; those with byte pieces go through the library's decoder, others need only the pieces' texts."""
        out = ["".join(self.texts[x]) if not self.is_byte[x].any() else None for x in ids]
        for k, text in enumerate(out):
            if text is None:
                out[k] = self._with_bytes(ids[k])
        return [x[1:] if self.model.dummy_prefix and x[:1] == " " else x for x in out]

    def _with_bytes(self, ids: np.ndarray) -> str:
        """Runs of byte pieces go through the library's decoder."""
        edges = np.flatnonzero(np.diff(self.is_byte[ids].astype(np.int8))) + 1
        out = []
        for run in np.split(ids, edges):
            out.append(self.tokenizer.decoder.decode([self.model.pieces[i][0] for i in run]) if self.is_byte[run[0]] else "".join(self.texts[run]))
        return "".join(out)


def library(data: bytes):
    """The sentencepiece library's processor for a model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def agreement(other, texts: list[str], ids: list[np.ndarray], back: list[str]) -> list[bool]:
    """Whether another processor gives these ids for each text and this text back for them."""
    theirs = (other.encode(t) for t in texts)
    return [x == y.tolist() and other.decode(x) == z for x, y, z in zip(theirs, ids, back, strict=True)]


def parity(data: bytes, texts: list[str]) -> list[int]:
    """Positions of texts that the sentencepiece library encodes or decodes otherwise."""
    own, other = Pieces(data), library(data)
    ids = own.encode(texts)
    return [i for i, same in enumerate(agreement(other, texts, ids, own.decode(ids))) if not same]


_loaded: dict[int, Pieces] = {}


def pieces_of(data: bytes) -> Pieces:
    """The worker's encoder for a model; its memory lasts from task to task."""
    key = zlib.crc32(data)
    if key not in _loaded:
        _loaded[key] = Pieces(data)
    return _loaded[key]


def encoded(docs: DataFrame, data: bytes) -> DataFrame:
    """(doc_id, text, ids)."""
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_threads()
        own = pieces_of(shared.value)
        for b in slices(batches, "text"):
            ids = own.encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "text", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string, ids array<int>")


def digests(docs: DataFrame, data: bytes) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, n_byte_ids, decoded_chars, round_trip, parity, as_library): encoded and decoded in one pass.

    as_library says of every document whether the sentencepiece library gives the same ids for its whole text and the
    same text for the ids; parity repeats it for one document in ``VERIFIED`` and is null for the others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(data)
    names = ["doc_id", "n_ids", "ids_crc32", "n_byte_ids", "decoded_chars", "round_trip", "parity", "as_library"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_threads()
        own, other = pieces_of(shared.value), library(shared.value)
        for b in slices(batches, "text", AT_ONCE):
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = own.encode(texts)
            back, crc = own.decode(ids), [zlib.crc32(x.tobytes()) for x in ids]
            meant = texts if own.plain else [own.normalize(t).replace(MARK, " ") for t in texts]
            same = agreement(other, texts, ids, back)
            parity = [x if c % VERIFIED == 0 else None for x, c in zip(same, crc, strict=True)]
            cols = [[len(x) for x in ids], crc, [int(own.is_byte[x].sum()) for x in ids], [len(x) for x in back]]
            flags = [[x == y for x, y in zip(meant, back, strict=True)], parity, same]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols], *[pa.array(c, pa.bool_()) for c in flags]], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_byte_ids long, decoded_chars long, round_trip boolean, parity boolean, as_library boolean")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(default_model(), "rb") as f:
        data = f.read()
    return digests(table(spark, sf_dir, "documents"), data)
