"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give base spans of four kinds. The field labels tokens as one of these, as a secret (keys, credentials) or
as a name. Its nodes are tokens that hold a digit or an at sign, or share a key with a base span of their document, such
as an address's local part or, in capitals, a part of that. Neighbours are joined in a chain; repeated or similar tokens
of a document (same core, same local part of an address, same part of one, same digits) share skip potentials, and loopy
message passing makes their labels agree. Tokens outside base spans that come out as personal with a marginal of
``THRESHOLD`` or more add spans; base spans always stay.

The field is trained here, in one task, on weak labels of a bounded, hash-chosen sample of documents (``max_train`` of
them, and ``max_tokens`` of their tokens): base spans, strings in the shape of keys, and capitalised parts of an address, all of which
similar tokens of the same document inherit. The evidence of half of the labelled tokens is hidden, so that shape,
context and repetition have to explain them.

Defined cases: a null or empty text has no spans and the digest of the empty string; rows without doc_id and repeated
rows are treated like any others; further columns are ignored; an empty table, or one without personal data, leaves
the weights at their prior.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm._common import slices, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans: those of the patterns first.
ALL_KINDS = (*KINDS, "secret", "name")
SECRET, NAME = 5, 6
LABELS = ("other", *ALL_KINDS)
THRESHOLD, ROUNDS = 0.9, 8

# Fixed values of the contract, in forms that match the same spans in linear time.
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_CLUE = re.compile("[0-9@]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}<>#$%&*|"
_PART = re.compile("[^\\W\\d_]{5,}")

Span = tuple[int, int, int]  # start, kind's number, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by start and kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for a, k, b in spans)


@dataclass
class Token:
    start: int
    end: int
    word: int
    core: str
    keys: list[str]
    base: int  # label by the patterns, 0 if none
    lead: bool = False  # follows an equals sign or a colon
    part: bool = False  # is, in capitals, a part of an address of the document

    @property
    def weak(self) -> int:
        """Label for training: that of the patterns, or by a key's shape, or as part of an address."""
        return self.base or (SECRET if looks_secret(self) else NAME if self.part else 0)


def looks_secret(t: Token) -> bool:
    """Long hexadecimal digests, capitals with digits as in access keys, and long mixed strings that are assigned."""
    c = t.core.rpartition("=")[2].strip(_EDGE)
    if not c.isascii():
        return False
    digits = sum(x.isdigit() for x in c)
    letters = sum(x.isalpha() for x in c)
    if len(c) < 16 or digits < 2 or letters < 2:
        return False
    if len(c) >= 32 and digits + letters == len(c) and all(x in "0123456789abcdefABCDEF" for x in c):
        return True
    if digits + letters == len(c) and c.upper() == c and len(c) >= 20:
        return True
    return (t.lead or "=" in t.core) and len(c) >= 20 and all(x.isalnum() or x in "+/_-." for x in c)


def tokens(text: str, spans: list[Span]) -> list[Token]:
    """Tokens with a digit or an at sign, and those that share a key with a base span."""
    out: list[Token] = []
    if not _CLUE.search(text):
        return out
    word, at, s, lead = 0, 0, 0, False
    known = _span_keys(text, spans)
    for m in _SPACE.finditer(text + " "):
        if m.start() > at:
            if (clue := _CLUE.search(text, at, m.start())) or known:
                core = text[at : m.start()]
                a = at + len(core) - len(core.lstrip(_EDGE))
                core = core.strip(_EDGE)
                b = a + len(core)
                if core and (clue or not known.isdisjoint(_keys(core))):
                    while s < len(spans) and spans[s][2] <= a:
                        s += 1
                    hits = [(x, k, y) for x, k, y in spans[s : s + 4] if x < b and y > a]
                    keys = _keys(core) + [k for x, i, y in hits for k in _base_keys(text[x:y], i)]
                    part = not hits and any(k[0] == "n" and k in known for k in keys)
                    out.append(Token(a, b, word, core, list(dict.fromkeys(keys)), hits[0][1] + 1 if hits else 0, lead, part))
            lead = text[m.start() - 1] in "=:"
        word, at = word + 1, m.end()
    return out


def _span_keys(text: str, spans: list[Span]) -> set[str]:
    """Keys of the base spans that a token without a digit or an at sign may share."""
    return {key for a, kind, b in spans for key in _base_keys(text[a:b], kind) if not _CLUE.search(key)}


def _base_keys(span: str, kind: int) -> list[str]:
    """Keys of a base span; an address also has the parts of its local part."""
    parts = _PART.findall(span.split("@")[0].casefold()) if kind == 0 else []
    return _keys(span.strip(_EDGE)) + [f"n{p}" for p in parts]


def _keys(core: str) -> list[str]:
    """What similar tokens share: the folded core, the local part of an address, a capitalised word, seven digits or more."""
    folded, digits = core.casefold(), "".join(c for c in core if "0" <= c <= "9")
    local = folded.split("@")[0]
    word = core[:1].isupper() and len(core) >= 5 and core.isalpha()
    return [k for k in dict.fromkeys((f"c{folded}" if len(folded) >= 6 else "", f"l{local}" if len(local) >= 5 else "", f"n{folded}" if word else "", f"d{digits}" if len(digits) >= 7 else "")) if k]


FEATURES = ("bias", "at", "dots3", "octets", "digits_only", "long_digits", "luhn", "dash_digits", "plus", "letters", "hex", "equals", "short", "lead", "long_hex", "capitals", "long", "name", *(f"base_{k}" for k in KINDS))


def features(t: Token, evidence: bool = True) -> list[float]:
    c = t.core
    tail = c.rpartition("=")[2].strip(_EDGE)
    digits = sum("0" <= x <= "9" for x in c)
    parts = c.split(".")
    quads = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    return [
        1.0,
        "@" in c,
        c.count(".") == 3,
        quads and all(len(p) <= 3 and int(p) <= 255 for p in parts),
        digits == len(c),
        14 <= digits <= 19 and digits >= len(c) - 4,
        14 <= digits <= 19 and luhn("".join(x for x in c if "0" <= x <= "9")),
        "-" in c and 7 <= digits <= 13,
        c[0] == "+",
        any(x.isalpha() for x in c),
        len(c) >= 16 and digits > 3 and c.isalnum() and not digits == len(c),
        "=" in c,
        len(c) <= 4,
        t.lead,
        len(tail) >= 24 and digits >= 2 and all(x in "0123456789abcdefABCDEF" for x in tail),
        len(tail) >= 16 and digits >= 2 and tail.isascii() and tail.isalnum() and tail.upper() == tail and not tail.isdigit(),
        len(tail) >= 20,
        c[0].isupper() and c.isalpha(),
        *[evidence and t.base == k + 1 for k in range(len(KINDS))],
    ]


def graph(docs: list[list[Token]]) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges and skip edges among the tokens of all docs, numbered through. Repeats form a chain: no pairs."""
    chain, skip, n = [], [], 0
    for toks in docs:
        last: dict[str, int] = {}
        for i, t in enumerate(toks):
            if i and t.word - toks[i - 1].word <= 3:
                chain.append((n + i - 1, n + i))
            linked = set()
            for k in t.keys:
                if k in last and last[k] not in linked:
                    linked.add(last[k])
                    skip.append((last[k], n + i))
                last[k] = n + i
        n += len(toks)
    return np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _gathered(at: np.ndarray, messages: np.ndarray, n: int) -> np.ndarray:
    """Sum of the messages to each of n nodes."""
    return np.stack([np.bincount(at, m, n) for m in messages.T], axis=1)


@dataclass
class Field:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray

    @classmethod
    def prior(cls) -> Field:
        n = len(LABELS)
        unary = np.zeros((len(FEATURES), n))
        unary[0, 0] = 2.0
        for k in range(len(KINDS)):
            unary[FEATURES.index(f"base_{KINDS[k]}"), k + 1] = 6.0
        return cls(unary, np.zeros((n, n)), 4.0 * np.eye(n))

    def infer(self, x: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of nodes and of edges (chain edges first) by damped loopy message passing."""
        local = x @ self.unary
        edges = np.concatenate([chain, skip])
        pair = np.concatenate([np.broadcast_to(self.chain, (len(chain), *self.chain.shape)), np.broadcast_to(self.skip, (len(skip), *self.skip.shape))])
        forth, back = (np.zeros((len(edges), len(LABELS))) for _ in range(2))
        u, v = edges[:, 0], edges[:, 1]
        belief = local
        for _ in range(rounds if len(edges) else 0):
            new_forth = _lse((belief[u] - back)[:, :, None] + pair, 1)
            new_back = _lse((belief[v] - forth)[:, None, :] + pair, 2)
            forth = 0.5 * forth + 0.5 * (new_forth - _lse(new_forth, 1)[:, None])
            back = 0.5 * back + 0.5 * (new_back - _lse(new_back, 1)[:, None])
            belief = local + _gathered(v, forth, len(local)) + _gathered(u, back, len(local))
        nodes = np.exp(belief - _lse(belief, 1)[:, None])
        joint = (belief[u] - back)[:, :, None] + pair + (belief[v] - forth)[:, None, :]
        flat = joint.reshape(len(edges), len(LABELS) ** 2)
        return nodes, np.exp(flat - (_lse(flat, 1)[:, None] if len(flat) else 0)).reshape(joint.shape)


def _gold(doc: list[Token]) -> list[int]:
    """Weak labels, also for tokens similar to one that has its own in the same document."""
    own = [t.weak for t in doc]
    of = {k: w for t, w in zip(reversed(doc), reversed(own), strict=True) if w for k in t.keys}
    return [w or next((of[k] for k in t.keys if k in of), 0) for t, w in zip(doc, own, strict=True)]


def train(docs: list[list[Token]], steps: int = 400, rate: float = 2.0, pull: float = 0.001, seed: int = 7) -> Field:
    """Gradient ascent on the approximate likelihood, with a pull towards the prior."""
    field, prior = Field.prior(), Field.prior()
    docs = [d for d in docs if d]
    if not docs:
        return field
    toks = [t for d in docs for t in d]
    shown = np.random.default_rng(seed).random(len(toks)) < 0.5
    x = np.array([features(t, bool(e)) for t, e in zip(toks, shown, strict=True)], float)
    gold = np.eye(len(LABELS))[[x for d in docs for x in _gold(d)]]
    chain, skip = graph(docs)
    edges, nc = np.concatenate([chain, skip]), len(chain)
    seen = gold[edges[:, 0]][:, :, None] * gold[edges[:, 1]][:, None, :]
    for step in range(steps):
        nodes, joint = field.infer(x, chain, skip, 4)
        r, gap = rate / (1 + step / 200), seen - joint
        field.unary += r * (x.T @ (gold - nodes) / len(toks) - pull * (field.unary - prior.unary))
        field.chain += r * (gap[:nc].sum(axis=0) / len(toks) - pull * field.chain)
        field.skip += r * (gap[nc:].sum(axis=0) / len(toks) - pull * (field.skip - prior.skip))
    return field


def added_spans(field: Field, found: list[tuple[list[Token], list[Span]]]) -> list[list[Span]]:
    """Spans that the field adds to each document's base spans."""
    own = [t for t, _ in found]
    sizes = [len(t) for t in own]
    if not sum(sizes):
        return [[] for _ in own]
    chain, skip = graph(own)
    nodes, _ = field.infer(np.array([features(t) for d in own for t in d], float), chain, skip)
    out, at = [], 0
    for toks, n in zip(own, sizes, strict=True):
        best = nodes[at : at + n]
        label = best.argmax(axis=1) if n else []
        new = []
        for i, t in enumerate(toks):
            if label[i] and not t.base and best[i, label[i]] >= THRESHOLD:
                new.append((t.start, int(label[i]) - 1, t.end))
        out.append(new)
        at += n
    return out


def fit(docs: DataFrame, max_train: int = 20_000, max_tokens: int = 6_000) -> Field:
    """The field trained on up to ``max_tokens`` tokens of the documents among ``max_train`` hash-chosen ids."""
    some = docs.filter("doc_id is not null").select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]"))
    texts = texts.join(F.broadcast(some), F.col("doc_id") == F.col("_id"), "left_semi")
    names = ["doc_id", "word", "core", "keys", "base", "lead", "part"]
    schema = pa.schema([("doc_id", pa.int64()), ("word", pa.int64()), ("core", pa.string()), ("keys", pa.list_(pa.string())), ("base", pa.int64()), ("lead", pa.bool_()), ("part", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [(doc, x) for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in tokens(t, base_spans(t))]
            yield pa.RecordBatch.from_pydict({n: [doc if n == "doc_id" else getattr(x, n) for doc, x in found] for n in names}, schema)

    rows = texts.mapInArrow(run, "doc_id long, word long, core string, keys array<string>, base long, lead boolean, part boolean").orderBy(F.xxhash64("doc_id"), "doc_id", "word").limit(max_tokens)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_doc: dict[int, list[Token]] = {}
        n = 0
        for b in batches:
            n += b.num_rows
            for r in b.to_pylist():
                by_doc.setdefault(r["doc_id"], []).append(Token(0, 0, r["word"], r["core"], r["keys"], r["base"], r["lead"], r["part"]))
        if n >= max_tokens and len(by_doc) > 1:
            by_doc.popitem()  # the last one may be cut short
        field = train(list(by_doc.values()))
        yield pa.RecordBatch.from_arrays([pa.array([m.astype(float).tobytes()], pa.binary()) for m in (field.unary, field.chain, field.skip)], ["unary", "chain", "skip"])

    n = len(LABELS)
    row = rows.repartition(1).mapInArrow(trained, "unary binary, chain binary, skip binary").first()
    return Field(*(np.frombuffer(bytes(m)).reshape(-1, n) for m in row)) if row else Field.prior()


def analysed(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    more = added_spans(field, [(tokens(t, s), s) for t, s in zip(texts, base, strict=True)])
    return [(s, sorted(s + a)) for s, a in zip(base, more, strict=True)]


def found(docs: DataFrame, field: Field) -> DataFrame:
    """Counts, digest and spans of every row."""
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            both = analysed([t or "" for t in b.column(1).to_pylist()], field)
            counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in both], pa.int64()) for kind in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(written_spans(base).encode()).hexdigest() for base, _ in both], pa.string())
            sizes = [pa.array(x, pa.int64()) for x in ([len(a) - len(base) for base, a in both], [len(a) for _, a in both])]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array([written_spans(a) for _, a in both], pa.string()), *sizes], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def masked(text: str, spans: list[Span]) -> str:
    """text with each span, or run of overlapping spans, replaced by its first kind in capitals."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{ALL_KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return found(docs, fit(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is replaced by its kind; no document goes."""
    field = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            k, n = b.schema.get_field_index("text"), b.schema.get_field_index("n_chars")
            texts = b.column(k).to_pylist()
            both = analysed([t or "" for t in texts], field)
            new = [t if t is None or not s else masked(t, s) for t, (_, s) in zip(texts, both, strict=True)]
            b = b.set_column(k, b.schema.field(k), pa.array(new, b.schema.field(k).type))
            if n >= 0:
                b = b.set_column(n, b.schema.field(n), pa.array([None if t is None else len(t) for t in new], b.schema.field(n).type))
            yield b

    return docs.mapInArrow(run, docs.schema)
