"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

Documents are cut into words; the hashes of all k-mers are winnowed to seeds (the smallest of every ``WINDOW`` in a row,
so that any exact passage of ``WINDOW + K - 1`` words keeps one). All seeds are counted first, hashes alone; a bit filter
of fixed size lets those through that stand in more than one row. A seed of up to ``HOLDERS`` rows is matched in all
pairs. One of more rows, a frequent one, is taken together with each seed within ``REACH`` words that few rows hold, and
matched where these are. Frequent seeds that follow each other within ``REACH`` words make a region. Regions with equal
words and seeds are one class, whose members are matched with its first one by all their seeds; a region shorter than ``LEAST``
words is told apart by as many words around it too. The first ones of different classes are compared by every seed, all
holders with all, on the words near it: ``passages`` matches every pair that a passage may hold; ``classes``, which the
query gives, ties together those that surely share one by as few pairs as will do, and matches every other pair that may.
The first two seeds of any chain are within ``REACH`` words, so that every chain is met in one of these ways.
Matches of a pair of documents are chained in order on both sides, with a cost for gaps, through a Fenwick tree of
prefix maxima. Chains are then aligned on the words between their seeds and cut into the runs that score best with a
point for each word alike and a fine for each that isn't, so that two passages far apart that share a chain are two
results; runs are prolonged at both ends until the score drops. A passage counts with ``LEAST`` words and ``IDENTITY``
of them alike.

Seeds and chains carry numbers only; texts are read again just for documents with a chain, which a bit filter of fixed
size picks out, each once, and only the stretches around its chains are passed on.

Defined cases: null and short texts have no seeds; a document is all rows that bear one doc_id, or none, and one text
(told apart by a 64-bit hash), so that rows without doc_id take part, and one id with two texts is two documents;
repeats inside one document are not reported, and a k-mer that repeats in a document seeds at its first place; each
pair of documents comes once, the larger doc_id first and a null one last; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm._common import slices, table, written
from lattica.llm._components import components
from lattica.llm.line_chunks import FILTER_BITS, bit_filter

K, WINDOW = 5, 10
#: Rows of a seed that are matched in all pairs.
HOLDERS = 8
#: Words from a frequent seed to another of its region, or to one that it is taken together with. The first two seeds of
#: a chain are no further apart: their gap would cost more than the first one scores.
REACH = 98
#: Words on either side of a frequent seed by which its rows are told apart; those of them by which most are, and how many
#: must be alike on one side and on both (of 35 words beside a seed in a passage of LEAST, 8 may differ); the score of such
#: a passage with a fine of one.
NEAR, SIDE, ALIKE, BOTH, NET = 40, 24, 10, 16, 24
#: Rows of a group that a doubtful row is aligned with, and rows of a seed that are compared word by word at once.
TRIES, FEW = 3, 64
#: Rows of a frequent seed that are compared in one place, in pairs of blocks.
BLOCK = 4096
#: Cost of a word skipped on either side between two seeds, and seeds of a chain.
GAP, SEEDS = 0.05, 2
LEAST, IDENTITY = 40, 0.8
#: Fines for a word that differs: for the first cut of a chain, and where a run has too few words alike after it. At 4
#: a run scores from 0.8 alike on.
FINES = (3, 4)
MARGIN, DROP = 64, 12
#: Words between two seeds that are compared; longer gaps count as unlike.
BETWEEN = 200
#: Stretches that a worker hands on at once.
STRETCHES = 64


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _slid(x: np.ndarray, window: int, op: np.ufunc) -> np.ndarray:
    """op over each so many values in a row, by doubling."""
    n = 1
    while n < window:
        step = min(n, window - n)
        x, n = op(x[:-step], x[step:]), n + step
    return x


def seeds(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the winnowed k-mers, each hash at its first position."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    h = _mixed(h)
    w = min(window, n)
    low = _slid(h, w, np.minimum)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(_slid(padded, w, np.maximum) == h)
    kept, first = np.unique(h[at], return_index=True)
    return kept, at[first]


def chains(x: list[int], y: list[int], k: int = K, gap: float = GAP, least: int = SEEDS) -> list[list[int]]:
    """Disjoint chains of matches (x[i], y[i]), x sorted: increasing on both sides, best first.

    score(i) = max(k, new(i) + max over j before i of score(j) - gap * (dx + dy)), where new(i) is the number of words of
    a seed that the match before it in x doesn't hold; the inner maximum over smaller y is a prefix maximum of
    score(j) + gap * (x[j] + y[j]) in a Fenwick tree.
    """
    ys = sorted(set(y))
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(ys) + 1)
    score, back = [0.0] * len(x), [-1] * len(x)
    i, before = 0, None
    while i < len(x):
        same, new = i, float(k if before is None else min(k, x[i] - before))
        before = x[i]
        while same < len(x) and x[same] == x[i]:  # equal x can't follow each other: all are looked up first
            r, best = bisect_left(ys, y[same]), (float("-inf"), -1)
            while r > 0:
                best = max(best, tree[r])
                r -= r & -r
            link = best[0] - gap * (x[same] + y[same])
            score[same], back[same] = (new + link, best[1]) if new + link > k else (float(k), -1)
            same += 1
        for j in range(i, same):
            r, own = bisect_left(ys, y[j]) + 1, (score[j] + gap * (x[j] + y[j]), j)
            while r < len(tree):
                tree[r] = max(tree[r], own)
                r += r & -r
        i = same
    used, out = [False] * len(x), []
    for end in sorted(range(len(x)), key=lambda j: -score[j]):
        chain, j = [], end
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = back[j]
        if len(chain) >= least:
            out.append(chain[::-1])
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two stretches have in common, in order."""
    if len(a) == len(b):
        return int((a == b).sum())
    return sum(m.size for m in SequenceMatcher(None, a.tolist(), b.tolist(), autojunk=False).get_matching_blocks()) if len(a) and len(b) else 0


def _reach(a: np.ndarray, b: np.ndarray, i: int, j: int, step: int) -> tuple[int, int]:
    """(words, matches) gained by going on from i and j in one direction, up to where the score was best."""
    score = best = length = gained = n = matches = 0
    left = min(len(a) - i, len(b) - j) if step > 0 else min(i, j) + 1
    while left > n and score > best - DROP:
        size = min(32, left - n)
        same = a[i + n : i + n + size] == b[j + n : j + n + size] if step > 0 else (a[i - n - size + 1 : i - n + 1] == b[j - n - size + 1 : j - n + 1])[::-1]
        for x in same.tolist():
            n += 1
            matches += x
            score += 1 if x else -FINES[-1]
            if score > best:
                best, length, gained = score, n, matches
            elif score <= best - DROP:
                break
    return length, gained


def best_runs(scores: list[int]) -> list[tuple[int, int]]:
    """All maximal scoring runs [from, to): no run of another cut scores more within or across them (Ruzzo and Tompa)."""
    runs: list[tuple[int, int, int, int]] = []  # from, to, sum before, sum after
    total = 0
    for i, s in enumerate(scores):
        low, total = total, total + s
        if s <= 0:
            continue
        start, high = i, total
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][2] >= low:
                j -= 1
            if j < 0 or runs[j][3] >= high:
                break
            start, low = runs[j][0], runs[j][2]
            del runs[j:]
        runs.append((start, i + 1, low, high))
    return [r[:2] for r in runs]


Block = tuple[int, int, int, int, int]  # start, end, other start, other end, words alike


def blocks(a: np.ndarray, b: np.ndarray, xs: list[int], ys: list[int], k: int = K) -> list[Block]:
    """Runs of words alike and unlike from the first seed of a chain to its last, in order and without overlap.

    Seeds without a shift between them and what stands between them are compared word by word; across a shift, what is
    common in order counts.
    """
    out, x, y, i = [], xs[0], ys[0], 0
    while i < len(xs):
        shift, j = xs[i] - ys[i], i
        while j + 1 < len(xs) and xs[j + 1] - ys[j + 1] == shift and xs[j + 1] - xs[j] <= BETWEEN:
            j += 1
        start, end, i = max(xs[i], x, y + shift), xs[j] + k, j + 1
        if start >= end:
            continue
        if start > x or start - shift > y:
            near = max(start - x, start - shift - y) <= BETWEEN
            out.append((x, start, y, start - shift, _alike(a[x:start], b[y : start - shift]) if near else 0))
        same = a[start:end] == b[start - shift : end - shift]
        edges = [start, *(np.flatnonzero(same[1:] != same[:-1]) + start + 1).tolist(), end]
        alike = bool(same[0])
        for s, e in zip(edges, edges[1:], strict=False):
            out.append((s, e, s - shift, e - shift, e - s if alike else 0))
            alike = not alike
        x, y = end, end - shift
    return out


def align(a: np.ndarray, b: np.ndarray, xs: list[int], ys: list[int], k: int = K) -> list[Block]:
    """The passages around a chain of seeds at xs and ys, of any length."""
    own = blocks(a, b, xs, ys, k)
    out: list[Block] = []

    def cut(lo: int, hi: int, fines: tuple[int, ...]) -> None:
        part = own[lo:hi]
        for i, j in best_runs([m - fines[0] * (max(e - s, f - t) - m) for s, e, t, f, m in part]):
            s, e, t, f, m = part[i][0], part[j - 1][1], part[i][2], part[j - 1][3], sum(x[4] for x in part[i:j])
            if m < IDENTITY * max(e - s, f - t) and len(fines) > 1:
                cut(lo + i, lo + j, fines[1:])
                continue
            left, more = _reach(a, b, s - 1, t - 1, -1)
            right, most = _reach(a, b, e, f, 1)
            out.append((s - left, e + right, t - left, f + right, m + more + most))

    cut(0, len(own), FINES)
    return list(dict.fromkeys(out))


def _seed_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        hs = [seeds(word_hashes(text or ""))[0].view(np.int64) for text in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs))], ["h"])


def regions(p: np.ndarray) -> list[tuple[int, int]]:
    """Runs [from, to) of the sorted places, none of them more than ``REACH`` after the one before."""
    edges = [0, *(np.flatnonzero(np.diff(p) > REACH) + 1).tolist(), len(p)]
    return [(s, e) for s, e in zip(edges, edges[1:], strict=False) if e > s]


def combined(h: np.ndarray, p: np.ndarray, hot: np.ndarray, cold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place of the first k-mer, place of the last) of each ``hot`` seed with each ``cold`` one within ``REACH`` words.

    Seeds h stand at the sorted places p; each hash comes at its first place.
    """
    few, many = np.flatnonzero(cold), np.flatnonzero(hot)
    low, high = np.searchsorted(p[few], p[many] - REACH), np.searchsorted(p[few], p[many] + REACH, "right")
    own = np.repeat(many, high - low)
    other = few[np.arange(len(own)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]
    a, b = np.minimum(own, other), np.maximum(own, other)
    kept, first = np.unique(_mixed(h[a] * np.uint64(0x9E3779B97F4A7C15) + h[b]), return_index=True)
    return kept, p[a][first], p[b][first]


SEED_ROWS = "h long, doc long, pos long, end long, seeds array<long>, places array<long>, words binary"


def _seed_rows(batches: Iterator[pa.RecordBatch], shared: np.ndarray, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Seeds that few others hold too, and those taken together, with their first and last place.

    Regions come as further rows, with their class for h, their seeds, the places of these, and 16 bits of each word of
    them and of ``NEAR`` words on either side (0: none).
    """
    names = [x.split()[0] for x in SEED_ROWS.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
    for b in slices(batches, "text"):
        hs, docs, starts, ends, found = [], [], [], [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = word_hashes(text or "")
            h, p = seeds(words)
            order = np.argsort(p)
            h, p = h[order], p[order]
            again = in_filter(shared, h)
            hot = in_filter(frequent, h) & again
            cold = again & ~hot
            g, s, e = combined(h, p, hot, cold)
            hs += [h[cold].view(np.int64), g.view(np.int64)]
            starts += [p[cold], s]
            ends += [p[cold], e]
            docs.append(np.full(len(hs[-1]) + len(hs[-2]), doc, np.int64))
            k, q = h[hot].view(np.int64), p[hot]
            for i, j in regions(q):
                first, last = int(q[i]), int(q[j - 1]) + K
                more = LEAST if last - first < LEAST else 0
                # one seed alone, as of words that repeat, makes no chain: all its holders are compared by the words near it
                alone = doc if j - i == 1 else 0
                own = xxhash.xxh64_intdigest(words[max(0, first - more) : last + more].tobytes() + (q[i:j] - first + alone).tobytes(), more)
                near = np.zeros(last - first + 2 * NEAR, np.uint16)
                lo, hi = max(0, first - NEAR), min(len(words), last + NEAR)
                near[lo - first + NEAR : hi - first + NEAR] = words[lo:hi].astype(np.uint16) | 1
                found.append((own - (1 << 64) if own >> 63 else own, doc, first, last, k[i:j], q[i:j], near.tobytes()))
        if hs:
            cols = [pa.array(np.concatenate(c)) for c in (hs, docs, starts, ends)]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.nulls(len(cols[0]), k) for k in kinds[4:]]], names)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit filter may hold each of the hashes."""
    at = hashes >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _met(rows: DataFrame) -> DataFrame:
    """Matches (doc, other, pos, at), doc > other, of all pairs of rows with a hash, which at most HOLDERS have."""
    held = rows.groupBy("h").agg(F.collect_list(F.struct("doc", "pos", "end")).alias("held")).filter("size(held) > 1")
    pair = lambda a, b: F.struct(a["doc"].alias("doc"), b["doc"].alias("other"), a["pos"].alias("pos"), b["pos"].alias("at"), a["end"].alias("end"), b["end"].alias("at_end"))
    every = F.flatten(F.transform("held", lambda a: F.transform(F.filter("held", lambda b: b["doc"] < a["doc"]), lambda b: pair(a, b))))
    out = held.select(F.explode(every).alias("m")).select("m.*")
    both = F.when(F.col("end") == F.col("pos"), F.array(F.struct("pos", "at"))).otherwise(F.array(F.struct("pos", "at"), F.struct(F.col("end").alias("pos"), F.col("at_end").alias("at"))))
    return out.select("doc", "other", F.explode(both).alias("m")).select("doc", "other", "m.pos", "m.at")


def sides(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of words the 128 bits of its elements (word, which of its repeats), and how many share a bit."""
    s = np.sort(near, axis=1)
    nth = np.zeros_like(s)
    for j in range(1, s.shape[1]):
        nth[:, j] = np.where(s[:, j] == s[:, j - 1], nth[:, j - 1] + 1, 0)
    bit = ((s.astype(np.uint32) * np.uint32(0x9E3779B1) + nth.astype(np.uint32) * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)) >> np.uint32(25)
    one = np.where(s == 0, np.uint64(0), np.uint64(1) << (bit & np.uint32(63)).astype(np.uint64))
    bits = np.stack([np.bitwise_or.reduce(np.where(bit >> np.uint32(6) == k, one, np.uint64(0)), axis=1) for k in (0, 1)])
    return bits, ((s != 0).sum(axis=1) - np.bitwise_count(bits).sum(axis=0, dtype=np.int64)).astype(np.uint8)


def _gains(same: np.ndarray, fine: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best score, its first length, lowest score up to there) of each row's first words."""
    score = np.cumsum(np.where(same, np.int16(1), np.int16(-fine)), axis=1, dtype=np.int16)
    length = score.argmax(axis=1)
    low = np.minimum.accumulate(score, axis=1)[np.arange(len(score)), length]
    best = score[np.arange(len(score)), length]
    up = best > 0
    return np.where(up, best, 0), np.where(up, length + 1, 0), np.where(up, low, 0)


def surely(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether, words before, words after) for words around equal seeds: a passage of ``LEAST`` words without a shift.

    Every stretch from either of its ends scores above 0 with the last fine, so that no cut of a chain from its first
    five words to its last five, which are alike, parts it.
    """
    same = (a == b) & (a != 0)
    left, before, low = _gains(same[:, NEAR - 1 :: -1], FINES[-1])
    right, after, down = _gains(same[:, NEAR + K :], FINES[-1])
    return (before + K + after >= LEAST) & (low + K + right > 0) & (down + K + left > 0), before, after


def perhaps(there: np.ndarray) -> np.ndarray:
    """Whether a passage can hold the seed in the middle of each row, with whatever shifts.

    The rows tell which words near it stand anywhere near it in another document too: no alignment has more alike.
    """
    out = there.sum(axis=1) >= IDENTITY * LEAST
    score = there[out].astype(np.int8) * np.int8(2) - np.int8(1)
    left, right = (np.cumsum(x, axis=1, dtype=np.int8).max(axis=1, initial=0).astype(int) for x in (score[:, NEAR - 1 :: -1], score[:, NEAR + K :]))
    out[out] = left + K + right >= NET
    return out


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a chain of equal k-mers around which two rows of words near a seed align to a passage, or none."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    a, b = np.where(a, a, -1), np.where(b, b, -2)
    there = {bytes(w): i for i, w in reversed(list(enumerate(np.lib.stride_tricks.sliding_window_view(b, K))))}
    met = [(i, there[w]) for i, w in enumerate(map(bytes, np.lib.stride_tricks.sliding_window_view(a, K))) if w in there]
    for chain in chains([x for x, _ in met], [y for _, y in met])[:1]:
        xs, ys = [met[i][0] for i in chain], [met[i][1] for i in chain]
        if any(min(e - s, f - t) >= LEAST and m >= IDENTITY * max(e - s, f - t) for s, e, t, f, m in align(a, b, xs, ys)):
            shift = np.diff(np.array(xs) - ys) != 0
            ends = np.concatenate((shift, [True])) | np.concatenate(([True], shift))  # of what has one shift
            return np.array(xs)[ends], np.array(ys)[ends]
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def links(near: np.ndarray, side: np.ndarray | None, every: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other rows after it, words from the seed to the match in it, and in these) of holders of a seed.

    With ``every`` all pairs that a passage may hold, by the words near the seed; without it such as tie together the
    rows that passages surely tie, and of the others all pairs that a passage may hold. ``side``: only rows that differ
    in it meet.
    """
    n = len(near)
    few = n <= FEW
    if not few:
        (left, lost), (right, last) = sides(near[:, NEAR - SIDE : NEAR]), sides(near[:, NEAR + K : NEAR + K + SIDE])
    label, doubtful = np.arange(n), []
    v, ids = np.unique(near, return_inverse=True)
    ids, there = ids.reshape(near.shape), np.zeros(len(v), bool)
    for a in range(n - 1):
        may = label[a + 1 :] != label[a]
        if side is not None:
            may &= side[a + 1 :] != side[a]
        if not may.any():
            continue
        if not few:
            x = np.bitwise_count(left[0, a + 1 :] & left[0, a]) + np.bitwise_count(left[1, a + 1 :] & left[1, a]) + np.minimum(lost[a + 1 :], lost[a])
            y = np.bitwise_count(right[0, a + 1 :] & right[0, a]) + np.bitwise_count(right[1, a + 1 :] & right[1, a]) + np.minimum(last[a + 1 :], last[a])
            may &= (np.maximum(x, y) >= ALIKE) & (x + y >= BOTH)
        b = np.flatnonzero(may) + a + 1
        there[ids[a]] = v[ids[a]] != 0
        b = b[perhaps(there[ids[b]])]
        there[ids[a]] = False
        if not len(b):
            continue
        sure, before, after = surely(near[a], near[b])
        if sure.any():
            met, first = np.unique(label[b[sure]], return_index=True)
            own, low, high = b[sure][first], -before[sure][first], after[sure][first]
            for shift, use in ((0 * own, own > a), (low, low < 0), (high, high > 0)):
                yield a, own[use], shift[use], shift[use]
            if not every:
                label[np.isin(label, met)] = label[a]
        if not sure.all():
            doubtful.append((a, b[~sure]))
    for a, b in doubtful:
        b = b[label[b] != label[a]]
        for group in [] if every else np.unique(label[b]).tolist():
            same = b[label[b] == group]
            for other in same[:: -(-len(same) // TRIES)].tolist() if len(same) > 1 else []:  # one that aligns stands for all that are tied to it
                xs, ys = aligned(near[a], near[other])
                if len(xs):
                    yield a, np.full(len(xs), other), xs - NEAR, ys - NEAR
                    label[label == group] = label[a]
                    break
        b = b[label[b] != label[a]]
        yield a, b, 0 * b, 0 * b


def _near_rows(batches: Iterator[pa.RecordBatch], large: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Each seed of the regions with the words near it, once for each pair of blocks that its row is in."""
    names, kinds = ["h", "part", "block", "doc", "pos", "near"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for b in batches:
        out = []
        for doc, start, hs, places, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for h, p in zip(hs, places, strict=True):
                at, n = 2 * (p - start), large.get(h, 1)
                own = xxhash.xxh64_intdigest(doc.to_bytes(8, "little", signed=True)) % n
                for k in range(n):
                    out.append((h, min(own, k) * n + max(own, k), own, doc, p, words[at : at + 2 * (2 * NEAR + K)]))
            if len(out) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _linked_rows(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """Matches of the holders of each (h, part), from rows sorted by these and by doc."""
    held: list[list] = []
    out: list[list[np.ndarray]] = []

    def close() -> None:
        block, doc, pos = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))
        near = np.frombuffer(b"".join(w for x in held for w in x[5]), np.uint16).reshape(len(doc), -1)
        held.clear()
        for a, b, dx, dy in links(near, block if block.min() != block.max() else None, every):
            if len(b):
                d, e, x, y = doc[a], doc[b], pos[a] + dx, pos[b] + dy
                out.append([np.maximum(d, e), np.minimum(d, e), np.where(d > e, x, y), np.where(d > e, y, x)])

    def batch() -> pa.RecordBatch:
        cols = [np.concatenate([x[k] for x in out]) for k in range(4)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc", "other", "pos", "at"])

    for b in batches:
        h, part, *rest = (c.to_numpy(zero_copy_only=False) for c in b.columns[:5])
        words = b.column(5).to_pylist()
        cut = np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1])) + 1
        bounds = [0, *cut.tolist(), len(h)] if len(h) else [0]
        for s, e in zip(bounds, bounds[1:], strict=False):
            if held and (held[-1][0] != h[s] or held[-1][1] != part[s]):
                close()
            held.append([h[s], part[s], *(c[s:e] for c in rest), words[s:e]])
        if sum(len(x[0]) for x in out) > 50_000:
            yield batch()
    if held:
        close()
    if out:
        yield batch()


def _met_regions(found: DataFrame, every: bool) -> DataFrame:
    """Matches (doc, other, pos, at), doc > other, of regions with the first of their class and of these with each other."""
    first = F.min_by(F.struct("doc", "pos", "seeds", "places", "words"), F.struct("doc", "pos")).alias("first")
    classes = written(found.groupBy("h").agg(first, F.count(F.lit(1)).alias("n")), "classes", "zstd")
    members = found.drop("words").join(classes.filter("n > 1").select("h", F.struct("first.doc", "first.places").alias("first")), "h").filter(F.col("doc") > F.col("first.doc"))
    copies = members.select("doc", F.col("first.doc").alias("other"), F.explode(F.arrays_zip("places", F.col("first.places").alias("at"))).alias("m"))
    # at most as many as BLOCK goes into the seeds of all classes
    many = classes.select(F.explode("first.seeds").alias("h")).groupBy("h").count().filter(F.col("count") > BLOCK)
    large = {r.h: -(-r["count"] // BLOCK) for r in many.toLocalIterator()}
    held = classes.select("first.doc", "first.pos", "first.seeds", "first.places", "first.words").mapInArrow(lambda rows: _near_rows(rows, large), "h long, part long, block long, doc long, pos long, near binary")
    dealt = held.repartition("h", "part").sortWithinPartitions("h", "part", "doc", "pos")
    pairs = dealt.mapInArrow(lambda rows: _linked_rows(rows, every), "doc long, other long, pos long, at long")
    return copies.select("doc", "other", F.col("m.places").alias("pos"), "m.at").unionAll(pairs)


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of each (doc, other), from rows sorted by doc, other and pos."""
    names = ["doc", "other", "xs", "ys"]
    held: list[list[np.ndarray]] = []

    def close() -> list[tuple]:
        doc, other, x, y = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))  # one match may be found in several ways
        x, y = x[new], y[new]
        if len(x) < SEEDS:
            return []
        x, y = x.tolist(), y.tolist()
        return [(int(doc[0]), int(other[0]), [x[i] for i in c], [y[i] for i in c]) for c in chains(x, y)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.list_(pa.int64())) for k, c in enumerate(cols)], names)

    for b in batches:
        doc, other, x, y = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(doc):
            continue
        cut = np.flatnonzero((doc[1:] != doc[:-1]) | (other[1:] != other[:-1])) + 1
        rows: list[tuple] = []
        bounds = [0, *cut.tolist(), len(doc)]
        for s, e in zip(bounds, bounds[1:], strict=False):
            if held and (held[-1][0][0] != doc[s] or held[-1][1][0] != other[s]):
                rows += close()
            if e - s >= SEEDS or s == 0 or e == len(doc):
                held.append([doc[s:e], other[s:e], x[s:e], y[s:e]])
        if rows:
            yield batch(rows)
    if held and (rows := close()):
        yield batch(rows)


def _lists(column: pa.Array) -> list[np.ndarray]:
    ends = column.offsets.to_numpy().tolist()
    values = column.values.to_numpy()
    return [values[s:e] for s, e in zip(ends, ends[1:], strict=False)]


def _aligned_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "other_id", "start", "end", "other_start", "other_end", "n_seeds", "matches", "identity", "doc", "other"]
    for b in batches:
        out = []
        numbers = (b.column(k).to_pylist() for k in (0, 1, 4, 5, 8, 9))
        for own, other, x, y, doc, there, xs, ys, p, q in zip(*numbers, *(_lists(b.column(k)) for k in (2, 3, 6, 7)), strict=True):
            for s, e, t, f, m in align(p, q, (xs - x).tolist(), (ys - y).tolist()):
                identity = m / max(e - s, f - t)
                if min(e - s, f - t) < LEAST or identity < IDENTITY:
                    continue
                n = int(((xs >= s + x) & (xs < e + x)).sum())
                both = [(own, s + x, e + x, doc), (other, t + y, f + y, there)]
                if own is None or other is not None and own < other:
                    both.reverse()
                (i, s, e, d), (j, t, f, o) = both
                out.append((i, j, s, e, t, f, n, m, identity, d, o))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 8 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names)


def _found(docs: DataFrame, every: bool) -> DataFrame:
    """Passages with the hashes doc and other of their documents."""
    spark = docs.sparkSession
    own = docs.filter("text is not null").select(F.xxhash64("doc_id", "text").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = own.select("doc", "text")
    counted = read.mapInArrow(_seed_hashes, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = written(counted, "repeats", "zstd")
    shared = spark.sparkContext.broadcast(bit_filter(again.select("h")))
    frequent = spark.sparkContext.broadcast(bit_filter(again.filter(F.col("n") > HOLDERS).select("h")))

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _seed_rows(batches, shared.value, frequent.value)

    both = written(read.mapInArrow(seeded, SEED_ROWS), "seeds", "zstd")
    pairs = _met(both.filter("seeds is null").select("h", "doc", "pos", "end")).unionAll(_met_regions(both.filter("seeds is not null"), every))
    dealt = pairs.repartition("doc", "other").sortWithinPartitions("doc", "other", "pos", "at")
    found = written(dealt.mapInArrow(_chain_rows, "doc long, other long, xs array<long>, ys array<long>"), "chains", "zstd")

    down = lambda c: F.greatest(F.lit(0), F.floor((c - MARGIN) / MARGIN) * MARGIN).cast("long")
    up = lambda c: (F.ceil((c + K + MARGIN) / MARGIN) * MARGIN).cast("long")
    first, last = (lambda n: F.element_at(n, 1)), (lambda n: F.element_at(n, -1))
    framed = found.withColumns({"a_from": down(first("xs")), "a_to": up(last("xs")), "b_from": down(first("ys")), "b_to": up(last("ys"))})
    ranges = framed.select("doc", F.struct(F.col("a_from").alias("lo"), F.col("a_to").alias("hi")).alias("r")).unionAll(framed.select("other", F.struct("b_from", "b_to")))
    # at most as many as a document has pairs of multiples of MARGIN
    wanted = written(ranges.groupBy("doc").agg(F.collect_set("r").alias("ranges")), "stretches", "zstd")
    known = spark.sparkContext.broadcast(bit_filter(wanted.select(F.col("doc").alias("h"))))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for b in batches:
            yield b.filter(pa.array(in_filter(words, b.column(0).to_numpy().view(np.uint64))))

    some = own.mapInArrow(picked, "doc long, doc_id long, text string")

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of each range; the join brings rows of one document, which are equal, one after another."""
        last = None
        for b in slices(batches, "text"):
            docs, ids, lo, hi, out = [], [], [], [], []
            for doc, doc_id, text, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if doc == last:
                    continue
                last, words = doc, word_hashes(text).view(np.int64)
                for r in own:
                    docs.append(doc)
                    ids.append(doc_id)
                    lo.append(r["lo"])
                    hi.append(r["hi"])
                    out.append(words[r["lo"] : r["hi"]])
                    if len(out) >= STRETCHES:
                        yield part(docs, ids, lo, hi, out)
            if out:
                yield part(docs, ids, lo, hi, out)

    def part(*columns: list) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc", "doc_id", "lo", "hi", "words"])
        for c in columns:
            c.clear()
        return out

    cut = some.join(wanted, "doc").select("doc", "doc_id", "text", "ranges").mapInArrow(sliced, "doc long, doc_id long, lo long, hi long, words array<long>")
    stretches = written(cut, "words", "zstd")
    a = stretches.select("doc", "doc_id", F.col("lo").alias("a_from"), F.col("hi").alias("a_to"), F.col("words").alias("a"))
    b = stretches.select(F.col("doc").alias("other"), F.col("doc_id").alias("other_id"), F.col("lo").alias("b_from"), F.col("hi").alias("b_to"), F.col("words").alias("b"))
    both = framed.join(a, ["doc", "a_from", "a_to"]).join(b, ["other", "b_from", "b_to"])
    kinds = "doc_id long, other_id long, start long, end long, other_start long, other_end long, n_seeds long, matches long, identity double, doc long, other long"
    return both.select("doc_id", "other_id", "xs", "ys", "a_from", "b_from", "a", "b", "doc", "other").mapInArrow(_aligned_rows, kinds).distinct()


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, other_id, start, end, other_start, other_end, n_seeds, matches, identity); places count words."""
    return _found(docs, True).drop("doc", "other").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """Passages that tie together all documents which any chain of passages ties, and class_id, the least doc_id of these."""
    found = written(_found(docs, False), "passages", "zstd")
    root = components(found.select(F.col("doc").alias("a"), F.col("other").alias("b")))
    ids = found.select(F.col("doc").alias("node"), "doc_id").unionAll(found.select("other", "other_id")).groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    least = written(ids.join(root, "node").groupBy("root").agg(F.min("doc_id").alias("class_id")), "least")
    own = written(root.join(least, "root").select(F.col("node").alias("doc"), "class_id"), "members")
    return found.join(own, "doc").drop("doc", "other").distinct()


def op4_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
