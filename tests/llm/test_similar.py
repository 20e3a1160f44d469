"""Near-duplicates at a similarity of shingles against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from plain_python import similar_groups

from lattica.llm import similar


def corpus(rng, n, length=(20, 200)):
    return [[f"w{v}" for v in rng.integers(0, 3000, rng.integers(*length))] for _ in range(n)]


def changed(rng, words, share):
    out = list(words)
    for i in rng.choice(len(out), max(1, int(share * len(out))), replace=False):
        out[i] = f"x{rng.integers(10**6)}"
    return out


def make(spark, texts):
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r.root, set()).add(r.doc_id)
    return {frozenset(s) for s in out.values()}


@pytest.mark.parametrize("largest", [4096, 20])
def test_components_as_by_brute_force(spark, monkeypatch, largest):
    """Also with buckets that are dealt again, down to those compared with their first rows."""
    monkeypatch.setattr(similar, "LARGEST", largest)
    rng = np.random.default_rng(1)
    base = corpus(rng, 60)
    texts = base + [changed(rng, b, s) for b in base for s in (0.005, 0.01, 0.02, 0.03, 0.1)] + base[:5]
    one = corpus(rng, 1, (300, 301))[0]
    texts += [changed(rng, one, 0.004) for _ in range(80)]  # copies that hardly differ
    want, got = similar_groups([" ".join(t) for t in texts]), groups(similar.similar(make(spark, texts)).collect())
    assert got == want or len(got ^ want) <= 4 and all(any(g <= w for w in want) for g in got)


def variants(rng, words, low, high, n):
    """Variants of a text at a similarity between two bounds: (similarity, estimate, words)."""
    own, out = similar.shingle_set(" ".join(words)), []
    for _ in range(n):
        other = changed(rng, words, rng.uniform(0.015, 0.035))
        b = similar.shingle_set(" ".join(other))
        j = len(np.intersect1d(own, b)) / len(np.union1d(own, b))
        if low <= j < high:
            out.append((j, similar.estimates(similar.sketch(own)[None], similar.sketch(b)[None])[0], other))
    return out


def test_doubtful_links_beyond_the_best_ones(spark):
    """Two texts are similar, each has more pairs that only look better, and these aren't similar."""
    rng = np.random.default_rng(4)
    one = corpus(rng, 1, (400, 401))[0]
    _, seen, other = min((v for v in variants(rng, one, 0.8, 0.82, 1500) if v[1] > 0.745), key=lambda v: v[1])
    texts = [one, other]
    for center in (one, other):
        lures = sorted(variants(rng, center, 0.77, 0.8, 800), key=lambda v: -v[1])[:8]
        assert all(seen < v[1] < 0.86 for v in lures)
        texts += [v[2] for v in lures]
    want = similar_groups([" ".join(t) for t in texts])
    assert {0, 1} in want
    assert groups(similar.similar(make(spark, texts)).collect()) == want


@pytest.mark.parametrize("largest", [4096, 100])
def test_rest_is_all_that_may_be_similar(spark, monkeypatch, largest):
    """As by comparing all sketches, for texts that share all least hashes; also where a bucket is cut into parts."""
    monkeypatch.setattr(similar, "LARGEST", largest)
    rng = np.random.default_rng(5)
    n = 700
    fps = rng.integers(0, 1 << 63, 3, dtype=np.uint64)[rng.integers(0, 3, n)] ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    small = rng.integers(1, 256, (3, similar.BINS), dtype=np.uint8)[rng.integers(0, 3, n)]
    small[rng.random(small.shape) < 0.12] = 7
    roots = rng.integers(0, 50, n)
    rows = [(i, int(fps[i].view(np.int64)), [1] * (similar.TABLES * similar.ROUNDS), small[i].tobytes(), int(roots[i])) for i in range(n)]
    nodes = spark.createDataFrame(rows, "node long, fp long, mins array<long>, sketch binary, root long")
    want = set()
    for i in range(n):
        near = similar.estimates(np.repeat(small[i : i + 1], n, 0), small) >= similar.SIMILARITY - similar.MARGIN
        bits = np.array([(int(fps[i]) ^ int(x)).bit_count() for x in fps]) <= similar.RADIUS
        want |= {(i, int(j)) for j in np.flatnonzero(near & bits & (roots != roots[i])) if i < j}
    assert len(want) > 1000
    assert {(r.a, r.b) for r in similar.rest(nodes).collect()} == want


def test_sketches_and_radius():
    rng = np.random.default_rng(2)
    off = bits = n = 0
    for words in corpus(rng, 200, (60, 400)):
        other = changed(rng, words, 0.02)
        a, b = similar.shingle_set(" ".join(words)), similar.shingle_set(" ".join(other))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est = similar.estimates(similar.sketch(a)[None], similar.sketch(b)[None])[0]
        off += abs(est - j) > similar.MARGIN
        if j >= 0.8:
            n += 1
            bits += (similar.majority(a) ^ similar.majority(b)).bit_count() > similar.RADIUS
    assert off <= 12 and n > 80 and bits == 0


def test_stage(spark, awkward, empty):
    kept = similar.similar_stage(spark, awkward, "")
    assert kept.columns == awkward.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len(set(rows))
    assert sorted(str(i) for i, _ in rows) == ["1", "2", "5", "6", "None"]  # 3, 4 and the null text are as 2: no words
    assert [t for i, t in rows if i is None] == ["no id here"]
    assert similar.similar_stage(spark, empty, "").count() == 0
