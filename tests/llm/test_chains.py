"""Chains against quadratic chaining, passages against planted and brute-force ones."""

from __future__ import annotations

import numpy as np
import pytest

from lattica.llm import chains


def new_words(x, i, k):
    before = [v for v in x if v < x[i]]
    return min(k, x[i] - max(before)) if before else k


def best_chain(x, y, k, gap):
    order, score = sorted(range(len(x)), key=lambda i: x[i]), {}
    for i in order:
        score[i] = max([float(k), *[new_words(x, i, k) + score[j] - gap * (x[i] - x[j] + y[i] - y[j]) for j in score if x[j] < x[i] and y[j] < y[i]]])
    return max(score.values())


def test_chain_scores():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(1, 25))
        x, y = sorted(rng.integers(0, 60, n).tolist()), rng.integers(0, 60, n).tolist()
        best = chains.chains(x, y, 5, 0.05, 1)[0]
        got = 5 + sum(new_words(x, b, 5) - 0.05 * (x[b] - x[a] + y[b] - y[a]) for a, b in zip(best, best[1:], strict=False))
        assert got == pytest.approx(best_chain(x, y, 5, 0.05))
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(best, best[1:], strict=False))


def test_winnowing_keeps_a_seed_of_every_stretch():
    rng = np.random.default_rng(7)
    words = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    _, at = chains.seeds(words)
    assert max(np.diff(np.concatenate(([-1], np.sort(at), [296])))) <= chains.WINDOW
    _, part = chains.seeds(words[100 : 100 + chains.K + chains.WINDOW - 1])
    assert {p + 100 for p in part.tolist()} & set(at.tolist())


def make_docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_passages(spark):
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{v}" for v in rng.integers(0, 10**6, n)]
    shared = words(80)
    fuzzy = list(shared)
    for i in range(7, 80, 16):
        fuzzy[i] = "changed"
    del fuzzy[40]
    texts = [words(100) + shared + words(50), words(30) + shared, fuzzy + words(200), words(300), words(90), shared[:20] + words(60)]
    out = chains.passages(make_docs(spark, [" ".join(t) for t in texts])).collect()
    assert {(r.doc_id, r.other_id) for r in out} >= {(1, 0), (2, 0)}
    assert {d for r in out for d in (r.doc_id, r.other_id)} == {0, 1, 2}
    exact = next(r for r in out if (r.doc_id, r.other_id) == (1, 0))
    assert (exact.start, exact.end, exact.other_start, exact.other_end, exact.identity) == (30, 110, 100, 180, 1.0)
    near = next(r for r in out if (r.doc_id, r.other_id) == (2, 0))
    assert near.start <= 2 and near.end >= 76 and 0.85 < near.identity < 1


@pytest.mark.parametrize("copies", [1, 12])
def test_passages_of_parts_that_are_common_elsewhere(spark, copies):
    rng = np.random.default_rng(9)
    words = lambda n: [f"w{v}" for v in rng.integers(0, 10**6, n)]
    parts = [words(20) for _ in range(3)]
    alone = lambda: [words(30) + p + words(30) for p in parts for _ in range(copies)]
    both = [words(25) + sum(parts, []) + words(25), words(70) + sum(parts, []) + words(5)]
    texts = alone() + both + alone()
    found = chains.passages(make_docs(spark, [" ".join(t) for t in texts])).collect()
    b = 3 * copies
    assert {(r.doc_id, r.other_id, r.start, r.end, r.other_start, r.other_end) for r in found} == {(b + 1, b, 70, 130, 25, 85)}


def test_all_shared_windows_are_connected(spark, small):
    docs = {r.doc_id: r.text.lower().split() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    where = {}
    for d, w in docs.items():
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add(d)
    out = chains.op4_chains(spark, small).collect()
    root = {d: d for d in docs}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for r in out:
        a, b = find(r.doc_id), find(r.other_id)
        root[max(a, b)] = min(a, b)
    shared = [s for s in where.values() if len(s) > 1]
    assert shared and all(len({find(d) for d in s}) == 1 for s in shared)


def test_chain_cases(spark, awkward, empty):
    assert chains.passages(awkward).count() == 0
    assert chains.passages(empty).count() == 0


def test_best_runs():
    rng = np.random.default_rng(10)
    for _ in range(300):
        s = rng.integers(-6, 5, int(rng.integers(0, 30))).tolist()

        def maximal(lo, hi):  # the best run, and those of what is left on either side of it
            best = max(((sum(s[i:j]), i - j, -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
            return [] if best[0] <= 0 else maximal(lo, best[3]) + [best[3:]] + maximal(best[4], hi)

        got = chains.best_runs(s)
        assert [sum(s[i:j]) for i, j in got] == [sum(s[i:j]) for i, j in maximal(0, len(s))]


def fuzzed(rng, words, share):
    out = list(words)
    for i in rng.choice(len(out), int(share * len(out)), replace=False):
        out[i] = f"changed{rng.integers(10**6)}"
    return out


@pytest.mark.parametrize("share", [0.0, 0.08])
def test_two_passages_at_any_gap(spark, share):
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{v}" for v in rng.integers(0, 10**7, n)]
    texts, planted = [], []
    for length in (60, 100, 200):
        for gap in (30, 60, 100, 200, 300, 600, 1000):
            one, two = words(length), words(length)
            texts.append(words(20) + one + words(gap) + two + words(20))
            texts.append(words(50) + fuzzed(rng, one, share) + words(gap) + fuzzed(rng, two, share) + words(7))
            planted += [(len(texts) - 1, 50, 50 + length), (len(texts) - 1, 50 + length + gap, 50 + 2 * length + gap)]
    found = chains.passages(make_docs(spark, [" ".join(t) for t in texts])).collect()
    assert all(r.doc_id == r.other_id + 1 and r.doc_id % 2 for r in found)
    lost = [p for p in planted if not any(r.doc_id == p[0] and min(r.end, p[2]) - max(r.start, p[1]) >= 0.75 * (p[2] - p[1]) for r in found)]
    assert not lost
    assert all(r.identity >= chains.IDENTITY and min(r.end - r.start, r.other_end - r.other_start) >= chains.LEAST for r in found)


def test_passage_whose_parts_lie_in_documents_before_and_after(spark):
    rng = np.random.default_rng(12)
    words = lambda n: [f"w{v}" for v in rng.integers(0, 10**7, n)]
    shared = words(150)
    cuts = lambda: [words(20) + shared[k : k + 25] + words(20) for k in range(0, 150, 25) for _ in range(10)]
    texts = cuts() + [words(9) + shared + words(30), words(44) + shared] + cuts()
    found = chains.passages(make_docs(spark, [" ".join(t) for t in texts])).collect()
    assert {(r.doc_id, r.other_id, r.start, r.end, r.other_start, r.other_end) for r in found} == {(61, 60, 44, 194, 9, 159)}


def test_variants_of_a_passage_that_many_hold(spark):
    """Each of 30 documents has words of its own in it, so that no pair of documents shares a stretch of 50 words."""
    rng = np.random.default_rng(14)
    words = lambda n: [f"w{v}" for v in rng.integers(0, 10**7, n)]
    shared, texts, n = words(80), [], 30
    for k in range(n):
        own = list(shared)
        for i in range(k % 5 * 3, 80, 16):
            own[i] = f"own{k}x{i}"
        texts.append(words(30 + k) + own + words(60))
    found = {(r.doc_id, r.other_id) for r in chains.passages(make_docs(spark, [" ".join(t) for t in texts])).collect()}
    near = {(a, b) for a in range(n) for b in range(a) if (a - b) % 5 == 0}
    assert near <= found


def test_copies_with_one_word_of_their_own(spark):
    """All pairs of 25 documents hold a passage of 60 words that differ in one."""
    rng = np.random.default_rng(15)
    words = lambda n: [f"w{v}" for v in rng.integers(0, 10**7, n)]
    shared, n = words(60), 25
    texts = [words(20) + shared[:30] + [f"own{k}"] + shared[31:] + words(20) for k in range(n)]
    found = [(r.doc_id, r.other_id) for r in chains.passages(make_docs(spark, [" ".join(t) for t in texts])).collect()]
    assert sorted(found) == [(a, b) for a in range(n) for b in range(a)]


def test_every_long_common_run_is_in_a_passage(spark, small):
    """Runs of 60 equal words that two documents share and at most six hold, by brute force."""
    docs = {r.doc_id: r.text.lower().split() for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    where = {}
    for d, w in docs.items():
        for k in range(len(w) - 59):
            where.setdefault(tuple(w[k : k + 60]), []).append((d, k))
    found = {}
    for r in chains.op4_chains(spark, small).collect():
        found.setdefault((r.doc_id, r.other_id), []).append(r)
    checked = 0
    for at in where.values():
        if len(at) == len({d for d, _ in at}) <= 6:
            for a, x in at:
                for b, y in at:
                    if a > b:
                        checked += 1
                        assert any(r.start <= x + 5 and x + 55 <= r.end and r.other_start <= y + 5 and y + 55 <= r.other_end for r in found.get((a, b), [])), (a, b, x, y)
    assert checked > 100


def test_ids_that_repeat_or_lack(spark):
    rng = np.random.default_rng(13)
    words = lambda n: [f"w{v}" for v in rng.integers(0, 10**7, n)]
    one, two = words(60), words(60)
    rows = [(1, one + words(50)), (1, words(70) + two), (2, words(3) + one), (2, words(80) + two), (None, words(30) + one), (3, two), (3, two)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    found = {(r.doc_id, r.other_id, r.end - r.start, r.identity) for r in chains.passages(docs).collect()}
    assert found == {(2, 1, 60, 1.0), (2, None, 60, 1.0), (1, None, 60, 1.0), (3, 1, 60, 1.0), (3, 2, 60, 1.0)}


def test_variants_are_tied_by_few_pairs(spark):
    """Each of 60 documents has words of its own; the query's form names each, in one class, without all pairs."""
    rng = np.random.default_rng(16)
    words = lambda n: [f"w{v}" for v in rng.integers(0, 10**7, n)]
    shared, other, n = words(90), words(60), 60
    texts = [words(20) + shared[:30] + [f"own{k}"] + shared[31 + k % 3 // 2 :] + words(20) for k in range(n)] + [words(9) + other, other + words(5), words(80)]
    out = chains.classes(make_docs(spark, [" ".join(t) for t in texts])).collect()
    assert {(d, r.class_id) for r in out for d in (r.doc_id, r.other_id)} == {(d, 0) for d in range(n)} | {(n, n), (n + 1, n)}
    assert len(out) <= 5 * n


def test_seed_of_words_that_repeat(spark):
    """60 times one word: all k-mers are one, which 20 documents hold."""
    rng = np.random.default_rng(17)
    words = lambda n: [f"w{v}" for v in rng.integers(0, 10**7, n)]
    docs = make_docs(spark, [" ".join(words(20 + k) + ["again"] * 60 + words(30)) for k in range(20)])
    assert {d for r in chains.classes(docs).collect() for d in (r.doc_id, r.other_id) if r.class_id == 0} == set(range(20))
    assert {(r.doc_id, r.other_id) for r in chains.passages(docs).collect()} == {(a, b) for a in range(20) for b in range(a)}
