"""Stages of the pipeline in plain Python, for tests to compare with."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from lattica.llm import line_chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    """The five base counts of the quality rules."""
    t = text or ""
    ws = WORD.findall(t)
    seen, cover = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2)), set()
    for i in range(len(ws) - 2):
        if seen[tuple(ws[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def shares(text):
    """The features of the learned rules by name."""
    t = text or ""
    n_words, word_chars, n_symbols, n_dup, n_repeat = counts(t)
    ws, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    chars, n, ls = max(word_chars, 1), max(n_words, 1), max(len(lines), 1)
    some = lambda pattern: len(re.findall(pattern, t))
    uppers = sum(c.isupper() and c.isalpha() for c in t)
    return {"word_len": word_chars / n, "symbol_share": n_symbols / chars, "bang_share": some("[!?]") / chars, "upper_share": uppers / chars, "digit_share": some("[0-9]") / chars, "comma_stop_share": some("[.,;]") / n, "dup_line_share": n_dup / ls, "repeat_share": n_repeat / n, "distinct_share": len(set(ws)) / n}


def first_rule(found, text):
    """1-based number of the first rule of a decision list that matches, else None."""
    own = shares(text)
    return next((k for k, rule in enumerate(found.rules, 1) if all((own[x.feature] >= x.threshold) == x.at_least for x in rule)), None)


def without_repeats(rows):
    """(id, text) pairs without repeated line chunks."""
    places = defaultdict(list)
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for a, b, _, chunk in line_chunks.repeatable(text):
            places[chunk].append((doc, a, b))
    drop = defaultdict(set)
    for found in places.values():
        for doc, a, b in sorted(found)[1:]:
            drop[doc] |= set(range(a, b))
    return {doc: "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop[doc]) for doc, text in rows}


def shingle_set(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def similar_groups(texts, limit=0.8):
    """Groups of positions whose shingle sets are linked at a Jaccard similarity of ``limit`` or more."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= limit * len(a | sets[j]):
                root[find(i)] = find(j)
    out = defaultdict(set)
    for i in range(len(sets)):
        out[find(i)].add(i)
    return {frozenset(s) for s in out.values()}
