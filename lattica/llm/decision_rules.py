"""Learned decision lists for document quality: sequential covering, emitted as Spark expressions.

All passes over documents are DataFrame expressions. The learner sees statistics of a bounded sample of labelled
rows (``max_train``), held on the driver as bit sets, and emits an ordered list of threshold conjunctions.

Defined cases: a null text counts as empty (no words, fails the base rule); repeated doc_ids are judged one row at a
time; a table without labels or without documents gives a list with no rules, so only the base rule decides; further
columns of the input are ignored by the query and pass through the pipeline stage.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm._common import let, table, words

#: Characters that count as symbols. Fixed value of the contract.
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_len", "symbol_share", "bang_share", "upper_share", "digit_share", "comma_stop_share", "dup_line_share", "repeat_share", "distinct_share")


#: Up to so many different repeated windows are looked up one by one; more are found by sorting. Both ways are exact.
FEW = 32


def repeated_window_words(ws: Column, width: int = 3) -> Column:
    """Number of words inside windows of ``width`` words that occur twice or more in the same array.

    Windows are compared by 64-bit hash within one document. The sorted hashes show which ones repeat; the covered
    words are counted from the starting positions, each reaching to the next start at most.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]))

    def by_sorting(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = lambda s: F.filter(s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | (F.get(s, i - 1)["h"] == x["h"]))
        return let(pairs, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["p"])))

    def starts(h: Column) -> Column:
        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
        one_by_one = lambda d: F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda p: p.isNotNull())
        return let(again, lambda d: F.when(F.size(d) == 0, F.array().cast("array<int>")).when(F.size(d) <= FEW, one_by_one(d)).otherwise(by_sorting(h)))

    def covered(p: Column) -> Column:
        reach = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(ws) <= width, F.lit(0)).otherwise(let(let(hashes, starts), covered)).cast("long")


def _count(text: Column, of: str) -> Column:
    """How many characters of the text are in the character class."""
    return (F.size(F.split(text, of)) - 1).cast("long")


def statistics(text: Column) -> Column:
    """Struct of the five base counts, the shares that rules are made of, and base_failed.

    It is one expression whose parts are bound by ``let``: no optimizer rule can copy a costly part.
    """
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))

    def counts(x: Column) -> Column:
        t, ws, ls = x["t"], x["ws"], x["ls"]
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            _count(t, f"[{SYMBOLS}]").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_window_words(ws).alias("n_repeat_words"),
            F.size(ls).alias("n_lines"),
            _count(t, "[!?]").alias("bangs"),
            _count(t, "\\p{Lu}").alias("uppers"),
            _count(t, "[0-9]").alias("digits"),
            _count(t, "[.,;]").alias("stops"),
            F.size(F.array_distinct(ws)).alias("distinct"),
        )

    def shares(c: Column) -> Column:
        chars, n, ls = (F.greatest(c[k], F.lit(1)) for k in ("word_chars", "n_words", "n_lines"))
        return F.struct(
            *[c[k].alias(k) for k in COUNTS],
            *[
                x.alias(k)
                for k, x in {
                    "word_len": c["word_chars"] / n,
                    "symbol_share": c["n_symbols"] / chars,
                    "bang_share": c["bangs"] / chars,
                    "upper_share": c["uppers"] / chars,
                    "digit_share": c["digits"] / chars,
                    "comma_stop_share": c["stops"] / n,
                    "dup_line_share": c["n_dup_lines"] / ls,
                    "repeat_share": c["n_repeat_words"] / n,
                    "distinct_share": c["distinct"] / n,
                }.items()
            ],
            ((c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])).alias("base_failed"),
        )

    parts = F.struct(F.coalesce(text, F.lit("")).alias("t"), words(text).alias("ws"), lines.alias("ls"))
    return let(let(parts, counts), shares)


@dataclass(frozen=True)
class Literal:
    """feature >= threshold, or feature < threshold."""

    feature: str
    at_least: bool
    threshold: float

    def column(self, of: Column) -> Column:
        c = of[self.feature]
        return c >= F.lit(self.threshold) if self.at_least else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered conjunctions that reject; a row that none of them matches is kept."""

    rules: list[list[Literal]] = field(default_factory=list)

    def fired(self, of: Column) -> Column:
        """1-based number of the first rule that matches the statistics, else null."""
        out = F.lit(None).cast("int")
        for k in range(len(self.rules), 0, -1):
            test = F.lit(True)
            for x in self.rules[k - 1]:
                test = test & x.column(of)
            out = F.when(test, F.lit(k)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, r)) + " -> reject" for r in self.rules) + "\n-> keep"


def _literals(rows: list[tuple], features: tuple[str, ...], cuts: int) -> list[tuple[Literal, int]]:
    """Each literal with the bit set of the rows it holds for."""
    out = []
    for k, name in enumerate(features):
        values = sorted({r[k] for r in rows})
        ordered = sorted(r[k] for r in rows)
        picked = sorted({ordered[(len(ordered) - 1) * q // cuts] for q in range(cuts + 1)} | {values[(len(values) - 1) * q // cuts] for q in range(cuts + 1)})
        for low, high in zip(picked, picked[1:], strict=False):
            at = (low + high) / 2
            mask = sum(1 << i for i, r in enumerate(rows) if r[k] >= at) if len(rows) < 64 else int("".join("1" if r[k] >= at else "0" for r in reversed(rows)), 2)
            out += [(Literal(name, True, at), mask), (Literal(name, False, at), ((1 << len(rows)) - 1) ^ mask)]
    return out


def learn(rows: list[tuple], bad: list[bool], features: tuple[str, ...] = FEATURES, cuts: int = 24, max_literals: int = 3, max_rules: int = 12, precision: float = 0.97, support: int = 8) -> DecisionList:
    """Sequential covering: grow a conjunction on two thirds of the rows, prune it on the rest, remove what it covers.

    A rule joins the list if, on the pruning rows, at least ``precision`` of what it newly covers is bad.
    """
    if not rows or not any(bad):
        return DecisionList()
    literals = _literals(rows, features, cuts)
    bits = lambda test: sum(1 << i for i in range(len(rows)) if test(i))
    is_bad, grow, left = bits(lambda i: bad[i]), bits(lambda i: i % 3 != 2), (1 << len(rows)) - 1
    found = DecisionList()

    def purity(mask: int) -> tuple[int, int]:
        return (mask & is_bad).bit_count(), mask.bit_count()

    while len(found.rules) < max_rules and left & is_bad:
        cover, rule = left & grow, []
        while len(rule) < max_literals and cover & ~is_bad:
            p0, n0 = purity(cover)
            best = None
            for x, mask in literals:
                p, n = purity(cover & mask)
                if p < support or n == n0:
                    continue
                # gain in information about badness, weighted by the bad rows that stay, as a ratio without logarithms of zero
                score = p * ((p / n) - (p0 / n0)) / (1 - p0 / n0)
                if best is None or score > best[0] + 1e-12:
                    best = (score, x, mask)
            if best is None or best[0] <= 0:
                break
            rule.append((best[1], best[2]))
            cover &= best[2]
        if not rule:
            break

        def worth(part: list) -> tuple[float, int]:
            mask = left & ~grow
            for _, m in part:
                mask &= m
            p, n = purity(mask)
            return ((p + 1) / (n + 2), p)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        mask = left
        for _, m in rule:
            mask &= m
        p, n = purity(mask & ~grow)
        whole_p, whole_n = purity(mask)
        if whole_p < support or whole_p < precision * whole_n or p < precision * n:
            break
        found.rules.append([x for x, _ in rule])
        left &= ~mask
    return found


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 12_000, after_base: bool = True, **options) -> DecisionList:
    """The list learned from at most ``max_train`` labelled rows, chosen by hash of their id.

    With ``after_base`` from those alone that pass the base rule, which then decides first. The bound makes the broadcast of ids and the rows that reach the driver small by construction.
    """
    some = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    one_each = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = one_each.select("doc_id", "quality", statistics(F.col("text")).alias("st")).limit(max_train).collect()
    rows = sorted(([float(r["st"][f]) for f in FEATURES], r["quality"] == 0) for r in rows if not (after_base and r["st"]["base_failed"]))
    random.Random(0).shuffle(rows)
    return learn([tuple(x) for x, _ in rows], [y for _, y in rows], **options)


def judged(text: Column, rules: DecisionList, after_base: bool = True) -> Column:
    """Statistics with the number of the rule that rejects and the verdict, which the base rule shares if ``after_base``."""

    def verdict(st: Column) -> Column:
        rule = rules.fired(st)
        return F.struct(*[st[k].alias(k) for k in (*COUNTS, "base_failed")], rule.alias("rule"), (rule.isNull() & ~st["base_failed"] if after_base else rule.isNull()).alias("kept"))

    return let(statistics(text), verdict)


def op10_decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", judged(F.col("text"), rules).alias("st")).select("doc_id", *[f"st.{k}" for k in (*COUNTS, "base_failed", "kept", "rule")])


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without words or that a learned rule rejects go; a text that is merely short stays."""
    rules = fit(docs, table(spark, sf_dir, "labels"), after_base=False)
    return docs.filter(let(judged(F.col("text"), rules, after_base=False), lambda st: st["kept"] & (st["n_words"] > 0)))
