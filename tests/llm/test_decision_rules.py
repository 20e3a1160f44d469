"""Counts against plain Python, the learner on made-up statistics, and defined cases."""

from __future__ import annotations

import random

from lattica.llm import decision_rules as rules
from plain_python import counts, first_rule
from pyspark.sql import functions as F

def test_counts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    more = ["", None, "a", "a b", "a b c a b c", "x " * 200, "a b c d " * 100, " lead\ttab\x0bvt ", "l\n\nl\n l\nl", "|#|&<>", "é ü 😀 é ü 😀", " ".join(f"p{i % 40} q{i % 41} r{i % 43}" for i in range(3000))]
    both = docs.select("text").union(spark.createDataFrame([(t,) for t in more], "text string"))
    for r in both.select("text", rules.statistics(F.col("text")).alias("st")).collect():
        assert tuple(r.st[k] for k in rules.COUNTS) == counts(r.text)
        n, *_, again = counts(r.text)
        assert r.st.base_failed == (n < 50 or 100 * again > 50 * n)


def test_learner_finds_a_conjunction():
    rng = random.Random(3)
    data = [(rng.random(), rng.random(), rng.random()) for _ in range(3000)]
    bad = [a > 0.7 and b < 0.4 or c > 0.95 for a, b, c in data]
    found = rules.learn(data, bad, ("a", "b", "c"), precision=0.9)
    hit = [any(all((r[("a", "b", "c").index(x.feature)] >= x.threshold) == x.at_least for x in rule) for rule in found.rules) for r in data]
    assert sum(h and b for h, b in zip(hit, bad, strict=True)) > 0.7 * sum(bad)
    assert sum(h and not b for h, b in zip(hit, bad, strict=True)) < 0.1 * sum(hit)
    assert rules.learn([], []).rules == [] == rules.learn(data, [False] * 3000, ("a", "b", "c")).rules


def test_labelled_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = rules.op10_decision_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed")
    assert out.filter("quality = 1 and not kept").count() == 0
    assert out.filter("quality = 0 and kept").count() <= 0.2 * out.filter("quality = 0").count()


def test_verdicts_as_in_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = rules.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert found.rules
    for r in rules.op10_decision_rules(spark, sf).collect():
        rule = first_rule(found, texts[r.doc_id])
        assert (r.rule, r.kept) == (rule, rule is None and not r.base_failed)


def test_stage_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.1"
    kept = rules.rules_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).select("doc_id").distinct()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean, bad = labels.filter("quality = 1 and toxic = 0"), labels.filter("quality = 0")
    assert clean.join(kept, "doc_id", "left_semi").count() >= 0.995 * clean.count()
    assert bad.join(kept, "doc_id", "left_semi").count() <= 0.02 * bad.count()


def test_defined_cases(spark, awkward, empty, labels):
    found = rules.fit(awkward, labels)
    st = rules.judged(F.col("text"), found)
    assert awkward.select(st["kept"]).count() == awkward.count()
    assert awkward.filter("text is null").select(st["n_words"], st["kept"]).distinct().collect() == [(0, False)]
    assert rules.fit(empty, labels).rules == []
    assert rules.fit(awkward, labels.limit(0)).rules == []
    assert empty.select(st["kept"]).count() == 0


def test_main_path_is_native(spark, small):
    plan = rules.op10_decision_rules(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
