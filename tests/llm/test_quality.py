from __future__ import annotations

import itertools
import random

import pytest
from compare import raw_tables, spark_rows, sql_rows
from pyspark.sql import functions as F

from tracewell.llm import quality as q


def test_same_as_sql(spark, sf_dir):
    assert spark_rows(q.op9_quality_cascade(spark, sf_dir)) == sql_rows(raw_tables(sf_dir), q.kept_sql())


def repeated(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)})


def test_repeated_words_against_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab" if i % 2 else "abcdefgh") for _ in range(rng.randint(0, 40))) for i in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = df.select("text", q.repeated_words(q.words_of(F.col("text"))).alias("n")).collect()
    assert [(r.text, r.n) for r in found] == [(t, repeated(t.split())) for t in texts]


def test_the_order_of_rules_does_not_matter(docs):
    kept = {row.doc_id for row in q.keep_good(docs).collect()}
    for rules in itertools.islice(itertools.permutations(q.RULES), 0, None, 90000):
        found = docs.where(q.verdict(rules, F.col("text")).isNull())
        assert {row.doc_id for row in found.collect()} == kept


def test_rules_that_reject_more_per_second_come_first(docs):
    rules = [q.Rule("never", lambda t, w: F.size(w) < 0), q.Rule("often", lambda t, w: F.size(w) > 3)]
    assert [r.name for r in q.ordered(q.sample_of(docs, "text"), rules)] == ["often", "never"]


def test_of_rules_that_reject_alike_the_cheaper_comes_first(spark):
    """What a rule costs stands above what starting a job does; the figures are printed."""
    rng = random.Random(5)
    texts = [(" ".join(rng.choice("abcdefgh") * 3 for _ in range(600)),) for _ in range(300)]
    sample = q.sample_of(spark.createDataFrame(texts, "text string"), "text")
    dear = q.Rule("dear", lambda t, w: q.repeated_words(w) >= 0)
    cheap = q.Rule("cheap", lambda t, w: F.size(w) >= 0)
    found = q.estimates(sample, [dear, cheap])
    print(found)
    assert found["dear"][0] == found["cheap"][0] == 300
    assert found["dear"][1] > 5 * found["cheap"][1]
    assert [r.name for r in q.ordered(sample, [dear, cheap])] == ["cheap", "dear"]


def test_the_sample_is_drawn_from_all_partitions(spark):
    rows = spark.range(0, 40000, 1, 40).selectExpr("CAST(id DIV 1000 AS string) AS text")
    drawn = [row.text for row in q.sample_of(rows, "text").collect()]
    assert 800 < len(drawn) < 1200 and len(set(drawn)) == 40


@pytest.mark.parametrize("text, rule", [
    ("word " * 9, "few_words"),
    ("one two three four five " * 4, "repeated_windows"),
    (" ".join(f"w{i}## x" for i in range(20)), "symbols"),
    (" ".join("abcdefghijklmnopqrstuvwxyz"), "short_words"),
    (" ".join(f"{i:02d}" + "x" * 30 for i in range(20)), "long_words"),
    (" ".join(f"WORD{chr(65 + i)}" for i in range(20)), "upper_case"),
    (" ".join(f"wo{chr(97 + i)}!!" for i in range(20)), "shouting"),
    (" ".join(str(10**6 + i) for i in range(20)), "digits"),
    ("\n".join(["line one"] * 4 + ["a b c d e f g"]), "repeated_lines"),
])
def test_each_rule(spark, text, rule):
    df = spark.createDataFrame([(text,)], "text string")
    named = [r for r in q.RULES if r.name == rule]
    assert df.select(q.verdict(named, F.col("text")).alias("v")).first().v == rule


def test_odd_rows(odd):
    kept = q.keep_good(odd)
    # One of them has twelve words and nothing against it.
    assert kept.columns == odd.columns and kept.count() == 1
    assert q.keep_good(odd.limit(0)).count() == 0
    found = q.measures(odd).collect()
    assert len(found) == odd.count() and sum(not r.base_failed for r in found) == 1
    assert [r.n_words for r in found if r.text == ""] == [0, 0]


def test_no_python_in_the_plan(docs):
    plan = q.keep_good(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
