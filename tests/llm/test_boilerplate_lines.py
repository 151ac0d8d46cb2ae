from __future__ import annotations

import pytest
from compare import raw_tables, spark_rows, sql_rows

from tracewell.llm import boilerplate_lines as b


def test_same_as_sql(spark, sf_dir):
    assert spark_rows(b.op7_line_spread(spark, sf_dir)) == sql_rows(raw_tables(sf_dir), b.line_spread_sql())


@pytest.mark.parametrize("registers", [4, 12])
def test_near_the_threshold_counts_are_exact(spark, registers):
    rows = [(line, f"site{i}") for line in range(5, 60) for i in range(line) for _ in range(2)]
    lines = spark.createDataFrame(rows, "n int, site string").selectExpr(
        "site", "named_struct('h', CAST(n AS LONG), 'n', n) AS line"
    )
    found = {row.line.n for row in b.widespread(lines, 25, registers).collect()}
    assert found == set(range(25, 60))


def test_odd_rows(spark, odd):
    found = b.without_widespread(odd, size="n_tokens")
    assert found.columns == odd.columns
    assert sorted(found.collect(), key=repr) == sorted(odd.collect(), key=repr)
    assert b.without_widespread(odd.limit(0), size=None).count() == 0


def test_what_goes_and_what_stays(spark):
    rows = [(i % 4, f"own {i}\n footer\t\n\n last", f"s{i}", 0) for i in range(3)]
    rows += [(None, "footer", "s1", 0), (9, "footer\nfooter \nx", None, 0), (9, "other", "s9", 0), (8, None, "s8", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    found = b.without_widespread(df, min_sites=3)
    assert found.schema == df.schema
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in found.collect()), key=repr) == sorted(
        [(i, f"own {i}\n", 6) for i in range(3)]
        + [(None, "", 0), (9, "x", 1), (9, "other", 0), (8, None, 0)],
        key=repr,
    )


def test_sites_of_other_rows_and_whole_texts(spark):
    rows = [(i, "copied\nfooter", f"s{i}", 0) for i in range(3)]
    rows += [(i, f"own {i}\nfooter", f"s{i}", 0) for i in range(3, 6)] + [(6, " \nfooter", "s6", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    found = b.without_widespread(df, min_sites=3, counted=df.where("doc_id NOT IN (1, 2)"), whole=True)
    assert sorted((r.doc_id, r.text) for r in found.collect()) == [
        (0, "copied"), (1, "copied"), (2, "copied"), (3, "own 3"), (4, "own 4"), (5, "own 5"), (6, " \nfooter"),
    ]
