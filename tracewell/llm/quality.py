r"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule rejects a text by an expression over the text and its words. On a
sample every rule is run alone: its share of rejected rows and its time give
rejections per second, and the rules are put into one CASE in that order, so a
text that one rule rejects never reaches the dearer ones. Whether a text is kept
does not depend on the order; the order decides time only.

The sample is about `SAMPLE_ROWS` rows drawn evenly from all of the table, which takes a
count and a scan, and is written to the shared folder; only counts and times come to the
driver. A rule's time is the least of `TRIES` runs over the sample repeated
`SAMPLE_REPEATS` times, after one that generates its code, less that of a rule that only
takes the words apart; repeating lifts it above what starting a job takes.

Words are `[^\x20\x09-\x0D]+`. A null or empty text has no words, all its counts
are 0 and it fails for having too few; a null key stays null; repeated rows give
repeated rows; an empty table gives an empty one, with the rules in the order they
were given. Columns of the input keep their values, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.batches import documents
from tracewell.sources.workspace import materialise

#: Rows on which cost and selectivity are estimated, on average.
SAMPLE_ROWS = 1000
#: How often they are gone through in a timed run, and runs of which the best counts.
SAMPLE_REPEATS, TRIES = 4, 2
#: What a rule is taken to cost at least, since less can't be told from nothing.
LEAST_SECONDS = 1e-4

_SPACES = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "[#*$%&|<>]+"
_WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACES), "")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def signs(text: Column, pattern: str) -> Column:
    """Characters that the pattern matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))


def dup_lines(text: Column) -> Column:
    return let(lines_with_words(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def repeated_words(words: Column) -> Column:
    """Words in windows of five that the text has twice or more.

    Distinct hashes prove that no window recurs; only where hashes recur are the
    windows themselves compared, as neighbours in sorted order.
    """

    def positions() -> Column:
        return F.sequence(F.lit(0), F.size(words) - _WINDOW)

    def covered(at: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(at) - 1)
        more = F.aggregate(steps, F.lit(0), lambda sum_, k: sum_ + F.least(F.lit(_WINDOW), at[k] - at[k - 1]))
        return F.when(F.size(at) == 0, 0).when(F.size(at) == 1, _WINDOW).otherwise(_WINDOW + more)

    def compared() -> Column:
        windows = F.transform(
            positions(),
            lambda i: F.struct(F.array_join(F.slice(words, i + 1, _WINDOW), " ").alias("w"), i.alias("i")),
        )

        def repeated(found: Column) -> Column:
            def twin(window: Column, k: Column) -> Column:
                before = (k > 0) & (F.get(found, k - 1)["w"] == window["w"])
                return F.coalesce(before, F.lit(False)) | F.coalesce(
                    F.get(found, k + 1)["w"] == window["w"], F.lit(False)
                )

            return F.sort_array(F.transform(F.filter(found, twin), lambda window: window["i"]))

        return let(F.array_sort(windows), lambda found: let(repeated(found), covered))

    def hashed(hashes: Column) -> Column:
        return F.transform(positions(), lambda i: F.xxhash64(*[hashes[i + j] for j in range(_WINDOW)]))

    windows = let(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    count = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(compared()))
    return F.when(F.size(words) < _WINDOW, 0).otherwise(count)


@dataclass(frozen=True)
class Rule:
    """`rejects` makes a boolean column of the text and its words."""

    name: str
    rejects: Callable[[Column, Column], Column]


#: What every text has to pass.
BASE_RULES = (
    Rule("few_words", lambda text, words: F.size(words) < 10),
    Rule("repeated_windows", lambda text, words: 100 * repeated_words(words) > 20 * F.size(words)),
)
#: Thresholds are integers, so that any engine decides alike.
FURTHER_RULES = (
    Rule("symbols", lambda text, words: 5 * signs(text, _SYMBOLS) > F.size(words)),
    Rule("short_words", lambda text, words: word_chars(words) < 2 * F.size(words)),
    Rule("long_words", lambda text, words: word_chars(words) > 15 * F.size(words)),
    Rule("upper_case", lambda text, words: 100 * signs(text, "[A-Z]+") > 45 * F.length(text)),
    Rule("shouting", lambda text, words: signs(text, "!+") > F.size(words)),
    Rule("digits", lambda text, words: 100 * signs(text, "[0-9]+") > 50 * F.length(text)),
    Rule(
        "repeated_lines",
        lambda text, words: let(
            lines_with_words(text),
            lambda lines: 100 * (F.size(lines) - F.size(F.array_distinct(lines))) > 45 * F.size(lines),
        ),
    ),
)
RULES = BASE_RULES + FURTHER_RULES


def with_words(df: DataFrame, text: str) -> DataFrame:
    """(row, text, words): the whole input row, its text (null as empty) and the words of it."""
    rows = df.select(F.struct("*").alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("words", words_of(F.col("text")))


def sample_of(df: DataFrame, text: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `rows` texts drawn evenly from all of `df`, or all of a small one, written in one part."""
    texts = df.select(F.col(text).cast("string").alias("text"))
    share = min(1.0, rows / max(df.count(), 1))
    return materialise(texts.sample(share, seed=1).repartition(1), "sample")


def estimates(sample: DataFrame, rules: Sequence[Rule]) -> dict[str, tuple[int, float]]:
    """Of each rule, by name, the rows of the sample it rejects and the seconds it takes for them."""
    again = sample.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_REPEATS))))

    def run(rule: Rule) -> tuple[int, float]:
        # Sums over all turns, so that no turn can be left out.
        rejected = F.count(verdict([rule], F.col("text"))).alias("rejected")
        counted = again.agg(rejected, F.sum("turn"))
        times = []
        for _ in range(1 + TRIES):
            start = time.perf_counter()
            found = counted.first()[0]
            times.append(time.perf_counter() - start)
        return found // SAMPLE_REPEATS, min(times[1:]) / SAMPLE_REPEATS

    floor = run(Rule("nothing", lambda text, words: F.size(words) < 0))[1]
    measured = {rule.name: run(rule) for rule in rules}
    return {name: (rejected, max(seconds - floor, LEAST_SECONDS)) for name, (rejected, seconds) in measured.items()}


def ordered(sample: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """The rules by rejections per second on the sample, most first."""
    found = estimates(sample, rules)
    return sorted(rules, key=lambda rule: -found[rule.name][0] / found[rule.name][1])


def cascade(rules: Sequence[Rule], text: Column, words: Column) -> Column:
    """Name of the first rule that rejects, else null; later rules are not computed."""
    found = F
    for rule in rules:
        found = found.when(rule.rejects(text, words), rule.name)
    return found if rules else F.lit(None).cast("string")


def verdict(rules: Sequence[Rule], text: Column) -> Column:
    """The cascade on a text alone.

    Text and words are bound inside the expression: a filter that moves below the
    projection that makes the words would make them anew for each of them.
    """
    return let(
        F.coalesce(text.cast("string"), F.lit("")),
        lambda t: let(words_of(t), lambda words: cascade(rules, t, words)),
    )


def keep_good(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that no rule rejects, as they are."""
    return df.where(verdict(ordered(sample_of(df, text), rules), F.col(text)).isNull())


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """`row` with the base counts and `base_failed` beside it, and the text and words for rules."""
    rows = with_words(df, text)
    counted = rows.select(
        "row",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        word_chars(F.col("words")).cast("long").alias("word_chars"),
        signs(F.col("text"), _SYMBOLS).cast("long").alias("n_symbols"),
        dup_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    order = ordered(sample_of(docs, "text"), FURTHER_RULES)
    rejected = cascade(order, F.col("text"), F.col("words"))
    found = measures(docs).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(rejected.isNull()))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    )


def kept_sql(documents: str = "documents") -> str:
    """The same counts and verdicts in SQL."""
    return rf"""
WITH w AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM {documents}
),
win AS (
    SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS k
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
),
rep AS (
    SELECT r, count(DISTINCT i + j) AS n_repeat_words
    FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win), (SELECT unnest(range(5)) AS j)
    WHERE c > 1
    GROUP BY r
),
m AS (
    SELECT doc_id, t, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN rep USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words
        OR 5 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
        OR 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 45 * length(t)
        OR length(t) - length(replace(t, '!', '')) > n_words
        OR 100 * (length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) > 50 * length(t)
        OR 100 * n_dup_lines > 45 * n_lines) AS kept
FROM m"""
