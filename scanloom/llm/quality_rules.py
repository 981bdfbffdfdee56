"""Quality rules as a short-circuit cascade (operator 4, native).

Each rule is a boolean expression over the text; it is true where the rule rejects.
On a sample the operator measures what a rule costs and which rows it rejects, in the
form in which it is run, and orders the rules by rejection per cost: each time the
rule that rejects most per cost of the rows that the rules before it leave. The
cascade is one CASE expression in that order, so a row pays only for the rules up to
the first that rejects it. A text is kept if no rule rejects it, so the order changes
the cost and never the verdict.

The sample is about SAMPLE_ROWS rows by a hash of the id, of texts up to SAMPLE_CHARS
characters, and only the order of the rules depends on it. A null or empty text has no words and
is rejected for having too few. Texts are read whole, whatever their length; an
empty table gives no rows; repeated rows get equal verdicts; other input columns
are ignored, or in keep_good() returned as they are.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, documents, let, quoted

SAMPLE_ROWS = 1000
SAMPLE_CHARS = 50_000
WINDOW = 5


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeat_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of so many words that the text has twice or
    more. The windows' hashes are compared, and sorted only in texts that have a
    window twice: n log n steps for n words."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - s, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def sorted_windows(pairs: Column) -> Column:
        hash_at = lambda i: F.get(pairs, i)["h"]
        twice = F.filter(pairs, lambda p, i: p["h"].eqNullSafe(hash_at(i - 1)) | p["h"].eqNullSafe(hash_at(i + 1)))
        return let(F.array_sort(F.transform(twice, lambda p: p["i"])), covered)

    def windows(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.array_sort(pairs), sorted_windows))

    def of_words(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - window)
        return F.when(F.size(h) <= window, F.lit(0)).otherwise(
            let(F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])), windows)
        )

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), of_words).cast("bigint")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, "")).cast("bigint")


class Text:
    """What rules ask of a text, computed when and where it is asked."""

    def __init__(self, text: Column):
        self.text = text

    def fewer_words_than(self, n: int) -> Column:
        """Reads no further than the n-th word."""
        return ~self.text.rlike(f"^(?:{SPACE})?(?:{WORD}{SPACE}){{{n - 1}}}{WORD}")

    @property
    def n_words(self) -> Column:
        return F.regexp_count(self.text, F.lit(WORD)).cast("bigint")

    @property
    def word_chars(self) -> Column:
        return word_chars(self.text)

    @property
    def n_symbols(self) -> Column:
        return symbols(self.text)

    @property
    def n_dup_lines(self) -> Column:
        return dup_lines(self.text)

    def repeats_over(self, percent: int) -> Column:
        """Whether over so many percent of the words lie in repeated windows."""
        return let(words(self.text), lambda w: 100 * repeat_words(w) > percent * F.size(w))


class Counted(Text):
    """The same for rows that have the counts as columns."""

    n_words, word_chars, n_symbols, n_dup_lines = (property(lambda self, c=c: F.col(c)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines"))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], Column]


#: Rejected whatever the other rules say.
BASE_RULES = (
    Rule("few_words", lambda t: t.fewer_words_than(10)),
    Rule("repeated_windows", lambda t: t.repeats_over(20)),
)
#: Rules for junk that the base rules leave: symbols stuck to the words, shouting,
#: copied lines, and words too short or too long on average to be prose.
MORE_RULES = (
    Rule("symbols", lambda t: 4 * t.n_symbols > t.n_words),
    Rule(
        "shouting",
        lambda t: 2 * F.length(F.regexp_replace(t.text, "[^\\p{Lu}]+", "")) > F.length(F.regexp_replace(t.text, "[^\\p{L}]+", "")),
    ),
    Rule("copied_lines", lambda t: 2 * t.n_dup_lines > F.size(F.filter(F.split(t.text, "\n", -1), lambda x: x.rlike(WORD)))),
    Rule("word_length", lambda t: ~(t.word_chars / F.greatest(t.n_words, F.lit(1))).between(2, 16)),
)


def by_gain(rejected: dict[str, set[int]], cost: dict[str, float]) -> list[str]:
    """Names of rules in the order of rejections per cost, of the rows that the rules
    before leave; rejected: the rows that each rejects."""
    order, left = [], dict(rejected)
    while left:
        best = min(left, key=lambda name: (-(len(left[name]) + 1) / cost[name], name))
        gone = left.pop(best)
        left = {name: rows - gone for name, rows in left.items()}
        order.append(best)
    return order


def _sample(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Some rows (text) by a hash of the id, held by the driver."""
    n = docs.count()
    spread = F.pmod(F.xxhash64(F.lit("sample"), F.col(quoted(id_col))), F.lit(max(1, n // SAMPLE_ROWS)))
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.where(spread == 0).select(text.alias("text")).where(F.length("text") <= SAMPLE_CHARS).limit(2 * SAMPLE_ROWS).collect()
    return docs.sparkSession.createDataFrame([(r.text,) for r in rows], "text string")


def order_rules(sample: DataFrame, rules: Sequence[Rule], text: Text) -> list[Rule]:
    """The rules in the order of by_gain(), as measured on the rows of a sample that
    they would be asked about; text: what the rules read of such a row."""
    rows = sample.collect()  # of _sample()
    if not rows:
        return list(rules)
    sample = sample.sparkSession.createDataFrame(rows, sample.schema).coalesce(1)
    tests = [F.coalesce(rule.rejects(text), F.lit(False)) for rule in rules]
    found = sample.select(*[t.alias(rule.name) for t, rule in zip(tests, rules, strict=True)]).collect()

    def seconds(test: Column) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            sample.agg(F.count_if(test)).first()
            took.append(time.perf_counter() - began)
        return min(took)

    idle = seconds(F.col(sample.columns[0]).isNull())
    cost = {rule.name: max(seconds(test) - idle, 1e-3) for test, rule in zip(tests, rules, strict=True)}
    order = by_gain({rule.name: {i for i, r in enumerate(found) if r[rule.name]} for rule in rules}, cost)
    return sorted(rules, key=lambda rule: order.index(rule.name))


def cascade(rules: Sequence[Rule], text: Text) -> Column:
    """False from the first rule that rejects, else true."""
    verdict = None
    for rule in rules:
        rejected = F.coalesce(rule.rejects(text), F.lit(False))
        verdict = F.when(rejected, F.lit(False)) if verdict is None else verdict.when(rejected, F.lit(False))
    return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def _counted(texts: DataFrame) -> DataFrame:
    """texts(text, ...) with its counts and base_failed."""
    text = F.col("text")
    counts = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            word_chars(text).alias("word_chars"),
            symbols(text).alias("n_symbols"),
            dup_lines(text).alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    failed = (F.col("c.n_words") < 10) | (100 * F.col("c.n_repeat_words") > 20 * F.col("c.n_words"))
    return texts.select("*", counts.alias("c")).select(*texts.columns, "c.*", failed.alias("base_failed"))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = MORE_RULES) -> DataFrame:
    """One row per document: its counts, base_failed and kept."""
    text = Counted(F.col("text"))
    reached = _counted(_sample(docs, id_col, text_col)).where(~F.col("base_failed"))
    verdict = cascade(order_rules(reached, rules, text), text)
    texts = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    return _counted(texts).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict)).drop("text")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """The rows of docs that no rule rejects."""
    ordered = order_rules(_sample(docs, id_col, text_col), rules, Text(F.col("text")))
    return docs.where(cascade(ordered, Text(F.coalesce(F.col(quoted(text_col)), F.lit("")))))


def op4_quality_cascade(spark, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir, "doc_id", "text"))


_W = "'[^\\x20\\x09-\\x0D]+'"
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, {_W}) AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_W})) AS l FROM t),
grams AS (SELECT doc_id, i, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS g
          FROM w, unnest(range(1, len(w) - 3)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS u(k) GROUP BY doc_id),
c AS (SELECT w.doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (4 * n_symbols > n_words)
       AND NOT (2 * length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) > length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')))
       AND NOT (2 * n_dup_lines > n_lines)
       AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 16 AS kept
FROM f"""
