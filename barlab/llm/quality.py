"""Quality rules: a table of thresholds compiled into one projection.

Every measure is an expression on the row, so the whole operator is a scan and
a projection: no shuffle, no user function. Repeated word windows are found
within the row by sorting the windows' hashes, which is n log n for any text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

# fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = (
    "the of and to in a is that it for was on with as by at from this are be an or have not "
    "der die das und in den von zu mit ist des ein eine im nicht auf für als auch sich dem es er "
    "le la les de des du et un une en est que qui dans pour sur au aux par pas avec ce il "
    "el los las del y por con para su una al lo como más se no"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails the rule if its measure lies outside [low, high]; None: no bound."""

    name: str
    measure: Callable[[], Column]
    low: float | None = None
    high: float | None = None

    def failed(self) -> Column:
        value, tests = self.measure(), []
        if self.low is not None:
            tests.append(value < self.low)
        if self.high is not None:
            tests.append(value > self.high)
        test = tests[0] if len(tests) == 1 else tests[0] | tests[1]
        return F.when(test, F.lit(self.name))


def per(part: str, whole: str, scale: int = 1) -> Callable[[], Column]:
    return lambda: F.try_divide(F.col(part) * F.lit(scale), F.col(whole))


RULES = (
    Rule("words", lambda: F.col("n_words"), low=20),
    Rule("repeated_words", per("n_repeat_words", "n_words", 100), high=30),
    Rule("word_length", per("word_chars", "n_words"), low=2, high=15),
    Rule("symbols", per("n_symbols", "n_words"), high=0.4),
    Rule("stop_words", per("n_stop_words", "n_words"), low=0.01),
    Rule("repeated_lines", per("n_dup_lines", "n_lines"), high=0.6),
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""

    def count(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        places = F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n"), p.alias("last"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(bound(ordered, count))


def measures(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.columns
    words = docs.select(*own, text.alias("__text"), F.array_remove(F.split(text, SPACES), "").alias("__words"))
    lined = words.select(
        *own,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("__text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("__lines"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    )
    last = F.size("__hashes") - WINDOW
    window = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col("__hashes"), i + k) for k in range(WINDOW)]))
    counts = ["n_words", "word_chars", "n_symbols", "n_stop_words"]
    windowed = lined.select(
        *own,
        *counts,
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(last >= 0, window).otherwise(F.array().cast("array<bigint>")).alias("__windows"),
    )
    return windowed.select(*own, *counts, "n_lines", "n_dup_lines", _covered(F.col("__windows")).alias("n_repeat_words"))


def quality(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measures, failed_rules (names, in the table's order) and kept.

    A null text has no words and fails the rule on words. Ratios of a text
    without words or lines are null and fail nothing. Rows are independent, so
    repeated rows and ids, nulls in other columns and an empty table need no
    care. A column of ``docs`` with the name of a measure is replaced.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "failed_rules", "kept"}
    clean = docs.select(*[c for c in docs.columns if c not in made or c == text_col])
    measured = measures(clean, text_col=text_col)
    failed = F.array_compact(F.array(*[r.failed() for r in rules]))
    return measured.withColumn("failed_rules", failed).withColumn("kept", F.size("failed_rules") == 0)


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM t),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w),
p AS (SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS word, len(words) AS n FROM w),
v AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win FROM p),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) > 1 AS dup FROM v WHERE i <= n - 7),
c AS (SELECT p.doc_id, p.i, bool_or(coalesce(d.dup, false)) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit
      FROM p LEFT JOIN d ON p.doc_id = d.doc_id AND p.i = d.i),
r AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n_repeat_words FROM c GROUP BY doc_id),
a AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
            OR coalesce(word_chars < 2 * n_words OR word_chars > 15 * n_words, false)
            OR coalesce(n_symbols / nullif(n_words, 0) > 0.4, false)
            OR coalesce(n_stop_words / nullif(n_words, 0) < 0.01, false)
            OR coalesce(n_dup_lines / nullif(n_lines, 0) > 0.6, false)) AS kept
FROM a
"""
