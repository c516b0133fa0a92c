"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A rule says from a text's measures whether it rejects the document.  On a
sample of ``SAMPLE_ROWS`` rows each rule's cost (seconds over that of reading
the measures' text alone) and its share of rejections are estimated; rules then
run in the order of rejections per cost, as one nested conditional that names
the first rejection.  The order never changes a verdict.  All measures the rules
need are computed before, so the order saves comparisons only.

Words are runs of anything but ASCII white space.  Measures of a text:

* ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (any of ``#*$%&|<>``),
* ``n_lines`` (lines with a word), ``n_dup_lines`` (those equal to an earlier line),
* ``n_repeat_words``: words inside five-word windows that the text holds twice or more, the first included,
* ``n_upper``, ``n_letters``.

Five-word windows are compared by a 64-bit hash inside one text.  Defined
results: a null text counts as empty; empty texts are rejected (too few words);
null or repeated ``doc_id`` rows are judged one by one; an empty table gives no
rows; other columns are kept (``judged`` replaces columns named as its results).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Rows on which the rules' cost and selectivity are estimated (it steers the order only).
SAMPLE_ROWS = 400
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Callable[[str], Column]], Column]  # from measure name to column


#: Thresholds as whole-number comparisons, so that every engine agrees.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 10),
    Rule("repeated_passages", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > 4 * m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > 25 * m("n_words")),
    Rule("repeated_lines", lambda m: 10 * m("n_dup_lines") > 3 * m("n_lines")),
    Rule("capitals", lambda m: 10 * m("n_upper") > 7 * m("n_letters")),
)
#: Lines below which the share of repeated ones tells nothing: one heading twice in three lines is a third.
LEAST_LINES = 10
#: The rules of the corpus pipeline; passages repeated in fewer lines fall under ``repeated_passages``.
CORPUS_RULES = tuple(
    Rule(r.name, lambda m: (m("n_lines") >= LEAST_LINES) & (10 * m("n_dup_lines") > 3 * m("n_lines"))) if r.name == "repeated_lines" else r for r in RULES)
#: The measures each step adds; a step is a projection, so its value is computed once.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")


def _without(text: Column, characters: str) -> Column:
    return F.length(text).cast("bigint") - F.length(F.translate(text, characters, "")).cast("bigint")


def measured(df: DataFrame, text: str = "text", wanted: tuple[str, ...] = MEASURES) -> DataFrame:
    """``df`` with a struct ``measures`` of the wanted measures of ``text``."""
    t = F.coalesce(F.col("__row")[text], F.lit(""))
    out = df.select(F.struct("*").alias("__row"))
    words, n = F.col("__words"), F.size("__words")
    # An array, not the text again and again; hashes only where there are five words.
    out = out.withColumn("__words", F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    found: dict[str, Column] = {
        "n_words": n.cast("bigint"),
        "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
        "n_symbols": _without(t, SYMBOLS),
    }
    if {"n_lines", "n_dup_lines"} & set(wanted):
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
        out = out.withColumn("__lines", lines)
        found["n_lines"] = F.size("__lines").cast("bigint")
        found["n_dup_lines"] = (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint")
    if "n_repeat_words" in wanted:
        parts = F.arrays_zip(*[F.slice(words, k, n - 4) for k in range(1, 6)])
        hashes = F.when(n >= 5, F.transform(parts, lambda x: F.xxhash64(x)))
        out = out.withColumn("__hashes", hashes)
        # Positions are needed only where some window occurs twice.
        twice = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
        pairs = F.arrays_zip(F.col("__hashes").alias("h"), F.sequence(F.lit(1), F.size("__hashes")).alias("i"))
        out = out.withColumn("__sorted", F.when(twice, F.sort_array(pairs)))
        pairs = F.col("__sorted")
        again = F.filter(pairs, lambda x, k: (x["h"] == F.get(pairs, k - 1)["h"]) | F.coalesce(x["h"] == F.get(pairs, k + 1)["h"], F.lit(False)))
        out = out.withColumn("__starts", F.sort_array(F.transform(again, lambda x: x["i"])))
        starts = F.col("__starts")
        # A window covers five words, or those up to the next repeated window.
        covered = F.transform(starts, lambda s, k: F.least(F.lit(5), F.coalesce(F.get(starts, k + 1) - s, F.lit(5))))
        found["n_repeat_words"] = F.coalesce(F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))
    if {"n_upper", "n_letters"} & set(wanted):
        found["n_upper"] = F.regexp_count(t, F.lit(r"\p{Lu}")).cast("bigint")
        found["n_letters"] = F.regexp_count(t, F.lit(r"\p{L}")).cast("bigint")
    return out.select("__row.*", F.struct(*[found[m].alias(m) for m in wanted]).alias("measures"))


def _needs(rule: Rule) -> tuple[str, ...]:
    used: list[str] = []
    rule.fails(lambda m: used.append(m) or F.lit(1))
    return tuple(m for m in MEASURES if m in used)


def estimated_order(df: DataFrame, rules=RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by falling rejections per cost on a sample of ``rows`` rows."""
    spark = df.sparkSession
    sample = spark.createDataFrame(df.select(text).limit(rows).collect(), df.select(text).schema)  # ``rows`` rows at most

    def timed(frame: DataFrame, value: Column) -> tuple[float, int]:
        start = time.perf_counter()
        rejected = frame.agg(F.count_if(value), F.count(F.lit(1))).first()
        return time.perf_counter() - start, rejected[0]

    base = F.length(F.coalesce(F.col(text), F.lit(""))) < 0
    timed(sample, base)  # the first run pays for what all share
    floor, _ = timed(sample, base)
    worth = {}
    for rule in rules:
        seconds, rejected = timed(measured(sample, text, _needs(rule)), rule.fails(lambda m: F.col("measures")[m]))
        worth[rule.name] = (rejected + 0.5) / max(seconds - floor, 1e-4)
    return sorted(rules, key=lambda r: -worth[r.name])


def verdict(rules: list[Rule]) -> Column:
    """Name of the first rule, in this order, that rejects the document; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.fails(lambda m: F.col("measures")[m]), F.lit(rule.name)).otherwise(out)
    return out


def judged(df: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``df`` with ``measures``, ``rejected_by`` and ``kept``."""
    order = estimated_order(df, rules, text)
    needed = tuple(m for m in MEASURES if any(m in _needs(r) for r in rules))
    out = measured(df.drop("measures", "rejected_by", "kept"), text, needed).withColumn("rejected_by", verdict(order))
    # A generator's row: a filter on it stays above, or Spark would put the measures' formulas into the filter, again and again.
    columns = [*(F.col(f"`{c}`") for c in out.columns), F.col("rejected_by").isNull().alias("kept")]
    return out.select(F.inline(F.array(F.struct(*columns))))



ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             coalesce(c.n, 0) AS n_repeat_words,
             len(regexp_extract_all(t, '\\p{Lu}')) AS n_upper, len(regexp_extract_all(t, '\\p{L}')) AS n_letters
      FROM w LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 4 * n_words OR word_chars > 25 * n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_upper > 7 * n_letters) AS kept
FROM m
"""
