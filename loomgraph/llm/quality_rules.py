"""Quality rules: a table of thresholds compiled into projections.

Measures are plain column expressions over the whole text and rules are rows
of a table; both become one expression, whose parts are bound once, without
user functions and without a shuffle, so a document is judged where it is read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import BLANKS, table

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on are this from or an at which not have he you we they "
    "le la les de des du un une et en que qui dans pour par sur pas est au ce avec ne se il elle "
    "der die das und den von zu mit sich ist im dem nicht ein eine auf für als auch es "
    "el los las y lo por con para su al del como más una no mi"
).split()
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window that counts as repeated if it is found twice.
WINDOW_WORDS = 5


class Rule(NamedTuple):
    """A document passes if low <= value <= high; a null value passes. The value is a measure or `measure / measure`."""

    name: str
    value: str
    low: float
    high: float


#: The thresholds.
RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 12.0),
    Rule("symbol_ratio", "n_symbols / word_chars", 0.0, 0.1),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.02, 1.0),
    Rule("dup_line_ratio", "n_dup_lines / n_lines", 0.0, 0.5),
    Rule("upper_ratio", "n_upper / word_chars", 0.0, 0.5),
)


#: The measures, all long.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_upper")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it, also where a filter is pushed down."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows that are found twice or more; windows are compared by a 64-bit hash of their words."""
    n = F.size(words)
    windows = F.when(n >= WINDOW_WORDS, F.transform(F.sequence(F.lit(1), n - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW_WORDS)))).otherwise(F.array().cast("array<bigint>"))
    ordered = lambda x: F.sort_array(F.transform(x, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(F.transform(s, lambda e, j: F.when((e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]), e["i"])), lambda i: i.isNotNull())
    grown = lambda a, p: F.struct((a["n"] + p + WINDOW_WORDS - F.greatest(p, a["end"])).alias("n"), (p + WINDOW_WORDS).alias("end"))
    covered = lambda places: F.aggregate(F.sort_array(places), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), grown, lambda a: a["n"])
    # Most texts repeat no window, and only the others are sorted by window and place.
    return bound(windows, lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), bound(ordered(x), lambda s: covered(twice(s)))).otherwise(0))


def _measured(text: Column) -> Column:
    """A struct of the measures of a text that isn't null."""

    def of(r: Column) -> Column:
        t, packed, words, lines = r["t"], r["packed"], r["words"], r["lines"]
        values = {
            "n_words": F.size(words),
            "word_chars": F.length(packed),
            "n_symbols": F.length(packed) - F.length(F.translate(packed, SYMBOLS, "")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeat_words(words),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))),
            "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        }
        return F.struct(*(values[m].cast("long").alias(m) for m in MEASURES))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    return bound(F.struct(text.alias("t"), F.translate(text, BLANKS, "").alias("packed"), words.alias("words"), lines.alias("lines")), of)


def base_failed(m: Column) -> Column:
    """Too few words, or over a fifth of them in repeated windows."""
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def compiled(rules: Sequence[Rule], m: Column) -> list[Column]:
    """One boolean column `fails_<name>` per rule over a struct of measures; a value that is null or divides by 0 doesn't fail."""
    out = []
    for r in rules:
        top, _, below = r.value.partition(" / ")
        value = F.try_divide(m[top].cast("double"), m[below].cast("double")) if below else m[top]
        out.append(F.coalesce(~value.between(r.low, r.high), F.lit(False)).alias(f"fails_{r.name}"))
    return out


def judged(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds the measures, base_failed, fails_<rule> for each rule, and kept (no rule and not the base fails).

    A null text counts as empty; every measure of an empty text is 0. Input
    columns called like an output are replaced.
    """

    def of(m: Column) -> Column:
        fails = compiled(rules, m)
        kept = reduce(lambda a, b: a | b, fails, base_failed(m))
        return F.struct(*(m[c].alias(c) for c in MEASURES), base_failed(m).alias("base_failed"), *fails, (~kept).alias("kept"))

    names = [*MEASURES, "base_failed", *(f"fails_{r.name}" for r in rules), "kept"]
    verdict = bound(_measured(F.coalesce(F.col(text), F.lit(""))), of)
    return df.drop(*names).withColumn("verdict_", verdict).select("*", *(F.col(f"verdict_.{n}").alias(n) for n in names)).drop("verdict_")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for every document.

    A null or empty text has no words and fails the base. An empty table gives
    an empty result; repeated rows are judged alike.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rule_sql(r: Rule) -> str:
    top, _, below = r.value.partition(" / ")
    return f"coalesce({top} / nullif({below}, 0)::DOUBLE NOT BETWEEN {r.low} AND {r.high}, false)"


ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
m AS (
  SELECT r, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') AS p,
    list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t
),
g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM (
    SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' '))) AS win FROM m WHERE len(w) >= 5)
),
c AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM g WHERE n >= 2) GROUP BY r),
v AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(p)::BIGINT AS word_chars, len(regexp_extract_all(p, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda y: list_contains([{", ".join(f"'{w}'" for w in STOP_WORDS)}], lower(y)))) AS n_stop_words,
    len(regexp_extract_all(x, '\p{{Lu}}')) AS n_upper
  FROM m LEFT JOIN c USING (r)
),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {" OR ".join(_rule_sql(r) for r in RULES)}) AS kept
FROM b
"""
