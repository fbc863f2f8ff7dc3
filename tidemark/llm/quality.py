"""Quality rules: a table of thresholds compiled into Spark projections, with built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for on with as by at be this are it or from "
    "le la les des et une que qui dans pour sur par "
    "der die das und den von zu mit ist ein eine auf nicht "
    "el los las del y con para se al lo"
).split()
#: Up to so many different repeated windows, a text's windows are looked up in their list; beyond, sorted.
FEW = 64


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= 100 * of / per <= high; an open side is None. Texts with less than `least` of `per`
    pass. Whole numbers keep the comparison exact."""

    name: str
    of: str
    per: str
    low: int | None = None
    high: int | None = None
    least: int = 1

    def passes(self) -> Column:
        share, base = 100 * F.col(self.of), F.col(self.per)
        out = F.lit(True)
        if self.low is not None:
            out = out & (share >= self.low * base)
        if self.high is not None:
            out = out & (share <= self.high * base)
        return out | (base < self.least)


#: The base: texts that fail one of these are rejected whatever the other rules say.
BASE_RULES = (Rule("repeated_words", "n_repeat_words", "n_words", high=20),)
MIN_WORDS = 10
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1_500),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("digits", "n_digits", "word_chars", high=50),
    Rule("stop_words", "n_stop_words", "n_words", low=1, least=100),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=50, least=2),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90, least=2),
    Rule("cut_lines", "n_cut_lines", "n_lines", high=50, least=2),
)


def _without(text: Column, characters: str) -> Column:
    """How many of the text's code points are among the characters."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeated(rows: DataFrame, window: int) -> DataFrame:
    """Adds `n_repeat_words`: words inside windows of `window` words that occur at least twice in the text.

    The windows of a text are hashed and sorted; only texts with a repeated window go on. Every step is a column of
    its own, so that nothing is evaluated again inside a lambda.
    """
    last = F.size("_w") - window
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(window))))
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("_h", F.when(last >= 0, hashes).otherwise(none))
    rows = rows.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array("_h")))
    rows = rows.withColumn("_d", F.array_distinct(F.filter("_s", lambda x, i: x == F.get("_s", i - 1))))
    pairs = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_p", F.when(F.size("_d") > FEW, pairs))
    few = F.filter(F.sequence(F.lit(0), last), lambda i: F.array_contains("_d", F.get("_h", i)))

    def neighbours(x: Column, j: Column) -> Column:
        before, after = F.get("_p", j - 1), F.get("_p", j + 1)
        return F.coalesce(x["h"] == before["h"], F.lit(False)) | F.coalesce(x["h"] == after["h"], F.lit(False))

    many = F.sort_array(F.transform(F.filter("_p", neighbours), lambda x: x["i"]))
    starts = F.when(F.col("_d").isNull(), F.array().cast("array<int>")).when(F.col("_p").isNull(), few).otherwise(many)
    rows = rows.withColumn("_starts", starts)
    reach = F.transform("_starts", lambda x, k: F.least(F.lit(window), F.coalesce(F.get("_starts", k + 1) - x, F.lit(window))))
    total = F.aggregate(reach, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", total).drop("_h", "_s", "_d", "_p", "_starts")


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 5) -> DataFrame:
    """(key, counts): every count that a rule can name. NULL counts as an empty text."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = rows.withColumn("_w", F.array_remove(F.split("_t", SPACE), ""))
    rows = rows.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0))
    rows = _repeated(rows, window)
    counts = {
        "n_words": F.size("_w"),
        "word_chars": F.length(F.translate("_t", " \t\n\x0b\f\r", "")),
        "n_symbols": _without(F.col("_t"), SYMBOLS),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.col("n_repeat_words"),
        "n_digits": _without(F.col("_t"), "0123456789"),
        "n_stop_words": F.size(F.filter("_w", lambda x: F.lower(x).isin(STOP_WORDS))),
        "n_lines": F.size("_l"),
        "n_bullet_lines": F.size(F.filter("_l", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))),
        "n_cut_lines": F.size(F.filter("_l", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))),
    }
    return rows.select(F.col("_key").alias(key), *(c.cast("long").alias(n) for n, c in counts.items()))


def apply(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS
) -> DataFrame:
    """`measures`, `base_failed`, `failed` (names of the rules that a text fails) and `kept`, one row per input row.

    Texts below `min_words` words or failing a base rule are rejected; the others are kept if they pass all rules.
    NULL and empty texts are rejected.
    """
    found = measures(docs, key, text)
    base = F.col("n_words") < min_words
    for rule in BASE_RULES:
        base = base | ~rule.passes()
    failed = F.array_compact(F.array(*(F.when(~r.passes(), F.lit(r.name)) for r in rules)))
    return found.select("*", base.alias("base_failed"), failed.alias("failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0)
    )


def oracle_sql() -> str:
    """The same verdicts for `documents` in DuckDB, rules included."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)

    def passes(r: Rule) -> str:
        sides = [f"100 * {r.of} >= {r.low} * {r.per}"] if r.low is not None else []
        sides += [f"100 * {r.of} <= {r.high} * {r.per}"] if r.high is not None else []
        return f"(({' AND '.join(sides)}) OR {r.per} < {r.least})"

    verdict = " AND ".join(map(passes, RULES))
    base = " OR ".join([f"n_words < {MIN_WORDS}", *(f"NOT {passes(r)}" for r in BASE_RULES)])
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM t),
s AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 4)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM s) WHERE n > 1),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM d) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words,
             coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(c.n, 0) AS n_repeat_words,
             length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits,
             len([x FOR x IN w IF lower(x) IN ({stop})]) AS n_stop_words,
             len(l) AS n_lines,
             len([x FOR x IN l IF regexp_matches(x, '^[\x20\x09]*[-*•]')]) AS n_bullet_lines,
             len([x FOR x IN l IF regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$')]) AS n_cut_lines
      FROM w LEFT JOIN c USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, ({base}) AS base_failed, NOT ({base}) AND {verdict} AS kept FROM m"""
