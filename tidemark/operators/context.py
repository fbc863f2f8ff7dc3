"""One text per entity from its related rows, and batch calls to an injected model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hotkeys import HOT_ROWS, Hot, hot_keys, with_parts
from .joins import spine_join
from .scan import running, total


# Up to this many rows per key Spark itself cuts each task's rows before the shuffle.
GROUP_LIMIT = 1000


def top_lines(
    df: DataFrame, keys: list[str], order: list[str], line: Column, n: int, alias: str, newest: bool = False, hot: Hot = HOT_ROWS
) -> DataFrame:
    """Array of the first n lines per key by `order` (`newest`: the last n, newest first).

    For small n each task passes on its own first n rows per key. For a larger n, hot keys are first
    cut within hashed parts.
    """
    lines = df.select(*keys, F.struct(*order).alias("__at"), line.alias("__line"))
    split = hot_keys(lines, keys, hot if n > GROUP_LIMIT else None)
    if split:
        parted = with_parts(lines, keys, F.pmod(F.xxhash64("__at"), F.lit(1024)), split, "__part")
        lines = _first_n(parted, [*keys, "__part"], n, newest).drop("__part")
    kept = _first_n(lines, keys, n, newest)
    listed = F.sort_array(F.collect_list(F.struct("__at", "__line")), asc=not newest)
    return kept.groupBy(*keys).agg(F.transform(listed, lambda x: x["__line"]).alias(alias))


def _first_n(df: DataFrame, parts: list[str], n: int, newest: bool) -> DataFrame:
    direction = F.col("__at").desc() if newest else F.col("__at").asc()
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*parts).orderBy(direction)))
    return ranked.where(F.col("__rn") <= n).drop("__rn")


def section(title: str, lines: Column, empty: str) -> Column:
    """A heading and its lines; `empty` when there are none."""
    body = F.when(F.size(F.coalesce(lines, F.array().cast("array<string>"))) > 0, F.array_join(lines, "\n"))
    return F.concat(F.lit(f"{title}\n"), F.coalesce(body, F.lit(empty)))


def assemble(parents: DataFrame, parts: list[DataFrame], on: list[str], sections: list[Column], alias: str = "context") -> DataFrame:
    """Left join the parts to the parents and join the sections by newlines; NULL sections are left out."""
    return spine_join(parents, parts, on).select(*on, F.concat_ws("\n", *sections).alias(alias))


def assemble_pages(
    parents: DataFrame, heads: list[Column], parts: list[tuple[str, str, DataFrame]], keys: list[str], alias: str = "context"
) -> DataFrame:
    """Whole texts of any length: keys, page, text.

    `parts` are (heading, text when empty, `threads` result with column "text"). Page 0 opens with
    the heads and has every heading; further pages hold what continues of each section. A parent
    whose sections have one page each has page 0 only.
    """
    listed = parents.select(*keys, F.lit(0).cast("long").alias("page"), F.lit(-1).alias("__part"), F.lit(None).cast("string").alias("text"))
    for i, (_, _, part) in enumerate(parts):
        listed = listed.unionByName(part.select(*keys, "page", F.lit(i).alias("__part"), "text"))
    # one row per key and page: a part has one text per page
    texts = [F.max(F.when(F.col("__part") == i, F.col("text"))).alias(f"__text_{i}") for i in range(len(parts))]
    pages = listed.groupBy(*keys, "page").agg(*texts).join(parents, keys)
    first = F.col("page") == 0
    sections = [F.when(first, head) for head in heads]
    for i, (heading, empty, _) in enumerate(parts):
        whole = F.concat(F.lit(f"{heading}\n"), F.coalesce(F.col(f"__text_{i}"), F.when(first, F.lit(empty))))
        sections.append(whole)
    return pages.select(*keys, "page", F.concat_ws("\n", *sections).alias(alias))


def fit_budget(
    notes: DataFrame,
    keys: list[str],
    order: list[str],
    text: str,
    head: DataFrame,
    used: str,
    max_chars: int = 12_000,
    overhead: int = 50,
    floor: int = 200,
    hot: Hot = HOT_ROWS,
) -> DataFrame:
    """Notes, oldest first, cut to what is left of a character budget per key.

    `head` gives per key the characters already `used`. A note is taken while more than `floor`
    characters remain, cut to the remainder less `overhead`, and uses its length plus `overhead`.
    A cut note leaves nothing, so the remainder before a note is the budget less the full lengths
    before it: one running sum. At most max_chars / overhead notes per key pass. Column: `excerpt`.
    """
    sized = notes.withColumn("__cost", F.length(text) + overhead)
    spent = running(sized, keys, order, {"__spent": total(F.col("__cost"), strict=True)}, hot=hot)
    left = F.lit(max_chars) - F.col(used) - 100 - F.col("__spent")
    return (
        spent.where(F.col("__spent") < max_chars)
        .join(head.select(*keys, used), keys)
        .withColumn("__left", left)
        .where(F.col("__left") > floor)
        .withColumn("excerpt", F.expr(f"substring({text}, 1, __left - {overhead})"))
        .drop("__cost", "__spent", "__left", used)
    )


def score_with_model(df: DataFrame, prompt: str, model: Callable[[str], str], keys: list[str]) -> DataFrame:
    """Call `model(prompt)` for every row: keys, `answer`, `error`. A failing row does not stop others."""
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", answer string, error string"

    def call(text: str) -> tuple[str | None, str | None]:
        try:
            return model(text), None
        except Exception as problem:
            return None, f"{type(problem).__name__}: {problem}"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = pd.DataFrame([call(t) for t in batch[prompt]], columns=["answer", "error"], index=batch.index)
            yield pd.concat([batch[keys], answers], axis=1)

    return df.select(*keys, prompt).mapInPandas(score, schema)
