"""Reading a model's JSON out of free text, column by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def braces(text: Column) -> Column:
    """From the first opening to the last closing brace; NULL when there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def unfenced(text: Column) -> Column:
    """Without a surrounding code fence and its language tag."""
    clean = F.regexp_replace(text, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(clean, r"(?s)^```[^\n]*\n", ""), r"^```", "")
    inner = F.regexp_replace(F.regexp_replace(inner, r"```$", ""), r"^\s+|\s+$", "")
    return F.when(clean.startswith("```"), inner).otherwise(clean)


def with_document(df: DataFrame, text: Column, name: str, objects: bool = False) -> DataFrame:
    """Add the JSON text as a variant column, NULL when it is not valid or, with `objects`, no object.

    Parsing stops after the first value and would let trailing characters pass. Inside an array they
    are an error, or a second element. The steps are columns of their own, so each runs once.
    """
    raw = df.withColumn("__raw", text)
    listed = raw.withColumn("__listed", F.try_parse_json(F.concat(F.lit("["), F.col("__raw"), F.lit("]"))))
    alone = F.try_variant_get("__listed", "$[1]", "variant").isNull()
    first = F.try_variant_get("__listed", "$[0]", "variant")
    wanted = alone & F.ltrim("__raw").startswith("{") if objects else alone
    return listed.withColumn(name, F.when(wanted, first)).drop("__raw", "__listed")


def field(document: Column, name: str, kind: str = "string") -> Column:
    """A top-level field; NULL when missing or not convertible."""
    return F.try_variant_get(document, f"$.{name}", kind)


def number(document: Column, name: str, lowest: float, highest: float) -> Column:
    """A numeric field kept inside bounds; 0 when missing or not a number."""
    raw = F.coalesce(field(document, name).try_cast("double"), F.lit(0.0))
    return F.least(F.greatest(raw, F.lit(float(lowest))), F.lit(float(highest)))


def clipped(document: Column, name: str, length: int) -> Column:
    """A text field cut to a length; empty when missing."""
    return F.substring(F.coalesce(field(document, name), F.lit("")), 1, length)
