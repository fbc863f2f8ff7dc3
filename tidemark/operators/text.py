"""Batch text operators over whole documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as js
from ..functions.text import PERSONAL_DATA, cited, may_contain, strip
from .hotkeys import join_dimension


def redact(df: DataFrame, column: str, out: str = "redacted", found: str = "pii_types") -> DataFrame:
    """Add the text with personal data replaced, and the kinds found (one entry per replacement).

    The kinds apply one after the other, each on the result of the one before. A text is searched
    only where a cheap test says the kind may occur, and rewritten only where it does.
    """
    text, counts = column, []
    for i, (label, pattern) in enumerate(PERSONAL_DATA):
        count, done = f"__n{i}", f"__text{i}"
        hits = F.regexp_count(F.col(text), F.lit(pattern))
        df = df.withColumn(count, F.when(may_contain(label, F.col(text)), hits).otherwise(0))
        rewritten = F.regexp_replace(F.col(text), pattern, f"[{label}]")
        df = df.withColumn(done, F.when(F.col(count) > 0, rewritten).otherwise(F.col(text)))
        counts.append(F.array_repeat(F.lit(label), F.coalesce(F.col(count), F.lit(0))))
        text = done
    scratch = [f"__{kind}{i}" for kind in ("n", "text") for i in range(len(PERSONAL_DATA))]
    return df.withColumns({out: F.col(text), found: F.concat(*counts)}).drop(*scratch)


def chunk_text(
    df: DataFrame, column: str, max_len: int = 1000, min_paragraph: int = 50, separator: str = r"\n\n+"
) -> DataFrame:
    """One row per chunk: `chunk_index`, `chunk`.

    Paragraphs of at most `min_paragraph` trimmed characters are dropped, the others packed in order
    until the next would pass `max_len`. A longer paragraph stays whole. The fold runs inside one
    row and its state is the finished chunks plus the open one.
    """
    paragraphs = F.filter(F.split(F.col(column), separator), lambda p: F.length(strip(p)) > min_paragraph)

    def pack(state: Column, p: Column) -> Column:
        full = (F.length(state["open"]) + F.length(p) > max_len) & (state["open"] != "")
        done = F.when(full, F.concat(state["done"], F.array(strip(state["open"])))).otherwise(state["done"])
        started = F.when(full, F.lit("")).otherwise(state["open"])
        return F.struct(done.alias("done"), F.concat(started, p, F.lit("\n\n")).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    chunks = F.aggregate(
        paragraphs,
        start,
        pack,
        lambda s: F.when(strip(s["open"]) != "", F.concat(s["done"], F.array(strip(s["open"])))).otherwise(s["done"]),
    )
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(chunks).alias("chunk_index", "chunk"))


def check_citations(df: DataFrame, column: str, allowed: str, out: str = "unknown_citations") -> DataFrame:
    """Sorted distinct ids cited in `column` that are not in the array column `allowed`."""
    return df.withColumn(out, F.array_sort(F.array_except(F.array_distinct(cited(F.col(column))), F.col(allowed))))


def ensure_section(df: DataFrame, column: str, section_id: str, content: str, topic: str = r"lock\s*-?\s*out") -> DataFrame:
    """Prepend the mandatory section (columns `section_id`, `content`) unless the text mentions it.

    Mentioned means the topic pattern, any case, or the bracketed section id. Adds `section_added`.
    """
    text, sid = F.col(column), F.col(section_id)
    bracketed = F.concat(F.lit("["), sid, F.lit("]"))
    there = text.rlike(f"(?i){topic}") | F.lower(text).contains(F.lower(bracketed))
    opened = F.concat(F.lit("Safety first "), bracketed, F.lit(": "), F.col(content), F.lit("\n\n"), text)
    return df.withColumns({"section_added": ~there, column: F.when(there, text).otherwise(opened)})


def ensure_titled_section(df: DataFrame, sections: DataFrame, column: str, on: list[str], title: str, topic: str = r"lock\s*-?\s*out") -> DataFrame:
    """`ensure_section` with the section whose title begins with `title`, any case, among those of the row's `on` columns.

    `sections` has `on`, section_id, title and content; of several such sections the first by id counts. A row
    without one stays as it is, not marked as changed.
    """
    titled = sections.where(F.lower("title").startswith(title.lower()))
    chosen = titled.groupBy(*on).agg(F.min(F.struct("section_id", "content")).alias("__s")).select(*on, F.col("__s.section_id").alias("__id"), F.col("__s.content").alias("__content"))
    joined = ensure_section(df.join(chosen, on, "left").withColumn("__before", F.col(column)), column, "__id", "__content", topic)
    kept = {column: F.coalesce(column, "__before"), "section_added": F.coalesce("section_added", F.lit(False)) & F.col("__id").isNotNull()}
    return joined.withColumns(kept).drop("__id", "__content", "__before")


# The placeholder, the length limit, the problem texts and the standard message.
PLACEHOLDER = "{credit}"
SMS_MAX = 160
STATES_AMOUNT = "states a money amount itself"
PLACEHOLDER_COUNT = f"needs the {PLACEHOLDER} placeholder exactly once"
NO_CREDIT = "mentions a credit when none applies"
TOO_LONG = f"longer than {SMS_MAX} characters once the credit is filled in"
STANDARD_MESSAGE = "Sorry for %s in %s on %s. %s%s"
OUTAGE_WORDS, OTHER_WORDS = "a service outage", "network issues"
ONGOING_WORDS, RESOLVED_WORDS = "We're fixing it now.", "It's resolved."
CREDIT_WORDS = f" We've added a {PLACEHOLDER} credit to your account."


def render(message: Column, credit: Column) -> Column:
    """The message with its placeholder filled by a dollar amount."""
    return F.replace(message, F.lit(PLACEHOLDER), F.format_string("$%.2f", credit))


def validate_message(message: Column, with_credit: Column, max_credit: Column) -> Column:
    """Problems of a drafted message, empty when it may be used."""
    count = F.regexp_count(message, F.lit(r"\{credit\}"))
    checks = [
        (message.rlike(r"(?i)\$\s?\d|\d+\s?(dollars|usd)\b"), STATES_AMOUNT),
        (with_credit & (count != 1), PLACEHOLDER_COUNT),
        (~with_credit & (count > 0), NO_CREDIT),
        (F.length(render(message, max_credit)) > SMS_MAX, TOO_LONG),
    ]
    return F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]), lambda x: x.isNotNull())


def fallback_message(kind: Column, area: Column, started_at: Column, ongoing: Column, with_credit: Column) -> Column:
    """The fixed text used when a draft is rejected."""
    return F.format_string(
        STANDARD_MESSAGE,
        F.when(kind == "OUTAGE", OUTAGE_WORDS).otherwise(OTHER_WORDS),
        area,
        F.date_format(started_at, "MMM dd"),
        F.when(ongoing, ONGOING_WORDS).otherwise(RESOLVED_WORDS),
        F.when(with_credit, CREDIT_WORDS).otherwise(""),
    )


# The category of answers nobody could place, the priorities, and below the actions of a reply.
MANUAL_REVIEW = "Needs manual review"
PRIORITIES = ["HIGH", "MEDIUM", "LOW"]


def parse_triage(df: DataFrame, column: str, taxonomy: DataFrame) -> DataFrame:
    """Validate a routing answer against the taxonomy (category, department, priority).

    Text around the JSON is ignored. Malformed or off-list answers become manual-review rows with
    valid = false; a bad priority takes the category's own, a bad confidence becomes 0.
    """
    # a category listed twice counts once, with its smallest department and priority
    names = taxonomy.groupBy(F.col("category").alias("__named")).agg(
        F.lit(True).alias("__listed"), F.min(F.struct("department", "priority")).alias("__first")
    ).select("__named", "__listed", F.col("__first.department").alias("__department"), F.col("__first.priority").alias("__default"))
    read = js.with_document(df, js.braces(F.col(column)), "__doc").withColumn("__named", js.field(F.col("__doc"), "category"))
    joined = join_dimension(read, names, ["__named"], "left")
    valid = F.coalesce("__listed", F.lit(False))
    doc, asked = F.col("__doc"), js.field(F.col("__doc"), "priority")
    return joined.withColumns(
        {
            "category": F.when(valid, F.col("__named")).otherwise(MANUAL_REVIEW),
            "department": F.col("__department"),
            "priority": F.when(~valid, "MEDIUM").otherwise(F.when(asked.isin(PRIORITIES), asked).otherwise(F.col("__default"))),
            "location": F.when(valid, js.clipped(doc, "location", 200)).otherwise(""),
            "summary": js.clipped(doc, "summary", 300),
            "confidence": F.when(valid, js.number(doc, "confidence", 0, 1)).otherwise(0.0),
            "valid": valid,
        }
    ).drop("__doc", "__named", "__listed", "__department", "__default")


REPLY_ACTIONS = ["refund", "credit", "no_action", "escalate", "resolve"]


def parse_reply(df: DataFrame, column: str) -> DataFrame:
    """Read a support suggestion; off-list actions become no_action. `parsed_ok` is false on bad JSON and on JSON that is
    no object; `amount_ok` is false on an amount beyond the range of integers, which counts as 0."""
    out = js.with_document(df, js.unfenced(F.col(column)), "__doc", objects=True)
    doc, action = F.col("__doc"), js.field(F.col("__doc"), "suggested_action")
    amount = js.field(doc, "suggested_amount_cents").try_cast("double")
    texts = {n: F.coalesce(js.field(doc, n), F.lit("")) for n in ("case_summary", "suggested_response", "reasoning")}
    return out.withColumns(
        {
            "parsed_ok": doc.isNotNull(),
            "suggested_action": F.when(action.isin(REPLY_ACTIONS), action).otherwise("no_action"),
            "suggested_amount_cents": F.coalesce(amount.try_cast("int"), F.lit(0)),
            "amount_ok": amount.isNull() | amount.try_cast("int").isNotNull(),
            **texts,
        }
    ).drop("__doc")


def parse_analysis(df: DataFrame, column: str) -> DataFrame:
    """Read a content review: score kept in 0..100, issues as JSON text, suggestions."""
    out = js.with_document(df, js.braces(F.col(column)), "__doc")
    doc = F.col("__doc")
    return out.withColumns(
        {
            "parsed_ok": doc.isNotNull(),
            "compliance_score": F.when(doc.isNotNull(), js.number(doc, "compliance_score", 0, 100)),
            "issues": F.to_json(F.try_variant_get(doc, "$.issues", "array<string>")),
            "suggestions": js.field(doc, "suggestions"),
        }
    ).drop("__doc")


def normalize_turns(df: DataFrame) -> DataFrame:
    """Collapse replayed assistant messages to plain text.

    Columns: type, role, id, text (plain content) and parts (array of type, text). A typed assistant
    message with plain content, or with parts and no id, becomes role and text; its output_text
    parts are joined by newlines. Everything else passes unchanged.
    """
    assistant = F.coalesce((F.col("type") == "message") & (F.col("role") == "assistant"), F.lit(False))
    plain = assistant & F.col("text").isNotNull()
    listed = assistant & F.col("text").isNull() & F.col("parts").isNotNull() & F.col("id").isNull()
    outputs = F.filter(F.col("parts"), lambda p: p["type"] == "output_text")
    joined = F.array_join(F.transform(outputs, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    collapsed = plain | listed
    blank = {c: F.when(~collapsed, F.col(c)) for c in ("type", "id", "parts")}
    return df.withColumns({"text": F.when(listed, joined).otherwise(F.col("text")), **blank})


def message_text(parts: Column) -> Column:
    """Text parts of a message joined without a separator."""
    texts = F.filter(parts, lambda p: p["type"] == "text")
    return F.array_join(F.transform(texts, lambda p: F.coalesce(p["text"], F.lit(""))), "")


def first_problem(checks: list[tuple[Column, Column]]) -> Column:
    """The message of the first check that holds, NULL when none does."""
    return reduce(lambda w, c: w.when(c[0], c[1]), checks[1:], F.when(checks[0][0], checks[0][1]))
