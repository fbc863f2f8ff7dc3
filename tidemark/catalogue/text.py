"""Text, retrieval and model-related operators over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as js
from ..functions.vector import cosine
from ..operators import context, retrieval, text
from .registry import Entry, Tables

WITH_DOC = "doc_id:b"


def _stub_model(prompt: str) -> str:
    """Stands in for an external model: echoes how long the text was."""
    if not prompt:
        raise ValueError("empty prompt")
    return f'{{"length": {len(prompt)}}}'


def drafts(t: Tables):
    """Work-order plans: event texts that cite manual sections, and the manual's own list."""
    cites = F.concat(F.lit("Check ["), F.upper(F.substring("event_type", 1, 3)), F.lit("-"), F.regexp_extract("props", "[0-9]+", 0), F.lit("] then [CNC-3.1]"))
    return t.events.select("event_id", cites.alias("plan"), F.array(F.lit("CNC-3.1"), F.lit("ERR-10")).alias("allowed"))


def answers(t: Tables):
    """Routing answers as a model would write them, from events."""
    body = F.concat(
        F.lit('Sure, here it is: {"category": "'), F.col("event_type"), F.lit('", "priority": "'),
        F.when(F.col("value") > 50, "HIGH").otherwise("SOON"), F.lit('", "confidence": '), F.format_string("%.4f", F.col("value") / 100),
        F.lit(', "summary": "seen"}'), F.when(F.col("value") < 5, "}").otherwise(" Done."),
    )
    return t.events.select("event_id", body.alias("raw"))


def taxonomy(t: Tables):
    kinds = t.events.select(F.col("event_type").alias("category")).distinct().where("category <> 'signup'")
    return kinds.withColumns({"department": F.concat(F.lit("dept of "), F.col("category")), "priority": F.lit("LOW")})


def turns(t: Tables):
    """Conversation turns as replayed messages: text split into parts; first turns carry an id."""
    parts = F.transform(
        F.split("text", "\n"), lambda x: F.struct(F.when(F.length(x) > 40, "output_text").otherwise("refusal").alias("type"), x.alias("text"))
    )
    return t.conversations.select(
        "conv_id", "turn", F.lit("message").alias("type"), "role", F.when(F.col("turn") <= 1, "m").alias("id"),
        F.when(F.col("role") == "user", F.col("text")).alias("text"), F.when(F.col("role") != "user", parts).alias("parts"),
    )


def nearest(t: Tables):
    centres = retrieval.group_centroids(t.embeddings, "label", "embedding")
    return retrieval.top_k_similar(t.embeddings, "vec_id", "embedding", centres, 5)


SQL_NEAREST = """WITH p AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM {embeddings}),
    c AS (SELECT label AS query_id, list(x ORDER BY i) AS q FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM p GROUP BY ALL) GROUP BY 1)
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM {embeddings}, c)
    QUALIFY rank <= 5"""

SQL_CHUNKS = r"""WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, x FROM (
      SELECT doc_id, unnest(string_split_regex(text, '\n+')) AS x, generate_subscripts(string_split_regex(text, '\n+'), 1) AS i FROM {documents})
      WHERE length(regexp_replace(x, '^\s+|\s+$', '', 'g')) > 50),
    f AS (SELECT doc_id, n, length(x) + 2 AS open, 0 AS chunk_index FROM p WHERE n = 1 UNION ALL
      SELECT p.doc_id, p.n, CASE WHEN f.open + length(p.x) > 1000 THEN 0 ELSE f.open END + length(p.x) + 2,
             f.chunk_index + CASE WHEN f.open + length(p.x) > 1000 THEN 1 ELSE 0 END FROM f JOIN p ON p.doc_id = f.doc_id AND p.n = f.n + 1)
    SELECT doc_id, chunk_index, md5(regexp_replace(string_agg(x, chr(10) || chr(10) ORDER BY n), '^\s+|\s+$', '', 'g')) AS digest
    FROM f JOIN p USING (doc_id, n) GROUP BY ALL"""

_WORD, _NOT_WORD, _SPACE = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]", r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]", r"[\s\x0b\x{85}\p{Z}.-]"


def _redact_sql() -> str:
    """The four kinds one after the other, without look-around: the neighbours of a hit are captured and put back.

    A second pass finds hits whose neighbour the hit before them has used up. A card number may end in a separator
    if a word character follows; more repetitions, and the separator, are preferred as the pattern's greed does.
    """
    inner = r"\p{Nd}[ -]?"
    ends = "|".join(rf"(?:{inner}){{{n - 1}}}\p{{Nd}}[ -]({_WORD})|(?:{inner}){{{n - 1}}}\p{{Nd}}({_NOT_WORD}|$)" for n in (16, 15, 14, 13))
    back = "".join(rf"\{g}" for g in range(2, 10))
    kinds = [
        ("EMAIL", rf"[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}.+-]+@[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}-]+\.[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}.-]+", "[EMAIL]"),
        ("SSN", rf"(^|{_NOT_WORD})\p{{Nd}}{{3}}-\p{{Nd}}{{2}}-\p{{Nd}}{{4}}({_NOT_WORD}|$)", r"\1[SSN]\2"),
        ("PHONE", rf"(^|\P{{Nd}})(?:\+?1{_SPACE}?)?\(?\p{{Nd}}{{3}}\)?{_SPACE}?\p{{Nd}}{{3}}{_SPACE}?\p{{Nd}}{{4}}(\P{{Nd}}|$)", r"\1[PHONE]\2"),
        ("CARD", rf"(^|{_NOT_WORD})(?:{ends})", rf"\1[CARD]{back}"),
    ]
    before = "SELECT doc_id, text, '' AS pii FROM {documents}"
    for label, pattern, put in kinds:
        once = f"regexp_replace(text, '{pattern}', '{put}', 'g')"
        twice = f"regexp_replace({once}, '{pattern}', '{put}', 'g')" if label != "EMAIL" else once
        count = f"((length(replace(done, '[{label}]', '[{label}].')) - length(done)) - (length(replace(text, '[{label}]', '[{label}].')) - length(text)))"
        before = f"SELECT doc_id, done AS text, concat(pii, repeat(',{label}', CAST({count} AS INTEGER))) AS pii FROM (SELECT *, {twice} AS done FROM ({before}))"
    return f"SELECT doc_id, text AS redacted, substr(pii, 2) AS pii FROM ({before})"


# Answers of a model: no JSON, JSON that is no object, amounts beyond integers, off-list actions, text around the JSON.
RAW_REPLY = """CASE WHEN value < 5 THEN 'sorry' WHEN event_type = 'signup' THEN '[1, 2]' ELSE concat('{"case_summary": "seen", "suggested_action": "',
    CASE WHEN event_type = 'purchase' THEN 'refund' ELSE event_type END, '", "suggested_amount_cents": ',
    CAST(CASE WHEN value > 90 THEN 99999999999 ELSE CAST(floor(value) AS BIGINT) END AS STRING), '}') END"""
RAW_ANALYSIS = """CASE WHEN value < 5 THEN 'none' ELSE concat('Review: {"compliance_score": ', CAST(CAST(floor(value) AS BIGINT) * 2 AS STRING),
    ', "issues": ["tone", "length"], "suggestions": "', event_type, '"} done') END"""

ENTRIES = [
    Entry(
        "redact",
        "doc_id:b redacted:s pii:s",
        lambda t: text.redact(t.documents.select("doc_id", "text"), "text").withColumn("pii", F.array_join("pii_types", ",")),
        _redact_sql(),
    ),
    Entry(
        "chunks",
        "doc_id:b chunk_index:b digest:s",
        lambda t: text.chunk_text(t.documents.select("doc_id", "text"), "text", separator=r"\n+").withColumn("digest", F.md5("chunk")),
        SQL_CHUNKS,
    ),
    Entry("top_k_similar", "query_id:b vec_id:b score:d6 rank:b", nearest, SQL_NEAREST),
    Entry(
        "nearest_single",
        "vec_id:b score:d6",
        lambda t: t.embeddings.where("embedding IS NOT NULL")
        .withColumn("score", cosine(F.col("embedding"), _first_centre(t)))
        .orderBy(F.col("score").desc(), "vec_id")
        .limit(5),
        f"SELECT vec_id, score FROM ({SQL_NEAREST}) WHERE query_id = 0",
    ),
    Entry(
        "retrieval_prefix",
        "query_id:b prefix:s",
        lambda t: retrieval.retrieval_prefix(
            nearest(t), t.embeddings.withColumn("content", F.format_string("vector %d of label %d", "vec_id", "label")), "vec_id", "content"
        ),
        f"""SELECT query_id, concat('Use the following context to inform your answer. If not relevant, say so.', chr(10), chr(10),
        string_agg(concat('[', rank, '] vector ', vec_id, ' of label ', label), chr(10) || chr(10) ORDER BY rank)) AS prefix
        FROM ({SQL_NEAREST}) JOIN {{embeddings}} USING (vec_id) GROUP BY 1""",
    ),
    Entry(
        "check_citations",
        "event_id:b unknown:s",
        lambda t: text.check_citations(drafts(t), "plan", "allowed").withColumn("unknown", F.array_join("unknown_citations", ",")),
        """SELECT event_id, CASE WHEN c = 'ERR-10' THEN '' ELSE c END AS unknown FROM (SELECT event_id, concat(upper(substr(event_type, 1, 3)), '-',
        regexp_extract(props, '[0-9]+', 0)) AS c FROM {events})""",
    ),
    Entry(
        "ensure_section",
        "event_id:b plan:s section_added:B",
        lambda t: text.ensure_section(
            t.events.select(
                "event_id", F.when(F.col("value") > 50, "Lock-out first.").when(F.col("value") > 30, "See [cnc-1]").otherwise("Replace part").alias("plan"),
                F.lit("CNC-1").alias("section_id"), F.lit("Isolate power.").alias("content"),
            ),
            "plan", "section_id", "content",
        ),
        """SELECT event_id, CASE WHEN value > 50 THEN 'Lock-out first.' WHEN value > 30 THEN 'See [cnc-1]' ELSE
        concat('Safety first [CNC-1]: Isolate power.', chr(10), chr(10), 'Replace part') END AS plan, NOT value > 30 AS section_added FROM {events}""",
    ),
    Entry(
        "validate_messages",
        "event_id:b problems:s",
        lambda t: t.events.select(
            "event_id",
            F.array_join(
                text.validate_message(
                    F.concat(F.lit("Sorry, "), F.when(F.col("value") > 50, "here is $5 and {credit} credit").otherwise("it is fixed")),
                    F.col("event_type") == "error",
                    F.col("value"),
                ),
                "; ",
            ).alias("problems"),
        ),
        """SELECT event_id, concat_ws('; ', CASE WHEN value > 50 THEN 'states a money amount itself' END,
        CASE WHEN event_type = 'error' AND value <= 50 THEN concat('needs the ', chr(123), 'credit', chr(125), ' placeholder exactly once') END,
        CASE WHEN event_type <> 'error' AND value > 50 THEN 'mentions a credit when none applies' END) AS problems FROM {events}""",
    ),
    Entry(
        "parse_triage",
        "event_id:b category:s department:s priority:s summary:s confidence:d4 valid:B",
        lambda t: text.parse_triage(answers(t), "raw", taxonomy(t)),
        """SELECT event_id, CASE WHEN ok THEN event_type ELSE 'Needs manual review' END AS category, CASE WHEN ok THEN concat('dept of ', event_type) END
        AS department, CASE WHEN NOT ok THEN 'MEDIUM' WHEN value > 50 THEN 'HIGH' ELSE 'LOW' END AS priority,
        CASE WHEN value < 5 THEN '' ELSE 'seen' END AS summary, CASE WHEN ok THEN least(1, value / 100) ELSE 0 END AS confidence, ok AS valid
        FROM (SELECT *, value >= 5 AND event_type <> 'signup' AS ok FROM {events})""",
    ),
    Entry(
        "parse_reply",
        "event_id:b parsed_ok:B suggested_action:s suggested_amount_cents:b amount_ok:B case_summary:s",
        lambda t: text.parse_reply(t.events.selectExpr("event_id", f"{RAW_REPLY} AS raw"), "raw"),
        f"""SELECT event_id, ok AS parsed_ok, CASE WHEN ok AND event_type = 'purchase' THEN 'refund' ELSE 'no_action' END AS suggested_action,
        CASE WHEN ok AND value <= 90 THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS suggested_amount_cents, NOT ok OR value <= 90 AS amount_ok,
        CASE WHEN ok THEN 'seen' ELSE '' END AS case_summary FROM (SELECT *, value >= 5 AND event_type <> 'signup' AS ok FROM {{events}})""",
    ),
    Entry(
        "parse_analysis",
        "event_id:b parsed_ok:B compliance_score:d4 issues:s suggestions:s",
        lambda t: text.parse_analysis(t.events.selectExpr("event_id", f"{RAW_ANALYSIS} AS raw"), "raw"),
        """SELECT event_id, value >= 5 AS parsed_ok, CASE WHEN value >= 5 THEN least(100, floor(value) * 2) END AS compliance_score,
        CASE WHEN value >= 5 THEN '["tone","length"]' END AS issues, CASE WHEN value >= 5 THEN event_type END AS suggestions FROM {events}""",
    ),
    Entry(
        "json_props",
        "event_id:b k:b clamped:d2",
        lambda t: js.with_document(t.events, js.braces(F.concat(F.lit("props: "), F.col("props"), F.lit(" end"))), "doc").select(
            "event_id", js.field(F.col("doc"), "k", "bigint").alias("k"), js.number(F.col("doc"), "k", 10, 60).alias("clamped")
        ),
        "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, greatest(10, least(60, CAST(json_extract(props, '$.k') AS DOUBLE))) AS clamped FROM {events}",
    ),
    Entry(
        "normalize_turns",
        "conv_id:b turn:b type:s id:s text:s n_parts:b",
        lambda t: text.normalize_turns(turns(t)).withColumn("n_parts", F.when(F.col("parts").isNotNull(), F.size("parts"))),
        r"""SELECT conv_id, turn, CASE WHEN flat THEN NULL ELSE 'message' END AS type, CASE WHEN turn <= 1 THEN 'm' END AS id,
        CASE WHEN role = 'user' THEN text WHEN flat THEN coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(x) > 40), chr(10)), '') END
        AS text, CASE WHEN role <> 'user' AND NOT flat THEN len(string_split(text, chr(10))) END AS n_parts
        FROM (SELECT *, role = 'assistant' AND turn > 1 AS flat FROM {conversations})""",
    ),
    Entry(
        "score_with_model",
        "doc_id:b answer:s error:s",
        lambda t: context.score_with_model(t.documents, "text", _stub_model, ["doc_id"]),
        """SELECT doc_id, CASE WHEN length(text) > 0 THEN concat('{"length": ', length(text), '}') END AS answer,
        CASE WHEN length(text) = 0 THEN 'ValueError: empty prompt' END AS error FROM {documents}""",
    ),
]


def _first_centre(t: Tables):
    first = retrieval.group_centroids(t.embeddings, "label", "embedding").where("query_id = 0").first()
    return F.array(*[F.lit(x) for x in first.vector])
