"""Text operators against plain Python on whole texts, and hand-made model answers."""

from __future__ import annotations

import json
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from __spark_entry__ import SMALL
from tidemark.functions import json as js
from tidemark.functions.text import PERSONAL_DATA
from tidemark.functions.vector import cosine
from tidemark.operators import context, retrieval, text

SAMPLES = [
    "Call (415) 555-0123 or +1 415.555.0199 today",
    "Mail jane.doe+x@city.example.org, SSN 123-45-6789.",
    "At 1200 Main St on 2024-03-05",
    "Card 4111 1111 1111 1111 and 4111-1111-1111-1111",
    "Größe ñandú@example.com ７７７-１２-３４５６ é123-45-6789é",
    "", "12345678901234567890", "555-0123", "x415-555-0123y 4155550123",
]


def python_redact(value):
    found = []
    for label, pattern in PERSONAL_DATA:
        value, n = re.compile(pattern.replace("(?U)", "")).subn(f"[{label}]", value)
        found += [label] * n
    return value, found


def test_redact_equals_python_on_every_document(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("text")
    frame = documents.unionByName(spark.createDataFrame([(s,) for s in SAMPLES], "text string"))
    out = text.redact(frame, "text").collect()
    assert len(out) >= 200
    for r in out:
        assert (r.redacted, r.pii_types) == python_redact(r.text)
    assert sum(len(r.pii_types) for r in out) > 8


def test_redact_null(spark):
    assert text.redact(spark.createDataFrame([(None,)], "text string"), "text").first().redacted is None


def python_chunks(value, max_len, separator):
    chunks, cur = [], ""
    for p in [p for p in re.split(separator, value) if len(p.strip()) > 50]:
        if cur and len(cur) + len(p) > max_len:
            chunks.append(cur.strip())
            cur = ""
        cur += p + "\n\n"
    return chunks + ([cur.strip()] if cur.strip() else [])


@pytest.mark.parametrize("max_len", [120, 1000])
def test_chunks_equal_python_on_every_document(spark, max_len):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    out = {}
    for r in text.chunk_text(documents, "text", max_len, separator="\n+").orderBy("doc_id", "chunk_index").collect():
        assert r.chunk_index == len(out.setdefault(r.doc_id, []))
        out[r.doc_id].append(r.chunk)
    for r in documents.collect():
        assert out.get(r.doc_id, []) == python_chunks(r.text, max_len, "\n+")


def test_chunk_edges(spark):
    body = "\n\n".join(["a" * 50, " " + "b" * 51 + " ", "c" * 1500, "d" * 60])
    out = text.chunk_text(spark.createDataFrame([(1, body)], "id long, text string"), "text")
    assert [r.chunk for r in out.orderBy("chunk_index").collect()] == ["b" * 51, "c" * 1500, "d" * 60]


TAXONOMY = [("Pothole", "Streets", "LOW"), ("Tree", "Parks", "MEDIUM")]
ANSWERS = {
    'Here: {"category": "Pothole", "priority": "HIGH", "location": "Main", "summary": "hole", "confidence": 0.7} bye': ("Pothole", "Streets", "HIGH", "hole", 0.7, True),
    '{"category": "Tree", "priority": "NOW", "confidence": "lots"}': ("Tree", "Parks", "MEDIUM", "", 0.0, True),
    '{"category": "Tree", "confidence": 7}': ("Tree", "Parks", "MEDIUM", "", 1.0, True),
    '{"category": "Tree", "confidence": -2, "summary": "%s"}' % ("s" * 400): ("Tree", "Parks", "MEDIUM", "s" * 300, 0.0, True),
    '{"category": "Dragons", "summary": "big"}': ("Needs manual review", None, "MEDIUM", "big", 0.0, False),
    "not json": ("Needs manual review", None, "MEDIUM", "", 0.0, False),
    '{"category": "Tree"}}': ("Needs manual review", None, "MEDIUM", "", 0.0, False),
    '{"category": "Tree"}, {"category": "Tree"}': ("Needs manual review", None, "MEDIUM", "", 0.0, False),
}


def test_triage(spark):
    taxonomy = spark.createDataFrame(TAXONOMY, "category string, department string, priority string")
    frame = spark.createDataFrame([(a,) for a in ANSWERS] + [(None,)], "raw string")
    for r in text.parse_triage(frame, "raw", taxonomy).collect():
        expected = ANSWERS.get(r.raw, ANSWERS["not json"])
        assert (r.category, r.department, r.priority, r.summary, r.confidence, r.valid) == expected


def test_replies_and_analyses(spark):
    body = {"case_summary": "late", "suggested_response": "sorry", "suggested_action": "refund", "suggested_amount_cents": 250, "reasoning": "x"}
    raws = ["```json\n%s\n```" % json.dumps(body), json.dumps(body | {"suggested_action": "dance"}), "oops", "```" + json.dumps(body) + "```"]
    out = {r.raw: r for r in text.parse_reply(spark.createDataFrame([(x,) for x in raws], "raw string"), "raw").collect()}
    assert [out[x].suggested_action for x in raws] == ["refund", "no_action", "no_action", "refund"]
    assert [out[x].parsed_ok for x in raws] == [True, True, False, True]
    assert out[raws[0]].suggested_amount_cents == 250
    raws = ['ok {"compliance_score": 140, "issues": ["a", "b"], "suggestions": "s"}', "none"]
    out = {r.raw: r for r in text.parse_analysis(spark.createDataFrame([(x,) for x in raws], "raw string"), "raw").collect()}
    assert (out[raws[0]].compliance_score, out[raws[0]].issues) == (100.0, '["a","b"]')
    assert (out["none"].compliance_score, out["none"].parsed_ok) == (None, False)


def test_json_helpers(spark):
    frame = spark.createDataFrame([('x {"a": {"b": 1}, "n": 5} y',), ("{broken",), (None,)], "t string")
    read = js.with_document(frame, js.braces(F.col("t")), "doc")
    out = read.select(js.braces(F.col("t")).alias("b"), js.number(F.col("doc"), "n", 0, 3).alias("n")).collect()
    assert [r.b for r in out] == ['{"a": {"b": 1}, "n": 5}', None, None]
    assert [r.n for r in out] == [3.0, 0.0, 0.0]


def test_citations_and_lockout(spark):
    plans = spark.createDataFrame([("Do [CNC-1] then [ZZ-9.9], [AB-2] and [AB-2]", ["CNC-1"])], "plan string, allowed array<string>")
    assert text.check_citations(plans, "plan", "allowed").first().unknown_citations == ["AB-2", "ZZ-9.9"]
    cases = {"LOCK OUT first": False, "lockout": False, "see [cnc-1]": False, "just fix": True}
    frame = spark.createDataFrame([(p, "CNC-1", "Isolate.") for p in cases], "plan string, sid string, content string")
    for r in text.ensure_section(frame.withColumn("raw", F.col("plan")), "plan", "sid", "content").collect():
        assert r.section_added == cases[r.raw]
        assert r.plan == ("Safety first [CNC-1]: Isolate.\n\njust fix" if cases[r.raw] else r.raw)


def test_messages(spark):
    checks = [
        ("A {credit} credit is yours", True, 5.0, []),
        ("No credit here", True, 5.0, [text.PLACEHOLDER_COUNT]),
        ("{credit} and {credit}", True, 5.0, [text.PLACEHOLDER_COUNT]),
        ("A {credit} credit", False, 0.0, [text.NO_CREDIT]),
        ("You get $5", False, 0.0, [text.STATES_AMOUNT]),
        ("You get 5 Dollars", False, 0.0, [text.STATES_AMOUNT]),
        ("x" * 154 + "{credit}", True, 12.5, []),
        ("x" * 155 + "{credit}", True, 12.5, [text.TOO_LONG]),
    ]
    frame = spark.createDataFrame([(i, m, w, c) for i, (m, w, c, _) in enumerate(checks)], "i int, m string, w boolean, c double")
    out = frame.select("i", text.validate_message(F.col("m"), F.col("w"), F.col("c")).alias("p")).orderBy("i").collect()
    assert [r.p for r in out] == [p for *_, p in checks]


TURNS = "type string, role string, id string, text string, parts array<struct<type:string,text:string>>"


def test_normalize_turns(spark):
    parts = [("output_text", "a"), ("refusal", "no"), ("output_text", "b"), ("output_text", None)]
    data = [
        ("message", "assistant", None, "plain", None),
        ("message", "assistant", None, None, parts),
        ("message", "assistant", "id1", None, parts),
        ("message", "user", None, "hi", None),
        (None, "assistant", None, "easy", None),
        ("function_call", None, None, None, None),
    ]
    out = text.normalize_turns(spark.createDataFrame(data, TURNS)).select("type", "text", "id").collect()
    assert [(r.type, r.text) for r in out] == [
        (None, "plain"), (None, "a\nb\n"), ("message", None), ("message", "hi"), (None, "easy"), ("function_call", None),
    ]
    texts = spark.createDataFrame([([("text", "a"), ("file", "f"), ("text", "b")],)], "p array<struct<type:string,text:string>>")
    assert texts.select(text.message_text(F.col("p")).alias("t")).first().t == "ab"


def test_top_k(spark, monkeypatch):
    vectors = [(i, [float(i % 3), 1.0, float(i)]) for i in range(20)] + [(99, None)]
    docs = spark.createDataFrame(vectors, "id long, v array<float>").repartition(5)
    queries = [(7, [0.0, 1.0, 5.0]), (8, [1.0, 0.0, 0.0])]
    monkeypatch.setattr(retrieval, "QUERIES_PER_PASS", 1)
    out = retrieval.top_k_similar(docs, "id", "v", queries, 4)

    def score(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)

    for q, vector in queries:
        best = sorted(((round(score(v, vector), 9), -i) for i, v in vectors if v), reverse=True)[:4]
        found = out.where(F.col("query_id") == q).orderBy("rank").collect()
        assert [(round(r.score, 9), -r.id) for r in found] == best
    zero = spark.createDataFrame([(900, [0.0, 0.0, 0.0])], docs.schema)
    few = retrieval.top_k_similar(docs.where("id < 2").unionByName(zero), "id", "v", spark.createDataFrame(queries, "query_id long, v array<double>"), 5)
    for q, _ in queries:
        found = few.where(F.col("query_id") == q).orderBy("rank").collect()
        assert [r.id for r in found][-1] == 900 and found[-1].score is None and len(found) > 1
    single = docs.select("id", cosine(F.col("v"), F.array(*[F.lit(x) for x in queries[0][1]])).alias("s")).where("id = 3").first().s
    assert single == pytest.approx(score(vectors[3][1], queries[0][1]))


def test_scoring_isolates_errors(spark):
    def model(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return prompt.upper()

    frame = spark.createDataFrame([(1, "ok"), (2, "bad")], "id long, p string")
    assert rows(context.score_with_model(frame, "p", model, ["id"])) == [(1, "OK", None), (2, None, "RuntimeError: no")]


@pytest.mark.parametrize("hot", [1, None])
def test_budget_equals_a_loop(spark, hot):
    notes = [(k, i, "n" * ((k * 37 + i * 113) % 900 + 1)) for k in range(6) for i in range(12)]
    heads = [(k, 300 * k) for k in range(6)]
    frame = spark.createDataFrame(notes, "k long, at long, text string")
    out = context.fit_budget(frame, ["k"], ["at"], "text", spark.createDataFrame(heads, "k long, used long"), "used", 3000, hot=hot)
    expected = []
    for k, used in heads:
        budget = 3000 - used - 100
        for _, i, value in [n for n in notes if n[0] == k]:
            if budget <= 200:
                break
            excerpt = value[: budget - 50]
            expected.append((k, i, excerpt))
            budget -= len(excerpt) + 50
    assert rows(out, "k", "at", "excerpt") == sorted(expected, key=repr)


def test_top_lines_and_sections(spark):
    frame = spark.createDataFrame([(1, i, f"l{i}") for i in range(8)] + [(2, 0, "x")], "k long, at long, t string")
    assert rows(context.top_lines(frame, ["k"], ["at"], F.col("t"), 3, "lines", newest=True)) == [(1, ["l7", "l6", "l5"]), (2, ["x"])]
    whole = context.top_lines(frame, ["k"], ["at"], F.col("t"), 5000, "lines", hot=2)
    assert rows(whole) == [(1, [f"l{i}" for i in range(8)]), (2, ["x"])]
    parents = spark.createDataFrame([(1,), (3,)], "k long")
    out = context.assemble(parents, [whole], ["k"], [F.lit("head"), context.section("## Lines", F.col("lines"), "none")])
    assert rows(out)[1] == (3, "head\n## Lines\nnone")
