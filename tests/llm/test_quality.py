from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {p for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside),
        len(words) < 10 or 100 * len(inside) > 20 * len(words),
    )


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@pytest.mark.parametrize("few", [64, 0])
def test_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW", few)
    rng = random.Random(8)
    made = [" ".join(rng.choice(["a", "bb", "ccc", "dé", "|"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    made += [None, "", " \n\t", "x", "a b c d e", "a b c d e a b c d e", "u v\x85w \x1c z", "🙂 " * 30, "l\nl\n \nl \nl", "w " * 30_000]
    docs = spark.createDataFrame([*enumerate(made), (None, "q"), (3, made[3])], "doc_id long, text string")
    docs = docs.withColumn("_w", F.lit("clash")).withColumn("n_words", F.lit(-1))
    found = quality.apply(docs).select(COLUMNS).collect()
    expected = [(i, *brute(t)) for i, t in [*enumerate(made), (None, "q"), (3, made[3])]]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert quality.apply(docs.limit(0)).count() == 0


def test_rules(spark):
    plain = "the house of the rising sun and the sea in the morning light for all of us"
    texts = {1: plain, 2: plain.replace(" ", " | "), 3: "1234567 " * 3 + "a b c d e f g h i", 4: "\n".join(f"- {w} {plain}" for w in "ab"), 5: "short",
             6: " ".join(f"zz{i}qq" for i in range(150))}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    found = {r.doc_id: r for r in quality.apply(docs).collect()}
    assert found[1].kept and not found[1].failed
    assert found[2].failed == ["symbols"] and found[3].failed == ["digits"] and found[6].failed == ["stop_words"]
    assert "bullet_lines" in found[4].failed and found[5].base_failed
    assert not any(found[i].kept for i in (2, 3, 4, 5, 6))


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    result = con.execute(queries.ORACLE_SQL["op6_quality"])
    names = [d[0] for d in result.description]
    expected = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall())
    found = queries.QUERIES["op6_quality"](spark, "/root/testdata/sf0.001")
    assert sorted(found.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in sorted(names)) for r in found.collect()) == expected


def test_no_python_in_the_plan(spark):
    df = queries.QUERIES["op6_quality"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
