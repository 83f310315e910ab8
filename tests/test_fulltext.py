"""Stems, the query syntax, and matches against a search text by text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from depscope.functions.english import stem
from depscope.operators import fulltext as T
from depscope.operators import search

STEMS = (
    "consigned consign consistency consist consistently consist consolatory consolatori consolidated consolid consolingly consol knackeries knackeri knaves knave kneaded knead knightly knight generously generous generate generat "
    "general general licensing licens licenses licens rights right reserved reserv running run hopping hop hoping hope flies fli dies die cries cri by by say say agreed agre feed feed luxuriated luxuri relational relat conditional "
    "condit skies sky dying die nationality nation sensational sensat hopefulness hope electrical electr decisiveness decis rate rate cease ceas gas gas gaps gap kiwis kiwi this this bed bed falling fall fizzed fizz filing file sized "
    "size communism communism communication communic arsenal arsenal geology geolog adjustment adjust replacement replac adoption adopt probate probat youth youth enjoyment enjoy succeeding succeed proceeds proceed"
).split()


def test_stems():
    assert [stem(w) for w in STEMS[::2]] == STEMS[1::2]


def lit(*stems, no=False):
    return T.Literal(tuple((s if isinstance(s, tuple) else (k, s)) for k, s in enumerate(stems)), no)


@pytest.mark.parametrize(
    ("text", "clauses"),
    [
        ("running tests", [[lit("run"), lit("test")]]),
        ('"fast the parsers" -slow', [[lit((0, "fast"), (2, "parser")), lit("slow", no=True)]]),
        ("a b or c", [[lit("b")], [lit("c")]]),
        ("or x or", [[lit("x")]]),
        ('x -"y z" OR w', [[lit("x"), lit("y", "z", no=True)], [lit("w")]]),
        ("full-text", [[lit("full", "text")]]),
        ('the "of the"', []),
        ("", []),
        ('a" parser', [[lit("parser")]]),
        ("--x -", [[lit("x", no=True)]]),
    ],
)
def test_parse(text, clauses):
    assert T.parse(text) == clauses


def brute(text, query, config):
    stems = [config.stem(w) for w in re.findall(r"[^\W_]+", (text or "").lower())]
    holds = lambda x: any(all(i + k < len(stems) and stems[i + k] == s for k, s in x.phrase) for i in range(len(stems))) != x.negated
    clauses = T.parse(query, config)
    if not any(all(holds(x) for x in c) for c in clauses):
        return None
    ranked = sorted({s for c in clauses for x in c if not x.negated for _, s in x.phrase})
    return round(sum(sum(1 / j**2 for j in range(1, stems.count(s) + 1)) for s in ranked) * 0.1 / 1.64493406685 / max(len(ranked), 1), 9)


WORDS = ["the", "parser", "parsers", "Parsing", "fast", "of", "slow", "größe", "x1", "tests", "日本"]
QUERIES = ['parser', 'fast parsers', '"fast parsing"', '"fast the parser"', "parse -slow", 'slow or "größe x1" -test', "-parser", '-"fast parser" -slow', "the", "unknown", "日本 or x1", '"parser of tests" fast', "-x1 or test"]


@pytest.mark.parametrize("config", [T.ENGLISH, T.SIMPLE])
def test_match(spark, config, monkeypatch):
    rng = random.Random(5)
    texts = [rng.choice([" ", "\n", ", "]).join(rng.choice(WORDS) for _ in range(rng.randint(0, 14))) for _ in range(80)] + [None, "", " -- ", "fast " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, body string").repartition(3)
    monkeypatch.setattr(T, "PIECE_BYTES", 200)
    index = T.build(df, "doc", "body", config)
    for q in QUERIES:
        want = {(i, r) for i, t in enumerate(texts) if (r := brute(t, q, config)) is not None}
        assert {(r["id"], round(r["rank"], 9)) for r in T.match(index, q).collect()} == want, q
    assert T.match(T.build(df.limit(0), "doc", "body", config), "fast or -slow").count() == 0


def test_stems_are_filtered_at_the_scan(spark):
    df = spark.createDataFrame([(i, f"word{i} common") for i in range(400)], "doc long, body string")
    some = T.match(T.build(df, "doc", "body", T.SIMPLE), "word7")
    assert [r["id"] for r in some.collect()] == [7]
    assert "EqualTo(stem,word7)" in some._jdf.queryExecution().executedPlan().toString()


def test_search_texts(spark):
    packages = spark.createDataFrame(
        [(1, "fast-parser", "parses", ["text"], ["tools"]), (2, "other", "Fast tests of a parser", [], ["text"]), (3, "third", None, ["parser"], []), (4, "none", "nothing here", None, None)],
        "package_id long, name string, description string, keywords array<string>, categories array<string>",
    )
    versions = spark.createDataFrame([(10, 1, "1.0.0", 5, None), (11, 1, "1.1.0", 9, "2020-01-01 00:00:00"), (12, 2, "0.1.0", 100, "2021-01-01 00:00:00")], "version_id long, package_id long, version string, downloads long, published_at string").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))
    edges = spark.createDataFrame([(12, 1), (12, 1), (10, 3)], "version_id long, target_id long")
    index = T.build(packages, "package_id", "description")
    names = lambda **k: [r["name"] for r in search.search_texts(packages, versions, edges, index, **k).collect()]
    assert names(query="parser") == ["fast-parser", "other", "third"]
    assert names(query="testing") == ["other"]
    assert names(query="text") == ["other", "fast-parser"]
    assert names(category="text") == ["other"] and names(keyword="text") == ["fast-parser"]
    assert names() == ["other", "fast-parser", "none", "third"] and names(limit=1, offset=1) == ["fast-parser"]
    assert names(order="recent")[:2] == ["other", "fast-parser"]
    first = search.search_texts(packages, versions, edges, index, "parser").first()
    assert (first["latest_version"], first["downloads"], first["depending_versions"]) == ("1.1.0", 9, 1)
