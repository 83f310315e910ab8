"""What expressions need, and searches over the trigram index against a scan of all lines."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from depscope.functions import grams as G
from depscope.operators import codesearch as S

EXPRESSIONS = [r"fn\s+main", r"(foo|bar)[.]baz", r"x?abc", r"(?:ab){2,}c", "caf(é|e)s", r"^use std", r"end;$", r"[a-z]+", "a|bcd", r"\p{L}+x", r"f[o0]{2}", "(?i)MAIN", r"a{3}b", r"(?=foo)foo", r"[a-c]bc", r"\bstd\b.*::", "É", "ab", r"main\(\)", r"\.baz", r"foo(bar)?baz", "(abc|)def", r"[^a]bc", r"\Qa.b\E", r"[a&&[b]]x"]
WORDS = ["fn main()", "FN\tMAIN", "foo.baz", "BAR.BAZ", "abababc", "cafés", "cafes", "CAFÉS", "use std::io", "end;", "aaab", "f00", "abc", "xabc", "É", "foobaz", "foobarbaz", "def", "Kelvin", "σς", "a.b", ""]


@pytest.mark.parametrize("pattern", EXPRESSIONS)
def test_needs_hold_wherever_the_expression_does(pattern):
    rng = random.Random(1)
    needs = G.of_expression(pattern)
    if any(x in pattern for x in (r"\p", r"\Q", "&&", "(?=")):
        assert needs == []
        return
    for _ in range(400):
        text = rng.choice(["", " "]).join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))
        if re.search(pattern, text, re.IGNORECASE | re.ASCII):
            assert all(any(all(g in text.lower() for g in some) for some in member) for member in needs), text


def test_needs():
    assert G.of_expression("abcd") == [[frozenset({"abc", "bcd"})]]
    assert G.of_expression("(foo|bar).*baz") == [[frozenset({"foo"}), frozenset({"bar"})], [frozenset({"baz"})]]
    assert G.of_expression("a+bcd") == [[frozenset({"abc", "bcd"})]]
    assert G.of_expression("ab|cdef") == [] == G.of_expression("(")
    assert G.of_text("ABcd é") == [[frozenset({"abc", "bcd", "cd ", "d é"})]] and G.of_text("ab") == []


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.sampled_from(["a", "b", "c", ".", "[ab]", "^", "$"]), lambda x: st.one_of(st.tuples(x, x).map("".join), st.tuples(x, x).map("(?:%s|%s)".__mod__), st.tuples(x, st.sampled_from(["*", "+", "?", "{2}", "{1,2}"])).map(lambda t: f"(?:{t[0]}){t[1]}")), max_leaves=12), st.lists(st.text("abc", max_size=14), max_size=20))
def test_needs_of_any_expression(pattern, texts):
    needs = G.of_expression(pattern)
    for text in texts:
        if re.search(pattern, text):
            assert all(any(all(g in text for g in some) for some in member) for member in needs)


def files(spark):
    rng = random.Random(4)
    texts = ["\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 6))) for _ in range(120)]
    rows = [(i, f"p{i % 3}/f_{i}.rs", t) for i, t in enumerate(texts)] + [(3, "p0/twice.rs", "fn main() again"), (None, "p1/none.rs", "fn main()"), (500, "p1/null.rs", None), (501, "p2/empty.rs", ""), (502, "p2/long.rs", "x " * 60_000 + "\nfn main() {}")]
    return rows, spark.createDataFrame(rows, "id long, path string, body string").repartition(3)


def scan(rows, hit, like=lambda p: True):
    return sorted(((i, p, k + 1, line) for i, p, t in rows if t is not None and like(p) for k, line in enumerate(t.split("\n")) if hit(line)), key=str)


@pytest.mark.parametrize("shard_bytes", [8 << 20, 300])
def test_searches(spark, shard_bytes):
    rows, df = files(spark)
    index = S.build(df, "id", "path", "body", shard_bytes)
    assert index.files.count() == len(rows) - 1
    found = lambda *a, **k: sorted(map(tuple, S.matching_lines(index, *a, **k).collect()), key=str)
    for pattern in (r"fn\s+main", "(foo|bar)[.]baz", "cafés", r"^use std", "[a-z]+x", r"main\(\) \{", "nothing here"):
        assert found(pattern, expression=True) == scan(rows, lambda line, p=pattern: re.search(p, line, re.IGNORECASE | re.ASCII)), pattern
    for text in ("MAIN()", "É", "abab", "f", "(foo|bar)"):
        assert found(text) == scan(rows, lambda line, t=text: t.lower() in line.lower()), text
    assert found("main", path_glob="p?/f_1*") == scan(rows, lambda line: "main" in line.lower(), lambda p: re.fullmatch(r"p./f_1.*", p))
    lines = scan(rows, lambda line: "main" in line.lower())
    first = {(i, p): min(x[2] for x in lines if x[:2] == (i, p)) for i, p, *_ in lines}
    assert {(r["id"], r["path"]): r["line_no"] for r in S.first_matches(S.matching_lines(index, "main")).collect()} == first
    assert [(r["id"], r["line_no"]) for r in S.capped(S.matching_lines(index, "main"), 1, 10).collect()] == [(i, first[i, p]) for i, p in sorted(first, key=lambda x: (x[1], x[0] is not None, x[0] or 0))][:10]


def test_few_files_are_read(spark):
    df = spark.createDataFrame([(i, f"f{i}", f"word{i:05d} " * 20) for i in range(300)], "id long, path string, body string").repartition(2)
    index = S.build(df, "id", "path", "body", shard_bytes=2000)
    lines = S.matching_lines(index, "word00077", expression=True)
    assert lines.count() == 1
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\].*text:string", plan)
    assert len(index.files.inputFiles()) == 30 and len(scans) == 1 and re.search(r"\(shard#\d+L = \d+\)", scans[0])


def test_empty(spark):
    index = S.build(spark.createDataFrame([], "id long, path string, body string"), "id", "path", "body")
    assert S.matching_lines(index, "main").count() == 0 == S.matching_lines(index, "m+", expression=True).count()
