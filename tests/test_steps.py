"""Steps that many queries share: how texts are dealt to tasks, and what a worker gets at once."""

import pyarrow as pa

from depscope.operators import source_items as S
from depscope.operators import stored as T
from depscope.sources import api_documents as D
from depscope.sources.registry import Registry

SMALL = "/root/testdata/sf0.001"


def test_texts_are_made_by_all_tasks(spark):
    for made in (Registry(spark, SMALL).api_documents, Registry(spark, SMALL).rust_files):
        assert sum(made.rdd.glom().map(lambda rows: len(rows) > 0).collect()) > 1
        assert made.count() == made.select("doc").distinct().count()


def test_an_item_is_parsed_once(spark, monkeypatch):
    plans, plain = [], D.stored

    def stored(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(D, "stored", stored)
    text = """{"index": {"1": {"name": "a", "visibility": {"restricted": {"path": "::x"}}, "docs": null, "attrs": ["b", "c"], "span": {"begin": [7, 1], "end": [3, 1]}, "deprecation": {"since": "1"}, "inner": {"struct_field": {"primitive": "u8"}}},
    "2": {"name": null, "visibility": "crate", "kind": "struct_field", "inner": "infer"}, "3": {"name": "c", "inner": {}}, "4": {"name": "d", "inner": "text"}, "5": {"name": "e", "visibility": "default", "span": null, "inner": {"module": null}}}}"""
    rows = {r["id"]: r for r in D.items(spark.createDataFrame([(1, text)], "doc long, text string")).collect()}
    assert plans[0].count("from_json(") == 2 and plans[0].count("get_json_object(") <= 1
    assert sorted(rows) == ["1", "2", "5"] and rows["1"]["visibility"] == "pub(in ::x)" and (rows["1"]["start_line"], rows["1"]["end_line"], rows["1"]["attrs"]) == (7, 7, '["b","c"]')
    assert (rows["1"]["kind"], rows["1"]["own"]["shown"], rows["1"]["deprecated_since"], rows["2"]["visibility"], rows["2"]["own"]["shown"], rows["5"]["kind"], rows["5"]["start_line"]) == ("struct_field", "u8", "1", "pub", "_", "module", 1)


def test_a_worker_gets_few_bytes_at_once(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(64).coalesce(1).selectExpr("repeat('x', 1048576) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    found = [r["n"] for r in T.stored(rows.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(found) == 64 and max(found) <= 5 and spark.conf.get(key) == before


def test_items_of_sources_are_not_copied(spark, monkeypatch):
    import dataclasses

    from depscope.functions import rust_items as R

    def copied(*_):
        raise AssertionError("an item was copied")

    monkeypatch.setattr(dataclasses, "asdict", copied)
    assert not hasattr(S, "asdict") and not hasattr(R.Token("word", "a", 0, 1), "__dict__")
    files = spark.createDataFrame([("p", "src/lib.rs", "pub struct A; impl A { fn b() {} } use c::d;"), ("q", "src/x.rs", None), ("r", "src/x.rs", "")], "package string, path string, text string")
    assert [(r["package"], r["kind"], r["name"], len(r["methods"]), [u["path"] for u in r["uses"]]) for r in S.items(files, "package", "path", "text").collect()] == [("p", "struct", "A", 0, []), ("p", "impl", "A", 1, []), ("p", "use", "", 0, ["c::d"])]


def test_tokens_that_begin_as_texts_do():
    from depscope.functions.rust_items import tokens

    text = """br'x' r#type r"a b" br##"c"## b'\\n' c"d" rate 'life b"e" // no\n bar/*/*x*/*/cat 1.5 r#"""
    assert [(t.kind, t.text) for t in tokens(text)] == [("word", "br"), ("char", "'x'"), ("word", "r#type"), ("raw", 'r"a b"'), ("raw", 'br##"c"##'), ("char", "b'\\n'"), ("text", 'c"d"'), ("word", "rate"), ("life", "'life"), ("text", 'b"e"'), ("word", "bar"), ("word", "cat"), ("number", "1.5"), ("word", "r"), ("mark", "#")]


def test_the_index_is_sorted_by_its_pieces_only(spark, monkeypatch):
    from depscope.operators import fulltext

    plans, plain = [], fulltext.stored

    def stored(df, name, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name, **more)

    monkeypatch.setattr(fulltext, "stored", stored)
    docs = spark.createDataFrame([(1, "pear fig apple fig Éclair"), (2, None), (3, "the fig zoo")], "id long, text string").coalesce(1)
    index = fulltext.build(docs, "id", "text", fulltext.SIMPLE)
    assert not any(x in plans[0] for x in ("Sort", "Exchange hash", "Exchange range"))
    rows = index.table.collect()
    assert [r["stem"] for r in rows] == ["apple", "fig", "pear", "the", "zoo", "éclair"]
    assert (rows[1]["ids"], rows[1]["positions"]) == ([1, 3], [[2, 4], [2]])
    assert [r["id"] for r in fulltext.match(index, "fig -pear").collect()] == [3]
