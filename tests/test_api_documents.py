"""API documents of two formats to rows; types to texts; chains of re-exports."""

import gzip
import json

import pytest
import zstandard

from depscope.functions import api_types as A
from depscope.operators.graph import chased
from depscope.sources import api_documents as D

U8, SELF = {"primitive": "u8"}, {"generic": "Self"}


def path(name, *args):
    return {"path": name, "id": 1, "args": {"angle_bracketed": {"args": list(args), "constraints": []}} if args else None}


@pytest.mark.parametrize(
    ("node", "text"),
    [
        ({"resolved_path": path("std::Vec", {"type": {"tuple": [U8, {"slice": U8}]}}, {"lifetime": "'a"}, {"const": {"expr": "3"}}, "infer")}, "std::Vec<(u8, [u8]), 'a, 3, _>"),
        ({"borrowed_ref": {"lifetime": None, "is_mutable": False, "type": {"array": {"type": U8, "len": "4"}}}}, "&[u8; 4]"),
        ({"raw_pointer": {"is_mutable": True, "type": U8}}, "*mut u8"),
        ({"impl_trait": [{"trait_bound": {"trait": path("Sized"), "modifier": "maybe", "generic_params": []}}, {"outlives": "'b"}, {"use": []}]}, "impl ?Sized + 'b + use<...>"),
        ({"dyn_trait": {"traits": [{"trait": path("A")}, {"trait": path("B")}], "lifetime": "'static"}}, "dyn A + B + 'static"),
        ({"function_pointer": {"sig": {"inputs": [["x", U8]], "output": U8}}}, "fn(x: u8) -> u8"),
        ({"qualified_path": {"name": "Item", "self_type": SELF, "trait": path("Iterator")}}, "<Self as Iterator>::Item"),
        ({"qualified_path": {"name": "Item", "self_type": SELF, "trait": None}}, "Self::Item"),
        ({"resolved_path": {"path": "Fn", "args": {"parenthesized": {"inputs": [U8], "output": U8}}}}, "Fn(u8) -> u8"),
        ({"resolved_path": {"path": "It", "args": {"angle_bracketed": {"args": [], "constraints": [{"name": "Item"}]}}}}, "It<Item = ...>"),
        ("infer", "_"),
        ({"kind": "borrowed_ref", "inner": {"lifetime": "'a", "mutable": True, "type": {"kind": "resolved_path", "inner": {"name": "Old", "args": None}}}}, "&'a mut Old"),
    ],
)
def test_types(node, text):
    assert A.type_text(node) == text


def test_conditions_and_parameters():
    assert A.condition_text({"bound_predicate": {"type": SELF, "bounds": [{"trait_bound": {"trait": path("Copy"), "modifier": "none"}}]}}) == "Self: Copy"
    assert A.condition_text({"eq_predicate": {"lhs": SELF, "rhs": {"type": U8}}}) == "Self = u8"
    assert A.parameter_text({"name": "N", "kind": {"const": {"type": U8, "default": "1"}}}) == "const N: u8 = 1"
    assert A.parameter_text({"name": "'a", "kind": {"lifetime": {"outlives": ["'b"]}}}) == "'a: 'b"
    assert A.parameter_text({"name": "impl X", "kind": {"type": {"bounds": [], "default": None, "is_synthetic": True}}}) is None
    assert A.type_name({"borrowed_ref": {"type": {"resolved_path": path("a::B")}}}) == "B" and A.type_name({"tuple": []}) == "(tuple)"


NONE = {"params": [], "where_predicates": []}


def item(name, kind, body, visibility="public", **more):
    return {"name": name, "visibility": visibility, "docs": None, "attrs": [], "span": {"begin": [3, 1], "end": [2, 1]}, "inner": {kind: body} if body is not None else kind, **more}


def use(target, name="x", glob=False, visibility="public"):
    return item(None, "use", {"source": "s", "name": name, "id": target, "is_glob": glob}, visibility)


def function(name, inputs=(), body=True, **header):
    return item(name, "function", {"sig": {"inputs": list(inputs), "output": None}, "generics": NONE, "header": header, "has_body": body})


def document():
    index = {
        "0": item("root", "module", {"items": [1, 2, 20, 21, 22]}),
        "1": item("deep", "module", {"items": [3, 4, 5, 23]}),
        "2": use(1, glob=True),
        "3": item("Shape", "enum", {"generics": NONE, "variants": [6, 7, 8, 99], "impls": [9]}),
        "4": item("Pair", "struct", {"kind": {"tuple": [10, None, 11]}, "generics": NONE, "impls": []}, "crate"),
        "5": item("Draw", "trait", {"is_auto": False, "is_unsafe": True, "is_dyn_compatible": True, "items": [12, 13, 14, 15], "generics": NONE, "bounds": [{"trait_bound": {"trait": path("Sized"), "modifier": "none"}}]}),
        "6": item("Dot", "variant", {"kind": "plain", "discriminant": {"expr": "7", "value": "7"}}),
        "7": item("Line", "variant", {"kind": {"tuple": [10]}, "discriminant": None}),
        "8": item("Box", "variant", {"kind": {"struct": {"fields": [16]}}, "discriminant": None}),
        "9": item(None, "impl", {"generics": NONE, "trait": path("m::Send"), "for": {"resolved_path": path("Shape")}, "items": [], "is_synthetic": True, "is_negative": True, "blanket_impl": None}),
        "10": item("0", "struct_field", U8), "11": item("1", "struct_field", "infer"), "16": item("side", "struct_field", U8, "default"),
        "12": function("draw", [["self", SELF]], body=False), "13": function("twice", [["self", SELF]]), "14": item("Out", "assoc_type", {"generics": NONE, "bounds": [{"outlives": "'a"}], "type": U8}), "15": item("N", "assoc_const", {"type": U8, "value": "1"}),
        "20": use(21, "A"), "21": use(22, "B"), "22": use(4, "C", visibility="default"), "23": use(3, "S"),
        "24": use(25, "X"), "25": use(24, "Y"), "26": use(25, "Z"), "27": item("  ", "struct", {"kind": "unit", "generics": NONE, "impls": []}), "28": item("LIMIT", "constant", {"type": U8, "const": {"expr": "1"}}), "29": item("G", "static", {"type": U8, "is_mutable": True}),
        "30": item("Alias", "type_alias", {"type": {"slice": U8}, "generics": NONE}), "31": item("old", "macro", "macro_rules! old"), "32": item(None, "impl", {"generics": NONE, "trait": None, "for": {"resolved_path": path("a::Pair")}, "items": [33, 14], "blanket_impl": None}),
        "33": function("new", [["n", U8]], is_const=True),
    }
    known = {"0": ["root"], "1": ["root", "deep"], "3": ["root", "deep", "Shape"], "4": ["root", "deep", "Pair"], "5": ["root", "deep", "Draw"], "20": ["root", "A"], "21": ["root", "B"], "22": ["root", "C"], "23": ["root", "S"], "24": ["root", "X"]}
    return {"root": 0, "format_version": 60, "index": index, "paths": {k: {"path": v, "kind": "x", "crate_id": 0} for k, v in known.items()}}


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([("d", json.dumps(document())), ("broken", '{"index": '), ("none", None), ("empty", "{}")], "doc string, text string")
    return D.items(df), D.paths(df)


def test_rows(read):
    rows, known = read
    symbols = {r["id"]: r for r in D.symbols(rows, known).collect()}
    assert {r["doc"] for r in symbols.values()} == {"d"} and not {"0", "2", "27", "9"} & set(symbols)
    # through the glob, through a chain, and past a re-export that isn't public
    assert (symbols["3"]["path"], symbols["4"]["path"], symbols["4"]["defined_at"], symbols["5"]["path"]) == ("root::S", "root::A", "root::deep::Pair", "root::Draw")
    assert (symbols["3"]["start_line"], symbols["3"]["end_line"], symbols["4"]["visibility"]) == (3, 3, "pub")
    assert [symbols[k]["signature"] for k in ("12", "28", "29", "30", "31")] == ["fn draw(self: Self)", "const LIMIT: u8", "static mut G: u8", "type Alias = [u8]", None]
    types = {r["type_name"]: r for r in D.types(rows, known).collect()}
    assert [tuple(f) for f in types["Pair"]["fields"]] == [("0", "u8", "public"), ("2", "_", "public")]
    assert [(v["name"], v["kind"], [f["name"] for f in v["fields"] or []], v["discriminant"]) for v in types["Shape"]["variants"]] == [("Dot", "plain", [], "7"), ("Line", "tuple", ["0"], None), ("Box", "struct", ["side"], None)]
    assert types["Shape"]["auto_traits"] == ["Send"] and types["Alias"]["fields"] == []
    impls = {r["id"]: r for r in D.implementations(rows).collect()}
    assert (impls["9"]["impl_kind"], impls["9"]["trait_display"], impls["9"]["is_negative"], impls["9"]["type_name"]) == ("synthetic", "m::Send", True, "Shape")
    assert (impls["32"]["impl_kind"], impls["32"]["type_name"], [(m["name"], m["is_const"], m["has_self"], m["signature"]) for m in impls["32"]["methods"]]) == ("inherent", "Pair", [("new", True, False, "fn new(n: u8)")])
    trait = D.traits(rows).collect()[0]
    assert (trait["trait_name"], trait["supertraits"], trait["is_unsafe"], [m["name"] for m in trait["required"]], [m["name"] for m in trait["provided"]], [tuple(t) for t in trait["types"]]) == ("Draw", ["Sized"], True, ["draw", "N"], ["twice"], [("Out", ["'a"], "u8")])


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    text = json.dumps(document())
    (tmp_path / "my-crate-1.0.0-alpha.1.json").write_text(text)
    (tmp_path / "sub/tokio_1.48.0_x86_64-linux_latest.json.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "sub/plain.json.zst").write_bytes(zstandard.compress(text.encode()))
    (tmp_path / "other.txt").write_text("x")
    found = {(r["package"], r["version"]): r["text"] for r in D.read_documents(spark, f"file://{tmp_path}").collect()}
    assert set(found) == {("my-crate", "1.0.0-alpha.1"), ("tokio", "1.48.0"), ("plain", None)} and set(found.values()) == {text}


def test_chased(spark):
    links = [(i, i + 1) for i in range(10)] + [(100, 101), (101, 100), (102, 101), (50, 51), (7000, 5)]
    found = {r["a"]: r["b"] for r in chased(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 10 for i in range(10)}, 50: 51, 7000: 10}
    assert chased(spark.createDataFrame([], "a long, b long")).count() == 0
