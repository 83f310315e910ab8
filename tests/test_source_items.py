"""Items of source texts among comments, strings and brackets; re-exports through chains, globs and circles."""

import random

import pytest

from depscope.functions.rust_items import items, last_name, tokens, use_tree
from depscope.operators import source_items as S

#: (text, the (kind, name, lines after its first, methods) that it holds)
PIECES = [
    ("// fn no() { \"", []),
    ("/* a /* fn no() {} */ \" ' */", []),
    ("/* one\n two */", []),
    ('const A: &str = "fn no() { \\" }";', [("const", "A", 0, 0, [])]),
    ('static mut B: &str = r##"} fn no() "# {"##;', [("static", "B", 0, 0, [])]),
    ("fn c<'a>(x: &'a [u8; 3]) -> char { let y = '{'; '\\'' }", [("function", "c", 0, 0, [])]),
    ("#[derive(Debug)] // struct No;\npub struct D<T: Into<Vec<u8>>> {\n  x: T,\n}", [("struct", "D", 1, 3, [])]),
    ("pub struct E(u8, Vec<u8>);", [("struct", "E", 0, 0, [])]),
    ("enum F {\n A { x: u8 },\n B(u8),\n}", [("enum", "F", 0, 3, [])]),
    ("unsafe impl<T> m::Tr<T> for &'static G<T> where T: X {\n fn one(&self) { fn inner() {} }\n const fn two() -> u8 { 1 }\n}", [("impl", "G", 0, 3, ["one", "two"])]),
    ("pub(crate) trait H: Sized { fn need(&self); fn have(&self) { } type Out; }", [("trait", "H", 0, 0, ["need", "have"])]),
    ("mod i {\n pub fn j() {}\n mod k { union L { a: u8 } }\n}", [("module", "i", 0, 3, []), ("function", "j", 1, 1, []), ("module", "k", 2, 2, []), ("union", "L", 2, 2, [])]),
    ("macro_rules! n { ($x:expr) => { fn no() {} }; }", [("macro", "n", 0, 0, [])]),
    ("lazy! { static ref NO: u8 = 1; }", []),
    ("call!(fn no() {});", []),
    ('extern "C" {\n fn o(x: i32);\n}', [("function", "o", 1, 1, [])]),
    ("pub async unsafe fn p() {}", [("function", "p", 0, 0, [])]),
    ("type Q<T> = Box<dyn Fn(u8) -> T>;", [("type_alias", "Q", 0, 0, [])]),
    ("extern crate r;", []),
    ("const S: T = T { a: [1; { 2 }] };", [("const", "S", 0, 0, [])]),
    ("use a::{b, c::*};", [("use", "", 0, 0, [])]),
    ("#![allow(x)]", []),
]


def test_items():
    rng = random.Random(3)
    for _ in range(150):
        text, want, line = "", [], 1
        for piece, own in rng.choices(PIECES, k=rng.randint(1, 12)):
            gap = rng.choice(["\n", "\n\n", "\n  "])
            want += [(kind, name, line + a, line + b, methods) for kind, name, a, b, methods in own]
            text += piece + gap
            line += (piece + gap).count("\n")
        assert [(i.kind, i.name, i.start_line, i.end_line, [m["name"] for m in i.methods]) for i in items(text)] == want, text


def test_parts_of_items():
    i, j = items("#[derive(Clone, fmt::Debug)] pub(super) struct X<A: B> where A: C { }\nimpl<'a, A: Iterator<Item = u8>> fmt::Display for &'a m::X<A> { pub /* so */ fn run(&self)  -> bool { true } }")
    assert (i.visibility, i.signature, i.attributes) == ("pub(super)", "pub(super) struct X<A: B> where A: C", ["derive(Clone, fmt::Debug)"])
    assert (j.name, j.type_display, j.trait_display, j.methods[0]["signature"], j.methods[0]["line"]) == ("X", "&'a m::X<A>", "fmt::Display", "pub fn run(&self) -> bool", 2)
    assert [last_name(x) for x in ("Vec<a::B>", "&mut dyn x::Y<Z>", "!Send", "[u8]")] == ["Vec", "Y", "Send", ""]


@pytest.mark.parametrize("text", ["", "fn a() {", 'fn a() { "open', "/* open", "}}} ) fn", "impl", "pub", "#[", "use a::{b", "struct", "const", "'", "mod m {"])
def test_broken_texts_end(text):
    assert isinstance(items(text), list)


def test_use_trees():
    leaves = lambda t: [(x["path"], x["name"]) for x in use_tree([w.text for w in tokens(t)])]
    assert leaves("a::b") == [("a::b", "b")]
    assert leaves("a::{self, b as c, d::*, e::{f, g as _}}") == [("a", "a"), ("a::b", "c"), ("a::d", None), ("a::e::f", "f"), ("a::e::g", "_")]
    assert leaves("::a::{b, }") == [("a::b", "b")] and leaves("{x, y}") == [("x", "x"), ("y", "y")] and leaves("*") == [("*", None)]


def read(spark, *files):
    return S.items(spark.createDataFrame([(1, p, t) for p, t in files], "package long, path string, text string"), "package", "path", "text")


def test_modules_macros_and_derives(spark):
    found = read(spark, ("src/lib.rs", "pub fn a() {}"), ("x-1.0/src/b/mod.rs", "fn c() {}"), ("src/b/d.rs", "mod e { fn f() {} }"), ("src/none.rs", None), ("src/main.rs", ""))
    assert {(r["name"], r["module"]) for r in S.symbols(found).collect()} == {("a", "crate"), ("c", "crate::b"), ("e", "crate::b::d"), ("f", "crate::b::d::e")}
    found = read(spark, ("src/lib.rs", "#[proc_macro_derive(Ser, attributes(a, b))]\npub fn ser(i: T) -> T { i }\n#[proc_macro_derive(De)] fn de() {}\n#[proc_macro_attribute] fn at() {}\n#[proc_macro] fn call() {}\n#[derive(A, b::C)]\nstruct X;\n#[derive()] enum Y {}"))
    assert {(r["macro"], r["name"], tuple(r["accepted"]), r["usage"], r["line"]) for r in S.macro_exports(found).collect()} == {("derive", "Ser", ("a", "b"), "#[derive(Ser)]", 2), ("derive", "De", (), "#[derive(De)]", 3), ("attribute", "at", (), "#[at(...)]", 4), ("function", "call", (), "call!(...)", 5)}
    assert {(r["type_name"], r["trait_name"], r["trait_display"]) for r in S.implementations(found).collect()} == {("X", "A", "A"), ("X", "C", "b::C")}


def test_re_exports(spark):
    chain = "pub mod m0 { pub struct Deep; }\n" + "\n".join(f"pub mod m{i} {{ pub use crate::m{i - 1}::{'Deep as N1' if i == 1 else f'N{i - 1} as N{i}'}; }}" for i in range(1, 11))
    found = read(
        spark,
        ("src/lib.rs", chain + "\npub use m10::N10 as End;\npub use x::A as B; pub use self::B as A2;\npub use self::loop1 as loop2; pub use self::loop2 as loop1; pub use std::vec::Vec;\npub use g1::*;\npub fn own() {}\nuse m0::Deep as Hidden;\npub use m0::{self as zero, Deep as _};"),
        ("src/x.rs", "pub enum A {}\npub mod y { pub use super::A as C; pub use super::super::own as D; }"),
        ("src/g1.rs", "pub use super::g2::*; pub fn one() {} fn private() {} pub fn own() {}"),
        ("src/g2.rs", "pub use super::g1::*; pub struct Two; pub use crate::x::A as Three; macro_rules! no { () => {} }"),
    )
    links = {(r["alias"].removeprefix("crate::"), r["target"].removeprefix("crate::"), r["kind"]) for r in S.re_exports(found).collect()}
    want = {(f"m{i}::N{i}", "m0::Deep", "struct") for i in range(1, 11)} | {("End", "m0::Deep", "struct"), ("B", "x::A", "enum"), ("A2", "x::A", "enum"), ("zero", "m0", "module"), ("x::y::C", "x::A", "enum"), ("x::y::D", "own", "function")}
    want |= {("g2::Three", "x::A", "enum"), ("one", "g1::one", "function"), ("Two", "g2::Two", "struct"), ("Three", "x::A", "enum"), ("g1::Two", "g2::Two", "struct"), ("g1::Three", "x::A", "enum"), ("g2::one", "g1::one", "function"), ("g2::own", "g1::own", "function")}
    assert links == want


def test_empty(spark):
    found = S.items(spark.createDataFrame([], "package long, path string, text string"), "package", "path", "text")
    assert S.symbols(found).count() == S.implementations(found).count() == S.re_exports(found).count() == S.macro_exports(found).count() == 0


def test_display_patterns(spark):
    found = read(spark, ("src/lib.rs", 'impl fmt::Display for E { fn fmt(&self, f: &mut F) -> R { match self { E::A(x) => write!(f, "a {}: {x}", 1), E::B => f.write_str(r#"b "q""#), _ => writeln!(f, "c\\n\\\n   d") } } }\nimpl Debug for E { fn fmt(&self) { write!(f, "no") } }\n#[derive(Error)]\n#[error("whole {0}")]\nenum G { #[error("one \\"{0}\\"")] One(u8), #[error(transparent)] Two, #[source] Three }\nstruct H;'))
    assert {(r["type_name"], r["place"], r["pattern"]) for r in S.display_patterns(found).collect()} == {("E", 0, "a {}: {x}"), ("E", 1, 'b "q"'), ("E", 2, "c\nd"), ("G", 0, "whole {0}"), ("G", 1, 'one "{0}"')}


def test_imports_in_scope(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_LINES", 2)
    text = "use std::a;\npub mod m {\n  use super::x as y;\n  fn f() {}\n  mod n {\n    use crate::q::*;\n    fn g() {}\n  }\n  fn h() {}\n}\nfn i() {}\nmod one { fn j() {} }"
    found = read(spark, ("src/lib.rs", text), ("src/k.rs", "use b::c as _;\nuse b::{self, d};\nfn l() {}"))
    places = spark.createDataFrame([(1, "src/lib.rs", n) for n in (4, 7, 9, 11, 12, 400)] + [(1, "src/k.rs", 3), (1, "src/none.rs", 1)], "package long, path string, line int")
    assert {(r["path"], r["line"], r["module"], r["name"], r["target"]) for r in S.in_scope(found, places).collect()} == {
        ("src/lib.rs", 4, "crate::m", "y", "crate::x"), ("src/lib.rs", 9, "crate::m", "y", "crate::x"), ("src/lib.rs", 7, "crate::m::n", None, "crate::q"),
        ("src/lib.rs", 11, "crate", "a", "crate::std::a"), ("src/lib.rs", 400, "crate", "a", "crate::std::a"), ("src/k.rs", 3, "crate::k", "b", "crate::k::b"), ("src/k.rs", 3, "crate::k", "d", "crate::k::b::d"),
    }
