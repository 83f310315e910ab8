import pytest
from pyspark.sql import functions as F

from depscope import session
from depscope.functions import advisory, semver
from depscope.functions import text as X
from depscope.operators import api, graph, resolve


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


ORDER = ["0.9.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2.0", "1.10.0", "10.0.0"]


def test_versions_sort(spark):
    rows = spark.createDataFrame([(v,) for v in reversed(ORDER)], "v string").orderBy(semver.key(F.col("v"))).collect()
    assert [r["v"] for r in rows] == ORDER == sorted(ORDER, key=lambda v: semver.parse(v).order())
    assert one(spark, semver.key(F.lit("1.2"))) is None and one(spark, semver.key(F.lit("v1.2.3+x"))) is not None


@pytest.mark.parametrize(
    ("requirement", "version", "want"),
    [
        ("^1.2.3", "1.9.0", True), ("^1.2.3", "2.0.0", False), ("1.2.3", "1.2.2", False), ("^0.2.3", "0.2.9", True), ("^0.2.3", "0.3.0", False), ("^0.0.3", "0.0.4", False), ("^0", "0.9.1", True),
        ("~1.2", "1.2.9", True), ("~1.2", "1.3.0", False), ("~1", "1.9.0", True), ("*", "3.1.4", True), ("1.*", "1.7.0", True), ("1.2.*", "1.3.0", False), (">=1.2, <1.5", "1.4.9", True), (">=1.2, <1.5", "1.5.0", False),
        (">1.2", "1.2.5", False), (">1.2", "1.3.0", True), ("<=1.2", "1.2.9", True), ("=1.2", "1.2.7", True), ("=1.2.3", "1.2.4", False), ("^1.2.3", "1.3.0-beta", False), (">=1.3.0-alpha", "1.3.0-beta", True), (">=1.3.0-alpha", "1.4.0-beta", False),
    ],
)
def test_requirements(requirement, version, want):
    assert semver.matches(semver.parse_requirement(requirement), semver.parse(version)) is want


def test_bad_requirements():
    assert semver.parse_requirement("not a version") is None and semver.parse_requirement(">=1.x.y") is None


@pytest.mark.parametrize(
    ("source", "text", "version", "want"),
    [
        ("osv", "SEMVER(introduced=0; fixed=1.2.0)", "1.1.9", "affected"), ("osv", "SEMVER(introduced=0; fixed=1.2.0)", "1.2.0", "not_affected"), ("osv", "SEMVER(introduced=1.0.0; last_affected=1.2.0)", "1.2.0", "affected"),
        ("osv", "SEMVER(introduced=1.0.0; last_affected=1.2.0)", "1.2.1", "not_affected"), ("osv", "SEMVER(fixed=1.0.0)", "0.9.0", "unknown"), ("osv", "SEMVER(introduced=0; fixed=1.0.0; introduced=2.0.0)", "2.1.0", "affected"),
        ("osv", "SEMVER(introduced=0; limit=1.0.0)", "1.5.0", "not_affected"), ("osv", "SEMVER(bad) ECOSYSTEM(introduced=0)", "1.0.0", "affected"), ("osv", "withdrawn=2020", "1.0.0", "not_affected"), ("osv", "SEMVER(introduced=0)", "one", "unknown"),
        ("rustsec_db", "patched=>=1.2.0", "1.1.0", "affected"), ("rustsec_db", "patched=>=1.2.0", "1.2.0", "not_affected"), ("rustsec_db", "patched=>=1.2.0; unaffected=<0.5.0", "0.4.0", "not_affected"), ("rustsec_db", "", "1.0.0", "affected"),
        ("rustsec_db", "patched=^1.0.3 | >=2.1", "1.0.9", "not_affected"), ("rustsec_db", "patched=nonsense", "1.0.0", "unknown"),
        ("ghsa", ">= 1.0.0, < 1.5.0", "1.4.0", "affected"), ("ghsa", ">= 1.0.0, < 1.5.0 || = 2.0.0", "2.0.0", "affected"), ("ghsa", ">= 1.0.0, < 1.5.0", "1.5.0-beta", "affected"), ("ghsa", "about 1", "1.0.0", "unknown"), ("other", "?", "1.0.0", "unknown"),
    ],
)
def test_applicability(source, text, version, want):
    assert advisory.applicability(source, text, version) == want


def test_merge_is_independent_of_order(spark):
    rows = [
        (1, 10, "1.0.0", "A", "osv", "SEMVER(introduced=2.0.0)", None, False, "low"), (2, 10, "1.0.0", "A", "ghsa", "< 1.5.0", None, False, "high"), (3, 10, "1.0.0", "B", "osv", "withdrawn=x", None, False, None),
        (4, 10, "1.0.0", "B", "ghsa", "< 1.5.0", None, False, None), (5, 10, "1.0.0", "C", "osv", "withdrawn=x", None, True, None), (6, 10, "1.0.0", "D", "x", "?", 10, False, None),
    ]
    schema = "row_id long, version_id long, version string, advisory_id string, source string, affected_range string, matched_version long, requires_resync boolean, severity string"
    want = [("A", "affected"), ("C", "unknown"), ("D", "affected")]
    for order in (rows, rows[::-1]):
        found = advisory.merged(spark.createDataFrame(order, schema)).orderBy("advisory_id").collect()
        assert [(r["advisory_id"], r["state"]) for r in found] == want


def test_text_functions(spark):
    assert round(one(spark, X.similarity(F.lit("serde"), F.lit("serde_json"))), 6) == round(6 / 11, 6)
    assert X.glob_to_like("src/*_a?.rs") == "src/%\\_a_.rs"
    assert one(spark, X.doc_summary(F.lit("one\ntwo\n\nthree"))) == "one\ntwo"
    assert one(spark, X.clean_strings(F.array(*[F.lit(x) for x in (" b", "a", "", "b ")]))) == ["a", "b"]
    assert one(spark, X.license_status(F.lit("MIT OR GPL-3.0"), [], ["gpl-3.0"])) == "denied"
    assert one(spark, X.license_status(F.lit("MIT"), ["apache-2.0"], [])) == "denied"
    assert one(spark, X.license_status(F.lit(" "), [], [])) == "unknown"
    assert one(spark, X.severity_label(F.lit(None), F.lit("CVSS 9.8"))) == "critical"
    assert one(spark, X.last_page(F.lit('<https://x/y?per_page=1&page=7>; rel="next", <https://x/y?per_page=1&page=42>; rel="last"'))) == 42
    owner, name = X.repository(F.lit("https://github.com/some/thing.git"))
    assert (one(spark, owner), one(spark, name)) == ("some", "thing")
    assert one(spark, X.match_reasons("se", F.lit("serde"), F.lit("x"), F.array(F.lit("use")), F.array(F.lit("y")))) == ["name", "keyword"]
    assert one(spark, semver.toolchain_floor(F.lit("1.70")))["minor"] == 70


def test_paging(spark):
    token = session.encode_cursor(2, 4, {"q": "x"})
    assert session.decode_cursor(token, {"q": "x"}) == (2, 4)
    with pytest.raises(ValueError):
        session.decode_cursor(token, {"q": "y"})
    rows = spark.range(5).orderBy("id")
    first = session.page(rows, 2)
    limit, offset = session.decode_cursor(first.next_cursor, {})
    second = session.page(rows, limit, offset)
    assert [r["id"] for r in second.rows.collect()] == [2, 3] and second.has_more
    assert session.page(rows, 2, 4).next_cursor is None
    assert session.clamp("graph_depth", 9) == 4 and session.clamp("versions", None) == 100


def test_replacements(spark):
    rows = [("read_all", "function", "removed", "fn(a, b) -> x", None), ("read_all_bytes", "function", "added", None, "fn(a, b) -> x"), ("zzz", "function", "added", None, "fn()"), ("gone", "type", "removed", "s", None)]
    changes = spark.createDataFrame(rows, "name string, kind string, change string, old_signature string, new_signature string")
    found = api.replacements(changes).collect()
    assert [(r["old_name"], r["new_name"]) for r in found] == [("read_all", "read_all_bytes")]


def test_walk_depth_is_checked(spark):
    with pytest.raises(ValueError):
        graph._walk(spark.range(1).withColumnRenamed("id", "package_id"), spark.range(1), 5)


def test_closure(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "a string, b string")
    found = {(r["start"], r["node"]) for r in graph.closure(links, 8).collect()}
    assert found == {(p, q) for p in "abc" for q in "abc"} | {("x", "y")}


def test_feature_impact_of_long_chains(spark):
    """Features enable one another over 20 steps and in a circle; the last one brings a dependency in."""
    links = [(1, f"f{i}", f"f{(i + 1) % 21}", False) for i in range(21)] + [(1, "f20", "late", True), (2, "f0", "f1", False)]
    features = spark.createDataFrame(links, "version_id long, feature string, target string, is_dependency boolean")
    dependencies = spark.createDataFrame([(1, "late", True), (2, "late", True)], "version_id long, name string, optional boolean")
    found = {(r["version_id"], r["feature"]): r["brings"] for r in resolve.feature_impact(features, dependencies).collect()}
    assert found == {(1, f"f{i}"): ["late"] for i in range(21)} | {(2, "f0"): []}


def test_feature_impact_of_all_versions(spark):
    from depscope.plans import catalog

    folder = "/root/testdata/sf0.001"
    found = catalog.QUERIES["feature_impact"](spark, folder).select("version_id").distinct().count()
    assert found == spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey").distinct().count()


def test_dependents_of_all_packages(spark):
    from depscope.plans import catalog

    folder = "/root/testdata/sf0.001"
    packages = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey")
    targets = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr(f"l_partkey % {packages.count()} AS c_custkey")
    found = {r["root_id"] for r in catalog.QUERIES["graph_dependents"](spark, folder).select("root_id").distinct().collect()}
    assert max(found) >= 40 and found == {r["c_custkey"] for r in packages.join(targets, "c_custkey", "left_semi").collect()}


def test_one_implementation_of_each_identity(spark):
    from depscope.operators import types

    schema = "impl_id long, release int, type_name string, trait_name string, impl_kind string, methods array<string>, trait_display string, is_blanket boolean, has_bounds boolean, index_source string, start_line long, end_line long"
    rows = [
        (1, 0, "Thing", "Clone", "derive", None, None, False, False, "parsed", 5, 6),
        (2, 0, "thing", "CLONE", "derive", [], None, False, False, "documented", 9, 9),
        (3, 0, "Thing", None, "inherent", ["a", "b"], None, False, False, "parsed", 1, 2),
        (4, 0, "Thing", None, "inherent", ["b", "c"], "X", False, False, "parsed", 1, 2),
        (5, 0, "Thing", "Clone", "other", None, None, True, True, "parsed", 1, 2),
    ]
    impls = spark.createDataFrame(rows, schema)
    assert {r["impl_id"] for r in types.one_of_each(impls).collect()} == {2, 3, 4, 5}
    ranked = {r["impl_id"]: (r["kind_rank"], r["source_rank"]) for r in types.implementations(impls, types=["THING"]).collect()}
    assert ranked == {1: (1, 2), 2: (1, 1), 3: (0, 2), 4: (0, 2), 5: (3, 2)}
    symbols = spark.createDataFrame([(7, 0, "THING", "public", "parsed", None, 1)], "symbol_id long, release int, name string, visibility string, index_source string, path string, start_line long")
    found = types.by_type(impls, symbols).collect()
    assert len(found) == 1 and found[0]["methods"] == ["a", "b", "c"] and found[0]["others"] == 2 and found[0]["traits"] == ["clone"] and found[0]["symbol_id"] == 7
    assert types.by_type(impls.limit(0), symbols).count() == types.by_trait(impls.limit(0)).count() == 0


def test_implementations_of_written_types(spark):
    from depscope.operators import types

    schema = "impl_id long, release int, type_name string, trait_name string, impl_kind string, methods array<string>, trait_display string, is_blanket boolean, has_bounds boolean, index_source string, start_line long, type_display string, is_synthetic boolean, is_negative boolean"
    row = lambda i, shown, synthetic=False, negative=False: (i, 0, "Vec", "A", "trait", None, None, False, False, "documented", i, shown, synthetic, negative)
    impls = spark.createDataFrame([row(1, "Vec<u8>"), row(2, "Vec<String>"), row(3, "vec<u8>"), row(4, None), row(5, None, True), row(6, "x", False, True)], schema)
    assert {r["impl_id"] for r in types.one_of_each(impls).collect()} == {1, 2, 5, 6}
    assert {r["impl_id"]: r["source_rank"] for r in types.implementations(impls).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0}


def test_features_over_chains_and_cycles(spark):
    from depscope.operators import resolve

    chain = [(1, f"f{i}", f"f{i + 1}") for i in range(12)] + [(1, "f12", "dep:last"), (1, "default", "f0"), (2, "a", "b"), (2, "b", "a"), (2, "b", "dep:x")]
    found = {(r["version_id"], r["feature"]): r for r in resolve.feature_listing(spark.createDataFrame(chain, "version_id long, feature string, target string")).collect()}
    assert found[1, "default"]["transitive"] == sorted(f"f{i}" for i in range(13)) and found[1, "f0"]["is_default"] and not found[1, "f1"]["is_default"]
    assert found[1, "f12"]["dependencies"] == ["last"] and found[1, "f12"]["transitive"] == []
    assert found[2, "a"]["transitive"] == ["a", "b"] and found[2, "b"]["dependencies"] == ["x"]


def test_pinned_versions_that_conflict(spark):
    from depscope.operators import resolve

    versions = spark.createDataFrame([(10, 1, "1.0.0", "2020-01-01"), (11, 1, "2.0.0", "2021-01-01"), (20, 2, "1.0.0", "2020-01-01"), (30, 3, "1.5.0", "2020-01-01")], "version_id long, package_id long, version string, published_at string")
    edges = spark.createDataFrame([(20, 1, "^1.0"), (20, 3, "^1.2"), (11, 3, "^2.0")], "version_id long, target_id long, requirement string")
    pairs = spark.createDataFrame([(1, 2)], "package_a long, package_b long")
    found = {r["version_a"]: (r["resolvable"], r["conflicts"]) for r in resolve.compatibility(pairs, versions, edges).collect()}
    # 2.0.0 is not ^1.0, and no version of package 3 is both ^1.2 and ^2.0
    assert found == {"1.0.0": (True, 0), "2.0.0": (False, 2)}
