"""The logical tables of a package registry over the star schema of the test data, in Spark and, for oracles, in SQL.

Packages are customers, their versions orders, dependencies line items; API symbols and advisories come from parts,
telemetry and jobs from events, source files and documentation from documents.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment that "now" is in every query.
AS_OF = "2002-01-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

SQL = {
    "packages": "SELECT c_custkey AS package_id, c_name AS name, lower(c_name) AS name_lower, c_mktsegment AS category, n_name AS keyword, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "versions": """SELECT o_orderkey AS version_id, o_custkey AS package_id, '1.' || (o_orderkey % 50) || '.' || (o_orderkey % 7) AS version, o_orderdate AS published_at, o_orderstatus = 'F' AS yanked,
        CAST(floor(o_totalprice) AS BIGINT) AS downloads, CASE o_orderpriority WHEN '1-URGENT' THEN 'MIT' WHEN '2-HIGH' THEN 'MIT OR Apache-2.0' WHEN '3-MEDIUM' THEN 'GPL-3.0-only WITH Classpath-exception-2.0' WHEN '5-LOW' THEN 'BSD-3-Clause AND MIT' END AS license FROM orders""",
    "edges": """SELECT l_orderkey AS version_id, l_partkey % (SELECT count(*) FROM customer) AS target_id, l_linenumber AS position, CASE l_returnflag WHEN 'N' THEN 'normal' WHEN 'A' THEN 'dev' ELSE 'build' END AS kind,
        l_linestatus = 'O' AS optional, '>=1.' || CAST(floor(l_quantity) AS BIGINT) || '.0' AS requirement, CAST(floor(l_quantity) AS BIGINT) AS least_minor FROM lineitem""",
    "symbols": """SELECT p_partkey AS symbol_id, p_size % 2 AS release, p_name AS name, lower(p_type) AS kind, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'fn ' || p_brand || '()' END AS signature,
        CASE WHEN p_partkey % 11 = 0 THEN 'private' WHEN p_partkey % 7 = 0 THEN NULL ELSE 'public' END AS visibility, CASE WHEN p_partkey % 3 = 0 THEN 'documented' ELSE 'parsed' END AS index_source,
        p_partkey % 20 AS file_id, CAST(p_size * 10 AS BIGINT) AS start_line, CAST(p_size * 10 + p_partkey % 9 AS BIGINT) AS end_line, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'root::' || p_brand || '::' || p_name END AS path,
        CASE WHEN p_partkey % 6 = 0 THEN 'inner::' || p_name WHEN p_partkey % 4 <> 0 THEN 'root::' || p_brand || '::' || p_name END AS defined_at, p_size > 45 AS deprecated FROM part""",
    "impls": """SELECT p_partkey AS impl_id, p_size % 2 AS release, p_name AS type_name, CASE WHEN p_partkey % 4 <> 0 THEN split_part(p_type, ' ', 1) END AS trait_name,
        CASE p_partkey % 4 WHEN 0 THEN 'inherent' WHEN 1 THEN 'derive' WHEN 2 THEN 'trait' ELSE 'auto' END AS impl_kind, CASE WHEN p_partkey % 5 > 0 THEN list_transform(range(1, p_partkey % 5), lambda i: 'm' || i) END AS methods,
        CASE WHEN p_partkey % 6 = 0 THEN p_brand END AS trait_display, p_partkey % 13 = 0 AS is_blanket, p_partkey % 17 = 0 AS has_bounds, p_partkey % 19 = 0 AS is_synthetic, p_partkey % 23 = 0 AS is_negative, CASE WHEN p_partkey % 10 = 3 THEN p_name || '<u8>' ELSE p_name END AS type_display, CASE WHEN p_partkey % 3 = 0 THEN 'documented' ELSE 'parsed' END AS index_source,
        CAST(p_size * 10 AS BIGINT) AS start_line, CAST(p_size * 10 + p_partkey % 9 AS BIGINT) AS end_line FROM part""",
    "features": """SELECT l_orderkey AS version_id, 'f' || l_linenumber AS feature, 'dep:p' || (l_partkey % (SELECT count(*) FROM customer)) AS target FROM lineitem
        UNION SELECT l_orderkey, 'f' || l_linenumber, 'f' || (l_linenumber - 1) FROM lineitem WHERE l_linenumber > 1 AND l_linestatus = 'O' UNION SELECT l_orderkey, 'default', 'f' || max(l_linenumber) FROM lineitem GROUP BY 1""",
    "advisories": """SELECT p_partkey AS row_id, p_partkey % (SELECT count(*) FROM customer) AS package_id, 'ADV-' || (p_partkey % 97) AS advisory_id, CASE WHEN p_size % 5 = 0 THEN 'SEMVER(introduced=0; fixed=1.' || (p_size * 4) || '.0)'
        WHEN p_size % 5 = 1 THEN '>= 1.' || p_size || '.0, < 1.' || (p_size + 20) || '.0' WHEN p_size % 5 = 2 THEN 'patched=>=1.' || (p_size * 3) || '.0' WHEN p_size % 5 = 3 THEN 'withdrawn=2001-01-01' ELSE 'see text' END AS affected_range,
        CASE p_size % 5 WHEN 0 THEN 'osv' WHEN 1 THEN 'ghsa' WHEN 2 THEN 'rustsec_db' ELSE 'osv' END AS source, CASE WHEN p_partkey % 3 = 0 THEN 'high' WHEN p_partkey % 3 = 1 THEN 'low' END AS severity FROM part WHERE p_size <= 10""",
    "invocations": "SELECT event_id, event_type AS tool, event_type <> 'error' AS success, value AS latency_ms, ts AS created_at, user_id, value < 20 AS hit FROM events",
    "jobs": """SELECT event_id AS job_id, user_id AS package_id, CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 WHEN 0 THEN 'package' WHEN 1 THEN 'security' WHEN 2 THEN 'docs' ELSE 'sources' END AS scope,
        CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'finished' END AS status, user_id % 4 AS attempts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS priority,
        date_trunc('second', ts) AS requested_at, date_trunc('second', ts) + to_seconds(CAST(floor(value) AS BIGINT)) AS finished_at, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'code ' || user_id END AS last_error FROM events""",
    "source_lines": "SELECT doc_id, source || '/' || doc_id || '.txt' AS path, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_no FROM documents WHERE text IS NOT NULL",
    "package_texts": """SELECT c_custkey AS package_id, c_name AS name, substring(text, 1, 600) AS description, [n_name] AS keywords, list_distinct(list_filter([c_mktsegment, lang], lambda x: x IS NOT NULL)) AS categories
        FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN documents ON doc_id = c_custkey""",
    "docs_pages": "SELECT doc_id, source AS section, source || '/' || doc_id AS path, text AS content, lang FROM documents WHERE text IS NOT NULL",
}


def oracle(body: str) -> str:
    """SQL with the logical tables that the body names as leading expressions."""
    used = [t for t in SQL if t in body.replace("latest_versions", "versions latest_versions")]
    parts = [f"{t} AS ({SQL[t]})" for t in used]
    if "latest_versions" in body:
        parts.append("latest_versions AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY published_at DESC NULLS LAST, version_id DESC) = 1)")
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {', '.join([*parts, body[15:]])}"
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join([*parts, body[5:]])}"
    return f"WITH {', '.join(parts)} {body}" if parts else body


class Registry:
    """The logical tables of one data directory; each is read when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def packages(self) -> DataFrame:
        return self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("package_id"), F.col("c_name").alias("name"), F.lower("c_name").alias("name_lower"), F.col("c_mktsegment").alias("category"), F.col("n_name").alias("keyword"), F.col("c_acctbal").alias("balance"),
        )

    def _package_of(self, key: str):
        return F.col(key) % self.table("customer").agg(F.count("*")).scalar()

    @cached_property
    def versions(self) -> DataFrame:
        key, license = F.col("o_orderkey"), F.col("o_orderpriority")
        return self.table("orders").select(
            key.alias("version_id"), F.col("o_custkey").alias("package_id"), F.concat(F.lit("1."), key % 50, F.lit("."), key % 7).alias("version"), F.col("o_orderdate").alias("published_at"), (F.col("o_orderstatus") == "F").alias("yanked"),
            F.floor("o_totalprice").cast("long").alias("downloads"),
            F.when(license == "1-URGENT", "MIT").when(license == "2-HIGH", "MIT OR Apache-2.0").when(license == "3-MEDIUM", "GPL-3.0-only WITH Classpath-exception-2.0").when(license == "5-LOW", "BSD-3-Clause AND MIT").alias("license"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        least = F.floor("l_quantity").cast("long")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("version_id"), self._package_of("l_partkey").alias("target_id"), F.col("l_linenumber").alias("position"),
            F.when(F.col("l_returnflag") == "N", "normal").when(F.col("l_returnflag") == "A", "dev").otherwise("build").alias("kind"),
            (F.col("l_linestatus") == "O").alias("optional"), F.concat(F.lit(">=1."), least, F.lit(".0")).alias("requirement"), least.alias("least_minor"),
        )

    @cached_property
    def symbols(self) -> DataFrame:
        key, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
        path = F.concat(F.lit("root::"), F.col("p_brand"), F.lit("::"), name)
        return self.table("part").select(
            key.alias("symbol_id"), (size % 2).alias("release"), name.alias("name"), F.lower("p_type").alias("kind"), F.when(key % 5 != 0, F.concat(F.lit("fn "), F.col("p_brand"), F.lit("()"))).alias("signature"),
            F.when(key % 11 == 0, "private").when(key % 7 != 0, "public").alias("visibility"), F.when(key % 3 == 0, "documented").otherwise("parsed").alias("index_source"),
            (key % 20).alias("file_id"), (size * 10).cast("long").alias("start_line"), (size * 10 + key % 9).cast("long").alias("end_line"), F.when(key % 4 != 0, path).alias("path"),
            F.when(key % 6 == 0, F.concat(F.lit("inner::"), name)).when(key % 4 != 0, path).alias("defined_at"), (size > 45).alias("deprecated"),
        )

    @cached_property
    def impls(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        names = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit("m"), i))
        return self.table("part").select(
            key.alias("impl_id"), (size % 2).alias("release"), F.col("p_name").alias("type_name"), F.when(key % 4 != 0, F.substring_index("p_type", " ", 1)).alias("trait_name"),
            F.when(key % 4 == 0, "inherent").when(key % 4 == 1, "derive").when(key % 4 == 2, "trait").otherwise("auto").alias("impl_kind"), F.when(key % 5 > 0, F.slice(names, F.lit(1), (key % 5 - 1).cast("int"))).alias("methods"),
            F.when(key % 6 == 0, F.col("p_brand")).alias("trait_display"), (key % 13 == 0).alias("is_blanket"), (key % 17 == 0).alias("has_bounds"), (key % 19 == 0).alias("is_synthetic"), (key % 23 == 0).alias("is_negative"), F.when(key % 10 == 3, F.concat("p_name", F.lit("<u8>"))).otherwise(F.col("p_name")).alias("type_display"), F.when(key % 3 == 0, "documented").otherwise("parsed").alias("index_source"),
            (size * 10).cast("long").alias("start_line"), (size * 10 + key % 9).cast("long").alias("end_line"),
        )

    @cached_property
    def features(self) -> DataFrame:
        """What each feature of a version enables: another feature, or a dependency (dep:)."""
        line = F.col("l_linenumber")
        named = lambda n: F.concat(F.lit("f"), n)
        rows = self.table("lineitem").select(F.col("l_orderkey").alias("version_id"), named(line).alias("feature"), F.concat(F.lit("dep:p"), self._package_of("l_partkey")).alias("target"), line.alias("line"), "l_linestatus")
        links = rows.where("line > 1 AND l_linestatus = 'O'").select("version_id", "feature", named(F.col("line") - 1).alias("target"))
        default = rows.groupBy("version_id").agg(F.max("line").alias("line")).select("version_id", F.lit("default").alias("feature"), named(F.col("line")).alias("target"))
        return rows.select("version_id", "feature", "target").unionByName(links).unionByName(default).distinct()

    @cached_property
    def advisories(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
        return self.table("part").where("p_size <= 10").select(
            key.alias("row_id"), self._package_of("p_partkey").alias("package_id"), text("ADV-", key % 97).alias("advisory_id"),
            F.when(size % 5 == 0, text("SEMVER(introduced=0; fixed=1.", size * 4, ".0)")).when(size % 5 == 1, text(">= 1.", size, ".0, < 1.", size + 20, ".0")).when(size % 5 == 2, text("patched=>=1.", size * 3, ".0")).when(size % 5 == 3, "withdrawn=2001-01-01").otherwise("see text").alias("affected_range"),
            F.when(size % 5 == 1, "ghsa").when(size % 5 == 2, "rustsec_db").otherwise("osv").alias("source"), F.when(key % 3 == 0, "high").when(key % 3 == 1, "low").alias("severity"),
        )

    @cached_property
    def invocations(self) -> DataFrame:
        return self.table("events").select("event_id", F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("latency_ms"), F.col("ts").alias("created_at"), "user_id", (F.col("value") < 20).alias("hit"))

    @cached_property
    def jobs(self) -> DataFrame:
        k, kind = F.get_json_object("props", "$.k").cast("long"), F.col("event_type")
        asked = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
        return self.table("events").select(
            F.col("event_id").alias("job_id"), F.col("user_id").alias("package_id"), F.when(k % 4 == 0, "package").when(k % 4 == 1, "security").when(k % 4 == 2, "docs").otherwise("sources").alias("scope"),
            F.when(kind == "view", "pending").when(kind == "click", "running").when(kind == "error", "failed").otherwise("finished").alias("status"), (F.col("user_id") % 4).alias("attempts"), k.alias("priority"),
            asked.alias("requested_at"), (asked + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor("value"))).alias("finished_at"),
            F.when((kind == "error") & (F.col("user_id") % 2 == 0), F.concat(F.lit("code "), F.col("user_id"))).alias("last_error"),
        )

    @cached_property
    def source_lines(self) -> DataFrame:
        docs = self.table("documents").where("text IS NOT NULL")
        return docs.select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", (F.col("line_no") + 1).cast("long"))

    @cached_property
    def source_files(self) -> DataFrame:
        docs = self.table("documents").where("text IS NOT NULL")
        return docs.select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), "text")

    def _parts(self, doc) -> DataFrame:
        """Parts dealt by their document, so that texts are made where they are grouped, by all tasks.

        A file of parts is small, and one task reads it; a number of partitions is given since a shuffle as small would be joined up.
        """
        return self.table("part").withColumn("doc", doc).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "doc")

    @cached_property
    def api_documents(self) -> DataFrame:
        """(doc, text): API documents of twenty parts each, every other one in an older format.

        A part is a struct sN with a field fN, an implementation iN with a function gN, and a re-export uN of the next
        part's re-export or, for each fourth, of its own struct. Module n, of which w re-exports everything, holds
        structs of even numbers.
        """
        k, doc = F.col("p_partkey"), F.floor(F.col("p_partkey") / 20)
        old = doc % 2 == 1
        text = lambda c: F.when(c, "true").otherwise("false")
        when = lambda c, a, b: F.when(c, F.lit(a)).otherwise(F.lit(b))
        item = lambda i, name, visibility, attrs, kind, body: F.concat(F.format_string('"%s": {"name": %s, "visibility": %s, "attrs": %s, "docs": "%s", "span": {"filename": "x", "begin": [%d, 1], "end": [%d, 2]}, "deprecation": %s, ', i, name, visibility, attrs, F.col("p_type"), F.col("p_size"), F.col("p_size") + k % 9, F.when(k % 13 == 0, F.format_string('{"since": "1.0", "note": "%s"}', F.col("p_brand"))).otherwise("null")), F.when(old, F.format_string('"kind": "%s", "inner": %s}', F.lit(kind), body)).otherwise(F.format_string('"inner": {"%s": %s}}', F.lit(kind), body)))
        of = lambda letter, n=k: F.concat(F.lit(letter), n)
        none = F.lit('{"params": [], "where_predicates": []}')
        bounded = when(k % 3 == 0, '{"params": [{"name": "A", "kind": {"type": {"bounds": [{"trait_bound": {"trait": {"path": "Clone", "id": 0, "args": null}, "generic_params": [], "modifier": "none"}}], "default": null, "is_synthetic": false}}}], "where_predicates": []}', '{"params": [], "where_predicates": []}')
        size = F.when(k % 2 == 0, F.lit('{"resolved_path": {"path": "Vec", "id": 1, "args": {"angle_bracketed": {"args": [{"type": {"primitive": "u8"}}], "constraints": []}}}}')).when(old, F.lit('{"kind": "borrowed_ref", "inner": {"lifetime": "\'a", "mutable": true, "type": {"kind": "slice", "inner": {"kind": "generic", "inner": "T"}}}}')).otherwise(F.lit('{"borrowed_ref": {"lifetime": "\'a", "is_mutable": true, "type": {"slice": {"generic": "T"}}}}'))
        visibility = F.when(k % 7 == 0, '"crate"').when(k % 11 == 0, '{"restricted": {"parent": 0, "path": "::inner"}}').when(k % 5 == 0, '"default"').otherwise('"public"')
        target = F.when(k % 4 == 3, of("s")).otherwise(of("u", k + 1))
        trait = F.when(k % 4 == 0, "null").otherwise(F.format_string('{"path": "fmt::%s", "id": 2, "args": null}', F.substring_index("p_type", " ", 1)))
        own = F.concat_ws(
            ", ",
            item(of("s"), F.concat(F.lit('"T'), k, F.lit('"')), visibility, when(k % 6 == 0, '["non_exhaustive"]', "[]"), "struct", F.format_string('{"kind": {"plain": {"fields": ["%s"], "has_stripped_fields": false}}, "generics": %s, "impls": ["%s"]}', of("f"), bounded, of("i"))),
            item(of("f"), F.lit('"size"'), F.lit('"default"'), F.lit("[]"), "struct_field", size),
            item(of("u"), F.lit("null"), when(k % 3 == 0, '"default"', '"public"'), F.lit("[]"), "use", F.format_string('{"source": "x", "name": "%s", "id": "%s", "is_glob": false}', of("U"), target)),
            item(of("i"), F.lit("null"), F.lit('"default"'), when(k % 6 == 1, '["automatically_derived"]', "[]"), "impl", F.format_string('{"is_unsafe": false, "generics": %s, "trait": %s, "for": {"resolved_path": {"path": "m::T%s", "id": 3, "args": null}}, "items": ["%s"], "is_negative": %s, "is_synthetic": %s, "blanket_impl": %s}', none, trait, k.cast("string"), of("g"), text(k % 9 == 0), text(k % 10 == 0), when(k % 8 == 1, '{"generic": "B"}', "null"))),
            item(of("g"), F.lit('"run"'), F.lit('"public"'), F.lit("[]"), "function", F.format_string('{"sig": {"inputs": [["self", {"generic": "Self"}], ["n", {"primitive": "u32"}]], "output": {"primitive": "bool"}, "is_c_variadic": false}, "generics": %s, "header": {"is_const": false, "is_unsafe": %s, "is_async": false, "abi": "Rust"}, "has_body": true}', none, text(k % 5 == 0))),
        )
        paths = F.format_string('"%s": {"path": [%s, "T%s"]}, "%s": {"path": ["root", "%s"]}', of("s"), when(k % 2 == 0, '"root", "a", "b"', '"root"'), k.cast("string"), of("u"), of("U"))
        quoted = lambda c: F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), c, F.lit('"')))), ", ")
        made = self._parts(doc.cast("long")).groupBy("doc").agg(F.array_join(F.collect_list(own), ", ").alias("items"), F.array_join(F.collect_list(paths), ", ").alias("paths"), quoted(of("u")).alias("uses"), quoted(F.when(k % 2 == 0, of("s"))).alias("even"))
        module = lambda i, name, members: F.format_string('"%s": {"name": "%s", "visibility": "public", "attrs": [], "docs": null, "span": null, "deprecation": null, "inner": {"module": {"is_crate": true, "items": [%s], "is_stripped": false}}}', F.lit(i), F.lit(name), members)
        glob = F.lit('"w": {"name": null, "visibility": "public", "attrs": [], "docs": null, "span": null, "deprecation": null, "inner": {"use": {"source": "n", "name": "n", "id": "n", "is_glob": true}}}')
        return made.select("doc", F.format_string('{"root": "r", "format_version": 60, "index": {%s, %s, %s, %s}, "paths": {"r": {"path": ["root"]}, "n": {"path": ["root", "a", "b"]}, %s}}', "items", module("r", "root", F.concat_ws(", ", F.lit('"n", "w"'), F.nullif("uses", F.lit("")))), module("n", "b", F.col("even")), glob, "paths").alias("text"))

    @cached_property
    def rust_files(self) -> DataFrame:
        """(doc, path, text): source files of twenty parts each, fourteen lines for each part."""
        k = F.col("p_partkey")
        n = k.cast("string")
        text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        lines = (
            text("// struct Fake", n, ' { "'),
            text("/* outer /* impl Nested for X {} */"),
            text("   still } */"),
            F.when(k % 2 == 0, "#[derive(Clone, fmt::Debug)]").otherwise('#[doc = "}"]'),
            text(F.when(k % 3 != 0, "pub ").otherwise(""), "struct T", n, "<A: Clone> {"),
            text("    size: Vec<u8>,"),
            text("}"),
            F.when(k % 4 != 0, text("impl<A: Clone> fmt::Display for m::T", n, "<A> {")).otherwise(text("impl<A> T", n, "<A> where A: Clone {")),
            text('    pub fn run(&self) -> bool { let x = "fn fake() {"; write!(f, "part \\"', n, '\\" {}", x); x == r#"}"# || \'{\' != \'}\' }'),
            text("}"),
            text("pub mod m", n, " { pub fn inner", n, "<'a>(x: &'a str) {} macro_rules! mac { ($x:expr) => { fn no() {} } } }"),
            F.when(k % 5 == 0, text("#[proc_macro_derive(D", n, ", attributes(one, two))]")).when(k % 5 == 1, "#[proc_macro_attribute]").when(k % 5 == 2, "#[proc_macro]").otherwise("#[inline]"),
            text("pub fn make", n, "(input: TokenStream) -> TokenStream { input }"),
            text("pub use self::{make", n, " as build", n, ", build", n, " as alias", n, ", m", n, "::*};"),
        )
        doc = F.floor(k / 20).cast("long")
        made = self._parts(doc).select("doc", F.struct(k.alias("k"), F.concat_ws("\n", *lines).alias("text")).alias("part")).groupBy("doc").agg(F.array_sort(F.collect_list("part")).alias("parts"))
        return made.select("doc", F.lit("src/lib.rs").alias("path"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))

    @cached_property
    def package_texts(self) -> DataFrame:
        """Packages with a description, the beginning of the document of their number."""
        about = self.table("documents").select(F.col("doc_id").alias("c_custkey"), F.substring("text", 1, 600).alias("description"), "lang")
        rows = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(about, "c_custkey", "left")
        return rows.select(F.col("c_custkey").alias("package_id"), F.col("c_name").alias("name"), "description", F.array("n_name").alias("keywords"), F.array_distinct(F.array_compact(F.array("c_mktsegment", "lang"))).alias("categories"))

    @cached_property
    def docs_pages(self) -> DataFrame:
        docs = self.table("documents").where("text IS NOT NULL")
        return docs.select("doc_id", F.col("source").alias("section"), F.concat("source", F.lit("/"), "doc_id").alias("path"), F.col("text").alias("content"), "lang")

    @cached_property
    def latest_versions(self) -> DataFrame:
        from ..operators.lookup import latest

        return latest(self.versions)
