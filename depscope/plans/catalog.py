"""The query catalogue: each operator over the whole logical tables, with the SQL that its result is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import score as S
from ..functions import text as X
from ..operators import advisory_sync, api, codesearch, fulltext, graph, lookup, monitor, resolve, search, source_items, types
from ..sources import api_documents, snapshot
from ..sources.registry import AS_OF, EVENTS_AS_OF, Registry, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _now(text: str = AS_OF):
    return F.lit(text).cast("timestamp_ntz")


def query(sql: str | None = None):
    """Register a query over a Registry under its function's name."""

    def add(f: Callable[[Registry], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Registry(spark, folder))
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


# look-ups


@query("SELECT package_id, version_id, version, published_at, yanked, downloads FROM latest_versions")
def latest_version(r):
    return r.latest_versions.select("package_id", "version_id", "version", "published_at", "yanked", "downloads")


@query("SELECT version_id, package_id, yanked FROM versions WHERE version = '1.3.2'")
def exact_version(r):
    return lookup.exact_version(r.versions, "1.3.2").select("version_id", "package_id", "yanked")


@query("SELECT package_id, CAST(sum(downloads) AS BIGINT) AS total_downloads, max(published_at) AS last_published, count(*) AS n_versions FROM versions GROUP BY 1")
def total_downloads(r):
    return lookup.download_totals(r.versions)


@query("SELECT package_id, version_id, version, place FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY published_at DESC NULLS LAST, version_id DESC) AS place FROM versions) WHERE place <= 5")
def version_history(r):
    return lookup.history(r.versions, 5).select("package_id", "version_id", "version", "place")


@query("SELECT l.package_id, l.version, p.name AS target, e.kind, e.optional, e.requirement, count(*) AS n FROM latest_versions l JOIN edges e USING (version_id) JOIN packages p ON p.package_id = e.target_id GROUP BY ALL")
def dependencies_of_latest(r):
    rows = lookup.dependencies(r.edges, r.latest_versions, r.packages)
    return rows.groupBy("package_id", "version", "target", "kind", "optional", "requirement").agg(F.count("*").alias("n"))


@query("SELECT e.target_id AS package_id, count(DISTINCT v.package_id) AS dependents FROM edges e JOIN versions v USING (version_id) GROUP BY 1")
def dependent_count(r):
    return lookup.dependent_counts(r.edges, r.versions)


@query("""WITH pairs AS (SELECT DISTINCT e.target_id, v.package_id FROM edges e JOIN versions v USING (version_id)),
ranked AS (SELECT pairs.target_id, pairs.package_id, p.name, l.version, coalesce(l.downloads, 0) AS downloads, row_number() OVER (PARTITION BY target_id ORDER BY l.downloads DESC NULLS LAST, p.name) AS place
    FROM pairs JOIN packages p USING (package_id) LEFT JOIN latest_versions l ON l.package_id = pairs.package_id)
SELECT * FROM ranked WHERE place <= 3""")
def top_dependents(r):
    return lookup.dependents(r.edges, r.versions, r.packages, 3).select("target_id", "package_id", "name", "version", "downloads", "place")


@query("""SELECT DISTINCT ON (e.target_id, v.package_id) e.target_id, v.package_id, v.version, v.version_id FROM edges e JOIN versions v USING (version_id) ORDER BY e.target_id, v.package_id, v.published_at DESC NULLS LAST, v.version_id DESC""")
def dependents_latest_version(r):
    return lookup.depending_versions(r.edges, r.versions).select("target_id", "package_id", "version", "version_id")


@query("SELECT version_id, version_id IN (SELECT version_id FROM edges) AS dependencies_synced FROM versions")
def dependencies_synced(r):
    return lookup.synced(r.versions, r.edges)


@query(f"SELECT version_id, package_id, CAST(floor(epoch(TIMESTAMP '{AS_OF}') - epoch(published_at)) AS BIGINT) // 86400 AS age_days, CASE WHEN yanked THEN 'deprecated' WHEN downloads >= 1000000 THEN 'high' WHEN downloads >= 100000 THEN 'medium' ELSE 'low' END AS adoption FROM versions")
def version_timeline(r):
    return lookup.timeline(r.versions, F.lit(AS_OF).cast("timestamp")).select("version_id", "package_id", "age_days", S.adoption(F.col("yanked"), F.col("downloads")).alias("adoption"))


@query("""WITH own AS (SELECT version_id, count(*) AS n, count(*) FILTER (WHERE optional) AS o FROM edges GROUP BY 1), dep AS (SELECT e.target_id AS package_id, count(DISTINCT v.package_id) AS d FROM edges e JOIN versions v USING (version_id) GROUP BY 1)
SELECT l.package_id, l.version, coalesce(n, 0) AS dependencies, coalesce(o, 0) AS optional_dependencies, coalesce(d, 0) AS dependents FROM latest_versions l LEFT JOIN own USING (version_id) LEFT JOIN dep ON dep.package_id = l.package_id""")
def compare_counts(r):
    return lookup.compare_counts(r.versions, r.edges)


@query("SELECT package_id, count(*) FILTER (WHERE published_at > TIMESTAMP '2002-01-01' - INTERVAL 365 DAY AND published_at <= TIMESTAMP '2002-01-01') AS releases, CAST(floor(epoch(TIMESTAMP '2002-01-01') - epoch(max(published_at))) AS BIGINT) // 86400 AS days, CAST(CASE WHEN count(*) FILTER (WHERE published_at > TIMESTAMP '2002-01-01' - INTERVAL 365 DAY AND published_at <= TIMESTAMP '2002-01-01') >= 24 OR CAST(floor(epoch(TIMESTAMP '2002-01-01') - epoch(max(published_at))) AS BIGINT) // 86400 < 30 THEN 21600 WHEN count(*) FILTER (WHERE published_at > TIMESTAMP '2002-01-01' - INTERVAL 365 DAY AND published_at <= TIMESTAMP '2002-01-01') >= 6 OR CAST(floor(epoch(TIMESTAMP '2002-01-01') - epoch(max(published_at))) AS BIGINT) // 86400 < 180 THEN 172800 WHEN CAST(floor(epoch(TIMESTAMP '2002-01-01') - epoch(max(published_at))) AS BIGINT) // 86400 > 1825 THEN 5184000 ELSE 1209600 END AS BIGINT) AS ttl_seconds FROM versions GROUP BY 1")
def releases_last_year(r):
    recent = (F.col("published_at") > _now() - F.make_dt_interval(F.lit(365))) & (F.col("published_at") <= _now())
    rows = r.versions.groupBy("package_id").agg(F.count_if(recent).alias("releases"), F.max("published_at").alias("last"))
    days = F.floor((F.unix_timestamp(_now().cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))) / 86400).cast("long")
    return rows.withColumn("days", days).withColumn("ttl_seconds", S.ttl_seconds(F.col("releases"), F.col("days"))).drop("last")


@query("SELECT (SELECT count(*) FROM packages) AS packages, (SELECT count(*) FROM versions) AS versions, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM advisories) AS advisories, (SELECT count(*) FROM docs_pages) AS docs_pages")
def coverage_counts(r):
    names = ("packages", "versions", "edges", "symbols", "advisories", "docs_pages")
    counts = [getattr(r, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("of"), "n") for n in names]
    both = counts[0]
    for c in counts[1:]:
        both = both.unionAll(c)
    return both.agg(*[F.max(F.when(F.col("of") == n, F.col("n"))).alias(n) for n in names])


@query("SELECT DISTINCT v.package_id, v.version FROM versions v WHERE v.version_id IN (SELECT version_id FROM edges)")
def searchable_versions(r):
    return search.searchable_versions(r.versions, r.edges)


@query("SELECT package_id FROM packages WHERE package_id NOT IN (SELECT target_id FROM edges JOIN latest_versions USING (version_id))")
def packages_without_dependents(r):
    used = r.edges.join(r.latest_versions.select("version_id"), "version_id").select(F.col("target_id").alias("package_id"))
    return r.packages.select("package_id").join(used, "package_id", "left_anti")


@query("SELECT package_id FROM packages p WHERE EXISTS (SELECT 1 FROM versions v WHERE v.package_id = p.package_id AND v.yanked)")
def packages_with_yanked(r):
    return r.packages.select("package_id").join(r.versions.where("yanked"), "package_id", "left_semi")


# search and text

_TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def _sim(a: str, b: str) -> str:
    x, y = _TRIGRAMS.format(a), _TRIGRAMS.format(b)
    inter = f"len(list_intersect({x}, {y}))"
    return f"coalesce({inter} * 1.0 / nullif(len({x}) + len({y}) - {inter}, 0), 0)"


@query(f"""WITH hit AS (SELECT *, 2 * {_sim("name", "'customer#00000012'")} + {_sim("category || ' ' || keyword", "'customer#00000012'")} + CASE WHEN contains(lower(name), 'customer#00000012') THEN 1.5 ELSE 0 END AS rel FROM packages
    WHERE contains(lower(name), 'customer#00000012') OR lower(category) = 'customer#00000012' OR lower(keyword) = 'customer#00000012'),
t AS (SELECT package_id, max(downloads) AS downloads FROM versions GROUP BY 1), d AS (SELECT target_id AS package_id, count(DISTINCT version_id) AS n FROM edges GROUP BY 1)
SELECT package_id, name, round(rel, 6) AS relevance, coalesce(downloads, 0) AS downloads, coalesce(n, 0) AS depending_versions FROM hit LEFT JOIN t USING (package_id) LEFT JOIN d USING (package_id) ORDER BY rel DESC, coalesce(downloads, 0) DESC, name LIMIT 10""")
def search_relevance(r):
    return search.search_packages(r.packages, r.versions, r.edges, "customer#00000012").select("package_id", "name", F.round("relevance", 6).alias("relevance"), "downloads", "depending_versions")


@query("""SELECT package_id, name, coalesce(max(downloads), 0) AS downloads FROM packages LEFT JOIN versions USING (package_id) WHERE lower(category) = 'machinery' GROUP BY ALL ORDER BY downloads DESC, name LIMIT 10""")
def search_downloads(r):
    return search.search_packages(r.packages, r.versions, r.edges, "machinery", "downloads").select("package_id", "name", "downloads")


@query(f"SELECT p_partkey AS id, round({_sim('p_name', 'p_type')}, 6) AS similarity FROM part")
def trigram_similarity(r):
    return r.table("part").select(F.col("p_partkey").alias("id"), F.round(X.similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query("SELECT a.package_id, count(*) AS candidates FROM packages a JOIN packages b ON a.category = b.category AND a.keyword = b.keyword AND a.package_id <> b.package_id GROUP BY 1")
def overlap_candidates(r):
    # how many others share both fields: counted by group, no pairs are made
    groups = r.packages.groupBy("category", "keyword").agg((F.count("*") - 1).alias("candidates")).where("candidates > 0")
    return r.packages.join(groups, ["category", "keyword"]).select("package_id", "candidates")


# full text: stems and phrases are expressions over the words here

_WORDS = "' ' || array_to_string(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), ' ') || ' '"
_TIMES = "list_sum(list_transform(range(1, len(list_filter(string_split(ws, ' '), lambda w: regexp_matches(w, '^{0}$'))) + 1), lambda j: 1.0 / (j * j)))"


@query(f"""WITH t AS (SELECT doc_id, {_WORDS.format("content")} AS ws FROM docs_pages)
SELECT doc_id, round((coalesce({_TIMES.format("right(s|ed|ing|ly)?")}, 0) + coalesce({_TIMES.format("reserv(e|es|ed|ing)?")}, 0) + coalesce({_TIMES.format("licens(e|es|ed|ing)?")}, 0)) * 0.1 / 1.64493406685 / 3, 9) AS rank FROM t
WHERE regexp_matches(ws, ' right(s|ed|ing|ly)? reserv(e|es|ed|ing)? ') OR (regexp_matches(ws, ' licens(e|es|ed|ing)? ') AND NOT regexp_matches(ws, ' idiots? '))""")
def fulltext_match(r):
    index = fulltext.build(r.docs_pages, "doc_id", "content")
    return fulltext.match(index, '"all rights reserved" or licensed -idiots').select(F.col("id").alias("doc_id"), F.round("rank", 9).alias("rank"))


@query(f"""WITH t AS (SELECT doc_id, {_WORDS.format("content")} AS ws FROM docs_pages)
SELECT doc_id FROM t WHERE NOT regexp_matches(ws, ' the ') AND NOT regexp_matches(ws, ' released under the ')""")
def fulltext_without(r):
    index = fulltext.build(r.docs_pages, "doc_id", "content", fulltext.SIMPLE)
    return fulltext.match(index, '-the -"released under the"').select(F.col("id").alias("doc_id"))


@query(f"""WITH t AS (SELECT *, coalesce(regexp_matches({_WORDS.format("description")}, ' licens(e|es|ed|ing)? '), false) AS matched FROM package_texts),
h AS (SELECT *, round(2 * {_sim("name", "'licensed'")} + {_sim("coalesce(description, '')", "'licensed'")} + CASE WHEN contains(lower(name), 'licensed') THEN 1.5 ELSE 0 END + CASE WHEN matched THEN 1 ELSE 0 END, 9) AS relevance
    FROM t WHERE contains(lower(name), 'licensed') OR contains(lower(coalesce(description, '')), 'licensed') OR list_contains(keywords, 'licensed') OR list_contains(categories, 'licensed') OR matched),
v AS (SELECT package_id, max(downloads) AS downloads, max(published_at) AS last_published, arg_max(version, (published_at, version_id)) AS latest_version FROM versions GROUP BY 1), d AS (SELECT target_id AS package_id, count(DISTINCT version_id) AS n FROM edges GROUP BY 1)
SELECT package_id, name, relevance, coalesce(downloads, 0) AS downloads, latest_version, last_published, coalesce(n, 0) AS depending_versions FROM h LEFT JOIN v USING (package_id) LEFT JOIN d USING (package_id) ORDER BY relevance DESC, coalesce(downloads, 0) DESC, name LIMIT 20""")
def search_fulltext(r):
    descriptions = fulltext.build(r.package_texts, "package_id", "description")
    return search.search_texts(r.package_texts, r.versions, r.edges, descriptions, "licensed", limit=20)


@query("SELECT doc_id, section, path, CASE WHEN instr(lower(content), 'license') > 0 THEN substring(content, greatest(instr(lower(content), 'license') - 80, 1), instr(lower(content), 'license') + 7 + 140 - greatest(instr(lower(content), 'license') - 80, 1)) ELSE substring(content, 1, 220) END AS snippet FROM docs_pages WHERE contains(lower(content), 'license') OR contains(lower(path), 'license')")
def docs_search(r):
    return search.search_docs(r.docs_pages, "license")


@query("SELECT doc_id, CASE WHEN instr(lower(content), 'thth') > 0 THEN substring(content, greatest(instr(lower(content), 'thth') - 80, 1), instr(lower(content), 'thth') + 4 + 140 - greatest(instr(lower(content), 'thth') - 80, 1)) ELSE substring(content, 1, 220) END AS snippet FROM docs_pages")
def docs_snippet(r):
    return r.docs_pages.select("doc_id", X.snippet(F.col("content"), "thth").alias("snippet"))


@query(r"""SELECT page_id, nullif(substring(trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1, 'is')), 1, 300), '') AS title,
substring(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')), 1, 1000000) AS content,
array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), '|') AS links FROM pages""")
def html_strip(r):
    html = F.col("html")
    return r.table("pages").select("page_id", X.html_title(html).alias("title"), X.strip_html(html).alias("content"), F.array_join(X.hrefs(html), "|").alias("links"))


@query("SELECT version_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(license, '[A-Za-z0-9.+:-]+'), lambda t: upper(t) NOT IN ('AND', 'OR', 'WITH')))), ',') AS tokens FROM versions WHERE license IS NOT NULL")
def license_tokens(r):
    return r.versions.where("license IS NOT NULL").select("version_id", F.array_join(X.license_tokens(F.col("license")), ",").alias("tokens"))


@query("""SELECT package_id, license, CASE WHEN license IS NULL THEN 'unknown' WHEN contains(license, 'GPL-3.0-only') THEN 'denied' WHEN NOT (contains(license, 'MIT') OR contains(license, 'Apache-2.0')) THEN 'denied' ELSE 'allowed' END AS status FROM latest_versions""")
def license_policy(r):
    return r.latest_versions.select("package_id", "license", X.license_status(F.col("license"), ["mit", "apache-2.0"], ["GPL-3.0-only"]).alias("status"))


@query("SELECT doc_id, path, line_no, severity, pattern, substring(trim(line), 1, 220) AS snippet FROM source_lines, (VALUES ('high', 'idiot'), ('high', 'secret'), ('medium', 'licensed'), ('medium', 'released under'), ('low', '###'), ('low', '!!'), ('low', 'all rights')) AS p(severity, pattern) WHERE contains(lower(line), pattern)")
def hotspots(r):
    return search.hotspots(r.source_lines)


@query("SELECT doc_id, path, min(line_no) AS line_no, arg_min(substring(trim(line), 1, 220), line_no) AS snippet, count(*) AS matches FROM source_lines WHERE contains(lower(line), 'thand') GROUP BY 1, 2")
def source_first_match(r):
    return search.first_match_per_file(r.source_lines, "thand")


@query("SELECT doc_id, path, line_no, place, substring(line, 1, 300) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY line_no) AS place FROM source_lines WHERE contains(lower(line), 'the ')) WHERE place <= 2")
def usage_capped(r):
    return search.matches_capped(r.source_lines, "the ", 2)


def _source_index(r: Registry) -> codesearch.Index:
    return codesearch.build(r.source_files, "doc_id", "path", "text")


@query(r"SELECT doc_id, path, min(line_no) AS line_no, arg_min(substring(trim(line), 1, 220), line_no) AS snippet, count(*) AS matches FROM source_lines WHERE regexp_matches(line, '(?i)released under the \w+ licen[sc]e') GROUP BY 1, 2")
def source_regex(r):
    lines = codesearch.matching_lines(_source_index(r), r"released under the \w+ licen[sc]e", expression=True)
    return codesearch.first_matches(lines).withColumnRenamed("id", "doc_id")


@query("SELECT doc_id, path, line_no, substring(line, 1, 300) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY line_no) AS place FROM source_lines WHERE regexp_matches(line, '(?i)(all rights|licensed) (reserved|under)') AND path LIKE '%/%1.txt') WHERE place <= 2 ORDER BY path, doc_id, line_no LIMIT 500")
def source_regex_capped(r):
    lines = codesearch.matching_lines(_source_index(r), "(all rights|licensed) (reserved|under)", expression=True, path_glob="*/*1.txt")
    return codesearch.capped(lines, 2, 500).withColumnRenamed("id", "doc_id")


@query("SELECT doc_id, path, line_no, line FROM source_lines WHERE contains(lower(line), 'idiot')")
def source_text(r):
    return codesearch.matching_lines(_source_index(r), "Idiot").withColumnRenamed("id", "doc_id")


@query("SELECT doc_id, path, string_agg(line, chr(10) ORDER BY line_no) AS content, min(line_no) AS first_line, max(line_no) AS last_line FROM source_lines WHERE line_no BETWEEN 2 AND 6 GROUP BY 1, 2")
def source_read(r):
    return search.read_lines(r.source_lines, 2, 6)


# symbols


@query("SELECT symbol_id, name, kind, path FROM symbols WHERE (contains(lower(name), 'ring') OR coalesce(contains(lower(path), 'ring'), false)) AND kind IN ('economy', 'promo') AND visibility = 'public'")
def symbol_search(r):
    return r.symbols.where(search.symbol_filters("ring", ["economy", "promo"], public_only=True)).select("symbol_id", "name", "kind", "path")


@query("SELECT count(*) AS hits, count(DISTINCT (name, kind)) AS collapsed FROM symbols WHERE contains(lower(name), 'ring') OR coalesce(contains(lower(path), 'ring'), false)")
def symbol_count(r):
    return r.symbols.where(search.symbol_filters("ring")).agg(F.count("*").alias("hits"), F.count_distinct(F.struct("name", "kind")).alias("collapsed"))


@query("SELECT DISTINCT ON (name, kind) name, kind, symbol_id, release FROM symbols ORDER BY name, kind, release DESC, symbol_id DESC")
def symbol_collapse(r):
    return search.newest_release_symbols(r.symbols, ["name", "kind"]).select("name", "kind", "symbol_id", "release")


_SURFACE = """DISTINCT ON (name, kind) name, kind, trim(signature) AS signature, lower(visibility) AS visibility FROM symbols WHERE (visibility = 'public' OR visibility IS NULL) AND release = {0}
    ORDER BY name, kind, CASE WHEN index_source = 'documented' THEN 0 ELSE 1 END, CASE WHEN signature IS NOT NULL THEN 0 ELSE 1 END, start_line, end_line, symbol_id"""
_DIFF = f"""WITH o AS (SELECT {_SURFACE.format(0)}), n AS (SELECT {_SURFACE.format(1)}),
d AS (SELECT coalesce(o.name, n.name) AS name, coalesce(o.kind, n.kind) AS kind, CASE WHEN n.name IS NULL THEN 'removed' WHEN o.name IS NULL THEN 'added' WHEN o.visibility IS DISTINCT FROM n.visibility THEN 'visibility_changed'
    WHEN o.signature IS DISTINCT FROM n.signature THEN 'signature_changed' END AS change, n.name IS NULL OR (o.name IS NOT NULL AND (o.signature IS DISTINCT FROM n.signature OR coalesce(o.visibility = 'public' AND n.visibility = 'private', false))) AS breaking
    FROM o FULL OUTER JOIN n ON o.name = n.name AND o.kind = n.kind)"""


def _diff(r):
    return api.difference(*[api.surface(r.symbols.where(F.col("release") == k), ["name", "kind"]) for k in (0, 1)])


@query(_DIFF + " SELECT name, kind, change, breaking FROM d WHERE change IS NOT NULL")
def api_diff(r):
    return _diff(r).select("name", "kind", "change", "breaking")


@query(_DIFF + " SELECT change, count(*) AS n, count(*) FILTER (WHERE breaking) AS breaking FROM d WHERE change IS NOT NULL GROUP BY 1")
def api_diff_counts(r):
    return _diff(r).groupBy("change").agg(F.count("*").alias("n"), F.count_if("breaking").alias("breaking"))


@query(_DIFF + " SELECT name, kind, change, CASE change WHEN 'removed' THEN 'replace' WHEN 'signature_changed' THEN 'adapt calls' WHEN 'visibility_changed' THEN 'stop using' END AS action FROM d WHERE breaking AND change IS NOT NULL")
def migration_actions(r):
    return _diff(r).where("breaking").select("name", "kind", "change", api.action(F.col("change")).alias("action"))


@query("SELECT name, kind, symbol_id, 'symbol' AS list FROM symbols WHERE deprecated UNION ALL SELECT name, kind, symbol_id, 'type' FROM symbols WHERE deprecated AND kind = 'standard'")
def deprecated_union(r):
    return api.deprecated_items(r.symbols)


@query("""SELECT symbol_id, CAST((CASE WHEN visibility = 'public' THEN 0 ELSE 1 END) * 100 + (CASE WHEN path IS NOT NULL THEN 0 ELSE 1 END) * 10 + CASE WHEN index_source = 'documented' THEN 0 ELSE 1 END AS BIGINT) AS rank, coalesce(path, 'root::' || name) AS import_path
FROM symbols WHERE lower(name) IN ('red widget', 'small ring') OR lower(list_extract(string_split(path, '::'), -1)) IN ('red widget', 'small ring')""")
def import_path_rank(r):
    names = r.spark.createDataFrame([("red widget",), ("small ring",)], "wanted string")
    return search.import_paths(r.symbols, names).select("symbol_id", "rank", "import_path")


@query("SELECT symbol_id, path, defined_at FROM symbols WHERE path IS NOT NULL AND defined_at IS NOT NULL AND path <> defined_at AND index_source = 'documented'")
def reexports(r):
    return r.symbols.where("path IS NOT NULL AND defined_at IS NOT NULL AND path <> defined_at AND index_source = 'documented'").select("symbol_id", "path", "defined_at")


@query("SELECT name, symbol_id, visibility FROM symbols QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE WHEN visibility = 'public' THEN 0 ELSE 1 END, CASE WHEN index_source = 'documented' AND path IS NOT NULL THEN 0 ELSE 1 END, start_line, symbol_id) = 1")
def type_best_row(r):
    return lookup.first_by(r.symbols, ["name"], F.when(F.col("visibility") == "public", 0).otherwise(1), F.when((F.col("index_source") == "documented") & F.col("path").isNotNull(), 0).otherwise(1), F.col("start_line"), F.col("symbol_id")).select("name", "symbol_id", "visibility")


_PLACES = "(SELECT f.file_id, l.line FROM (SELECT unnest(range(0, 20)) AS file_id) f, (SELECT unnest(range(5, 500, 45)) AS line) l)"


def _places(r):
    return r.spark.range(20).select(F.col("id").alias("file_id")).withColumn("line", F.explode(F.sequence(F.lit(5), F.lit(499), F.lit(45)))).withColumn("line", F.col("line").cast("long"))


@query(f"SELECT p.file_id, p.line, arg_max(s.name, (s.start_line, s.symbol_id)) AS name, max(s.start_line) AS start_line FROM {_PLACES} p JOIN symbols s ON s.file_id = p.file_id AND s.kind = 'promo' AND s.start_line <= p.line AND s.start_line >= p.line - 200 GROUP BY 1, 2")
def asof_containing(r):
    return api.containing(r.symbols, _places(r), "promo")


@query(f"SELECT file_id, line, symbol_id, distance, place FROM (SELECT p.file_id, p.line, s.symbol_id, abs(s.start_line - p.line) AS distance, row_number() OVER (PARTITION BY p.file_id, p.line ORDER BY abs(s.start_line - p.line), s.start_line, s.symbol_id) AS place FROM {_PLACES} p JOIN symbols s ON s.file_id = p.file_id) WHERE place <= 5")
def nearest_types(r):
    return api.nearest(r.symbols, _places(r), 5).select("file_id", "line", "symbol_id", "distance", "place")


# API documents; the same rows follow from the parts that the documents are made of

_SHOWN = """CASE WHEN p_partkey % 7 = 0 THEN 'pub' WHEN p_partkey % 11 = 0 THEN 'pub(in ::inner)' WHEN p_partkey % 5 = 0 THEN 'private' ELSE 'public' END"""
_PARTS = f"""p AS (SELECT *, p_partkey // 20 AS doc, {_SHOWN} AS visibility, CASE WHEN p_partkey % 2 = 0 THEN 'root::a::b::T' ELSE 'root::T' END || p_partkey AS defined_at FROM part),
ways AS (SELECT p_partkey, defined_at AS path FROM p UNION ALL SELECT p_partkey, 'root::T' || p_partkey FROM p WHERE p_partkey % 2 = 0 AND visibility = 'public'
    UNION ALL SELECT p.p_partkey, 'root::U' || u.p_partkey FROM p JOIN part u ON u.p_partkey BETWEEN p.p_partkey - 3 AND p.p_partkey WHERE p.p_partkey % 4 = 3 AND u.p_partkey % 3 <> 0),
best AS (SELECT p_partkey, arg_min(path, (len(string_split(path, '::')), len(path), path)) AS path FROM ways GROUP BY 1)"""


def _api_items(r: Registry) -> tuple[DataFrame, DataFrame]:
    return api_documents.items(r.api_documents), api_documents.paths(r.api_documents)


@query(f"""WITH {_PARTS}, s AS (SELECT doc, 's' || p_partkey AS id, 'T' || p_partkey AS name, 'struct' AS kind, visibility, 'struct T' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '<A: Clone>' ELSE '' END AS signature, best.path, defined_at, p.* FROM p JOIN best USING (p_partkey)
    UNION ALL SELECT doc, 'f' || p_partkey, 'size', 'struct_field', 'private', NULL, NULL, NULL, p.* FROM p UNION ALL SELECT doc, 'g' || p_partkey, 'run', 'function', 'public', 'fn run(self: Self, n: u32) -> bool', NULL, NULL, p.* FROM p)
SELECT doc, id, name, kind, visibility, signature, path, defined_at, greatest(p_size, 1) AS start_line, greatest(CAST(p_size + p_partkey % 9 AS INTEGER), 1) AS end_line, CASE WHEN p_partkey % 13 = 0 THEN '1.0' END AS deprecated_since, CASE WHEN p_partkey % 13 = 0 THEN p_brand END AS deprecated_note, p_type AS docs FROM s""")
def api_document_symbols(r):
    return api_documents.symbols(*_api_items(r)).drop("attrs")


@query(f"""WITH {_PARTS} SELECT doc, 'T' || p_partkey AS type_name, kind, visibility, best.path, CASE WHEN p_partkey % 3 = 0 THEN 'A: Clone' ELSE '' END AS generics, 'size: ' || CASE WHEN p_partkey % 2 = 0 THEN 'Vec<u8>' ELSE '&''a mut [T]' END AS fields,
CASE WHEN p_partkey % 10 = 0 AND p_partkey % 4 <> 0 THEN split_part(p_type, ' ', 1) ELSE '' END AS auto_traits, p_partkey % 6 = 0 AS is_non_exhaustive FROM p JOIN best USING (p_partkey), (SELECT 'struct' AS kind)""")
def api_document_types(r):
    rows = api_documents.types(*_api_items(r))
    fields = F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit(": "), f["type"])), ", ")
    return rows.select("doc", "type_name", "kind", "visibility", "path", F.array_join("generics", ", ").alias("generics"), fields.alias("fields"), F.array_join("auto_traits", ",").alias("auto_traits"), "is_non_exhaustive")


@query("""SELECT p_partkey // 20 AS doc, 'i' || p_partkey AS id, 'T' || p_partkey AS type_name, 'm::T' || p_partkey AS type_display, CASE WHEN p_partkey % 4 <> 0 THEN split_part(p_type, ' ', 1) END AS trait_name, CASE WHEN p_partkey % 4 <> 0 THEN 'fmt::' || split_part(p_type, ' ', 1) END AS trait_display,
CASE WHEN p_partkey % 4 = 0 THEN 'inherent' WHEN p_partkey % 10 = 0 THEN 'synthetic' WHEN p_partkey % 8 = 1 THEN 'blanket' WHEN p_partkey % 6 = 1 THEN 'derive' ELSE 'trait' END AS impl_kind, p_partkey % 8 = 1 AS is_blanket, p_partkey % 10 = 0 AS is_synthetic, p_partkey % 9 = 0 AS is_negative,
CASE WHEN p_partkey % 8 = 1 THEN 'B' END AS blanket_type, 'run' || CASE WHEN p_partkey % 5 = 0 THEN ' unsafe' ELSE '' END AS methods FROM part""")
def api_document_impls(r):
    rows = api_documents.implementations(api_documents.items(r.api_documents))
    methods = F.array_join(F.transform("methods", lambda m: F.concat(m["name"], F.when(m["is_unsafe"], " unsafe").otherwise(""))), ",")
    return rows.select("doc", "id", "type_name", "type_display", "trait_name", "trait_display", "impl_kind", "is_blanket", "is_synthetic", "is_negative", "blanket_type", methods.alias("methods"))


# items of source files; the same rows follow from the parts that the files are made of


def _source_items(r: Registry) -> DataFrame:
    return source_items.items(r.rust_files, "doc", "path", "text")


_PLACED = "p AS (SELECT *, p_partkey // 20 AS doc, CAST(14 * (p_partkey % 20 - min(p_partkey % 20) OVER (PARTITION BY p_partkey // 20)) AS INTEGER) AS above, CAST(p_partkey AS VARCHAR) AS k FROM part)"


@query(f"""WITH {_PLACED} SELECT doc AS package, 'crate' AS module, 'T' || k AS name, 'struct' AS kind, CASE WHEN p_partkey % 3 <> 0 THEN 'public' ELSE 'private' END AS visibility, CASE WHEN p_partkey % 3 <> 0 THEN 'pub ' ELSE '' END || 'struct T' || k || '<A: Clone>' AS signature, above + 5 AS start_line, above + 7 AS end_line FROM p
UNION ALL SELECT doc, 'crate', 'm' || k, 'module', 'public', 'pub mod m' || k, above + 11, above + 11 FROM p UNION ALL SELECT doc, 'crate::m' || k, 'inner' || k, 'function', 'public', 'pub fn inner' || k || '<''a>(x: &''a str)', above + 11, above + 11 FROM p
UNION ALL SELECT doc, 'crate::m' || k, 'mac', 'macro', 'private', 'macro_rules! mac', above + 11, above + 11 FROM p UNION ALL SELECT doc, 'crate', 'make' || k, 'function', 'public', 'pub fn make' || k || '(input: TokenStream) -> TokenStream', above + 13, above + 13 FROM p""")
def source_symbols(r):
    return source_items.symbols(_source_items(r)).drop("path")


@query(f"""WITH {_PLACED} SELECT doc AS package, 'T' || k AS type_name, CASE WHEN p_partkey % 4 <> 0 THEN 'm::T' || k || '<A>' ELSE 'T' || k || '<A>' END AS type_display, CASE WHEN p_partkey % 4 <> 0 THEN 'Display' END AS trait_name, CASE WHEN p_partkey % 4 <> 0 THEN 'fmt::Display' END AS trait_display,
CASE WHEN p_partkey % 4 <> 0 THEN 'trait' ELSE 'inherent' END AS impl_kind, 'pub fn run(&self) -> bool' AS methods, above + 8 AS start_line, above + 10 AS end_line FROM p
UNION ALL SELECT doc, 'T' || k, 'T' || k, t, d, 'derive', '', above + 5, above + 7 FROM p, (VALUES ('Clone', 'Clone'), ('Debug', 'fmt::Debug')) AS v(t, d) WHERE p_partkey % 2 = 0""")
def source_impls(r):
    return source_items.implementations(_source_items(r)).drop("path").withColumn("methods", F.array_join(F.transform("methods", lambda m: m["signature"]), ","))


@query(f"""WITH {_PLACED} SELECT doc AS package, CASE p_partkey % 5 WHEN 0 THEN 'derive' WHEN 1 THEN 'attribute' ELSE 'function' END AS macro, CASE WHEN p_partkey % 5 = 0 THEN 'D' ELSE 'make' END || k AS name, CASE p_partkey % 5 WHEN 0 THEN '#[derive(D' || k || ')]' WHEN 1 THEN '#[make' || k || '(...)]' ELSE 'make' || k || '!(...)' END AS usage,
CASE WHEN p_partkey % 5 = 0 THEN 'one,two' ELSE '' END AS accepted, above + 13 AS line FROM p WHERE p_partkey % 5 < 3""")
def macro_exports(r):
    return source_items.macro_exports(_source_items(r)).select("package", "macro", "name", "usage", F.array_join("accepted", ",").alias("accepted"), "line")


@query(f"""WITH {_PLACED} SELECT doc AS package, 'crate::build' || k AS alias, 'crate::make' || k AS target, 'function' AS kind FROM p UNION ALL SELECT doc, 'crate::alias' || k, 'crate::make' || k, 'function' FROM p UNION ALL SELECT doc, 'crate::inner' || k, 'crate::m' || k || '::inner' || k, 'function' FROM p""")
def resolved_reexports(r):
    return source_items.re_exports(_source_items(r)).select("package", "alias", "target", "kind")


@query(f"""WITH {_PLACED} SELECT doc AS package, 'T' || k AS type_name, 'part "' || k || '" {{}}' AS pattern FROM p WHERE p_partkey % 4 <> 0""")
def display_patterns(r):
    return source_items.display_patterns(_source_items(r)).select("package", "type_name", "pattern")


@query(f"""WITH {_PLACED}, u AS (SELECT doc, 3 * count(*) AS n FROM p GROUP BY 1)
SELECT doc AS package, above + 13 AS line, 'crate' AS module, n AS imports FROM p JOIN u USING (doc)""")
def imports_in_scope(r):
    found = _source_items(r)
    places = found.where("kind = 'function'").select("package", "path", F.col("start_line").alias("line"))
    return source_items.in_scope(found, places).groupBy("package", "line", "module").agg(F.count("*").alias("imports"))


# graph

_HOP = "hop AS (SELECT DISTINCT l.package_id, e.target_id, e.kind, e.optional FROM latest_versions l JOIN edges e USING (version_id))"
_BACK = "hop AS (SELECT DISTINCT e.target_id AS package_id, v.package_id AS target_id, e.kind, e.optional FROM edges e JOIN versions v USING (version_id))"
_WALK2 = """w1 AS (SELECT package_id AS root_id, package_id AS from_id, target_id AS to_id, kind, optional, CAST(1 AS BIGINT) AS depth FROM hop),
f1 AS (SELECT DISTINCT root_id, to_id AS package_id FROM w1), w2 AS (SELECT root_id, f1.package_id AS from_id, target_id AS to_id, kind, optional, CAST(2 AS BIGINT) AS depth FROM f1 JOIN hop USING (package_id)), w AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2)"""


@query(f"WITH {_HOP}, {_WALK2} SELECT * FROM w")
def graph_dependencies(r):
    return graph.walk_dependencies(r.packages, r.edges, r.versions, 2)


@query(f"WITH {_BACK}, {_WALK2} SELECT w.* FROM w JOIN packages p ON p.package_id = w.root_id")
def graph_dependents(r):
    return graph.walk_dependents(r.packages, r.edges, r.versions, 2)


@query(f"WITH {_HOP}, {_WALK2} SELECT root_id, node_id, min(distance) AS distance FROM (SELECT root_id, to_id AS node_id, depth AS distance FROM w UNION ALL SELECT root_id, root_id, 0 FROM w) GROUP BY 1, 2")
def graph_distances(r):
    return graph.distances(graph.walk_dependencies(r.packages, r.edges, r.versions, 2))


@query(f"WITH {_HOP}, {_WALK2} SELECT DISTINCT root_id FROM w WHERE to_id = root_id")
def graph_cycles(r):
    return graph.cyclic_roots(graph.walk_dependencies(r.packages, r.edges, r.versions, 2))


@query("""WITH RECURSIVE link AS (SELECT DISTINCT l.package_id AS a, e.target_id AS b FROM latest_versions l JOIN edges e USING (version_id) WHERE e.kind = 'build'), reach AS (SELECT a, b FROM link UNION SELECT r.a, link.b FROM reach r JOIN link ON link.a = r.b)
SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a""")
def dependency_cycles(r):
    links = r.edges.where("kind = 'build'").join(r.latest_versions.select("version_id", F.col("package_id").alias("a")), "version_id").select("a", F.col("target_id").alias("b"))
    return graph.strong_components(links)


# comparison


@query("""WITH d AS (SELECT e.target_id AS package_id, count(DISTINCT v.package_id) AS dependents FROM edges e JOIN versions v USING (version_id) GROUP BY 1), n AS (SELECT version_id, count(*) AS deps, count(DISTINCT kind) AS feats FROM edges GROUP BY 1), a AS (SELECT package_id, count(DISTINCT advisory_id) AS adv FROM advisories GROUP BY 1)
SELECT l.package_id, round(greatest(0, least(100, 50 + 8 * log10(downloads + 1) + 10 * log10(coalesce(dependents, 0) + 1) + 0.2 * least(coalesce(feats, 0), 20) + 2 * CASE WHEN license IS NOT NULL THEN 1 ELSE 0 END - 0.15 * coalesce(deps, 0) - 12 * coalesce(adv, 0) - 40 * CASE WHEN yanked THEN 1 ELSE 0 END)), 6) AS score
FROM latest_versions l LEFT JOIN d ON d.package_id = l.package_id LEFT JOIN n ON n.version_id = l.version_id LEFT JOIN a ON a.package_id = l.package_id""")
def maintenance_score(r):
    return maintenance_scores(r)


def maintenance_scores(r: Registry) -> DataFrame:
    own = r.edges.groupBy("version_id").agg(F.count("*").alias("deps"), F.count_distinct("kind").alias("feats"))
    adv = r.advisories.groupBy("package_id").agg(F.count_distinct("advisory_id").alias("adv"))
    rows = r.latest_versions.join(lookup.dependent_counts(r.edges, r.versions), "package_id", "left").join(own, "version_id", "left").join(adv, "package_id", "left").na.fill(0, ["dependents", "deps", "feats", "adv"])
    value = S.maintenance(F.col("downloads"), F.col("dependents"), F.col("feats"), F.col("license").isNotNull(), F.col("deps"), F.col("adv"), F.col("yanked"))
    return rows.select("package_id", F.round(value, 6).alias("score"))


@query(f"""WITH c AS (SELECT a.package_id, b.package_id AS other_id, {_sim("a.name", "b.name")} AS sim, CASE WHEN a.category = b.category THEN 1 ELSE 0 END AS cat, CASE WHEN a.keyword = b.keyword THEN 1 ELSE 0 END AS kw FROM packages a JOIN packages b ON a.package_id <> b.package_id WHERE a.package_id % 50 = 0),
d AS (SELECT e.target_id AS package_id, count(DISTINCT v.package_id) AS dependents FROM edges e JOIN versions v USING (version_id) GROUP BY 1), av AS (SELECT package_id, count(DISTINCT advisory_id) AS adv FROM advisories GROUP BY 1),
s AS (SELECT c.package_id, other_id, least(4 * sim, 4.0) + 1.5 * cat + kw + 0.15 * ln(downloads + 1) + 0.20 * ln(coalesce(dependents, 0) + 1) + greatest(0.0, least(2.0, 2 - (CAST(floor(epoch(TIMESTAMP '{AS_OF}') - epoch(published_at)) AS BIGINT) // 86400) / 365))
    - 1.25 * coalesce(adv, 0) - 5 * CASE WHEN yanked THEN 1 ELSE 0 END - CASE WHEN license IS NULL THEN 1 ELSE 0 END AS score
    FROM c JOIN latest_versions l ON l.package_id = other_id LEFT JOIN d ON d.package_id = other_id LEFT JOIN av ON av.package_id = other_id WHERE (cat + kw > 0 OR sim >= 0.3) AND NOT coalesce(contains(license, 'GPL-3.0-only'), false))
SELECT package_id, other_id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY round(score, 6) DESC, other_id) AS place FROM s) WHERE place <= 3""")
def alternatives_score(r):
    # a search: every 50th package is held against all packages
    adv = r.advisories.groupBy("package_id").agg(F.count_distinct("advisory_id").alias("adv"))
    policy = X.license_status(F.col("license"), [], ["GPL-3.0-only"])
    newest = lookup.timeline(r.latest_versions, F.lit(AS_OF).cast("timestamp")).where(policy != "denied").join(lookup.dependent_counts(r.edges, r.versions), "package_id", "left").join(adv, "package_id", "left").na.fill(0, ["dependents", "adv"])
    newest = newest.select("package_id", "downloads", "age_days", "yanked", "dependents", "adv", policy.alias("policy"))
    value = lambda *pair: S.alternative(*pair, F.col("downloads"), F.col("dependents"), F.col("age_days"), F.col("adv"), F.col("yanked"), F.col("policy"))
    packages = r.packages.select("package_id", "name", "category", "keyword")
    return search.alternatives(packages.where("package_id % 50 = 0"), packages.join(newest, "package_id"), value, 3)


# maintenance of the index


@query("""WITH old AS (SELECT package_id, name, balance FROM packages), new AS (SELECT package_id, CASE WHEN package_id % 3 = 0 THEN name || '!' ELSE name END AS name, CASE WHEN package_id % 5 = 0 THEN NULL ELSE balance END AS balance FROM packages WHERE package_id % 2 = 0)
SELECT new.package_id, new.name FROM new JOIN old USING (package_id) WHERE new.name IS DISTINCT FROM old.name OR new.balance IS DISTINCT FROM old.balance""")
def upsert_changed(r):
    old = r.packages.select("package_id", "name", "balance")
    return snapshot.changed(old, _incoming(r), ["package_id"], ["name", "balance"]).select("package_id", "name")


def _incoming(r: Registry) -> DataFrame:
    k = F.col("package_id")
    return r.packages.where(k % 2 == 0).select("package_id", F.when(k % 3 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")).alias("name"), F.when(k % 5 != 0, F.col("balance")).alias("balance"))


@query("""SELECT package_id, CASE WHEN package_id % 6 = 0 THEN name || '!' ELSE name END AS name, balance FROM packages""")
def upsert_coalesce(r):
    return snapshot.upsert(r.packages.select("package_id", "name", "balance"), _incoming(r), ["package_id"], coalesce=["balance"])


@query("SELECT version_id, package_id FROM versions WHERE version_id IN (SELECT version_id FROM edges WHERE kind = 'normal')")
def prune_unseen(r):
    return snapshot.prune(r.versions.select("version_id", "package_id"), r.edges.where("kind = 'normal'"), ["version_id"])


@query("SELECT advisory_id, severity, max(row_id) AS row_id FROM advisories GROUP BY 1, 2")
def dedup_greatest_id(r):
    return snapshot.newest_only(r.advisories.select("advisory_id", "severity", "row_id"), ["advisory_id", "severity"], "row_id")


@query("SELECT version_id, target_id, kind FROM edges WHERE version_id NOT IN (SELECT version_id FROM versions WHERE yanked) UNION ALL SELECT version_id, package_id, 'replaced' FROM versions WHERE yanked")
def replace_partition(r):
    fresh = r.versions.where("yanked").select("version_id", F.col("package_id").alias("target_id"), F.lit("replaced").alias("kind"))
    return snapshot.replace(r.edges.select("version_id", "target_id", "kind"), fresh, ["version_id"])


@query("SELECT DISTINCT p.package_id, 'security' AS scope FROM packages p WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.package_id = p.package_id AND j.scope = 'security' AND j.status IN ('pending', 'running'))")
def enqueue_missing(r):
    return snapshot.enqueue(r.jobs, r.packages.select("package_id", F.lit("security").alias("scope")))


# monitoring


@query(f"SELECT count(*) FILTER (WHERE status = 'pending' AND requested_at <= TIMESTAMP '2024-01-20') AS due, count(*) FILTER (WHERE status = 'pending' AND requested_at > TIMESTAMP '2024-01-20') AS delayed, count(*) FILTER (WHERE status = 'pending' AND attempts > 0) AS retrying, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'failed') AS failed FROM jobs")
def queue_counts(r):
    return monitor.queue_counts(r.jobs, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE {s} AND {t}) AS {a}_{b}" for a, s in (("in_flight", "status IN ('pending', 'running')"), ("failed", "status = 'failed'")) for b, t in (("1", "attempts = 1"), ("2", "attempts = 2"), ("3_or_more", "attempts >= 3"))) + " FROM jobs")
def retry_distribution(r):
    return monitor.retry_distribution(r.jobs)


@query("SELECT scope, count(*) AS failures FROM jobs WHERE status = 'failed' GROUP BY 1")
def failures_by_scope(r):
    return monitor.failures_by_scope(r.jobs)


@query("SELECT job_id, last_error, finished_at FROM jobs WHERE last_error IS NOT NULL AND last_error <> '' ORDER BY finished_at DESC NULLS LAST, job_id DESC LIMIT 10")
def recent_errors(r):
    return monitor.recent_errors(r.jobs, 10)


@query("SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'pending' AND priority >= 50) AS background, count(*) FILTER (WHERE status = 'pending' AND priority < 50) AS interactive FROM jobs")
def gauge_counts(r):
    return monitor.gauges(r.jobs)


@query("SELECT scope, count(*) AS pending FROM jobs WHERE status = 'pending' GROUP BY 1")
def pending_by_scope(r):
    return monitor.pending_by_scope(r.jobs)


@query("SELECT scope, count(*) AS finished, round(avg(epoch(finished_at) - epoch(requested_at)), 6) AS mean_seconds, CASE WHEN count(*) >= 3 THEN greatest(1, least(86400, CAST(round(avg(epoch(finished_at) - epoch(requested_at))) AS BIGINT))) END AS estimate FROM jobs WHERE status = 'finished' AND finished_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY GROUP BY 1")
def eta_stats(r):
    return monitor.eta(r.jobs, _now(EVENTS_AS_OF)).withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("SELECT count(*) AS calls, round(avg(latency_ms), 6) AS mean_latency, round(count(*) FILTER (WHERE NOT success) / count(*), 6) AS error_rate, round(count(*) FILTER (WHERE hit) / count(*), 6) AS hit_rate FROM invocations WHERE created_at > TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR AND created_at <= TIMESTAMP '2024-01-31'")
def operations_24h(r):
    return monitor.operations(r.invocations, _now(EVENTS_AS_OF)).select("calls", *[F.round(c, 6).alias(c) for c in ("mean_latency", "error_rate", "hit_rate")])


@query("SELECT tool, quantile_disc(latency_ms, 0.95) AS value, count(*) AS n FROM invocations GROUP BY 1")
def p95_latency(r):
    return monitor.nearest_rank(r.invocations, ["tool"], "latency_ms")


@query("SELECT DISTINCT ON (scope) scope, job_id, 'running' AS status, attempts + 1 AS attempts FROM jobs WHERE status = 'pending' AND requested_at <= TIMESTAMP '2024-01-31' ORDER BY scope, priority, attempts, requested_at, job_id")
def claim_next(r):
    return monitor.claimed_per_scope(r.jobs, _now(EVENTS_AS_OF)).select("scope", "job_id", "status", "attempts")


@query("""SELECT job_id, CASE WHEN status <> 'running' THEN status WHEN job_id % 3 <> 0 THEN 'finished' WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS status,
CASE WHEN status = 'running' AND job_id % 3 = 0 AND attempts < 3 THEN TIMESTAMP '2024-01-31' + to_seconds(CAST(least(5 * pow(2, least(greatest(attempts - 1, 0), 5)), 300) AS BIGINT)) ELSE requested_at END AS requested_at, CASE WHEN status = 'running' AND job_id % 3 = 0 THEN 'stopped' ELSE last_error END AS last_error FROM jobs""")
def job_transitions(r):
    outcomes = r.jobs.where("status = 'running'").select("job_id", (F.col("job_id") % 3 != 0).alias("ok"), F.lit("stopped").alias("error"))
    return monitor.advanced(r.jobs, outcomes, _now(EVENTS_AS_OF), S.retry_delay(F.col("attempts"))).select("job_id", "status", "requested_at", "last_error")


@query("SELECT tool, time_bucket(INTERVAL 1 DAY, created_at, TIMESTAMP '1970-01-01') AS day, count(*) AS calls, round(avg(latency_ms), 6) AS mean_latency FROM invocations GROUP BY 1, 2")
def tumbling_latency(r):
    day = F.window(F.col("created_at").cast("timestamp"), "1 day")
    return r.invocations.groupBy("tool", day.alias("w")).agg(F.count("*").alias("calls"), F.round(F.avg("latency_ms"), 6).alias("mean_latency")).select("tool", F.col("w.start").cast("timestamp_ntz").alias("day"), "calls", "mean_latency")


@query("""WITH s AS (SELECT user_id, created_at, CASE WHEN created_at < lag(created_at) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM invocations WINDOW w AS (PARTITION BY user_id ORDER BY created_at, event_id)),
n AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS session FROM s) SELECT user_id, min(created_at) AS started, count(*) AS calls FROM n GROUP BY user_id, session""")
def sessions(r):
    gap = F.session_window(F.col("created_at").cast("timestamp"), "30 minutes")
    return r.invocations.groupBy("user_id", gap.alias("w")).agg(F.count("*").alias("calls")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "calls")


# resolution and advisories; version keys are numbers here, so SQL can follow


@query("SELECT version_id, package_id, dense_rank() OVER (PARTITION BY package_id ORDER BY CAST(split_part(version, '.', 2) AS BIGINT), CAST(split_part(version, '.', 3) AS BIGINT)) AS place FROM versions")
def semver_order(r):
    w = Window.partitionBy("package_id").orderBy("key")
    return resolve.keyed(r.versions).withColumn("place", F.dense_rank().over(w).cast("long")).select("version_id", "package_id", "place")


_WANTED = "w AS (SELECT DISTINCT e.target_id AS package_id, e.requirement, e.least_minor FROM edges e JOIN latest_versions l USING (version_id) WHERE NOT e.optional)"
_PICKED = f"""{_WANTED}, k AS (SELECT *, CAST(split_part(version, '.', 2) AS BIGINT) AS minor, CAST(split_part(version, '.', 3) AS BIGINT) AS patch FROM versions),
p AS (SELECT w.package_id, w.requirement, arg_max(k.version_id, (k.minor, k.patch, k.published_at, k.version_id)) AS version_id FROM w LEFT JOIN k ON k.package_id = w.package_id AND k.minor >= w.least_minor GROUP BY 1, 2)"""


def _wanted(r):
    return r.edges.join(r.latest_versions.select("version_id"), "version_id").where("NOT optional").select(F.col("target_id").alias("package_id"), "requirement").distinct()


@query(f"WITH {_PICKED} SELECT package_id, requirement, p.version_id, v.version, CASE WHEN NOT EXISTS (SELECT 1 FROM versions x WHERE x.package_id = p.package_id) THEN 'unknown_package' WHEN p.version_id IS NULL THEN 'unsatisfied' ELSE 'selected' END AS status FROM p LEFT JOIN (SELECT version_id, version FROM versions) v ON v.version_id = p.version_id")
def dependency_resolve(r):
    return resolve.selected(_wanted(r), r.versions).select("package_id", "requirement", "version_id", "version", "status")


@query(f"WITH {_WANTED}, n AS (SELECT package_id, count(DISTINCT requirement) AS asked, max(least_minor) AS top FROM w GROUP BY 1 HAVING count(DISTINCT requirement) > 1), m AS (SELECT package_id, max(CAST(split_part(version, '.', 2) AS BIGINT)) AS minor FROM versions GROUP BY 1) SELECT n.package_id, n.asked FROM n LEFT JOIN m USING (package_id) WHERE coalesce(minor, -1) < top")
def dependency_conflicts(r):
    return resolve.jointly_unsatisfied(_wanted(r), r.versions).select("package_id", "asked")


@query("""WITH base AS (SELECT DISTINCT l.package_id AS root_id, e.target_id AS package_id, e.least_minor FROM latest_versions l JOIN edges e USING (version_id) WHERE NOT e.optional),
k AS (SELECT *, CAST(split_part(version, '.', 2) AS BIGINT) AS minor, CAST(split_part(version, '.', 3) AS BIGINT) AS patch FROM versions), tops AS (SELECT package_id, max(minor) AS top FROM k GROUP BY 1),
s0 AS (SELECT root_id, package_id, max(least_minor) AS need FROM base GROUP BY 1, 2),
p0 AS (SELECT root_id, package_id, arg_max(k.version_id, (minor, patch, published_at, k.version_id)) AS version_id FROM s0 JOIN k USING (package_id) WHERE minor >= need GROUP BY 1, 2),
asked AS (SELECT * FROM base UNION SELECT root_id, e.target_id, e.least_minor FROM p0 JOIN edges e USING (version_id) WHERE NOT e.optional),
s1 AS (SELECT root_id, package_id, max(least_minor) AS need, count(DISTINCT least_minor) AS n_requirements FROM asked GROUP BY 1, 2),
p1 AS (SELECT root_id, package_id, arg_max(k.version_id, (minor, patch, published_at, k.version_id)) AS version_id FROM s1 JOIN k USING (package_id) WHERE minor >= need GROUP BY 1, 2)
SELECT root_id, package_id, n_requirements, version_id, CASE WHEN version_id IS NOT NULL THEN 'selected' WHEN top IS NULL THEN 'unknown_package' ELSE 'unsatisfied' END AS status FROM s1 LEFT JOIN p1 USING (root_id, package_id) LEFT JOIN tops USING (package_id)""")
def dependency_resolve_graph(r):
    newest = r.latest_versions.select("version_id", F.col("package_id").alias("root_id"))
    roots = r.edges.where("NOT optional").join(newest, "version_id").select("root_id", F.col("target_id").alias("package_id"), "requirement")
    return resolve.resolved(roots, r.versions, r.edges, levels=2).select("root_id", "package_id", F.size("requirements").cast("long").alias("n_requirements"), "version_id", "status")


_STATES = """k AS (SELECT version_id, package_id, CAST(split_part(version, '.', 2) AS BIGINT) AS minor FROM versions),
rows AS (SELECT k.version_id, a.advisory_id, a.affected_range LIKE 'withdrawn=%' AS silenced, CASE WHEN a.affected_range LIKE 'withdrawn=%' THEN 0
    WHEN a.affected_range LIKE 'SEMVER%' THEN CASE WHEN minor < CAST(regexp_extract(a.affected_range, 'fixed=1\\.(\\d+)', 1) AS BIGINT) THEN 2 ELSE 0 END
    WHEN a.source = 'rustsec_db' THEN CASE WHEN minor >= CAST(regexp_extract(a.affected_range, '1\\.(\\d+)', 1) AS BIGINT) THEN 0 ELSE 2 END
    WHEN a.source = 'ghsa' THEN CASE WHEN minor >= CAST(regexp_extract(a.affected_range, '>= 1\\.(\\d+)', 1) AS BIGINT) AND minor < CAST(regexp_extract(a.affected_range, '< 1\\.(\\d+)', 1) AS BIGINT) THEN 2 ELSE 0 END ELSE 1 END AS strength
    FROM k JOIN advisories a USING (package_id)),
st AS (SELECT version_id, advisory_id, max(strength) AS strength FROM rows GROUP BY 1, 2 HAVING NOT bool_or(silenced))"""


@query(f"WITH {_STATES} SELECT version_id, advisory_id, CASE strength WHEN 2 THEN 'affected' ELSE 'unknown' END AS state FROM st WHERE strength > 0")
def advisory_states(r):
    return resolve.advisories_of(r.versions, r.advisories).select("version_id", "advisory_id", "state")


def _sync(r: Registry) -> advisory_sync.Synced:
    """A round in which a part of the questions fails, over rows of which some go and all others become critical."""
    rows = r.advisories.select("row_id", "package_id", "source", "advisory_id", F.when(F.col("row_id") % 2 == 0, F.col("row_id")).alias("version_id"), "affected_range", "severity")
    feed = rows.where("row_id % 5 <> 0").withColumn("severity", F.lit("critical")).drop("row_id")
    source = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(k).alias("k")) for k, s in enumerate(("osv", "ghsa", "rustsec_db"))]))
    answers = r.packages.select("package_id", source.alias("s")).select("package_id", "s.source", ((F.col("package_id") * 7 + F.col("s.k")) % 4 != 0).alias("ok"), F.lit("stopped").alias("message"))
    stamps = r.packages.where("package_id % 2 = 0").select("package_id", _now("2001-06-01 00:00:00").alias("checked_at"))
    return advisory_sync.synced(rows.drop("row_id"), feed, answers, stamps, _now())


_ANSWERS = """e AS (SELECT row_id, package_id, source, advisory_id, CASE WHEN row_id % 2 = 0 THEN row_id END AS version_id, affected_range, severity FROM advisories),
a AS (SELECT package_id, source, (package_id * 7 + k) % 4 <> 0 AS ok FROM packages, (VALUES ('osv', 0), ('ghsa', 1), ('rustsec_db', 2)) AS s(source, k))"""


@query(f"""WITH {_ANSWERS}, f AS (SELECT DISTINCT ON (package_id, source, advisory_id, version_id) package_id, source, advisory_id, version_id, affected_range, 'critical' AS severity FROM e JOIN a USING (package_id, source) WHERE ok AND row_id % 5 <> 0 ORDER BY package_id, source, advisory_id, version_id, affected_range DESC)
SELECT package_id, source, advisory_id, version_id, affected_range, severity FROM e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.ok AND a.package_id = e.package_id AND a.source = e.source) UNION ALL SELECT * FROM f""")
def advisory_rows_synced(r):
    return _sync(r).rows


@query(f"""WITH {_ANSWERS}, c AS (SELECT package_id FROM a GROUP BY 1 HAVING bool_and(ok)) SELECT p.package_id, CASE WHEN c.package_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '2001-06-01' END AS checked_at
FROM packages p LEFT JOIN c ON c.package_id = p.package_id WHERE c.package_id IS NOT NULL OR p.package_id % 2 = 0""")
def advisory_stamps(r):
    return _sync(r).stamps


@query(f"WITH {_STATES} SELECT l.version_id, count(*) FILTER (WHERE strength = 2) AS affected, count(*) FILTER (WHERE strength = 1) AS unknown FROM latest_versions l LEFT JOIN st USING (version_id) GROUP BY 1")
def advisory_counts(r):
    return resolve.advisory_counts(r.latest_versions, r.advisories)


@query(f"""WITH {_PICKED}, {_STATES.replace("k AS", "kk AS").replace("FROM k JOIN", "FROM kk JOIN").replace("k.version_id", "kk.version_id")}, c AS (SELECT version_id, count(*) FILTER (WHERE strength = 2) AS affected, count(*) FILTER (WHERE strength = 1) AS unknown FROM st GROUP BY 1)
SELECT p.package_id, p.requirement, array_to_string(list_filter([CASE WHEN l.version_id IS NULL THEN 'not_indexed' END, CASE WHEN v.yanked THEN 'yanked' END, CASE WHEN affected > 0 THEN 'has_advisory' END, CASE WHEN unknown > 0 THEN 'advisory_applicability_unknown' END,
    CASE WHEN v.version <> l.version THEN 'outdated' END, CASE WHEN l.version_id IS NOT NULL AND p.version_id IS NULL THEN 'unsatisfied' END, CASE WHEN NOT (l.version_id IS NULL OR coalesce(v.yanked, false) OR coalesce(affected, 0) > 0 OR coalesce(unknown, 0) > 0 OR coalesce(v.version <> l.version, false) OR p.version_id IS NULL) THEN 'ok' END], lambda x: x IS NOT NULL), ',') AS markers
FROM p LEFT JOIN (SELECT version_id, version, yanked FROM versions) v ON v.version_id = p.version_id LEFT JOIN latest_versions l ON l.package_id = p.package_id LEFT JOIN c ON c.version_id = p.version_id""")
def dependency_audit(r):
    return resolve.audited(_wanted(r), r.versions, r.advisories).select("package_id", "requirement", F.array_join("markers", ",").alias("markers"))


@query("""WITH f AS (SELECT DISTINCT version_id, kind AS feature, 'p' || target_id AS name, optional FROM edges), link AS (SELECT DISTINCT version_id, 'dev' AS a, 'build' AS b FROM f WHERE feature = 'dev'),
need AS (SELECT version_id, name FROM f GROUP BY 1, 2 HAVING bool_and(optional)), s AS (SELECT DISTINCT version_id, feature FROM f UNION SELECT version_id, 'dev' FROM link),
hit AS (SELECT s.version_id, s.feature, f.name FROM s JOIN f ON f.version_id = s.version_id AND (f.feature = s.feature OR (s.feature = 'dev' AND f.feature = 'build')) JOIN need ON need.version_id = f.version_id AND need.name = f.name)
SELECT s.version_id, s.feature, coalesce(string_agg(DISTINCT hit.name, ',' ORDER BY hit.name), '') AS brings, count(DISTINCT hit.name) >= 2 AS heavy FROM s LEFT JOIN hit USING (version_id, feature) GROUP BY 1, 2""")
def feature_impact(r):
    return _impact(r.edges)


def _impact(edges: DataFrame) -> DataFrame:
    base = edges.select("version_id", F.col("kind").alias("feature"), F.concat(F.lit("p"), "target_id").alias("name"), "optional").distinct()
    own = base.select("version_id", "feature", F.col("name").alias("target"), F.lit(True).alias("is_dependency"))
    chain = base.where("feature = 'dev'").select("version_id", "feature", F.lit("build").alias("target"), F.lit(False).alias("is_dependency")).distinct()
    return resolve.feature_impact(own.unionByName(chain), base.select("version_id", "name", "optional"), heavy=2).select("version_id", "feature", F.array_join("brings", ",").alias("brings"), "heavy")


_LISTING = """WITH RECURSIVE link AS (SELECT version_id, feature, target FROM features WHERE target NOT LIKE 'dep:%'),
reach AS (SELECT version_id, feature, target FROM link UNION SELECT r.version_id, r.feature, l.target FROM reach r JOIN link l ON l.version_id = r.version_id AND l.feature = r.target)"""


@query(_LISTING + """ SELECT f.version_id, f.feature, EXISTS (SELECT 1 FROM link d WHERE d.version_id = f.version_id AND d.feature = 'default' AND d.target = f.feature) AS is_default,
coalesce(string_agg(DISTINCT target, ',' ORDER BY target) FILTER (WHERE target NOT LIKE 'dep:%'), '') AS enables, coalesce(string_agg(DISTINCT substring(target, 5), ',' ORDER BY substring(target, 5)) FILTER (WHERE target LIKE 'dep:%'), '') AS dependencies,
coalesce(any_value(t.transitive), '') AS transitive FROM features f LEFT JOIN (SELECT version_id, feature, string_agg(target, ',' ORDER BY target) AS transitive FROM reach GROUP BY 1, 2) t USING (version_id, feature) GROUP BY 1, 2""")
def feature_listing(r):
    rows = resolve.feature_listing(r.features)
    return rows.select("version_id", "feature", "is_default", *[F.array_join(c, ",").alias(c) for c in ("enables", "dependencies", "transitive")])


@query(_LISTING + """, own AS (SELECT version_id, feature, feature AS at FROM features UNION SELECT version_id, feature, target FROM reach),
need AS (SELECT version_id, 'p' || target_id AS name FROM edges GROUP BY 1, 2 HAVING bool_and(optional)), hit AS (SELECT DISTINCT o.version_id, o.feature, substring(f.target, 5) AS name FROM own o JOIN features f ON f.version_id = o.version_id AND f.feature = o.at AND f.target LIKE 'dep:%'),
kept AS (SELECT hit.* FROM hit JOIN need USING (version_id, name))
SELECT s.version_id, s.feature, coalesce(string_agg(kept.name, ',' ORDER BY kept.name), '') AS brings, count(kept.name) >= 2 AS heavy FROM (SELECT DISTINCT version_id, feature FROM features) s LEFT JOIN kept USING (version_id, feature) GROUP BY 1, 2""")
def feature_closure(r):
    is_dependency = F.col("target").startswith("dep:")
    rows = r.features.select("version_id", "feature", F.when(is_dependency, F.substring("target", 5, 1 << 20)).otherwise(F.col("target")).alias("target"), is_dependency.alias("is_dependency"))
    needs = r.edges.select("version_id", F.concat(F.lit("p"), "target_id").alias("name"), "optional")
    return resolve.feature_impact(rows, needs, heavy=2).select("version_id", "feature", F.array_join("brings", ",").alias("brings"), "heavy")


_PAIRS = """o AS (SELECT package_id, version_id, version, row_number() OVER (PARTITION BY package_id ORDER BY published_at DESC NULLS LAST, version_id DESC) AS place, CAST(split_part(version, '.', 2) AS BIGINT) AS minor FROM versions),
x AS (SELECT ab.package_a, ab.package_b, a.version_id AS id_a, b.version_id AS id_b, a.version AS version_a, b.version AS version_b, a.place AS place_a, b.place AS place_b, a.minor AS minor_a, b.minor AS minor_b FROM ab JOIN o a ON a.package_id = package_a JOIN o b ON b.package_id = package_b WHERE a.place <= 5 AND b.place <= 5),
e AS (SELECT x.*, edges.target_id, least_minor, requirement FROM x JOIN edges ON edges.version_id IN (x.id_a, x.id_b)), tops AS (SELECT package_id AS target_id, max(minor) AS top FROM o GROUP BY 1),
direct AS (SELECT id_a, id_b, package_a, package_b FROM e WHERE (target_id = package_a AND minor_a < least_minor) OR (target_id = package_b AND minor_b < least_minor)),
joint AS (SELECT id_a, id_b, package_a, package_b FROM e LEFT JOIN tops USING (target_id) GROUP BY 1, 2, 3, 4, target_id, top HAVING count(*) > 1 AND coalesce(top, -1) < max(least_minor)),
n AS (SELECT id_a, id_b, package_a, package_b, count(*) AS conflicts FROM (SELECT * FROM direct UNION ALL SELECT * FROM joint) GROUP BY 1, 2, 3, 4)"""


@query(f"WITH ab AS (SELECT 3 AS package_a, 7 AS package_b), {_PAIRS} SELECT version_a, version_b, coalesce(conflicts, 0) = 0 AS resolvable, coalesce(conflicts, 0) AS conflicts FROM x LEFT JOIN n USING (id_a, id_b, package_a, package_b)")
def compatibility_matrix(r):
    pairs = r.spark.createDataFrame([(3, 7)], "package_a long, package_b long")
    return resolve.compatibility(pairs, r.versions, r.edges).select("version_a", "version_b", "resolvable", "conflicts")


@query(f"WITH ab AS (SELECT DISTINCT l.package_id AS package_a, e.target_id AS package_b FROM latest_versions l JOIN edges e USING (version_id) WHERE l.package_id <> e.target_id), {_PAIRS} SELECT package_a, package_b, count(*) AS tested, count(*) FILTER (WHERE conflicts IS NULL) AS compatible FROM x LEFT JOIN n USING (id_a, id_b, package_a, package_b) GROUP BY 1, 2")
def compatibility_of_dependencies(r):
    newest = r.latest_versions.select("version_id", F.col("package_id").alias("package_a"))
    pairs = r.edges.join(newest, "version_id").select("package_a", F.col("target_id").alias("package_b")).where("package_a <> package_b").distinct()
    return resolve.compatibility(pairs, r.versions, r.edges).groupBy("package_a", "package_b").agg(F.count("*").alias("tested"), F.count_if("resolvable").alias("compatible"))


# types, traits and their implementations

_KIND_RANK = "CASE impl_kind WHEN 'inherent' THEN 0 WHEN 'derive' THEN 1 WHEN 'trait' THEN 2 ELSE 3 END"
_SOURCE_RANK = "CASE WHEN index_source = 'documented' AND (coalesce(len(methods), 0) > 0 OR trait_display IS NOT NULL OR is_blanket OR is_synthetic OR is_negative) THEN 0 WHEN index_source = 'documented' THEN 1 ELSE 2 END"
_ONE_IMPL = f"""one AS (SELECT * FROM impls QUALIFY row_number() OVER (PARTITION BY release, lower(type_name), coalesce(lower(type_display), ''), coalesce(lower(trait_name), ''), coalesce(lower(trait_display), ''), impl_kind ORDER BY CASE WHEN index_source = 'documented' THEN 4 ELSE 0 END + CASE WHEN coalesce(len(methods), 0) > 0 THEN 2 ELSE 0 END
    + CASE WHEN trait_display IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN has_bounds THEN 1 ELSE 0 END + CASE WHEN is_blanket THEN 1 ELSE 0 END DESC, {_KIND_RANK}, {_SOURCE_RANK}, type_name, start_line, impl_id) = 1)"""


@query(f"SELECT impl_id, type_name, trait_name, CAST({_KIND_RANK} AS BIGINT) AS kind_rank, CAST({_SOURCE_RANK} AS BIGINT) AS source_rank, CAST(coalesce(len(methods), 0) AS BIGINT) AS n_methods FROM impls WHERE lower(trait_name) IN ('economy', 'promo') AND release = 1")
def impl_rows(r):
    rows = types.implementations(r.impls.where("release = 1"), traits=["Economy", "PROMO"])
    return rows.select("impl_id", "type_name", "trait_name", F.col("kind_rank").cast("long").alias("kind_rank"), F.col("source_rank").cast("long").alias("source_rank"), F.size(types.methods()).cast("long").alias("n_methods"))


@query(f"WITH {_ONE_IMPL} SELECT impl_id, type_name, trait_name, impl_kind FROM one")
def impl_dedup(r):
    return types.one_of_each(r.impls).select("impl_id", "type_name", "trait_name", "impl_kind")


@query(f"""WITH {_ONE_IMPL}, best AS (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY release, lower(name) ORDER BY CASE WHEN visibility = 'public' THEN 0 ELSE 1 END, CASE WHEN index_source = 'documented' AND path IS NOT NULL THEN 0 ELSE 1 END, start_line, symbol_id) = 1),
m AS (SELECT release, lower(type_name) AS key, string_agg(DISTINCT u, ',' ORDER BY u) AS methods FROM (SELECT release, type_name, unnest(methods) AS u FROM one WHERE impl_kind = 'inherent') GROUP BY 1, 2)
SELECT one.release, lower(type_name) AS key, coalesce(any_value(m.methods), '') AS methods, count(*) FILTER (WHERE impl_kind <> 'inherent') AS others, coalesce(string_agg(DISTINCT lower(trait_name), ',' ORDER BY lower(trait_name)), '') AS traits, any_value(best.symbol_id) AS symbol_id, any_value(best.path) AS path
FROM one LEFT JOIN m ON m.release = one.release AND m.key = lower(type_name) LEFT JOIN best ON best.release = one.release AND lower(best.name) = lower(type_name) GROUP BY 1, 2""")
def type_info(r):
    return types.by_type(r.impls, r.symbols).select("release", "key", F.array_join("methods", ",").alias("methods"), "others", F.array_join("traits", ",").alias("traits"), "symbol_id", "path")


@query(f"WITH {_ONE_IMPL} SELECT release, lower(trait_name) AS key, count(DISTINCT lower(type_name)) AS types, count(*) FILTER (WHERE impl_kind = 'derive') AS derived, count(*) FILTER (WHERE is_blanket) AS blanket FROM one WHERE trait_name IS NOT NULL GROUP BY 1, 2")
def trait_impls(r):
    return types.by_trait(r.impls)


# states of the index by package and version


@query("SELECT version_id, count(*) FILTER (WHERE kind = 'normal') > 0 AS has_normal, count(*) FILTER (WHERE optional) > 0 AS has_optional FROM edges GROUP BY 1")
def content_flags(r):
    return r.edges.groupBy("version_id").agg(F.bool_or(F.col("kind") == "normal").alias("has_normal"), F.bool_or("optional").alias("has_optional"))


@query("SELECT package_id, max(finished_at) AS checked_at, coalesce(max(finished_at) < TIMESTAMP '2024-01-24', true) AS due FROM packages LEFT JOIN (SELECT package_id, finished_at FROM jobs WHERE scope = 'security' AND status = 'finished') USING (package_id) GROUP BY 1")
def security_due(r):
    done = r.jobs.where("scope = 'security' AND status = 'finished'").groupBy("package_id").agg(F.max("finished_at").alias("checked_at"))
    return r.packages.select("package_id").join(done, "package_id", "left").withColumn("due", F.coalesce(F.col("checked_at") < F.lit("2024-01-24 00:00:00").cast("timestamp_ntz"), F.lit(True)))


@query("SELECT version_id, package_id, version FROM versions v WHERE NOT yanked AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.package_id = v.package_id AND j.scope = 'docs' AND j.status = 'finished' AND j.finished_at >= TIMESTAMP '2024-01-30')")
def enrichment_candidates(r):
    fresh = r.jobs.where((F.col("scope") == "docs") & (F.col("status") == "finished") & (F.col("finished_at") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")))
    return r.versions.where("NOT yanked").join(fresh.select("package_id"), "package_id", "left_anti").select("version_id", "package_id", "version")


@query("SELECT version_id, p.name || '-' || version AS key FROM versions JOIN packages p USING (package_id)")
def version_keys(r):
    return r.versions.join(r.packages.select("package_id", "name"), "package_id").select("version_id", F.concat_ws("-", "name", "version").alias("key"))


@query("SELECT max(published_at) AS versions, (SELECT max(created_at) FROM invocations) AS invocations, (SELECT max(finished_at) FROM jobs) AS jobs FROM versions")
def index_freshness(r):
    latest = lambda df, c, n: df.agg(F.max(c).alias("t")).select(F.lit(n).alias("of"), "t")
    both = latest(r.versions, "published_at", "versions").unionAll(latest(r.invocations, "created_at", "invocations")).unionAll(latest(r.jobs, "finished_at", "jobs"))
    return both.agg(*[F.max(F.when(F.col("of") == n, F.col("t"))).alias(n) for n in ("versions", "invocations", "jobs")])


@query("""SELECT v.version_id, v.package_id, v.version_id = l.version_id AS is_latest, v.yanked, CAST(floor(epoch(TIMESTAMP '2002-01-01') - epoch(v.published_at)) AS BIGINT) // 86400 >= 365 AS is_legacy,
coalesce(a.n, 0) AS advisories FROM versions v JOIN latest_versions l USING (package_id) LEFT JOIN (SELECT package_id, count(DISTINCT advisory_id) AS n FROM advisories GROUP BY 1) a ON a.package_id = v.package_id""")
def version_markers(r):
    newest = r.latest_versions.select("package_id", F.col("version_id").alias("latest_id"))
    adv = r.advisories.groupBy("package_id").agg(F.count_distinct("advisory_id").alias("advisories"))
    rows = lookup.timeline(r.versions, F.lit(AS_OF).cast("timestamp")).join(newest, "package_id").join(adv, "package_id", "left")
    return rows.select("version_id", "package_id", (F.col("version_id") == F.col("latest_id")).alias("is_latest"), "yanked", (F.col("age_days") >= 365).alias("is_legacy"), F.coalesce("advisories", F.lit(0)).alias("advisories"))


@query("""WITH t AS (SELECT package_id, sum(downloads) AS total, count(*) AS n, count(*) FILTER (WHERE yanked) AS y FROM versions GROUP BY 1), d AS (SELECT e.target_id AS package_id, count(DISTINCT v.package_id) AS dep FROM edges e JOIN versions v USING (version_id) GROUP BY 1),
o AS (SELECT version_id, count(*) AS deps FROM edges GROUP BY 1)
SELECT p.package_id, p.name, l.version, CAST(total AS BIGINT) AS total_downloads, n AS n_versions, y AS yanked_versions, coalesce(dep, 0) AS dependents, coalesce(deps, 0) AS dependencies, deps IS NOT NULL AS dependencies_known
FROM packages p JOIN latest_versions l USING (package_id) JOIN t ON t.package_id = p.package_id LEFT JOIN d ON d.package_id = p.package_id LEFT JOIN o ON o.version_id = l.version_id""")
def package_intel(r):
    totals = r.versions.groupBy("package_id").agg(F.sum("downloads").alias("total_downloads"), F.count("*").alias("n_versions"), F.count_if("yanked").alias("yanked_versions"))
    own = r.edges.groupBy("version_id").agg(F.count("*").alias("dependencies"))
    rows = r.packages.select("package_id", "name").join(r.latest_versions.select("package_id", "version_id", "version"), "package_id").join(totals, "package_id").join(lookup.dependent_counts(r.edges, r.versions), "package_id", "left").join(own, "version_id", "left")
    known = F.col("dependencies").isNotNull().alias("dependencies_known")
    return rows.select("package_id", "name", "version", "total_downloads", "n_versions", "yanked_versions", F.coalesce("dependents", F.lit(0)).alias("dependents"), F.coalesce("dependencies", F.lit(0)).alias("dependencies"), known)


@query("SELECT name, kind, symbol_id FROM symbols WHERE release = 0 AND visibility = 'public' AND index_source = 'documented'")
def api_surface(r):
    return r.symbols.where("release = 0").where(search.symbol_filters(source="documented", public_only=True)).select("name", "kind", "symbol_id")


@query("SELECT symbol_id, name FROM symbols WHERE lower(name) LIKE '%ring' OR lower(name) LIKE '%get'")
def error_like_types(r):
    return api.error_types(r.symbols, ("ring", "get")).select("symbol_id", "name")


@query("SELECT kind, min(start_line) AS first_line, count(*) AS n FROM symbols WHERE visibility = 'public' GROUP BY 1")
def symbol_first_lines(r):
    return r.symbols.where("visibility = 'public'").groupBy("kind").agg(F.min("start_line").alias("first_line"), F.count("*").alias("n"))


@query("""SELECT package_id, array_to_string(list_filter([CASE WHEN contains(lower(name), '01') THEN 'name' END, CASE WHEN contains(lower(keyword), '1') AND contains(lower(keyword), '01') THEN 'keyword' END, CASE WHEN contains(lower(category), '01') THEN 'category' END], lambda x: x IS NOT NULL), ',') AS reasons FROM packages""")
def match_reasons(r):
    none = F.lit(None).cast("string")
    return r.packages.select("package_id", F.array_join(X.match_reasons("01", F.col("name"), F.coalesce(none, F.lit("")), F.array("keyword"), F.array("category")), ",").alias("reasons"))


@query("SELECT symbol_id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> ''), ',') AS tokens FROM symbols")
def symbol_keys(r):
    return r.symbols.select("symbol_id", api.symbol_key(F.col("name")).alias("key"), F.array_join(api.symbol_tokens(F.col("name")), ",").alias("tokens"))


@query("SELECT job_id, CAST(least(5 * pow(2, least(greatest(attempts - 1, 0), 5)), 300) AS BIGINT) AS delay FROM jobs WHERE status = 'failed'")
def retry_delays(r):
    return r.jobs.where("status = 'failed'").select("job_id", S.retry_delay(F.col("attempts")).alias("delay"))


@query("SELECT doc_id, trim(split_part(content, chr(10) || chr(10), 1)) AS summary, substring(content, 1, 100) AS head, length(content) > 100 AS cut FROM docs_pages")
def docs_summary(r):
    head, cut = X.shortened(F.col("content"), 100)
    return r.docs_pages.select("doc_id", X.doc_summary(F.col("content")).alias("summary"), head.alias("head"), cut.alias("cut"))


@query("SELECT version_id, target_id, kind FROM edges WHERE version_id NOT IN (SELECT version_id FROM versions WHERE package_id % 10 = 0)")
def cascade_delete(r):
    gone = r.versions.where("package_id % 10 = 0")
    return snapshot.delete(r.edges.select("version_id", "target_id", "kind"), gone, ["version_id"])


@query("SELECT job_id, scope FROM jobs WHERE requested_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def retained_jobs(r):
    return r.jobs.where(F.col("requested_at") >= _now(EVENTS_AS_OF) - F.make_dt_interval(F.lit(7))).select("job_id", "scope")
