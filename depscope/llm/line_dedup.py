"""Line dedup by site-relative frequency: lines that stand on too large a share of their host's pages go.

DataFrame operations only. A page is a row; a line is what stands between \\n, compared without blanks, tabs and
carriage returns at its ends; empty lines are never counted or dropped. Lines are keyed by 128 bits of hash, so the
text itself is never shuffled, and counts are summed within each task first. What is left after the ratio is at
most (lines of a page) / ratio keys for each host. If their whole number is small, each host's keys are broadcast
and held against the lines where the pages are read. Else each page's own distinct keys are joined with the list by
host and key, so that neither a hot host nor a long list meets in one task.

Defined cases: a null text stays null; pages of a null host are one host; repeated rows count as pages of their own; a
host of fewer than MIN_PAGES pages loses nothing; a text of any length is one row, its lines an array; an empty table
gives an empty result; columns of any name are carried along, and one with the name of a new column, in any case, is
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import numbered, picked, place_of, renewed
from .scratch import written

#: A line goes if it stands on over RATIO_NUM / RATIO_DEN of its host's pages, and on MIN_PAGES at least.
RATIO_NUM, RATIO_DEN, MIN_PAGES = 1, 10, 5
BROADCAST_LINES = 200_000


def _key(line: Column) -> Column:
    bare = F.trim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b")))


def _distinct_keys(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), _key), lambda k: k.isNotNull()))


def boilerplate_lines(pages: DataFrame, host: str, text: str, num: int = RATIO_NUM, den: int = RATIO_DEN, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key, pages): the keys of lines beyond the ratio."""
    own = picked(pages, host, text).toDF("host", "text").withColumn("text", F.col("text").cast("string"))
    lines = own.select("host", F.explode(_distinct_keys(F.col("text"))).alias("key"))
    counts = lines.groupBy("host", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = own.groupBy("host").agg(F.count("*").alias("total")).withColumnRenamed("host", "of")
    return counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(den * F.col("pages") > num * F.col("total")).select("host", "key", "pages")


def _marked(pages: DataFrame, host: str, text: str, **ratio) -> DataFrame:
    """numbered(pages) with lines, an array of (line, whether it goes); null for a null text."""
    found = written(boilerplate_lines(pages, host, text, **ratio), "boilerplate")
    work = numbered(pages)
    whole, own_host = (F.col(f"c{place_of(pages, c)}") for c in (text, host))
    if found.count() <= BROADCAST_LINES:
        bad = found.groupBy(F.col("host").alias("bp_host")).agg(F.collect_list("key").alias("bp_keys"))
        joined = work.join(F.broadcast(bad), own_host.eqNullSafe(F.col("bp_host")), "left").drop("bp_host")
    else:
        # each page asks for its own keys; a page that finds none is not in the answer
        work = written(work.withColumn("bp_page", F.monotonically_increasing_id()), "pages")
        asked = work.select("bp_page", own_host.alias("of"), F.explode(_distinct_keys(whole.cast("string"))).alias("asked"))
        hit = asked.join(found, F.col("of").eqNullSafe(F.col("host")) & (F.col("asked") == F.col("key")))
        joined = work.join(hit.groupBy("bp_page").agg(F.collect_list("key").alias("bp_keys")), "bp_page", "left").drop("bp_page")
    gone = lambda line: F.coalesce(F.array_contains("bp_keys", _key(line)), F.lit(False))
    lines = F.transform(F.split(whole.cast("string"), "\n"), lambda x: F.struct(x.alias("line"), (F.col("bp_keys").isNotNull() & gone(x)).alias("gone")))
    return joined.withColumn("lines", lines).drop("bp_keys")


def _kept_text() -> Column:
    return F.array_join(F.transform(F.filter("lines", lambda x: ~x["gone"]), lambda x: x["line"]), "\n")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", out: str = "text", lines: str | None = None, dropped: str | None = None, **ratio) -> DataFrame:
    """pages with column `out`: the text without its host's boilerplate lines.

    lines, dropped: names of columns for the numbers of lines that are not empty and of those dropped.
    """
    new = {out: _kept_text()}
    if lines:
        full = F.filter("lines", lambda x: F.trim(x["line"], F.lit(" \t\r")) != "")
        new[lines] = F.coalesce(F.size(full).cast("long"), F.lit(0).cast("long"))
    if dropped:
        new[dropped] = F.coalesce(F.size(F.filter("lines", lambda x: x["gone"])).cast("long"), F.lit(0).cast("long"))
    replaced = {k.lower() for k in new}
    places = [i for i, c in enumerate(pages.columns) if c.lower() not in replaced]
    marked = _marked(pages, host, text, **ratio)
    made = marked.select(*[F.col(f"c{i}") for i in places], *new.values())
    return made.toDF(*[pages.columns[i] for i in places], *new)


def deduplicated(docs: DataFrame, host: str = "source", text: str = "text", **ratio) -> DataFrame:
    """docs without boilerplate lines, with the columns of docs in their order; n_chars, if there, follows the text."""
    marked = _marked(docs, host, text, **ratio).withColumn("kept", _kept_text())
    return marked.select(*renewed(docs, place_of(docs, text), F.col("kept"))).toDF(*docs.columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    made = drop_boilerplate(docs, out="cleaned", lines="n_lines", dropped="n_dropped")
    return made.select("doc_id", "n_lines", "n_dropped", F.length(F.coalesce("cleaned", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("cleaned", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
c AS (SELECT source, bare, count(DISTINCT rid) AS pages FROM k WHERE bare <> '' GROUP BY 1, 2),
t AS (SELECT source, count(*) AS total FROM d GROUP BY 1),
bad AS (SELECT c.source, bare FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE pages >= {MIN_PAGES} AND {RATIO_DEN} * pages > {RATIO_NUM} * total),
m AS (SELECT k.*, bad.bare IS NOT NULL AS gone FROM k LEFT JOIN bad ON k.source IS NOT DISTINCT FROM bad.source AND k.bare = bad.bare),
r AS (SELECT rid, count(*) FILTER (WHERE bare <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS cleaned FROM m GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
    CAST(length(coalesce(cleaned, '')) AS BIGINT) AS kept_chars, sha256(coalesce(cleaned, '')) AS kept_sha256
FROM d LEFT JOIN r USING (rid)
"""
