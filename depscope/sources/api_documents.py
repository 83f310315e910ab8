"""API documents (an index of items by id, and paths by id) to rows of symbols, types, implementations and traits.

A document becomes a row for each of its items; one pass of Python reads an item's own part of it. Everything between
items is a join: members of types, implementations and traits, the modules that items stand in, re-exports. The path
that an item is shown by is the shortest of its own and of those of the re-exports that lead to it, through any number of
others and through whole modules. Documents of older formats, which name and nest some fields otherwise, are read as well.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import api_types as A
from ..operators.graph import chased
from ..operators.stored import stored

_OWN = """kind string, signature string, generics array<string>, conditions array<string>, shown string, type_name string, trait string, trait_name string, supers array<string>, blanket string, members array<string>, impls array<string>,
form string, value string, target string, alias string, is_glob boolean, flags array<string>, parameters array<struct<name:string,type:string>>, returns string"""
_TYPES = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<struct<name:string,type:string>>": pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))}
#: The fields of _OWN in Arrow.
_OWN_FIELDS = [pa.field(f.split(" ")[0], _TYPES[f.split(" ")[1]]) for f in _OWN.replace("\n", " ").split(", ")]


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, package, version, text) of all .json files beneath a folder, also .json.gz and .json.zst; package and version are those of the file name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,json.gz,json.zst}").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                if path.endswith(".gz"):
                    data = gzip.decompress(data)
                elif path.endswith(".zst"):
                    import zstandard

                    data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([bytes(data).decode()])], names=["path", "text"])

    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json(\.gz|\.zst)?$", "")
    version = r"v?[0-9]+\.[0-9]+\.[0-9]+(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?"
    dashed, lined = F.regexp_extract(stem, rf"^(.+?)-({version})$", 1), F.regexp_extract(stem, rf"^(.+?)_(v?[0-9]+\.[0-9]+\.[0-9]+[^_]*)(_.*)?$", 1)
    read = files.mapInArrow(run, "path string, text string")
    package = F.when(dashed != "", dashed).when(lined != "", lined).otherwise(stem)
    found = F.coalesce(F.nullif(F.regexp_extract(stem, rf"^(.+?)-({version})$", 2), F.lit("")), F.nullif(F.regexp_extract(stem, r"^(.+?)_(v?[0-9]+\.[0-9]+\.[0-9]+[^_]*)(_.*)?$", 2), F.lit("")))
    return read.select("path", package.alias("package"), found.alias("version"), "text")


#: What an item has beside its own part; one parse of the item reads it.
_ITEM = "name string, visibility string, docs string, attrs string, kind string, inner string, span struct<begin:array<int>,end:array<int>>, deprecation struct<since:string,note:string>"


def _visibility(own: Column) -> Column:
    return F.when(own == "public", "public").when(own == "default", "private").when(own == "crate", "pub").when(own.isNotNull(), F.concat(F.lit("pub(in "), F.get_json_object(own, "$.restricted.path"), F.lit(")")))


def items(documents: DataFrame, key: str = "doc") -> DataFrame:
    """A row for each item of documents (key, text), written: what the document says of it, and `own`, read from its own part."""
    about = F.from_json("text", "index map<string,string>")
    rows = documents.select(F.col(key).alias("doc"), F.explode(about["index"]).alias("id", "item")).select("doc", "id", F.from_json("item", _ITEM).alias("item"))
    line = lambda end, least: F.greatest(F.coalesce(F.try_element_at(F.col(f"item.span.{end}"), F.lit(1)), F.lit(1)), least)
    start = line("begin", F.lit(1))
    rows = rows.select(
        "doc", "id", "item.name", _visibility(F.col("item.visibility")).alias("visibility"), "item.docs", F.col("item.deprecation.since").alias("deprecated_since"), F.col("item.deprecation.note").alias("deprecated_note"),
        start.alias("start_line"), line("end", start).alias("end_line"), F.coalesce("item.attrs", F.lit("[]")).alias("attrs"), F.col("item.kind").alias("written_kind"), "item.inner",
    )
    names = [c for c in rows.columns if c not in ("written_kind", "inner")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
            of = [A.part(k, i) for k, i in zip(column("written_kind").to_pylist(), column("inner").to_pylist(), strict=True)]
            row = pa.array([r for r, x in enumerate(of) if x is not None], pa.int64())
            made = [A.described(x[0], n, x[1]) for x, n in zip(of, column("name").to_pylist(), strict=True) if x is not None]
            own = pa.StructArray.from_arrays([pa.array([m.get(f.name) for m in made], f.type) for f in _OWN_FIELDS], fields=_OWN_FIELDS)
            yield pa.RecordBatch.from_arrays([*[column(c).take(row) for c in names], own.field(0), own], names=[*names, "kind", "own"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return stored(rows.mapInArrow(run, f"{schema}, kind string, own struct<{_OWN}>"), "api-items")


def paths(documents: DataFrame, key: str = "doc") -> DataFrame:
    """(doc, id, path) of what the documents give paths for, written."""
    about = F.from_json("text", "paths map<string,struct<path:array<string>>>")
    return stored(documents.select(F.col(key).alias("doc"), F.explode(about["paths"]).alias("id", "of")).select("doc", "id", F.array_join("of.path", "::").alias("path")), "api-paths")


def _rank(path: Column) -> Column:
    """Fewer segments, then fewer characters, then the alphabet."""
    return F.struct(F.size(F.filter(F.split(path, "::"), lambda s: s != "")), F.length(path), path)


def shown_paths(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(doc, id, shown_path): for each item the best of its own path and those of public re-exports that lead to it.

    A re-export `use x` is an alias of its own path; `use m::*` gives every public item of module m a path beside the
    re-export. Both lead on where their target is a re-export itself; those that lead in a circle lead nowhere.
    """
    uses = rows.where("kind = 'use' AND own.target IS NOT NULL").select("doc", "id", "visibility", "own.target", "own.is_glob")
    ends = chased(uses.select(F.struct("doc", "id").alias("a"), F.struct("doc", F.col("target").alias("id")).alias("b"))).select(F.col("a.doc").alias("doc"), F.col("a.id").alias("id"), F.col("b.id").alias("end"))
    public = uses.where("visibility = 'public'")
    named = public.where("NOT is_glob").join(known, ["doc", "id"]).join(ends, ["doc", "id"]).select("doc", F.col("end").alias("id"), "path")
    inside = rows.where("kind = 'module'").select("doc", F.col("id").alias("module"), F.explode("own.members").alias("id"))
    around = inside.join(known.select("doc", F.col("id").alias("module"), F.col("path").alias("parent")), ["doc", "module"])
    globs = public.where("is_glob").join(around.select("doc", "id", "parent"), ["doc", "id"]).select("doc", F.col("target").alias("module"), "parent")
    children = inside.join(rows.where("visibility = 'public' AND name IS NOT NULL").select("doc", "id", "name"), ["doc", "id"])
    spread = globs.join(children, ["doc", "module"]).join(ends, ["doc", "id"], "left").join(uses.select("doc", "id", F.lit(True).alias("is_use")), ["doc", "id"], "left").where("end IS NOT NULL OR is_use IS NULL")
    spread = spread.select("doc", F.coalesce("end", "id").alias("id"), F.concat_ws("::", "parent", "name").alias("path"))
    every = known.select("doc", "id", "path").unionByName(named).unionByName(spread)
    return every.groupBy("doc", "id").agg(F.min_by("path", _rank(F.col("path"))).alias("shown_path"))


def symbols(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Named items but for modules and re-exports, with the path they are shown by and the one they are defined at."""
    named = rows.where((F.trim("name") != "") & ~F.col("kind").isin("module", "use", "extern_crate"))
    return named.join(shown_paths(rows, known), ["doc", "id"], "left").join(known.withColumnRenamed("path", "defined_at"), ["doc", "id"], "left").select(
        "doc", "id", F.trim("name").alias("name"), "kind", "visibility", "own.signature", F.col("shown_path").alias("path"), "defined_at", "start_line", "end_line", "deprecated_since", "deprecated_note", "docs", "attrs",
    )


def _members(some: DataFrame, rows: DataFrame, column: str = "own.members") -> DataFrame:
    """(doc, id, place, name, visibility, kind, own of the member): one row for each member of some rows that the document has."""
    links = some.select("doc", "id", F.posexplode(column).alias("place", "member"))
    of = rows.select("doc", F.col("id").alias("member"), "name", "visibility", "kind", "own")
    return links.join(of, ["doc", "member"])


def _gathered(made: DataFrame, name: str) -> DataFrame:
    """`value` of each member as one list for each (doc, id), in the order of the document."""
    return made.groupBy("doc", "id").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("of")).select("doc", "id", F.transform("of", lambda x: x["value"]).alias(name))


def _fields(members: DataFrame, form: Column) -> DataFrame:
    name = F.when(form == "tuple", F.col("place").cast("string")).otherwise(F.col("name"))
    return _gathered(members.where("kind = 'struct_field'").withColumn("value", F.struct(name.alias("name"), F.col("own.shown").alias("type"), "visibility")), "fields")


def types(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Structs, enums, unions and aliases with their fields, variants and automatic traits."""
    some = rows.where(F.col("kind").isin("struct", "enum", "union", "type_alias"))
    members = _members(rows.where(F.col("kind").isin("struct", "union", "variant")), rows)
    fields = _fields(members.join(rows.select("doc", "id", F.col("own.form").alias("form")), ["doc", "id"]), F.col("form"))
    variants = _members(some.where("kind = 'enum'"), rows).where("kind = 'variant' AND name IS NOT NULL").join(fields.withColumnRenamed("id", "member"), ["doc", "member"], "left")
    variants = _gathered(variants.withColumn("value", F.struct("name", F.col("own.form").alias("kind"), "fields", F.col("own.value").alias("discriminant"))), "variants")
    auto = _members(some, rows, "own.impls").where("kind = 'impl' AND array_contains(own.flags, 'is_synthetic') AND own.trait_name IS NOT NULL").groupBy("doc", "id").agg(F.array_sort(F.collect_set("own.trait_name")).alias("auto_traits"))
    made = some.join(fields, ["doc", "id"], "left").join(variants, ["doc", "id"], "left").join(auto, ["doc", "id"], "left").join(shown_paths(rows, known), ["doc", "id"], "left")
    empty = lambda c: F.coalesce(c, F.from_json(F.lit("[]"), made.schema[c].dataType)).alias(c)
    return made.select("doc", "id", F.coalesce("name", F.lit("")).alias("type_name"), "kind", "visibility", "own.generics", "own.conditions", F.col("shown_path").alias("path"), *map(empty, ("fields", "variants", "auto_traits")), F.contains("attrs", F.lit("non_exhaustive")).alias("is_non_exhaustive"), "start_line", "end_line")


def _method() -> Column:
    flag = lambda n: F.array_contains("own.flags", n).alias(n)
    has_self = F.coalesce(F.try_element_at("own.parameters", F.lit(1))["name"] == "self", F.lit(False))
    return F.struct("name", "own.signature", has_self.alias("has_self"), flag("is_const"), flag("is_async"), flag("is_unsafe"), "own.parameters", "own.returns", "visibility")


def implementations(rows: DataFrame) -> DataFrame:
    """Implementations with the written type and trait, what kind they are of, and their methods."""
    some = rows.where("kind = 'impl'")
    methods = _gathered(_members(some, rows).where("kind = 'function' AND name IS NOT NULL").withColumn("value", _method()), "methods")
    flag = lambda n: F.array_contains("own.flags", n)
    kind = F.when(F.col("own.trait_name").isNull(), "inherent").when(flag("is_synthetic"), "synthetic").when(F.col("own.blanket").isNotNull(), "blanket").when(F.contains("attrs", F.lit("automatically_derived")), "derive").otherwise("trait")
    made = some.join(methods, ["doc", "id"], "left")
    return made.select(
        "doc", "id", "own.type_name", F.col("own.shown").alias("type_display"), "own.trait_name", F.col("own.trait").alias("trait_display"), kind.alias("impl_kind"), F.coalesce("methods", F.from_json(F.lit("[]"), made.schema["methods"].dataType)).alias("methods"),
        F.col("own.blanket").isNotNull().alias("is_blanket"), flag("is_synthetic").alias("is_synthetic"), flag("is_negative").alias("is_negative"), F.col("own.blanket").alias("blanket_type"), "own.generics", "own.conditions", "start_line", "end_line",
    )


def traits(rows: DataFrame) -> DataFrame:
    """Traits with what an implementation must give, what it has anyway, and their types."""
    some = rows.where("kind = 'trait' AND name IS NOT NULL")
    members = _members(some, rows).where("name IS NOT NULL")
    body = F.array_contains("own.flags", "has_body")
    function = F.col("kind") == "function"
    made = some.join(_gathered(members.where((function & ~body) | (F.col("kind") == "assoc_const")).withColumn("value", F.struct("name", "own.signature", "kind")), "required"), ["doc", "id"], "left")
    made = made.join(_gathered(members.where(function & body).withColumn("value", F.struct("name", "own.signature", "kind")), "provided"), ["doc", "id"], "left")
    made = made.join(_gathered(members.where("kind = 'assoc_type'").withColumn("value", F.struct("name", F.col("own.supers").alias("bounds"), F.col("own.shown").alias("default"))), "types"), ["doc", "id"], "left")
    empty = lambda c: F.coalesce(c, F.from_json(F.lit("[]"), made.schema[c].dataType)).alias(c)
    flag = lambda n: F.array_contains("own.flags", n).alias(n)
    return made.select("doc", "id", F.col("name").alias("trait_name"), flag("is_auto"), flag("is_unsafe"), flag("is_dyn_compatible"), F.col("own.supers").alias("supertraits"), *map(empty, ("required", "provided", "types")), "own.generics")
