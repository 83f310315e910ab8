"""Items of source files: symbols, implementations, exported macros, and where re-exports lead.

Python reads one file at a time into its items; a file is a row, and never more than an Arrow batch of them is held.
Re-exports are followed by joins: names that a glob brings in become links of their own until no more come, and chains
of links are resolved by pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rust_items as R
from .graph import chased
from .stored import pieces, stored, text_lengths

_ITEM = """kind string, name string, module string, visibility string, signature string, start_line int, end_line int, attributes array<string>, type_display string, trait_display string,
methods array<struct<name:string,signature:string,line:int,has_body:boolean>>, uses array<struct<path:string,name:string>>, patterns array<string>"""
PIECE_BYTES = 4 << 20


def module_of(path: Column) -> Column:
    """The module that a file is: src/lib.rs and src/main.rs are the root, src/a/mod.rs and src/a.rs are a."""
    inner = F.regexp_replace(F.regexp_replace(path, r"^(?:.*/)?src/", ""), r"(?:^|/)(?:lib|main|mod)\.rs$|\.rs$", "")
    return F.when(inner == "", "crate").otherwise(F.concat(F.lit("crate::"), F.replace(inner, F.lit("/"), F.lit("::"))))


def items(files: DataFrame, package_col: str, path_col: str, text_col: str) -> DataFrame:
    """(package, path, and an item's own columns) of the items of files, written; files without a text have none."""
    source = files.where(F.col(text_col).isNotNull()).select(F.col(package_col).alias("package"), F.col(path_col).alias("path"), module_of(F.col(path_col)).alias("root"), F.col(text_col).alias("text"))
    names = [c.split(" ")[0] for c in _ITEM.replace("\n", " ").split(", ")]
    typed = source.select(*[F.from_json(F.lit("{}"), _ITEM).alias("item"), "*"])
    kind = typed.schema["package"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_lengths(batch.column(4)), PIECE_BYTES):
                found = [R.items(t, m) for t, m in zip(piece.column(4).to_pylist(), piece.column(3).to_pylist(), strict=True)]
                row = pa.array([k for k, x in enumerate(found) for _ in x], pa.int64())
                kind = piece.schema.field("item").type
                made = [pa.array([getattr(i, n) for x in found for i in x], kind.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([piece.column(1).take(row), piece.column(2).take(row), *made], names=["package", "path", *names])

    schema = f"package {kind}, path string, {_ITEM}"
    return stored(typed.mapInArrow(run, schema), "source-items")


def symbols(found: DataFrame) -> DataFrame:
    """Functions, types, traits, constants, modules and macros with the lines that they span."""
    return found.where(~F.col("kind").isin("impl", "use")).select("package", "path", "module", "name", "kind", "visibility", "signature", "start_line", "end_line")


def _last(path: Column) -> Column:
    """The name that a written path is looked up by."""
    bare = F.regexp_replace(path, r"^(?:!|&|\s|'\w+\s|mut\s|dyn\s|impl\s)+", "")
    return F.element_at(F.split(F.regexp_replace(bare, r"(?s)[<(\[\s].*$", ""), "::"), -1)


def implementations(found: DataFrame) -> DataFrame:
    """Written implementations, and one for each trait that a type derives."""
    own = found.where("kind = 'impl'")
    written = own.select("package", "path", F.col("name").alias("type_name"), "type_display", _last(F.col("trait_display")).alias("trait_name"), "trait_display", F.when(F.col("trait_display").isNull(), "inherent").otherwise("trait").alias("impl_kind"), "methods", "start_line", "end_line")
    derives = F.flatten(F.transform(F.filter("attributes", lambda a: a.rlike(r"^derive\s*\(")), lambda a: F.split(F.regexp_extract(a, r"(?s)^derive\s*\((.*)\)\s*$", 1), r"\s*,\s*")))
    types = found.where(F.col("kind").isin("struct", "enum", "union")).withColumn("derived", F.explode(F.filter(derives, lambda d: F.trim(d) != "")))
    shown = F.trim("derived")
    derived = types.select("package", "path", F.col("name").alias("type_name"), F.col("name").alias("type_display"), _last(shown).alias("trait_name"), shown.alias("trait_display"), F.lit("derive").alias("impl_kind"), F.array().cast(own.schema["methods"].dataType).alias("methods"), "start_line", "end_line")
    return written.unionByName(derived)


def macro_exports(found: DataFrame) -> DataFrame:
    """Procedural macros: (package, path, macro, name, usage, accepted, signature, line); accepted are a derive's helper attributes."""
    each = found.where("kind = 'function'").withColumn("attribute", F.explode("attributes"))
    attribute = F.regexp_replace("attribute", r"\s+", "")
    inner = F.regexp_extract(attribute, r"^proc_macro_derive\(([^,()]+)", 1)
    accepted = F.filter(F.split(F.regexp_extract(attribute, r"^proc_macro_derive\([^,()]+,attributes\((.*?)\)", 1), ","), lambda a: a != "")
    macro = F.when(inner != "", "derive").when(attribute == "proc_macro_attribute", "attribute").when(attribute == "proc_macro", "function")
    rows = each.select("package", "path", macro.alias("macro"), F.when(inner != "", inner).otherwise(F.col("name")).alias("name"), accepted.alias("accepted"), "signature", F.col("start_line").alias("line")).where("macro IS NOT NULL")
    usage = F.when(F.col("macro") == "derive", F.format_string("#[derive(%s)]", "name")).when(F.col("macro") == "attribute", F.format_string("#[%s(...)]", "name")).otherwise(F.format_string("%s!(...)", "name"))
    return rows.withColumn("usage", usage)


def display_patterns(found: DataFrame) -> DataFrame:
    """(package, path, type_name, place, pattern): what the types' Display implementations write, and messages in their attributes."""
    shown = found.where((F.col("kind") == "impl") & (_last(F.col("trait_display")) == "Display"))
    told = found.where(F.col("kind").isin("enum", "struct"))
    return shown.unionByName(told).select("package", "path", F.col("name").alias("type_name"), F.posexplode("patterns").alias("place", "pattern"))


#: Lines that a range of lines is cut into for a join.
BUCKET_LINES = 256


def in_scope(found: DataFrame, places: DataFrame) -> DataFrame:
    """(package, path, line, module, name, target): the imports that hold at places (package, path, line).

    They are those of the innermost module around the line. Modules are cut into buckets of lines and joined by these,
    so that a file with many modules and places isn't compared pairwise. A null name is a glob.
    """
    spans = found.where("kind = 'module'").select("package", "path", F.concat_ws("::", "module", "name").alias("inside"), F.col("start_line").alias("from_line"), F.col("end_line").alias("to_line"))
    cut = lambda c: F.floor(F.col(c) / BUCKET_LINES)
    spans = spans.withColumn("bucket", F.explode(F.sequence(cut("from_line"), cut("to_line"))))
    asked = places.select("package", "path", "line").distinct().withColumn("bucket", cut("line"))
    around = asked.join(spans, ["package", "path", "bucket"]).where(F.col("line").between(F.col("from_line"), F.col("to_line")))
    # of modules on one line the one of the longest name is innermost
    inner = around.groupBy("package", "path", "line").agg(F.max_by("inside", F.struct("from_line", -F.col("to_line"), F.length("inside"))).alias("inside"))
    roots = found.select("package", "path", module_of(F.col("path")).alias("root")).distinct()
    module = asked.drop("bucket").join(inner, ["package", "path", "line"], "left").join(roots, ["package", "path"]).select("package", "path", "line", F.coalesce("inside", "root").alias("module"))
    uses = found.where("kind = 'use'").select("package", "path", "module", F.explode("uses").alias("use")).where("coalesce(use.name, '') <> '_'")
    return module.join(uses.select("package", "path", "module", F.col("use.name").alias("name"), _absolute(F.col("use.path"), F.col("module")).alias("target")), ["package", "path", "module"])


def _absolute(path: Column, module: Column) -> Column:
    """A written path from the root: self and super are of the module it stands in; one without any is beside it."""
    parts, around = F.split(path, "::"), F.split(module, "::")
    ups = F.size(F.filter(parts, lambda p: p == "super"))
    rest = F.filter(parts, lambda p: ~p.isin("super", "self"))
    base = F.slice(around, F.lit(1), F.greatest(F.size(around) - ups, F.lit(1)))
    return F.when(path.startswith("crate::") | (path == "crate"), path).otherwise(F.array_join(F.concat(base, rest), "::"))


def re_exports(found: DataFrame) -> DataFrame:
    """(package, alias, target, kind): public names that are given by `pub use`, with the item that each leads to.

    What leads out of the package, or in a circle, leads to no item and is left out. A name that a module has itself, or
    names in a use, hides those of its globs. Where several globs bring one name, the alphabetically first target counts.
    """
    uses = found.where("kind = 'use' AND visibility = 'public'").select("package", "module", F.explode("uses").alias("use")).where("use.path IS NOT NULL AND coalesce(use.name, '') <> '_'")
    target = _absolute(F.col("use.path"), F.col("module"))
    joined = lambda name: F.concat_ws("::", "module", name)
    named = uses.where("use.name IS NOT NULL").select("package", joined(F.col("use.name")).alias("alias"), target.alias("target"))
    globs = stored(uses.where("use.name IS NULL").select("package", F.col("module").alias("into"), target.alias("of")).distinct(), "globs")
    defined = stored(found.where(~F.col("kind").isin("impl", "use", "macro")).select("package", joined("name").alias("alias"), "kind", "visibility").dropDuplicates(["package", "alias"]), "defined")
    first = lambda rows: rows.groupBy("package", "alias").agg(F.min("target").alias("target"))
    links = stored(first(named).join(defined.select("package", "alias"), ["package", "alias"], "left_anti"), "links")
    front = defined.where("visibility = 'public'").select("package", "alias").unionByName(links.select("package", "alias"))
    while True:
        parent = F.substring_index("alias", "::", -1)
        names = front.select("package", F.col("alias").alias("target"), parent.alias("name"), F.expr("substring(alias, 1, length(alias) - length(substring_index(alias, '::', -1)) - 2)").alias("of"))
        brought = first(names.join(globs, ["package", "of"]).select("package", F.concat_ws("::", "into", "name").alias("alias"), "target"))
        fresh = stored(brought.join(defined.select("package", "alias"), ["package", "alias"], "left_anti").join(links.select("package", "alias"), ["package", "alias"], "left_anti"), "brought")
        if fresh.isEmpty():
            break
        links, front = links.unionByName(fresh), fresh.select("package", "alias")
    pair = lambda c: F.struct("package", F.col(c).alias("path"))
    ends = chased(links.select(pair("alias").alias("a"), pair("target").alias("b")))
    ends = ends.select(F.col("a.package").alias("package"), F.col("a.path").alias("alias"), F.col("b.path").alias("target"))
    return ends.join(defined.select("package", F.col("alias").alias("target"), "kind"), ["package", "target"])
