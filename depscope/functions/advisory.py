"""Which versions an advisory row affects: affected, not_affected or unknown, by the dialect of its range.

A range is compiled once into keys of versions, and compared in generated code. applicability() is the same for single
texts in plain Python, which the columns are held against.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import semver
from .semver import Version, matches, parse, parse_requirement

YES, NO, UNKNOWN = "affected", "not_affected", "unknown"


def withdrawn(affected_range: Column) -> Column:
    """Whether a clause of the range starts with withdrawn=."""
    return F.coalesce(affected_range.startswith("withdrawn=") | affected_range.contains("; withdrawn="), F.lit(False))


def _events(body: str) -> tuple[list[tuple], list[str]] | None:
    """(events in order of version, limits) of an event list; None if it breaks a rule."""
    events, limits, kinds = [], [], set()
    for part in filter(None, (p.strip() for p in re.split(r"[;,]", body))):
        kind, _, value = part.partition("=")
        kind, value = kind.strip(), value.strip()
        if kind == "limit":
            if value != "*" and parse(value) is None:
                return None
            limits.append(value)
            continue
        if kind not in ("introduced", "fixed", "last_affected"):
            return None
        at = None if value == "0" else parse(value)
        if value != "0" and at is None:
            return None
        kinds.add(kind)
        events.append(((at is not None, at.order() if at else ()), ("introduced", "fixed", "last_affected").index(kind)))
    if "introduced" not in kinds or {"fixed", "last_affected"} <= kinds:
        return None
    return sorted(events), limits


def _by_events(text: str, v: Version) -> str:
    """Any range of events that holds wins; one that can't be read leaves the rest unknown."""
    unread = False
    for body in re.findall(r"(?:SEMVER|ECOSYSTEM)\(([^)]*)\)", text):
        found = _events(body)
        if found is None:
            unread = True
            continue
        events, limits = found
        if limits and not any(x == "*" or v.order() < parse(x).order() for x in limits):
            continue
        on, at = False, (True, v.order())
        for place, kind in events:
            if kind == 0 and at >= place:
                on = True
            elif kind == 1 and at >= place or kind == 2 and at > place:
                on = False
        if on:
            return YES
    return UNKNOWN if unread else NO


def _by_patches(text: str, v: Version) -> str:
    """Affected unless a patched or unaffected requirement holds; an empty text affects every version."""
    for clause in filter(None, (c.strip() for c in text.split(";"))):
        kind, _, value = clause.partition("=")
        if kind == "categories":
            continue
        if kind not in ("patched", "unaffected"):
            return UNKNOWN
        for requirement in filter(None, (r.strip() for r in value.split(" | "))):
            found = parse_requirement(requirement)
            if found is None:
                return UNKNOWN
            if matches(found, v):
                return NO
    return YES


def _by_comparators(text: str, v: Version) -> str:
    """Alternatives of comparators by full precedence, pre-releases included."""
    unread = False
    for alternative in text.split("||"):
        ok = True
        for part in alternative.split(","):
            m = re.match(r"^\s*(>=|<=|>|<|=)\s*(\S+)\s*$", part)
            bound = m and parse(m[2])
            if not bound:
                ok, unread = False, True
                break
            a, b = v.order(), bound.order()
            ok &= {">=": a >= b, "<=": a <= b, ">": a > b, "<": a < b, "=": a == b}[m[1]]
        if ok:
            return YES
    return UNKNOWN if unread else NO


def applicability(source: str | None, affected_range: str | None, version: str | None) -> str:
    text = affected_range or ""
    if text.startswith("withdrawn=") or "; withdrawn=" in text:
        return NO
    v = parse(version)
    if v is None:
        return UNKNOWN
    if "SEMVER(" in text or "ECOSYSTEM(" in text:
        return _by_events(text, v)
    if source == "rustsec_db" or "patched=" in text or "unaffected=" in text:
        return _by_patches(text, v)
    if source == "ghsa":
        return _by_comparators(text, v)
    return UNKNOWN


def _trimmed(text: Column, separator: str) -> Column:
    """The parts of a text that aren't blank."""
    return F.filter(F.transform(F.split(text, separator, -1), lambda p: F.trim(p)), lambda p: p != "")


def _side(part: Column, k: int) -> Column:
    """What stands before or behind the first =."""
    return F.trim(F.regexp_extract(part, r"(?s)^([^=]*)(?:=(.*))?$", k))


def _event_lists(text: Column) -> Column:
    """For each list of events: whether it can be read, its events in the order of versions, and its limits."""

    def one(body: Column) -> Column:
        event = lambda p: F.struct(_side(p, 1).alias("kind"), (_side(p, 2) != "0").alias("bounded"), (_side(p, 2) == "*").alias("any"), semver.key(_side(p, 2)).alias("key"))
        return semver.bound(F.transform(_trimmed(body, "[;,]"), event), told)

    def told(made: Column) -> Column:
        has = lambda kind: F.exists(made, lambda e: e["kind"] == kind)
        read = lambda e: F.when(e["kind"] == "limit", e["any"] | e["key"].isNotNull()).otherwise(e["kind"].isin("introduced", "fixed", "last_affected") & (~e["bounded"] | e["key"].isNotNull()))
        ordered = F.array_sort(F.transform(F.filter(made, lambda e: e["kind"] != "limit"), lambda e: F.struct(e["bounded"].alias("bounded"), F.when(e["bounded"], e["key"]).alias("key"), F.when(e["kind"] == "introduced", 0).when(e["kind"] == "fixed", 1).otherwise(2).alias("kind"))))
        return F.struct((F.forall(made, read) & has("introduced") & ~(has("fixed") & has("last_affected"))).alias("read"), ordered.alias("events"), F.filter(made, lambda e: e["kind"] == "limit").alias("limits"))

    return F.transform(F.regexp_extract_all(text, F.lit(r"(?:SEMVER|ECOSYSTEM)\(([^)]*)\)"), F.lit(1)), one)


def _patch_list(text: Column) -> Column:
    """The requirements of patched and unaffected clauses in order, null ones where the text can't be read from there on."""
    none = F.array(F.struct(F.lit(None).cast("string").alias("text")))

    def one(clause: Column) -> Column:
        kind = F.regexp_extract(clause, r"(?s)^([^=]*)", 1)
        asked = F.transform(_trimmed(F.regexp_extract(clause, r"(?s)^[^=]*=(.*)$", 1), r" \| "), lambda r: F.struct(r.alias("text")))
        return F.when(kind == "categories", F.filter(none, lambda _: F.lit(False))).when(kind.isin("patched", "unaffected"), asked).otherwise(none)

    return F.transform(F.flatten(F.transform(_trimmed(text, ";"), one)), lambda r: semver.requirement(r["text"]))


def _alternatives(text: Column) -> Column:
    """For each alternative its comparisons, of an operator and a key that is null where it can't be read."""
    pattern = r"^\s*(>=|<=|>|<|=)\s*(\S+)\s*$"
    one = lambda p: F.struct(F.regexp_extract(p, pattern, 1).alias("op"), semver.key(F.regexp_extract(p, pattern, 2)).alias("key"))
    return F.transform(F.split(text, r"\|\|", -1), lambda a: F.transform(F.split(a, ",", -1), one))


def compiled(source: Column, affected_range: Column) -> Column:
    """A range as keys to compare with, made once for each advisory row: struct(way, events, patches, alternatives)."""
    text = F.coalesce(affected_range, F.lit(""))
    source = F.coalesce(source, F.lit(""))
    events = text.contains("SEMVER(") | text.contains("ECOSYSTEM(")
    patches = (source == "rustsec_db") | text.contains("patched=") | text.contains("unaffected=")
    way = F.when(withdrawn(text), "withdrawn").when(events, "events").when(patches, "patches").when(source == "ghsa", "alternatives").otherwise("none")
    only = lambda name, value: F.when(way == name, value).alias(name)
    return F.struct(way.alias("way"), only("events", _event_lists(text)), only("patches", _patch_list(text)), only("alternatives", _alternatives(text)))


def holds(range_: Column, at: Column) -> Column:
    """What a compiled() range says of the version with a key."""

    def on(state: Column, e: Column) -> Column:
        reached = ~e["bounded"] | (at >= e["key"])
        passed = ~e["bounded"] | (at > e["key"])
        return F.when((e["kind"] == 0) & reached, True).when(((e["kind"] == 1) & reached) | ((e["kind"] == 2) & passed), False).otherwise(state)

    inside = lambda x: (F.size(x["limits"]) == 0) | F.exists(x["limits"], lambda e: e["any"] | (at < e["key"]))
    hit = F.exists(range_["events"], lambda x: x["read"] & inside(x) & F.aggregate(x["events"], F.lit(False), on))
    by_events = F.when(hit, YES).when(F.exists(range_["events"], lambda x: ~x["read"]), UNKNOWN).otherwise(NO)
    told = F.filter(F.transform(range_["patches"], lambda r: F.when(r.isNull(), UNKNOWN).when(semver.meets(at, r), NO)), lambda x: x.isNotNull())
    by_patches = F.coalesce(F.try_element_at(told, F.lit(1)), F.lit(YES))
    compare = lambda c: F.coalesce(F.when(c["op"] == ">=", at >= c["key"]).when(c["op"] == "<=", at <= c["key"]).when(c["op"] == ">", at > c["key"]).when(c["op"] == "<", at < c["key"]).when(c["op"] == "=", at == c["key"]), F.lit(False))
    unread = F.exists(range_["alternatives"], lambda a: F.exists(a, lambda c: c["key"].isNull()))
    by_comparators = F.when(F.exists(range_["alternatives"], lambda a: F.forall(a, compare)), YES).when(unread, UNKNOWN).otherwise(NO)
    way = range_["way"]
    return F.when(way == "withdrawn", NO).when(at.isNull(), UNKNOWN).when(way == "events", by_events).when(way == "patches", by_patches).when(way == "alternatives", by_comparators).otherwise(UNKNOWN)


def applies(source: Column, affected_range: Column, version: Column) -> Column:
    return holds(compiled(source, affected_range), semver.key(version))


def merged(rows: DataFrame) -> DataFrame:
    """One row per (version_id, advisory_id) of advisory rows joined to versions.

    rows: version_id, version, advisory_id, source, affected_range, matched_version (or null), requires_resync, severity;
    range and key, if they are there, are compiled() ranges and keys of versions.
    A withdrawn row that needs no new sync silences its advisory; rows that need one count as unknown; a row that
    names the version affects it. The strongest row wins, ties by source, range and row.
    """
    if "range" not in rows.columns:
        rows = rows.withColumn("range", compiled(F.col("source"), F.col("affected_range")))
    if "key" not in rows.columns:
        rows = rows.withColumn("key", semver.key(F.col("version")))
    state = F.when(F.col("requires_resync"), UNKNOWN).when(F.col("matched_version") == F.col("version_id"), YES).otherwise(holds(F.col("range"), F.col("key")))
    judged = rows.withColumn("state", state).withColumn("silenced", withdrawn(F.col("affected_range")) & ~F.col("requires_resync")).withColumn("explicit", F.coalesce(F.col("matched_version") == F.col("version_id"), F.lit(False)))
    strength = F.when(F.col("state") == YES, 2).when(F.col("state") == UNKNOWN, 1).otherwise(0)
    best = F.min_by(F.struct("state", "source", "affected_range", "severity"), F.struct(-strength, ~F.col("explicit"), F.col("source"), F.col("affected_range"), F.col("row_id")))
    return judged.groupBy("version_id", "advisory_id").agg(F.bool_or("silenced").alias("silenced"), best.alias("best")).where("NOT silenced").select("version_id", "advisory_id", "best.*").where(F.col("state") != NO)
