"""Semantic versions as ordered columns, and requirements over them.

A version becomes a struct that compares as versions do: numbers, then releases after pre-releases, then the parts of
a pre-release, numbers before texts. A requirement becomes intervals of such keys. So sorting, maxima and matching stay
in generated code. The functions over single texts in plain Python are for manifests and for holding columns against.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _key(major: Column, minor: Column, patch: Column, release: Column, parts: Column) -> Column:
    return F.struct(major.alias("major"), minor.alias("minor"), patch.alias("patch"), release.alias("release"), parts.alias("parts"))


def _parts(pre: Column) -> Column:
    part = lambda p: F.struct((~p.rlike("^[0-9]+$")).alias("named"), F.coalesce(p.try_cast("long"), F.lit(0)).alias("number"), F.when(p.rlike("^[0-9]+$"), "").otherwise(p).alias("text"))
    return F.transform(F.filter(F.split(pre, r"\."), lambda p: p != ""), part)


def key(version: Column) -> Column:
    """struct(major, minor, patch, release, parts) for a version, null for other texts; build metadata is left out."""
    text = F.trim(version)
    groups = F.struct(*[F.regexp_extract(text, PATTERN, k).alias(n) for k, n in enumerate(("a", "b", "c", "pre"), 1)])

    def made(g: Column) -> Column:
        n = F.struct(*[g[x].try_cast("long").alias(x) for x in "abc"], g["pre"].alias("pre"))
        whole = lambda n: F.when(n["a"].isNotNull() & n["b"].isNotNull() & n["c"].isNotNull(), _key(n["a"], n["b"], n["c"], n["pre"] == "", _parts(n["pre"])))
        return bound(n, whole)

    return bound(groups, made)


class Version(NamedTuple):
    major: int
    minor: int
    patch: int
    pre: tuple

    def order(self) -> tuple:
        return (self.major, self.minor, self.patch, not self.pre, tuple((isinstance(p, str), p if isinstance(p, int) else 0, p if isinstance(p, str) else "") for p in self.pre))


def parse(text: str | None) -> Version | None:
    m = re.match(PATTERN, (text or "").strip())
    if not m:
        return None
    pre = tuple(int(p) if p.isdigit() else p for p in m[4].split(".")) if m[4] else ()
    return Version(int(m[1]), int(m[2]), int(m[3]), pre)


_COMPARATOR = re.compile(r"^(\^|~|>=|<=|>|<|=)?\s*v?(\d+|[*xX])(?:\.(\d+|[*xX]))?(?:\.(\d+|[*xX]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$")


class Comparator(NamedTuple):
    op: str
    major: int
    minor: int | None
    patch: int | None
    pre: tuple


def parse_requirement(text: str) -> list[Comparator] | None:
    """Comparators that must all hold; [] is any version; None if the text can't be read."""
    out = []
    text = text.strip()
    if text in ("*", "x", "X"):
        return []
    for part in text.split(","):
        m = _COMPARATOR.match(part.strip())
        if not m:
            return None
        wild = [i for i in (2, 3, 4) if m[i] in ("*", "x", "X")]
        if wild and (m[1] not in (None, "=") or wild[0] == 2):
            return [] if wild[0] == 2 and m[1] is None and "," not in text else None
        if wild and wild[0] == 3 and m[4] and m[4].isdigit():
            return None
        numbers = [int(m[i]) if m[i] and m[i].isdigit() else None for i in (2, 3, 4)]
        pre = tuple(int(p) if p.isdigit() else p for p in m[5].split(".")) if m[5] else ()
        out.append(Comparator("*" if wild else m[1] or "^", *numbers, pre))
    return out


def _holds(c: Comparator, v: Version) -> bool:
    floor = Version(c.major, c.minor or 0, c.patch or 0, c.pre).order()
    at = v.order()
    if c.op in ("=", "*"):
        return v.major == c.major and c.minor in (None, v.minor) and c.patch in (None, v.patch) and (c.patch is None or v.pre == c.pre)
    # a partial version stands for all that begin with it
    after = (c.major + 1, 0, 0) if c.minor is None else (c.major, c.minor + 1, 0) if c.patch is None else None
    bare = (v.major, v.minor, v.patch)
    if c.op == ">":
        return at > floor if after is None else bare >= after
    if c.op == ">=":
        return at >= floor
    if c.op == "<":
        return at < floor
    if c.op == "<=":
        return at <= floor if after is None else bare < after
    if c.op == "~":
        top = (c.major + 1, 0, 0) if c.minor is None else (c.major, c.minor + 1, 0)
    elif c.major or c.minor is None:
        top = (c.major + 1, 0, 0)
    elif c.minor or c.patch is None:
        top = (0, c.minor + 1, 0)
    else:
        top = (0, 0, c.patch + 1)
    return at >= floor and bare < top


def matches(requirement: list[Comparator], v: Version) -> bool:
    """Pre-releases match only where a comparator names a pre-release of the same three numbers."""
    if not all(_holds(c, v) for c in requirement):
        return False
    return not v.pre or any(c.pre and (c.major, c.minor, c.patch) == (v.major, v.minor, v.patch) for c in requirement)


_COMPARED = r"^(\^|~|>=|<=|>|<|=)?\s*v?(\d+|[*xX])(?:\.(\d+|[*xX]))?(?:\.(\d+|[*xX]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def _comparator(text: Column, alone: Column) -> Column:
    """struct(ok, low, low_open, high, high_open, pre) of one comparator: an interval of keys, open ends null.

    pre: the key of a comparator that names a pre-release. alone: whether no other comparator stands beside it.
    """
    fields = F.struct(text.rlike(_COMPARED).alias("read"), *[F.regexp_extract(text, _COMPARED, k).alias(n) for k, n in enumerate(("op", "a", "b", "c", "pre"), 1)])
    wild = lambda t: t.isin("*", "x", "X")

    def numbers(f: Column) -> Column:
        number = lambda t: F.when(~wild(t), F.nullif(t, F.lit("")).try_cast("long"))
        loose = wild(f["b"]) | wild(f["c"])
        anything = wild(f["a"]) & (f["op"] == "") & alone
        # numbers that are written but aren't any, wildcards under another operator, and what follows a wildcard can't be read
        unread = F.exists(F.array(f["a"], f["b"], f["c"]), lambda t: (t != "") & ~wild(t) & t.try_cast("long").isNull())
        ok = f["read"] & ~unread & ~(loose & ~f["op"].isin("", "=")) & ~(wild(f["b"]) & (f["c"] != "") & ~wild(f["c"])) & (~wild(f["a"]) | anything)
        op = F.when(anything, "any").when(f["op"] != "", f["op"]).when(loose, "=").otherwise("^")
        return F.struct(ok.alias("ok"), op.alias("op"), *[number(f[n]).alias(n) for n in "abc"], (f["pre"] == "").alias("release"), _parts(f["pre"]).alias("parts"))

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    none = F.array().cast("array<struct<named:boolean,number:bigint,text:string>>")
    # below every version of these numbers, pre-releases included
    under = lambda a, b, c: _key(a, b, c, F.lit(False), none)

    def keys(n: Column) -> Column:
        major, minor, patch = n["a"], n["b"], n["c"]
        after = F.when(minor.isNull(), under(major + one, zero, zero)).otherwise(under(major, minor + one, zero))
        caret = F.when((major > 0) | minor.isNull(), under(major + one, zero, zero)).when((minor > 0) | patch.isNull(), under(zero, minor + one, zero)).otherwise(under(zero, zero, patch + one))
        floor = _key(major, F.coalesce(minor, zero), F.coalesce(patch, zero), n["release"], n["parts"])
        return F.struct(n["ok"].alias("ok"), n["op"].alias("op"), (minor.isNull() | patch.isNull()).alias("partial"), n["release"].alias("release"), floor.alias("floor"), under(major, F.coalesce(minor, zero), zero).alias("begins"), after.alias("after"), caret.alias("caret"))

    def interval(k: Column) -> Column:
        op, partial = k["op"], k["partial"]
        same = op == "="
        low = F.when(same & partial, k["begins"]).when((op == ">") & partial, k["after"]).when(op.isin(">", ">=", "=", "~", "^"), k["floor"])
        high = F.when(same & partial, k["after"]).when(same | (op == "<"), k["floor"]).when(op == "<=", F.when(partial, k["after"]).otherwise(k["floor"])).when(op == "~", k["after"]).when(op == "^", k["caret"])
        low_open, high_open = (op == ">") & ~partial, op.isin("<", "~", "^") | (op.isin("=", "<=") & partial)
        return F.struct(k["ok"].alias("ok"), low.alias("low"), low_open.alias("low_open"), high.alias("high"), high_open.alias("high_open"), F.when(~k["release"] & ~partial, k["floor"]).alias("pre"))

    return bound(bound(bound(fields, numbers), keys), interval)


def requirement(text: Column) -> Column:
    """struct(low, high, pre): the interval of keys that meet all comparators of a requirement, and the keys of those that name a pre-release.

    low is (key, open) and high (key, closed), null where there is no bound. Null if the text can't be read. Made once for
    each text; meets() only compares.
    """
    parts = F.split(F.trim(text), ",", -1)

    def narrowest(made: Column) -> Column:
        ends = lambda side, flag, name: F.transform(F.filter(made, lambda c: c[side].isNotNull()), lambda c: F.struct(c[side].alias("key"), flag(c).alias(name)))
        low, high = F.array_max(ends("low", lambda c: c["low_open"], "open")), F.array_min(ends("high", lambda c: ~c["high_open"], "closed"))
        pre = F.transform(F.filter(made, lambda c: c["pre"].isNotNull()), lambda c: c["pre"])
        return F.when(F.forall(made, lambda c: F.coalesce(c["ok"], F.lit(False))), F.struct(low.alias("low"), high.alias("high"), pre.alias("pre")))

    return bound(bound(parts, lambda all_: F.transform(all_, lambda p: _comparator(F.trim(p), F.size(all_) == 1))), narrowest)


def meets(at: Column, required: Column) -> Column:
    """Whether a version's key meets a requirement(); null if either can't be read.

    Pre-releases do only where a comparator names a pre-release of the same three numbers.
    """
    low, high = required["low"], required["high"]
    above = low.isNull() | (at > low["key"]) | ((at == low["key"]) & ~low["open"])
    below = high.isNull() | (at < high["key"]) | ((at == high["key"]) & high["closed"])
    named = F.exists(required["pre"], lambda p: (p["major"] == at["major"]) & (p["minor"] == at["minor"]) & (p["patch"] == at["patch"]))
    return F.when(at.isNotNull() & required.isNotNull(), above & below & (at["release"] | named))


def satisfies(version: Column, text: Column) -> Column:
    """Whether a version text meets a requirement text; null if either can't be read."""
    return meets(key(version), requirement(text))


def toolchain_floor(text: Column) -> Column:
    """struct(major, minor, patch) of a floor such as 1, 1.70 or 1.70.2; null for other texts."""
    m = r"^\s*v?(\d+)(?:\.(\d+))?(?:\.(\d+))?\s*$"
    n = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, m, k), F.lit("")).try_cast("long"), F.lit(0))
    return F.when(text.rlike(m), F.struct(n(1).alias("major"), n(2).alias("minor"), n(3).alias("patch")))
