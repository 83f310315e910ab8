"""Text functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """Distinct three-character substrings of the lower-cased words, each word padded by two blanks and one."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3))
    return F.array_distinct(F.flatten(F.transform(words, grams)))


def trigram_codes(text: Column) -> Column:
    """trigrams(), each as one whole number: its three characters are a-z, 0-9 or blank."""
    at = lambda g, i: F.ascii(F.substring(g, i, 1))
    return F.transform(trigrams(text), lambda g: at(g, 1) * 65_536 + at(g, 2) * 256 + at(g, 3))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard index of the trigrams of two texts; 0 where neither has any."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def contains(text: Column, part: str) -> Column:
    """Whether the text holds the part, ignoring case; wildcards have no meaning."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def glob_to_like(glob: str) -> str:
    """A LIKE pattern over whole strings: * is any run, ? any character, and %, _ and \\ stand for themselves."""
    return "".join({"*": "%", "?": "_", "%": "\\%", "_": "\\_", "\\": "\\\\"}.get(c, c) for c in glob)


def doc_summary(docs: Column) -> Column:
    """What stands before the first blank line."""
    return F.trim(F.substring_index(docs, "\n\n", 1))


def shortened(text: Column, limit: int) -> tuple[Column, Column]:
    """(the first `limit` characters, whether others followed)."""
    return F.substring(text, 1, limit), F.length(text) > limit


def clean_strings(values: Column) -> Column:
    """Trimmed, without blank ones, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")))


def license_tokens(expression: Column) -> Column:
    """Identifiers of a licence expression, sorted and distinct."""
    found = F.regexp_extract_all(expression, F.lit(r"([A-Za-z0-9.+:-]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: ~F.upper(t).isin("AND", "OR", "WITH"))))


def license_status(expression: Column, allow: list[str], deny: list[str]) -> Column:
    """unknown without an expression; denied if an identifier is, or if none of a given allow list is; else allowed."""
    tokens = F.transform(license_tokens(expression), lambda t: F.upper(t))
    hit = lambda names: F.arrays_overlap(tokens, F.array(*[F.lit(n.strip().upper()) for n in names])) if names else F.lit(False)
    allowed = hit(allow) if allow else F.lit(True)
    return F.when(expression.isNull() | (F.trim(expression) == ""), "unknown").when(hit(deny), "denied").when(~allowed, "denied").otherwise("allowed")


def overlap(a: Column, b: Column) -> Column:
    """Common values of two lists, ignoring case."""
    low = lambda x: F.transform(x, lambda v: F.lower(v))
    return F.size(F.array_intersect(low(a), low(b)))


def match_reasons(query: str, name: Column, description: Column, keywords: Column, categories: Column) -> Column:
    any_of = lambda values: F.exists(values, lambda v: contains(v, query))
    hits = (("name", contains(name, query)), ("description", contains(description, query)), ("keyword", any_of(keywords)), ("category", any_of(categories)))
    return F.array_compact(F.array(*[F.when(hit, tag) for tag, hit in hits]))


def snippet(text: Column, query: str, before: int = 80, after: int = 140, otherwise: int = 220) -> Column:
    """Characters around the first match, or the first ones."""
    at = F.instr(F.lower(text), query.lower())
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + len(query) + after - start)).otherwise(F.substring(text, 1, otherwise))


def strip_html(html: Column) -> Column:
    """Text of a page: tags become blanks, four entities are read, white space is squeezed."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.substring(F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " ")), 1, 1_000_000)


def html_title(html: Column) -> Column:
    found = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1))
    return F.when(found != "", F.substring(found, 1, 300))


def hrefs(html: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))))


def generic_argument(text: Column) -> Column:
    """What stands between the first < and the last >."""
    return F.regexp_extract(text, r"<(.*)>", 1)


def repository(url: Column) -> tuple[Column, Column]:
    """(owner, name) of a code host's URL."""
    pattern = r"github\.com[/:]([^/]+)/([^/#?]+?)(?:\.git)?(?:[/#?].*)?$"
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(url, pattern, 2), F.lit(""))


def last_page(link_header: Column) -> Column:
    """The page number of the link marked last."""
    return F.nullif(F.regexp_extract(link_header, r'[?&]page=([0-9]+)[^>]*>;\s*rel="last"', 1), F.lit("")).try_cast("long")


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")


def severity_label(label: Column, score: Column) -> Column:
    """The database's own label, else one for the first number of the score text: 9, 7, 4, above 0."""
    n = first_number(score)
    own = F.lower(F.trim(label))
    return F.when(own != "", own).when(n >= 9, "critical").when(n >= 7, "high").when(n >= 4, "medium").when(n > 0, "low")
