"""Quality rules, line first: rules judge lines, failing lines go, documents that lose too much go with them.

A text splits at \\n. A line without a word (`[^\\x20\\x09-\\x0D]+`) is neutral: it stays and counts for nothing.
A line with n words fails if one of these holds (integers only, so that every engine agrees):

* punctuation: over 2 of `#*$%&|<>[]` for 5 words, or over one `!` for 2 words and 4 of them at least;
* ending: 8 words or more without one of `.!?`;
* navigation: over one `|` or `>` for 4 words;
* shouting: 20 ASCII letters or more, over 3 of 4 in upper case;
* boilerplate: it holds one of BOILERPLATE, ignoring the case of A-Z, or equals an earlier line of its text.

A document is kept if it passes the base rule (50 words at least, and at most half of its words stand in three-word
windows found twice or more) and the failing lines held at most half of the characters of its words.

Defined cases: null is a text without words (not kept, cleaned text null); rows are judged one by one, so repeated
rows and ids are kept as they are; the first of equal lines stays; a text of any length is one row; an input column with
the name of a new one, in any case, is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .rows import with_arrow_columns, with_new_text

SYMBOLS = "[#*$%&|<>]"
#: Phrases of licence lines, footers and menus.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "accept cookies", "click here", "sign up for our", "subscribe to our",
    "enable javascript", "skip to content", "back to top",
)
MIN_WORDS = 50

FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
    T.StructField("n_failed_lines", T.LongType()), T.StructField("failed_chars", T.LongType()),
    T.StructField("cleaned", T.StringType()),
]


def _flags(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_SYMBOL, _BAR, _BANG = _flags(SYMBOLS), _flags("|>"), _flags("!")
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_END = _flags(".!?")
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _sums(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.int32)
    np.cumsum(table[data], out=out[1:])
    return out


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are found twice or more; which are not the first of their kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later = np.concatenate([[False], same])
    twice = later | np.concatenate([same, [False]])
    out = np.empty((2, len(keys)), bool)
    out[0, order], out[1, order] = twice, later
    return out[0], out[1]


def judge(texts: pa.Array) -> list[pa.Array]:
    """The columns FIELDS for a few MB of texts."""
    data, off = B.text_bytes(texts)
    n = len(off) - 1
    starts, ends, first = B.word_spans(data, off)
    n_words = np.diff(first)
    chars = _sums(data, _LEAD)
    word_chars = np.concatenate([[0], np.cumsum(chars[ends] - chars[starts])])
    sums = B.prefix_hash(data)

    # words in three-word windows found twice or more in their text
    grams, gram_first = B.shingle_hashes(B.span_hash(sums, starts, ends), first, 3)
    gram_row = B.row_of(gram_first)
    twice, _ = _repeats(B.mix(grams + B.mix(gram_row.astype(np.uint64))))
    twice &= (n_words >= 3)[gram_row]
    at = np.flatnonzero(twice) - gram_first[gram_row[twice]] + first[gram_row[twice]]
    covered = np.zeros(len(starts) + 1, bool)
    for k in range(3):
        covered[at + k] = True
    n_repeat = np.diff(np.concatenate([[0], np.cumsum(covered[:-1])])[first])

    # lines
    ls, le, line_first = B.line_spans(data, off)
    row = B.row_of(line_first)
    words_before = np.searchsorted(starts, np.concatenate([ls, le]))
    w0, w1 = words_before[: len(ls)], words_before[len(ls) :]
    lw = w1 - w0
    count = {k: (c := _sums(data, t))[le] - c[ls] for k, t in (("symbols", _SYMBOL), ("bars", _BAR), ("bangs", _BANG), ("upper", _UPPER), ("letters", _LETTER), ("ends", _END))}
    brackets = _sums(data, _flags("[]"))
    count["symbols"] = count["symbols"] + brackets[le] - brackets[ls]
    _, later = _repeats(B.mix(B.span_hash(sums, ls, le) + B.mix(row.astype(np.uint64))))
    duplicate = later & (lw > 0)
    has = lw > 0
    lowered = B.LOWER[data].tobytes()
    phrase = np.zeros(len(ls), bool)
    for p in BOILERPLATE:
        i = lowered.find(p.encode())
        while i >= 0:
            k = np.searchsorted(ls, i, side="right") - 1
            phrase[k] |= i + len(p) <= le[k]
            i = lowered.find(p.encode(), i + 1)
    failed = has & (
        (5 * count["symbols"] > 2 * lw)
        | ((count["bangs"] >= 4) & (2 * count["bangs"] > lw))
        | ((lw >= 8) & (count["ends"] == 0))
        | (4 * count["bars"] > lw)
        | ((count["letters"] >= 20) & (4 * count["upper"] > 3 * count["letters"]))
        | phrase
        | duplicate
    )
    per_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[line_first])
    total, lost = np.diff(word_chars[first]), per_text((word_chars[w1] - word_chars[w0]) * failed)
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
    kept = ~base_failed & (2 * lost <= total)

    n_failed = per_text(failed)
    cleaned = texts.to_pylist()
    raw = data.tobytes()
    for i in np.flatnonzero(n_failed):
        span = range(line_first[i], line_first[i + 1])
        cleaned[i] = b"\n".join(raw[ls[k] : le[k]] for k in span if not failed[k]).decode()
    symbols = np.diff(_sums(data, _SYMBOL)[off])
    ints = (n_words, total, symbols, per_text(duplicate), n_repeat)
    assert len(n_words) == n
    return [
        *(pa.array(np.asarray(x, np.int64)) for x in ints), pa.array(base_failed), pa.array(kept),
        pa.array(np.asarray(n_failed, np.int64)), pa.array(np.asarray(lost, np.int64)), pa.array(cleaned, pa.string()),
    ]


def apply_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with the columns FIELDS (an input column of such a name is replaced)."""
    return with_arrow_columns(docs, text, FIELDS, judge, keep)


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, without their failing lines, with the columns of docs, whatever their names."""
    return with_new_text(docs, text, FIELDS, judge, "cleaned", "kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_rules(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "failed_chars")


_PHRASES = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
_COUNT = "length(regexp_replace(line, '[^{0}]', '', 'g'))"
_W = r"[^\x20\x09-\x0D]+"
OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{_W}') AS ws FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
gk AS (SELECT rid, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) AS k FROM g),
gt AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM gk) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM gt) GROUP BY rid),
l0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
l1 AS (SELECT rid, pos, line, lower(line) AS low, regexp_extract_all(line, '{_W}') AS ws, row_number() OVER (PARTITION BY rid, line ORDER BY pos) AS nth FROM l0),
l2 AS (SELECT rid, ws, len(ws) AS n, nth > 1 AS dup, length(array_to_string(ws, '')) AS chars,
    {_COUNT.format(r"\[\]#*$%&|<>")} AS symbols, {_COUNT.format("|>")} AS bars, {_COUNT.format("!")} AS bangs,
    {_COUNT.format("A-Z")} AS upper, {_COUNT.format("A-Za-z")} AS letters, {_COUNT.format(".!?")} AS ends, ({_PHRASES}) AS phrase
    FROM l1 WHERE len(ws) > 0),
l3 AS (SELECT *, (5 * symbols > 2 * n OR (bangs >= 4 AND 2 * bangs > n) OR (n >= 8 AND ends = 0) OR 4 * bars > n
    OR (letters >= 20 AND 4 * upper > 3 * letters) OR phrase OR dup) AS failed FROM l2),
l4 AS (SELECT rid, count(*) FILTER (WHERE dup) AS n_dup, count(*) FILTER (WHERE failed) AS n_failed, coalesce(sum(chars) FILTER (WHERE failed), 0) AS lost FROM l3 GROUP BY rid),
r AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_failed, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(lost, 0) AS BIGINT) AS failed_chars
    FROM w LEFT JOIN rep USING (rid) LEFT JOIN l4 USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * failed_chars <= word_chars AS kept, n_failed_lines, failed_chars FROM r
"""
