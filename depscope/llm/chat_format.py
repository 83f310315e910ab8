"""Chat formatting with an offset-aligned loss mask.

A conversation is rendered turn by turn as `<|turn|>role<|text|>text<|end|>`. Inside roles and texts `\\` becomes `\\\\` and
`<|` becomes `<\\|`, so a marker never stands inside a turn, and unescaping restores every text. The whole rendering
is encoded once, the markers being added tokens, so no token crosses a marker. Turns are read back from the output
by their markers; their sorted text spans and the sorted token spans meet by binary search, and the tokens of
assistant texts carry the loss.

Turns of a conversation are ordered by turn, then role and text (nulls first); a conversation is one row, as its
hash and its encoding need it whole. Defined cases: a null role or text is empty; rows of a null conv_id are one
conversation; turns of equal number go by role and text, and repeated rows are turns of their own; a text of any length is
in one row, that of its conversation; an empty table gives an empty result; extra columns, of any name, are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import picked

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"
_READ = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}" for role, text in turns)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end are of the escaped text within the rendering."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _READ.finditer(formatted)]


def loss_mask(spans: list[tuple[int, int]], offsets: list[tuple[int, int]]) -> list[int]:
    """1 for each token that lies in one of the spans; both lists are sorted and tokens never cross a span's end."""
    starts = [a for a, _ in offsets]
    mask = [0] * len(offsets)
    for start, end in spans:
        for k in range(bisect_left(starts, start), bisect_right(starts, end - 1) if end > start else 0):
            mask[k] = 1
    return mask


def masked_text(formatted: str, spans: list[tuple[int, int]], offsets: list[tuple[int, int]], mask: list[int]) -> list[str]:
    """The unescaped text of each run of tokens under the mask, as their offsets give it; raises where these leave out text of the spans."""
    runs: list[tuple[int, int]] = []
    open_run = False
    for (a, b), on in zip(offsets, mask, strict=True):
        if on and open_run and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        elif on:
            runs.append((a, b))
        open_run = bool(on)
    if sum(b - a for a, b in runs) != sum(b - a for a, b in spans):
        raise ValueError("the tokenizer's offsets leave out text, or reach beyond a turn")
    return [unescape(formatted[a:b]) for a, b in runs]


_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = False
        t.no_truncation()
        t.no_padding()
        t.add_tokens([AddedToken(x, normalized=False, special=False) for x in (TURN, TEXT, END)])
        _tokenizers[path] = t
    return _tokenizers[path]


SCHEMA = "conv_id long, n_turns long, formatted string, ids array<int>, loss_mask array<int>, loss_texts array<string>, roles array<string>, texts array<string>"


def format_conversations(rows: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text), with SCHEMA. tokenizer: path of a tokenizers file."""
    own = picked(rows, "conv_id", "turn", "role", "text").select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    turns = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    turns = turns.select("conv_id", F.transform("turns", lambda t: F.coalesce(t["role"], F.lit(""))).alias("roles"), F.transform("turns", lambda t: F.coalesce(t["text"], F.lit(""))).alias("texts"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer)
        for batch in batches:
            for i in range(batch.num_rows):
                roles, texts = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                formatted = render(list(zip(roles, texts, strict=True)))
                encoded = encoder.encode(formatted, add_special_tokens=False)
                back = read_turns(formatted)
                spans = [(a, b) for role, _, a, b in back if role == LOSS_ROLE]
                mask = loss_mask(spans, encoded.offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, 1), pa.array([len(back)], pa.int64()), pa.array([formatted], pa.string()),
                        pa.array([encoded.ids], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.int32())),
                        pa.array([masked_text(formatted, spans, encoded.offsets, mask)], pa.list_(pa.string())),
                        pa.array([[x[0] for x in back]], pa.list_(pa.string())), pa.array([[x[1] for x in back]], pa.list_(pa.string())),
                    ],
                    names=names,
                )

    return turns.mapInArrow(run, SCHEMA)


def turns_digest(turns: list[tuple[str, str]]) -> str:
    return sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def op2_chat_format(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    planted = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*[F.col(n).cast(t).alias(n) for n, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    made = format_conversations(rows.unionByName(extra), tokenizer)
    told = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return made.select("conv_id", "n_turns", F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP2_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 23 AS n FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
