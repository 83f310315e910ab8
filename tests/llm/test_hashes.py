"""Structured texts under the shared hash, combining marks, mapped models, offsets that leave out text."""

import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from depscope.llm import bytesops as B
from depscope.llm import chat_format, context_tree, decontaminate, ngram_join, quality_rules, sentencepiece_codec, suffix_dedup, token_counts


def morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


#: Two texts whose polynomials modulo 2^64 are equal, whatever its point and the values of the letters.
ONE, OTHER = morse(1024), morse(1024, "b", "a")


@pytest.mark.parametrize("n", [8, 64, 1024, 1 << 16])
def test_structured_words_differ(n):
    data = np.frombuffer((morse(n) + morse(n, "b", "a") + "xy" + morse(n)).encode(), np.uint8)
    sums = B.prefix_hash(data)
    starts = np.array([0, n, 2 * n + 2])
    a, b, c = B.span_hash(sums, starts, starts + n)
    assert a == c != b
    windows = B.window_hash(sums, n)
    assert (windows[starts] == [a, b, c]).all() and len(windows) == len(data) - n + 1


def test_hash_is_the_polynomial():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    sums = B.prefix_hash(data)
    p = B._PRIME
    for start, end in ((0, 3000), (17, 17), (5, 6), (1000, 2999)):
        parts = [sum(int(B._BYTE_VALUES[k][x]) * pow(B._POINTS[k], i, p) for i, x in enumerate(data[start:end])) % p for k in range(2)]
        want = B.mix(np.array([(parts[0] | parts[1] << 31) + (end - start) * 0xD6E8FEB86659FD93 & (1 << 64) - 1], np.uint64))
        assert B.span_hash(sums, np.array([start]), np.array([end])) == want


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame([(1, ONE), (2, OTHER)], "doc_id long, text string")


def test_operators_on_structured_words(spark, two):
    assert {r["component_id"] for r in ngram_join.near_duplicates(two).collect()} == {1, 2}
    assert ngram_join.one_of_each(two).count() == 2
    found = decontaminate.mark_contamination(two, spark.createDataFrame([(7, ONE)], "item_id long, text string"), keep=["doc_id"]).collect()
    assert {r["doc_id"]: r["n_hit"] for r in found} == {1: 1, 2: 0}
    keys, _ = context_tree._word_keys(pa.array([ONE, OTHER, ONE]))
    assert len(set(keys.tolist())) == 2
    lines = spark.createDataFrame([(1, f"{'one two three. ' * 20}\n{ONE}.\n{OTHER}.\n{ONE}.")], "doc_id long, text string")
    assert quality_rules.apply_rules(lines).first()["n_dup_lines"] == 1


def test_regions_of_structured_words():
    data, off = B.text_bytes(pa.array([f"{ONE}{OTHER}", f"{OTHER}{ONE}"]))
    row, start, end, anchor, content = suffix_dedup.regions(data, off, 1024, 64)
    texts = ["".join(map(chr, data[off[r] + a : off[r] + b])) for r, a, b in zip(row, start, end, strict=True)]
    for t, h in zip(texts, content, strict=True):
        assert all((t == u) == (h == g) for u, g in zip(texts, content, strict=True))


def test_many_marks():
    c = token_counts.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
    count = lambda t: len(c.library.encode(t, add_special_tokens=False).ids)
    start = time.monotonic()
    texts = ["e" + "́" * 20_000, "x" + "̣" * 5000 + "́" * 5000, "ᅡ" * 5000, "ᄀ" + "ᅡᆨ" * 2000, "é" + "̈́" * 3000 + " a"]
    data, off = B.text_bytes(pa.array(texts))
    _, totals = c.table(data, off)
    assert totals.tolist() == [count(t) for t in texts]
    assert time.monotonic() - start < 120
    rng = random.Random(2)
    marks = ["́", "̣", "̂", "̈́", "̸", "ᅡ", "ᆨ", "़", "́́", "a", "=", "ᄀ", " "]
    for _ in range(60):
        t = "".join(rng.choice(marks) for _ in range(rng.randint(1, 14)))
        data, off = B.text_bytes(pa.array([t]))
        counts, _ = c.table(data, off)
        ends = np.cumsum([len(x.encode()) for x in t])
        assert [int(counts[e - 1]) for e in ends] == [count(t[: k + 1]) for k in range(len(t))], [hex(ord(x)) for x in t]


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
def test_mapped_models(tmp_path, rule):
    """The given model with another map; the library normalises and encodes in one, the operator in two steps."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).serialized_model_proto()
    compiled = dict(sentencepiece_codec._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()))[2]
    field = lambda n, data: sentencepiece_codec._varint(n << 3 | 2) + sentencepiece_codec._varint(len(data)) + data
    parts = []
    for number, value, raw in sentencepiece_codec._raw_fields(model):
        parts.append(field(3, b"".join(r for n, _, r in sentencepiece_codec._raw_fields(value) if n != 2) + field(2, compiled)) if number == 3 else raw)
    (tmp_path / "mapped.model").write_bytes(b"".join(parts))
    lib = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "mapped.model"))
    codec = sentencepiece_codec.Codec(str(tmp_path / "mapped.model"))
    assert codec.map.units
    rng = random.Random(6)
    pieces = ["ﬃ", "́", "é", "①", "Å", "１２", "ﷺ", "word", " ", "  ", "\n", "\t", "é", "㍿", "½", "A", "ẞ", "한", "​", "▁", "日本", "x", "　", "…"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(10_000)]
    assert sum(lib.encode(t) != sentencepiece.SentencePieceProcessor(model_proto=model).encode(t) for t in texts[:500]) > 100
    for t, (ids, starts, ends), want in zip(texts, codec.encode(texts), lib.encode(texts), strict=True):
        assert ids.tolist() == want, (t, ids.tolist(), want)
        assert codec.decode(ids) == lib.decode(want)
        if len(ids):
            assert starts[0] == 0 and ends[-1] == len(t.encode()) and (starts[1:] == ends[:-1]).all() and (starts <= ends).all()


def test_offsets_that_leave_out_text():
    formatted = "<|turn|>assistant<|text|> hi there <|end|>"
    start = formatted.index(" hi")
    spans = [(start, start + 10)]
    whole = [(0, start), (start, start + 3), (start + 3, start + 10), (start + 10, len(formatted))]
    assert chat_format.masked_text(formatted, spans, whole, [0, 1, 1, 0]) == [" hi there "]
    trimmed = [(0, start), (start + 1, start + 3), (start + 4, start + 9), (start + 10, len(formatted))]
    with pytest.raises(ValueError, match="leave out"):
        chat_format.masked_text(formatted, spans, trimmed, [0, 1, 1, 0])
