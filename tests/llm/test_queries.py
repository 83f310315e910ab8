"""The queries of operators without SQL, on a small folder, against the libraries and plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest

from depscope import llm

WORDS = ["the", "Ring", "größe", "niño", "x1", "it's", "—dash", "日本", "a|b", "<|endoftext|>", "end."]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    text = lambda n: rng.choice([" ", "\n"]).join(rng.choice(WORDS) for _ in range(n))
    shared = "".join(rng.choice("abcdefghij ") for _ in range(260))
    texts = [text(rng.randint(1, 60)) for _ in range(24)] + [f"{text(5)} {shared} {text(5)}", f"{shared}{text(3)}", shared * 3, "z" * 500, "", None, " ", "the Ring " * 1500]
    return list(enumerate(texts, 3)) + [(5, "a second text of one id"), (-4, "the last")]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("documents")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def found(spark, folder, name, *columns):
    return Counter(tuple(r) for r in llm.queries()[name](spark, folder).select(*columns).collect())


def test_token_counts(spark, rows, folder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    n = {x: len(t.encode(x or "", add_special_tokens=False).ids) for _, x in rows}
    assert found(spark, folder, "op5_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == Counter((i, len((x or "").encode()), n[x], n[x] > 2048) for i, x in rows)
    assert any(v > 2048 for v in n.values())


def test_scores(spark, rows, folder):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda x: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")), None]
    seen = Counter(w for i, x in rows if not held(i) for w in tokens(x))
    n, v = sum(seen.values()), len(seen)
    made = llm.queries()["op6_context_tree_score"](spark, folder).collect()
    base = lambda x: sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(x))
    want = Counter((i, held(i), len(tokens(x)), sum(seen[w] > 0 for w in tokens(x)), n, round(base(x), 6)) for i, x in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in made) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in made)


def test_token_files(spark, rows, folder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {x: [*t.encode(x or "", add_special_tokens=False).ids, 2] for _, x in rows}
    crc = lambda x: zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids[x]))
    made = llm.queries()["op7_token_files"](spark, folder).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in made) == Counter((i, len(ids[x]), crc(x)) for i, x in rows)
    at = 0
    for r in sorted(made, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at
        at += r["n_tokens"]


def test_sentencepiece(spark, rows, folder):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((i, len(k := lib.encode(x or "")), sha(",".join(map(str, k))), sha(lib.decode(k))) for i, x in rows)
    assert found(spark, folder, "op8_sentencepiece", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_sentencepiece_texts_without_tokens(spark, rows, folder):
    # all columns: one that is not asked for is not made either
    made = llm.queries()["op8_sentencepiece"](spark, folder).collect()
    assert Counter((r["doc_id"], r["covered_bytes"]) for r in made) == Counter((i, len((x or "").encode())) for i, x in rows)
    assert sum(r["n_tokens"] == 0 for r in made) == sum(not x for _, x in rows) > 0


def test_sentencepiece_keeps_no_long_part():
    import sentencepiece

    from depscope.llm import sentencepiece_codec

    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, lib = sentencepiece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["the Ring " + c * 5000 + " end." for c in "abcd"] * 2
    assert [x[0].tolist() for x in codec.encode(texts)] == lib.encode(texts)
    assert {" the", " Ring", " end."} <= set(codec.known) and max(map(len, codec.known)) <= sentencepiece_codec.LONGEST


def test_suffix_dedup(spark, rows, folder):
    data = [(x or "").encode() for _, x in rows]
    starts = Counter(d[k : k + 200] for d in data for k in range(len(d) - 199))
    want = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for k in range(len(d) - 199):
            if starts[d[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.append((i, len(d), sum(gone), spans, sha(bytes(c for c, g in zip(d, gone, strict=True) if not g))))
    assert found(spark, folder, "op9_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(want)
    assert sum(w[3] for w in want) > 4
