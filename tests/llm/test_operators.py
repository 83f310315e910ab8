"""Each operator against a brute-force version, on texts with nulls, empties, repeats, a long one and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from depscope import llm
from depscope.llm import chat_format, components, context_tree, decontaminate, fm_index, line_dedup, ngram_join, part_table, quality_rules, sentencepiece_codec, suffix_dedup, token_counts, token_files

SPACE = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def bag(rows):
    return Counter(tuple(r) for r in rows)


# quality rules


def brute_lines(text):
    """(line, whether it fails, whether it repeats an earlier one) of each line."""
    seen = set()
    for line in (text or "").split("\n"):
        w = re.findall(SPACE, line)
        again = bool(w) and line in seen
        seen.add(line)
        n = len(w)
        count = lambda chars, line=line: sum(c in chars for c in line)
        upper = len(re.findall("[A-Z]", line))
        letters = len(re.findall("[A-Za-z]", line))
        bad = 5 * count("#*$%&|<>[]") > 2 * n or (count("!") >= 4 and 2 * count("!") > n) or (n >= 8 and not count(".!?")) or 4 * count("|>") > n or (letters >= 20 and 4 * upper > 3 * letters)
        bad = bad or any(p in lower(line) for p in quality_rules.BOILERPLATE) or again
        yield line, bool(w) and bad, again


def brute_quality(text):
    words = re.findall(SPACE, text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    dup, failed, lost = 0, 0, 0
    for line, bad, again in brute_lines(text):
        dup += again
        failed += bad
        lost += bad * sum(map(len, re.findall(SPACE, line)))
    chars = sum(map(len, words))
    base = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), chars, len(re.findall(r"[#*$%&|<>\[\]]", text or "")) - len(re.findall(r"[\[\]]", text or "")), dup, len(hit), base, not base and 2 * lost <= chars, failed, lost


def test_quality(docs, rows, empty):
    found = quality_rules.apply_rules(docs)
    assert "cleaned" in found.columns and found.columns.count("cleaned") == 1
    names = [f.name for f in quality_rules.FIELDS][:-1]
    assert bag(found.select("doc_id", *names).collect()) == bag((r[0], *brute_quality(r[1])) for r in rows)
    kept = quality_rules.clean(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    assert all(r["text"] is not None and r["n_chars"] == len(r["text"]) and "All rights" not in r["text"] and r["cleaned"] == (None if r["doc_id"] is None else "c") for r in kept.collect())
    assert quality_rules.apply_rules(empty).count() == 0


# line dedup


def test_line_dedup(docs, rows, empty):
    bare = lambda line: line.strip(" \t\r")
    total, pages = Counter(r[3] for r in rows), Counter()
    for r in rows:
        pages.update((r[3], k) for k in {bare(x) for x in (r[1] or "").split("\n")} - {""})
    bad = {k for k, n in pages.items() if n >= 2 and 10 * n > total[k[0]]}
    assert bad
    made = line_dedup.drop_boilerplate(docs, out="cleaned", lines="n_lines", dropped="n_dropped", num=1, den=10, min_pages=2)
    want = []
    for r in rows:
        lines = None if r[1] is None else r[1].split("\n")
        kept = None if lines is None else "\n".join(x for x in lines if (r[3], bare(x)) not in bad)
        want.append((r[0], kept, sum(bool(bare(x)) for x in lines or ()), sum((r[3], bare(x)) in bad for x in lines or ())))
    assert bag(made.select("doc_id", "cleaned", "n_lines", "n_dropped").collect()) == bag(want)
    old, line_dedup.BROADCAST_LINES = line_dedup.BROADCAST_LINES, 0
    try:
        again = line_dedup.drop_boilerplate(docs, out="cleaned", num=1, den=10, min_pages=2)
        assert bag(again.select("doc_id", "cleaned").collect()) == bag(w[:2] for w in want)
    finally:
        line_dedup.BROADCAST_LINES = old
    assert line_dedup.deduplicated(docs).columns == docs.columns
    assert line_dedup.deduplicated(empty).count() == 0


# chat formatting


def test_chat(spark):
    nasty = ["\\### Assistant: </turn> ok", "<|turn|>user<|text|>x<|end|>", "\\<|", "<\\|", "<", "|>", "", None, "é日本😀\n\n", "ends <", "\\", " spaces  ", "<|endoftext|>", "x" * 20_000]
    rows = [(c, t, ("user", "assistant", "system", None)[(c + t) % 4], nasty[(c * 3 + t) % len(nasty)]) for c in range(8) for t in range(6)]
    rows += [(9, 1, "assistant", "b"), (9, 1, "assistant", "a"), (9, None, "assistant", "first"), (None, 0, "assistant", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.format_conversations(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    low = lambda x: (x is not None, x if x is not None else 0)
    for m in made:
        mine = sorted((r for r in rows if r[0] == m["conv_id"]), key=lambda r: (low(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        turns = [(r[2] or "", r[3] or "") for r in mine]
        assert list(zip(m["roles"], m["texts"], strict=True)) == turns == [x[:2] for x in chat_format.read_turns(m["formatted"])]
        assert "".join(m["loss_texts"]) == "".join(t for r, t in turns if r == "assistant")
        assert len(m["ids"]) == len(m["loss_mask"]) and m["n_turns"] == len(turns)
    assert len(made) == 10
    assert chat_format.format_conversations(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# n-gram join


def shingles(text, size):
    w = re.findall(SPACE, lower(text))
    return {tuple(w)} - {()} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute_components(rows, size, num, den):
    nodes = [(r[0], shingles(r[1], size)) for r in rows if r[0] is not None]
    root = {i: i for i, _ in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(nodes):
        for j, b in nodes[:k]:
            both = len(a & b)
            if a and b and den * both >= num * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(r[0], len(shingles(r[1], size)), None if r[0] is None else find(r[0])) for r in rows]


@pytest.mark.parametrize(("size", "num"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(docs, rows, size, num):
    found = ngram_join.near_duplicates(docs, size=size, num=num, den=100)
    assert bag(found.collect()) == bag(brute_components(rows, size, num, 100))


def test_ngram_join_of_near_copies(spark):
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = ngram_join.BROADCAST_ROWS
    try:
        for ngram_join.BROADCAST_ROWS in (old, 0):
            found = ngram_join.near_duplicates(df, size=4, num=85, den=100)
            assert bag(found.collect()) == bag(brute_components(rows, 4, 85, 100))
    finally:
        ngram_join.BROADCAST_ROWS = old


def brute_groups(rows, size=5, num=80):
    """For each row with an id and a shingle, the least place of a row that it is linked with."""
    sets = [shingles(r[1], size) if r[0] is not None else set() for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= num * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) if sets[i] else None for i in range(len(rows))]


def test_one_of_each(docs, rows, empty):
    kept = ngram_join.one_of_each(docs)
    groups = brute_groups(rows)
    least = {}
    for r, g in zip(rows, groups, strict=True):
        if g is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = Counter(r[0] for r, g in zip(rows, groups, strict=True) if g is None) + Counter(least.values())
    found = kept.collect()
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in found) == want
    # two rows share the id 5, but no text: both stay
    assert sorted(r["text"] for r in found if r["doc_id"] == 5) == sorted(r[1] for r in rows if r[0] == 5) and want[5] == 2
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    found = {tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {(i, 0) for i in range(61)} | {(100, 100), (101, 100), (150, 150), (200, 150)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# decontamination


def test_decontamination(spark, docs, rows, empty):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    texts = [rows[2][1][30:200], "two words", "one", "", None, "no such words here", rows[8][1], rows[8][1], "Tiny!", " ".join(["abab"] * 12), "line one line one"]
    items = [(i, t) for i, t in enumerate(texts)] + [(None, "one"), (3, "the x1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_WORDS, 1):
        old, decontaminate.BLOCK_WORDS = decontaminate.BLOCK_WORDS, block
        try:
            found = decontaminate.mark_contamination(docs, bench).collect()
        finally:
            decontaminate.BLOCK_WORDS = old
        want = []
        for r in rows:
            w = words(r[1])
            hit, its = set(), set()
            for i, t in items:
                b = words(t)
                for g in {tuple(b[k : k + 10]) for k in range(max(len(b) - 9, 1))} if b and i is not None else ():
                    for p in range(len(w) - len(g) + 1):
                        if tuple(w[p : p + len(g)]) == g:
                            hit |= set(range(p, p + len(g)))
                            its.add(str(i))
            want.append((r[0], len(w), len(hit), len(its), tuple(sorted(its))))
        assert bag((f["doc_id"], f["n_words"], f["n_hit"], f["n_items"], tuple(f["items"])) for f in found) == bag(want)
    texts_of = {}
    for r in rows:
        texts_of.setdefault((r[0], len(words(r[1]))), []).append(r[1])
    for f in found:
        # each run of hit words goes, from the first byte of its first word to the last byte of its last one
        original = texts_of[f["doc_id"], f["n_words"]]
        assert len(set(original)) == 1
        raw, out, done = (original[0] or "").encode(), b"", 0
        for s in f["spans"]:
            out, done = out + raw[done : s["start"]], s["end"]
        assert f["cleaned"] == (None if original[0] is None else (out + raw[done:]).decode())
        assert sum(len(words(raw[s["start"] : s["end"]].decode())) for s in f["spans"]) == f["n_hit"]
        assert all(a["end"] < b["start"] for a, b in zip(f["spans"], f["spans"][1:], strict=False))
    assert any(f["n_hit"] for f in found)
    assert decontaminate.decontaminated(docs, bench).columns == docs.columns
    assert decontaminate.mark_contamination(empty, bench).count() == 0
    assert decontaminate.mark_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_fm_index():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 400)
    text[-1] = 0
    index = fm_index.FMIndex(text)
    for n in (1, 2, 3, 6):
        pats = np.array([rng.integers(1, 4, n) for _ in range(30)])
        low, high = index.search(pats, np.full(30, n))
        for p, a, b in zip(pats, low, high, strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, max(a, b)))) == want


# tokens


def test_token_counts(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    c = token_counts.PrefixCounter(path)
    n = lambda t: len(c.library.encode(t, add_special_tokens=False).ids)
    found = token_counts.prefix_tables(docs, path, budget=40).collect()
    assert bag((f["doc_id"], f["n_bytes"], f["n_tokens"], f["n_parts"]) for f in found) == bag((r[0], len((r[1] or "").encode()), n(r[1] or ""), len(re.findall(SPACE, r[1] or ""))) for r in rows)
    texts = {(r[0], len((r[1] or "").encode())): r[1] or "" for r in rows}
    for f in found:
        text = texts[f["doc_id"], f["n_bytes"]]
        counts = np.array(f["prefix_counts"], np.int64)
        assert len(counts) == len(text)
        for k in range(0, len(text) + 1, max(1, len(text) // 40)):
            assert token_counts.tokens_of_prefix(counts, k) == n(text[:k])
        fit = token_counts.longest_prefix(counts, 40)
        assert f["fit_bytes"] == len(text[:fit].encode())
        if len(text) < 700:
            assert fit == max(k for k in range(len(text) + 1) if n(text[:k]) <= 40)
    assert token_counts.prefix_tables(empty, path).count() == 0
    named = token_counts.prefix_tables(docs.withColumnRenamed("spans", "N_Tokens"), path, every=False)
    assert [x.lower() for x in named.columns].count("n_tokens") == 1 and "prefix_counts" not in named.columns


PIECES = ["a", "Word", "the", " ", "  ", "\n", "\t", ".", "...", "'", "'s", "'ll", "'LL", "'re", "r", "e", "v", "l", "s", "é", "É", "ñ", "1", "23", "²", "&&&", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endof", "日本", "\u3000", "\xa0", "—", "“x”",
          "\r", "-", "xyzzyq", "ﬁ", "\u0301", "e\u0301", "a\u0323\u0302", "İ", "Σ", "한", "\u1112\u1161\u11ab", "=\u0338", "\x1c", "\x00", "😀", "internationalization", "й", "\u0438\u0306", "\n\n", " \n"]


def test_every_prefix_of_odd_texts():
    c = token_counts.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(8)
    for _ in range(25):
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9))) for _ in range(20)]
        data, off = token_counts.B.text_bytes(pa.array(texts))
        counts, totals = c.table(data, off)
        for i, t in enumerate(texts):
            want = [len(c.library.encode(t[: k + 1], add_special_tokens=False).ids) for k in range(len(t))]
            ends = np.cumsum([len(x.encode()) for x in t]).astype(int)
            assert [int(counts[off[i] + e - 1]) for e in ends] == want and totals[i] == (want[-1] if want else 0), t


def test_counts_of_long_words():
    c = token_counts.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(9)
    words = ["".join(rng.choice("acgt") for _ in range(100_000)), "日本語" * 3000, "e\u0301" * 3000, "a" * 30_000 + "<|endoftext|>" + "b" * 30_000]
    data, off = token_counts.B.text_bytes(pa.array(words))
    counts, totals = c.table(data, off)
    for i, w in enumerate(words):
        assert totals[i] == len(c.library.encode(w, add_special_tokens=False).ids)
        for k in (1, 77, 5000, len(w) - 1):
            assert counts[off[i] + len(w[:k].encode()) - 1] == len(c.library.encode(w[:k], add_special_tokens=False).ids)


def test_byte_level_ids_of_odd_texts():
    e = token_files.ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert e.merges is not None
    rng = random.Random(10)
    for _ in range(60):
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(40)]
        ids, first = e.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == e.library.encode(t, add_special_tokens=False).ids, t


def test_part_table_of_equal_hashes_and_long_strings(monkeypatch):
    seen = []

    def make(parts):
        seen.append(len(parts))
        return np.concatenate([np.frombuffer(p, np.uint8) for p in parts]).astype(np.int32), np.array([len(p) for p in parts])

    words = [b"a", b"bb", b"ccc", b"bb", b"x" * 500, b"ddd", b"a"]
    data, first = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
    table = part_table.PartTable(make, np.int32, entries=2)
    for _ in range(3):
        values, ends = table.lists(data, first[:-1], first[1:])
        assert values.tolist() == data.tolist() and ends.tolist() == first.tolist()
    monkeypatch.setattr(part_table.B, "span_hash", lambda sums, starts, ends: np.full(len(starts), 7, np.uint64))
    values, ends = part_table.PartTable(make, np.int32).lists(data, first[:-1], first[1:])
    assert values.tolist() == data.tolist() and ends.tolist() == first.tolist()


def test_token_files(spark, docs, rows, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    make = lambda: (token_files.encoder(path).encode, token_files.encoder(path).dtype)
    folder = f"file://{tmp_path}/out"
    old, token_files.FILE_BYTES = token_files.FILE_BYTES, 4000
    try:
        index = token_files.write_token_files(docs, folder, make, 2)
    finally:
        token_files.FILE_BYTES = old
    lib = token_files.encoder(path).library
    found = token_files.read_token_files(spark, folder).orderBy("start").collect()
    # rows of one id stand in any order, which is the same each time
    assert [f["doc_id"] for f in found] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert bag((f["doc_id"], tuple(f["ids"])) for f in found) == bag((r[0], (*lib.encode(r[1] or "", add_special_tokens=False).ids, 2)) for r in rows)
    want, start = [], 0
    for f in found:
        want.append((f["doc_id"], start, len(f["ids"]), f["ids"]))
        start += len(f["ids"])
    assert [(f["doc_id"], f["start"], f["n_tokens"], f["ids"]) for f in found] == want
    again = f"file://{tmp_path}/again"
    token_files.write_token_files(docs.repartition(5), again, make, 2)
    assert [tuple(f) for f in token_files.read_token_files(spark, again).orderBy("start").collect()] == [tuple(f) for f in found]
    assert [f["ids_crc32"] for f in found] == [zlib.crc32(np.array(w[3], "<u4").tobytes()) for w in want]
    shuffled = token_files.shuffled_reads(index, folder, 5).collect()
    assert shuffled != token_files.shuffled_reads(index, folder, 6).collect() and token_files.shuffled_reads(index.where("id = 5"), folder, 5).count() == 2
    assert bag((f["doc_id"], tuple(f["ids"])) for f in shuffled) == bag((w[0], tuple(w[3])) for w in want)
    content = max((p for p in (tmp_path / "out/data").iterdir() if p.name.startswith("part-")), key=lambda p: p.stat().st_size).read_bytes()
    assert len(list(token_files.records(content))) > 1
    with pytest.raises(ValueError):
        list(token_files.records(content[:20] + bytes([content[20] ^ 1]) + content[21:]))
    token_files.write_token_files(empty, f"file://{tmp_path}/none", make, 2)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none").count() == 0


def test_sentencepiece(docs, rows, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    found = sentencepiece_codec.encode_and_decode(docs, path).collect()
    want = []
    for r in rows:
        p = lib.encode(r[1] or "", return_type="proto")
        ids = [x.id for x in p.pieces]
        # the library gives the whole character to the last of its byte pieces, the operator each byte to its own
        split = any(lib.is_byte(i) and int(lib.id_to_piece(i)[3:5], 16) > 127 for i in ids)
        ends = () if split else tuple(x.end for x in p.pieces)
        want.append((r[0], tuple(ids), () if split else tuple(x.begin for x in p.pieces), ends, lib.decode(ids)))
    split = {w[0] for w in want if w[1] and not w[3]}
    spans = lambda f, k: () if f["doc_id"] in split and f["ids"] else tuple(f[k])
    assert bag((f["doc_id"], tuple(f["ids"]), spans(f, "starts"), spans(f, "ends"), f["decoded"]) for f in found) == bag(want)
    assert all(list(f["starts"]) == [0, *f["ends"][:-1]] for f in found if f["ids"])
    assert sentencepiece_codec.encode_and_decode(empty, path).count() == 0


def test_character_map():
    import sentencepiece

    n = sentencepiece.SentencePieceNormalizer(rule_name="nfkc")
    m = sentencepiece_codec.CharacterMap(dict(sentencepiece_codec._fields(n.serialized_normalizer_spec()))[2])
    for text in ("ﬁne Å １２ が é", "㍿x한½", "①②ﷺ", "plain"):
        data, source = m.normalise(text)
        assert data.decode().replace(" ", "") == n.normalize(text).replace("▁", "").replace(" ", "")
        assert len(source) == len(data) + 1 and source == sorted(source) and source[-1] == len(text.encode())


# language model


def test_scores(docs, rows, empty):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*re.findall(SPACE, lower(t)), None]
    c = Counter(x for r in rows if not held(r[0]) for x in tokens(r[1]))
    total, kinds = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        w = tokens(r[1])
        want[r[0], held(r[0]), len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w), 6)] += 1
    old = context_tree.WORD_SHARE
    try:
        for context_tree.WORD_SHARE in (old, 20):
            found = context_tree.score_texts(docs).collect()
            assert Counter((f["doc_id"], f["held_out"], f["n_tokens"], f["n_known"], f["train_tokens"], round(f["base_score"], 6)) for f in found) == want
    finally:
        context_tree.WORD_SHARE = old
    size = {(r[0], r[1]): len((r[1] or "").encode()) + 1 for r in rows}
    assert all(f["bits_per_byte"] > 0 for f in found)
    assert -sum(f["score"] for f in found) / sum(size.values()) * math.log2(10) < 4
    assert context_tree.score_texts(empty).count() == 0


def test_context_tree_is_exact():
    """Against weights from the definition, on a small alphabet, every context being a node."""
    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, 300)
    padded = np.concatenate([np.full(context_tree.DEPTH, 255), data])
    counts = [Counter() for _ in range(context_tree.DEPTH + 1)]
    for i in range(context_tree.DEPTH, len(padded)):
        for d in range(context_tree.DEPTH + 1):
            counts[d][bytes(padded[i - d : i].astype(np.uint8)), int(padded[i])] += 1
    levels = []
    for d in range(context_tree.DEPTH + 1):
        keys = sorted({int.from_bytes(k, "big") for k, _ in counts[d]})
        table = np.zeros((len(keys), 256))
        for (k, b), n in counts[d].items():
            table[keys.index(int.from_bytes(k, "big")), b] += n
        levels.append((np.array(keys, np.uint64), table))
    tree = context_tree.ContextTree(levels)
    assert np.allclose((10.0 ** tree.log10.astype(np.float64)).sum(axis=1), 1, atol=1e-4)

    def log_block(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pair(d, context, q):
        """Zeros and ones at a node of the decomposition, q in heap order."""
        out = [0, 0]
        depth = q.bit_length() - 1
        for (k, b), n in counts[d].items():
            if k == context and (b | 256) >> (8 - depth) == q:
                out[(b >> (7 - depth)) & 1] += n
        return out

    def weighted(d, context, q):
        own = log_block(*pair(d, context, q))
        if d == context_tree.DEPTH:
            return own
        children = {k for k, _ in counts[d + 1] if k[1:] == context}
        return np.logaddexp(own, sum(weighted(d + 1, k, q) for k in children)) - math.log(2) if children else own

    def one(d, context, older, q):
        a, b = pair(d, context, q)
        own = (b + 0.5) / (a + b + 1)
        if d == context_tree.DEPTH:
            return own
        children = {k for k, _ in counts[d + 1] if k[1:] == context}
        stop = math.exp(log_block(a, b) - math.log(2) - weighted(d, context, q))
        child = older[-1:] + context
        return stop * own + (1 - stop) * (one(d + 1, child, older[:-1], q) if child in children else 0.5)

    older = bytes([1, 0, 2, 2, 1])
    p, q = 1.0, 1
    for k in range(7, -1, -1):
        x = one(0, b"", older, q)
        bit = (2 >> k) & 1
        p *= x if bit else 1 - x
        q = 2 * q + bit
    node = 0
    for k in range(1, context_tree.DEPTH + 1):
        nxt = tree.child[node, older[-k]]
        if nxt < 0:
            break
        node = nxt
    assert math.isclose(10.0 ** float(tree.log10[node, 2]), p, rel_tol=1e-4)


def test_every_context_is_a_node(spark):
    """Beyond 65,536 training bytes too, and with runs looked up by broadcast or by a join."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(500, 1500))) for _ in range(160)]
    texts += ["abcq" * 2 + "zyx" * k + "é" + rng.choice("cvbn") * 3 for k in range(1, 40)] + ["qqqq", "", "never met 日本"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    counts = [Counter() for _ in range(context_tree.DEPTH + 1)]
    for x, h in zip(texts, held, strict=True):
        data = b"\xff" * context_tree.DEPTH + x.encode() + b"\xff"
        for i in range(context_tree.DEPTH, len(data)) if not h else ():
            for d in range(context_tree.DEPTH + 1):
                counts[d][int.from_bytes(data[i - d : i], "big"), data[i]] += 1
    assert sum(counts[0].values()) > 2 * 65536
    levels = []
    for c in counts:
        keys = sorted({k for k, _ in c})
        table = np.zeros((len(keys), 256))
        at = {k: i for i, k in enumerate(keys)}
        for (k, b), n in c.items():
            table[at[k], b] = n
        levels.append((np.array(keys, np.uint64), table))
    want = context_tree.ContextTree(levels).score(pa.array(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    old = context_tree.RUN_SHARE, context_tree._RUNS
    try:
        for context_tree.RUN_SHARE, context_tree._RUNS in (old, (300, 50)):
            found = {r["doc_id"]: r["score"] for r in context_tree.score_texts(docs).collect()}
            assert len(found) == len(texts)
            assert all(math.isclose(found[i], want[i], rel_tol=1e-4) for i in range(len(texts)))
    finally:
        context_tree.RUN_SHARE, context_tree._RUNS = old


# repeated strings


@pytest.mark.parametrize(("length", "anchor"), [(200, 64), (40, 16)])
def test_suffix_dedup(docs, rows, length, anchor):
    found = suffix_dedup.remove_repeats(docs, length=length, anchor=anchor).collect()
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    want = []
    for i, b in raw:
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cover[p : p + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(cover)))
        want.append((i, len(b), sum(cover), runs, sha(bytes(x for x, c in zip(b, cover, strict=True) if not c))))
    assert bag((f["doc_id"], f["n_bytes"], f["n_removed"], len(f["spans"]), sha(bytes(f["kept"]))) for f in found) == bag(want)


def test_suffix_dedup_paths(docs, empty):
    old = suffix_dedup.BROADCAST_ROWS
    want = bag((f["doc_id"], f["n_removed"]) for f in suffix_dedup.remove_repeats(docs).collect())
    try:
        suffix_dedup.BROADCAST_ROWS = 0
        assert bag((f["doc_id"], f["n_removed"]) for f in suffix_dedup.remove_repeats(docs).collect()) == want
    finally:
        suffix_dedup.BROADCAST_ROWS = old
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("length", [3, 7, 20, 64])
def test_repeated_suffixes(length):
    rng = random.Random(length)
    common = bytes(rng.randrange(3) for _ in range(150))
    texts = [bytes(rng.randrange(2 if i % 2 else 4) for _ in range(rng.randrange(200))) for i in range(12)]
    texts += [common, common[:90] + b"\0" + common[90:], common, b"", b"\0" * 80, common[40:], b"ab" * 60]
    size = np.array([len(t) for t in texts])
    ends = np.repeat(np.cumsum(size), size)
    text = b"".join(texts)
    places = [p for p in range(len(text)) if p + length <= ends[p]]
    seen = Counter(text[p : p + length] for p in places)
    want = [p for p in places if seen[text[p : p + length]] > 1]
    for passes in (1, 2, 16, 300):
        assert suffix_dedup.repeated_suffixes(np.frombuffer(text, np.uint8), ends, length, passes).tolist() == want
    assert len(suffix_dedup.repeated_suffixes(np.empty(0, np.uint8), np.empty(0, np.int64), length)) == 0


@pytest.mark.parametrize("limit", [512, 3, 1])
def test_suffix_dedup_hot_anchor(spark, limit):
    rng = random.Random(5)
    common = "".join(rng.choice("abcdefghij ") for _ in range(420))
    rows = [(i, common[: rng.randrange(150, 420)] + "".join(rng.choice("xyz") for _ in range(90)) + common[rng.randrange(300) :]) for i in range(40)]
    rows += [(100, rows[0][1]), (101, common[:230] + "Q" + common[231:]), (102, common[:230] + "Q" + common[231:400])]
    old = suffix_dedup.HOT_KINDS, suffix_dedup.HOT_PLACES
    suffix_dedup.HOT_KINDS = suffix_dedup.HOT_PLACES = limit
    try:
        test_suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, 200, 64)
    finally:
        suffix_dedup.HOT_KINDS, suffix_dedup.HOT_PLACES = old


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in llm.queries()) == list(range(1, 14))
    assert set(llm.oracle_sql()) <= set(llm.queries())
