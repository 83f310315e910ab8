"""The five stages against a brute-force version, and the names and values that every carried column keeps."""

import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest

from depscope.llm import chat_format, context_tree, decontaminate, line_dedup, ngram_join, quality_rules, sentencepiece_codec, suffix_dedup, token_counts

from .conftest import SCHEMA, sentence
from .test_operators import SPACE, bag, brute_groups, brute_lines, brute_quality, lower


def word_spans(text):
    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))]


def brute_pipeline(rows, items):
    import sentencepiece

    # 1: quality rules; 2: line dedup
    rows = [(r[0], "\n".join(x for x, bad, _ in brute_lines(r[1]) if not bad), *r[2:]) for r in rows if brute_quality(r[1])[6]]
    bare = lambda line: line.strip(" \t\r")
    total, pages = Counter(r[3] for r in rows), Counter()
    for r in rows:
        pages.update((r[3], k) for k in {bare(x) for x in r[1].split("\n")} - {""})
    gone = {k for k, n in pages.items() if n >= line_dedup.MIN_PAGES and line_dedup.RATIO_DEN * n > line_dedup.RATIO_NUM * total[k[0]]}
    assert gone
    rows = [(r[0], "\n".join(x for x in r[1].split("\n") if (r[3], bare(x)) not in gone), *r[2:]) for r in rows]
    # 3: one row of each group, the one of least id
    best, kept = {}, []
    for r, g in zip(rows, brute_groups(rows), strict=True):
        if g is None:
            kept.append(r)
        elif g not in best or r[0] < best[g][0]:
            best[g] = r
    rows = [*kept, *best.values()]
    # 4: words inside an occurrence of a benchmark phrase go
    phrases = set()
    for i, t in items:
        w = [lower(t)[a:b] for a, b in word_spans(t)] if i is not None else []
        phrases |= {tuple(w[k : k + 10]) for k in range(max(len(w) - 9, 1))} - {()}
    out = []
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    hits = 0
    for r in rows:
        spans = word_spans(r[1])
        w = [lower(r[1])[a:b] for a, b in spans]
        hit = {q for n in {len(p) for p in phrases} for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in phrases for q in range(p, p + n)}
        text, done = "", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                text += r[1][done : spans[k][0]]
            done = spans[k][1]
        text += r[1][done:]
        hits += len(hit)
        # 5: ids and the text that they give back
        ids = library.encode(text)
        back = library.decode(ids)
        out.append((r[0], back, r[2], r[3], len(back), *r[5:], len(ids), tuple(ids)))
    assert hits
    return out


@pytest.fixture(scope="session")
def folder(spark, rows, tmp_path_factory):
    import random

    rng = random.Random(11)
    clean = [sentence(rng, 70) + "." for _ in range(30)]
    page = lambda k: f"Our own header line {k % 2}.\n{clean[k]}\n{sentence(rng, 30)}."
    own = [*rows, *((1000 + k, page(k), "en", "s9", 5, 1, 2, "k", "c", "s", 3, "t") for k in range(30))]
    own.append((2000, clean[3][:-1] + " one word more.", "en", "s8", 5, 1, 2, "k", "c", "s", 3, "t"))
    own.append((2001, clean[4] + " " + sentence(rng, 60) + ".", "en", "s8", 5, 1, 2, "k", "c", "s", 3, "t"))
    items = [(0, " ".join(clean[4].split(" ")[3:30])), (1, "none of these words are found anywhere at all in here"), (2, None), (None, clean[5])]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(own, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), own, items


def test_pipeline(spark, folder):
    path, own, items = folder
    found = corpus_pipeline.run(spark, path)
    assert found.columns == [*(x.split()[0] for x in SCHEMA.split(", ")), "n_tokens", "ids"]
    low = lambda r: tuple(tuple(x) if isinstance(x, list) else x for x in r)
    assert bag(low(r) for r in found.collect()) == bag(brute_pipeline(own, items))


NASTY = ["KEPT", "kept_", "__qr_kept", "lines", "Gone", "bp_keys", "Cleaned", "__copy", "c0", "c1", "v_cleaned", "V_Hits", "text_", "NODE", "rank", "ids", "N_Tokens", "a b", "x`y", "h.i", "id", "Spans"]


def test_columns_of_any_name_stay(spark, rows):
    """Case variants of work columns, blanks, quotes and dots; the session's Arrow limits come back."""
    some = [(r[0], r[1], r[3], len(r[1] or ""), *NASTY) for r in rows[:20]]
    names = ["doc_id", "Text", "source", "N_chars", *NASTY]
    docs = spark.createDataFrame(some, "a long, b string, c string, d long, " + ", ".join(f"e{i} string" for i in range(len(NASTY)))).toDF(*names)
    bench = spark.createDataFrame([(1, rows[2][1][:200])], "item_id long, text string")
    limits = [spark.conf.get(f"spark.sql.execution.arrow.max{k}PerBatch") for k in ("Records", "Bytes")]
    model = public_tokenizers.path("piece_bpe_32k.model")
    for made in (quality_rules.clean(docs), line_dedup.deduplicated(docs), ngram_join.one_of_each(docs), decontaminate.decontaminated(docs, bench)):
        assert made.columns == names
        found = made.collect()
        assert found and all(tuple(r)[4:] == tuple(NASTY) and tuple(r)[3] == len(tuple(r)[1] or "") for r in found)
    last = sentencepiece_codec.encoded(docs, model)
    keep = [n for n in names if n.lower() not in ("ids", "n_tokens")]
    assert last.columns == [*keep, "n_tokens", "ids"] and all(tuple(r)[4:-2] == tuple(n for n in NASTY if n in keep) for r in last.collect())
    for made in (quality_rules.apply_rules(docs), line_dedup.drop_boilerplate(docs, out="cleaned", lines="lines"), decontaminate.mark_contamination(docs, bench), token_counts.prefix_tables(docs, public_tokenizers.path("word_bpe_49k.json"))):
        lowered = [c.lower() for c in made.columns]
        assert len(set(lowered)) == len(lowered) and made.count() == 20
    for made in (ngram_join.near_duplicates(docs), suffix_dedup.remove_repeats(docs), context_tree.score_texts(docs)):
        assert made.count() == 20
    talk = spark.createDataFrame([(1, 0, "assistant", "hi", "x")], "conv_id long, turn long, role string, text string, Turns string")
    assert chat_format.format_conversations(talk, public_tokenizers.path("byte_bpe_50k.json")).first()["loss_texts"] == ["hi"]
    assert limits == [spark.conf.get(f"spark.sql.execution.arrow.max{k}PerBatch") for k in ("Records", "Bytes")]


def test_texts_of_a_megabyte(spark):
    """One long line, one long word, many equal words and many short lines, beside a null and an empty text."""
    long = ["word " * 200_000, "x" * 1_000_000, "été. " * 150_000, "Ab c.\n" * 150_000, None, ""]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(long)], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(1, "word word")], "item_id long, text string")
    n = {r["doc_id"]: r["n_words"] for r in quality_rules.apply_rules(docs).collect()}
    assert n == {i: len(re.findall(SPACE, t or "")) for i, t in enumerate(long)}
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.mark_contamination(docs, bench).collect()} == {0: 200_000, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
    assert line_dedup.deduplicated(docs).count() == ngram_join.one_of_each(docs).count() == 6
    made = {r["doc_id"]: r["fit_bytes"] for r in token_counts.prefix_tables(docs, public_tokenizers.path("word_bpe_49k.json"), every=False).collect()}
    assert made[0] == 2048 * 5 and made[4] == made[5] == 0
