"""Ranked search against scores computed text by text."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from depscope.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = ["ring", "Ring", "größe", "the", "THE", "a1", "7", "x" * 16, "x" * 17, "X" * 40, "日本語のとても長いことば", "é", "Z", "abcdefgh", "abcdefghi", "İstanbul"]


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, limit=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, total, df = len(held), sum(x[2] for x in held), Counter()
    for _, c, _ in held:
        df.update(c.keys())
    out = []
    for item, text in items:
        rows = []
        for i, c, size in held:
            m = 25 + 75 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in terms(text) if c[w])
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(rows)[:limit])]
    return Counter(out)


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(WORDS) + rng.choice([" ", ", ", "\n", "-", "\x00", "_"]) for _ in range(k))
    docs = [(rng.randint(0, 10_000), text(rng.randint(0, 40))) for _ in range(n)]
    docs += [docs[0], docs[0], (docs[1][0], "ring ring"), (None, docs[2][1]), (None, None), (-3, None), (-4, ""), (-5, " _-@ "), (-9, "ring " * 70_000), (-10, "rare " + "the " * 300)]
    items = [(k, text(rng.randint(1, 12))) for k in range(20)] + [(0, "ring"), (0, "ring"), (None, "the rare"), (50, None), (51, ""), (52, "unknown words"), (53, "rare rare the"), (54, "ring " * 500)]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score long, rank string").repartition(3), spark.createDataFrame([(t, i, 2) for i, t in items], "text string, item_id long, doc_id long")


@pytest.mark.parametrize(("shard", "block", "window"), [(8 << 20, 4 << 20, 4096), (700, 200, 3)])
def test_ranked(spark, monkeypatch, shard, block, window):
    docs, items = corpus()
    d, q = frames(spark, docs, items)
    index = L.build_index(d, shard_bytes=shard)
    assert index.count() > (10 if shard < 1000 else 0)
    monkeypatch.setattr(L, "WINDOW", window)
    found = L.ranked(index, q, block_bytes=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == brute(docs, items)
    assert Counter(map(tuple, L.ranked(index, q, limit=1000).collect())) == brute(docs, items, 1000)


def test_equal_keys(monkeypatch):
    """All terms have one hash: bytes still tell them apart."""
    import pyarrow as pa

    monkeypatch.setattr(L, "_order", lambda low, high: np.full(len(low), 7, np.uint64))
    docs, items = corpus(5, 30)
    row = L.shard(pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.large_string()))
    one = L.Shard(pa.RecordBatch.from_arrays([pa.array([v]) for v in row.values()], names=list(row)), 0)
    wanted = L._terms(pa.array([0]), pa.array([" ".join(t or "" for _, t in items)]))
    at = one.find(wanted)
    seen = set()
    for (place, times), k in zip(wanted.queries[0], range(len(at)), strict=True):
        assert place == k and times
        if at[k] >= 0:
            found, count = one.list_of(int(at[k]))
            assert (np.diff(found) > 0).all()
            seen.add((len(found), int(count.sum())))
    df, tf = Counter(), Counter()
    for _, t in docs:
        c = Counter(terms(t))
        df.update(c.keys())
        tf.update(c)
    assert {(df[w], tf[w]) for w in set(terms(" ".join(t or "" for _, t in items))) & set(df)} == seen


def test_empty(spark):
    docs, items = corpus(n=5)
    d, q = frames(spark, docs, items)
    assert L.ranked(L.build_index(d.limit(0)), q).count() == 0
    assert L.ranked(L.build_index(d), q.limit(0)).count() == 0


def test_query(spark, tmp_path):
    docs, items = corpus(11)
    d, q = frames(spark, docs, items)
    d.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    q.select("item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert Counter(map(tuple, L.op13_lexical_search(spark, str(tmp_path)).collect())) == brute(docs, items)
