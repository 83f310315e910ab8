"""Cycles of any length against reachability by hand."""

import random

from depscope.operators import graph


def brute(links):
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
    reach = {}
    for a in out:
        seen, todo = set(), list(out[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        reach[a] = seen
    return {a: min(b for b in reach[a] if a in reach.get(b, ())) for a in out if a in reach[a]}


def test_strong_components(spark):
    rng = random.Random(5)
    links = [(i, (i + 1) % 7) for i in range(7)] + [(6, 20), (20, 21), (21, 20), (21, 22), (30, 30), (40, 41), (50, 0), (60, 61), (61, 62), (62, 60), (62, 20)]
    links += [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(34)]
    links += links[:3]
    found = {r["node"]: r["component"] for r in graph.strong_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == brute(links)
    assert graph.strong_components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).count() == 0
    assert graph.strong_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_step_is_broadcast(spark, monkeypatch):
    plans, plain = [], graph._settled

    def settled(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(graph, "_settled", settled)
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (7, 1)], "a long, b long")
    assert {tuple(r) for r in graph.strong_components(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    assert {tuple(r) for r in graph.chased(links.where("a in (1, 2, 5, 7)")).collect()} == {(1, 3), (2, 3), (5, 4), (7, 3)}
    assert graph.closure(links).where("start = 7").count() == 6
    assert len(plans) > 10 and not [p for p in plans if "Broadcast" in p]


def test_a_level_is_dealt_to_all_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(graph, "HUB", 10, raising=False)
    # 0 leads to 1, and 1 to 2 to 60, each by two kinds, of which one is met twice; 2 leads to 3 to 9 and to nothing known
    pairs = [(0, 1)] + [(1, i) for i in range(2, 61)] + [(2, i) for i in range(3, 10)] + [(2, None)]
    edges = [(t, a, k, k == "dev") for a, t in pairs for k in ("dev", "normal", "normal")]
    versions = spark.createDataFrame([(i, i, "2020") for i in range(61)] + [(99, None, "2020")], "version_id long, package_id long, published_at string")
    edges = spark.createDataFrame([(99 if v is None else v, *rest) for v, *rest in edges], "version_id long, target_id long, kind string, optional boolean")
    roots = spark.createDataFrame([(i,) for i in range(61)], "package_id long")
    found = [(tuple(r)[:6], r["at"]) for r in graph.walk_dependents(roots, edges, versions, 2).withColumn("at", F.spark_partition_id()).collect()]
    want = [(a, a, t, k, k == "dev", 1) for a, t in pairs for k in ("dev", "normal")]
    want += [(a, t, u, k, k == "dev", 2) for a, t in pairs for b, u in pairs if b == t for k in ("dev", "normal")]
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((r for r, _ in found), key=order) == sorted(want, key=order)
    assert len({at for r, at in found if r[5] == 2}) > 1
    # the edges of a package with more than HUB of them are not all met in one task
    assert len({at for r, at in found if r[0] == 0 and r[5] == 2}) > 1
