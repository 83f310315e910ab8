"""Bounded walks over the dependency graph, one join per level."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import latest
from .stored import stored

MAX_DEPTH = 4
#: Edges of a package that one part of it holds, about.
HUB = 10_000


def walk_dependencies(roots: DataFrame, edges: DataFrame, versions: DataFrame, depth: int) -> DataFrame:
    """Edges met from the latest versions of roots (package_id), by root and depth; every next package at its latest version.

    Nodes may be met again at other depths; only the depth bounds the walk. Equal edges of one depth count once.
    """
    newest = latest(versions).select("package_id", "version_id")
    hop = edges.join(newest, "version_id").select("package_id", "target_id", "kind", "optional").distinct()
    return _walk(roots, hop, depth)


def walk_dependents(roots: DataFrame, edges: DataFrame, versions: DataFrame, depth: int) -> DataFrame:
    """Edges that lead to roots, from any version of any package; target_id is the dependent."""
    hop = edges.join(versions.select("version_id", "package_id"), "version_id").select(F.col("target_id").alias("package_id"), F.col("package_id").alias("target_id"), "kind", "optional").distinct()
    return _walk(roots, hop, depth)


def _walk(roots: DataFrame, hop: DataFrame, depth: int) -> DataFrame:
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be between 1 and {MAX_DEPTH}")
    hop = stored(hop.where("package_id IS NOT NULL"), "hop")
    hubs = _hubs(hop) if depth > 1 else None
    front, found = roots.select(F.col("package_id").alias("root_id"), "package_id"), None
    for d in range(1, depth + 1):
        met = front.join(hop, "package_id") if d == 1 else _dealt(front, hop, hubs)
        level = met.select("root_id", F.col("package_id").alias("from_id"), F.col("target_id").alias("to_id"), "kind", "optional", F.lit(d).cast("long").alias("depth"))
        found = level if found is None else found.unionByName(level)
        front = level.select("root_id", F.col("to_id").alias("package_id")).distinct()
    return found


def _hubs(hop: DataFrame) -> DataFrame:
    """The packages of more than HUB edges, and the parts that their edges are dealt to."""
    counts = hop.groupBy("package_id").agg(F.count("*").alias("edges")).where(F.col("edges") > HUB)
    return stored(counts.select("package_id", F.ceil(F.col("edges") / HUB).cast("int").alias("parts")), "hubs")


def _dealt(front: DataFrame, hop: DataFrame, hubs: DataFrame) -> DataFrame:
    """The join of front and hop by package_id, in as many tasks as a shuffle has partitions.

    It gives many times what it reads, by which adaptive execution would join tasks up, so the number is given. The
    edges of a hub are dealt to its parts by their targets, and its front goes to each; a hub has more than HUB edges,
    so that hubs are few.
    """
    n = int(hop.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.coalesce("parts", F.lit(1))
    edges = hop.join(F.broadcast(hubs), "package_id", "left").withColumn("part", F.pmod(F.hash("target_id"), parts)).drop("parts")
    front = front.join(F.broadcast(hubs), "package_id", "left").select("root_id", "package_id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    by = ["package_id", "part"]
    return front.repartition(n, *by).join(edges.repartition(n, *by), by)


def distances(walk: DataFrame) -> DataFrame:
    """Least distance of each node from each root, the root at 0."""
    seen = walk.select("root_id", F.col("to_id").alias("node_id"), F.col("depth").alias("distance")).unionByName(walk.select("root_id", F.col("root_id").alias("node_id"), F.lit(0).cast("long").alias("distance")))
    return seen.groupBy("root_id", "node_id").agg(F.min("distance").alias("distance"))


def _settled(df: DataFrame) -> DataFrame:
    """The rows of df without their lineage, in the folder of spark.checkpoint.dir; in one of our own where it is unset and Spark is local."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        master = context.getConf().get("spark.master", "")
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="depscope-"))
    return df.checkpoint()


def _joined(some: DataFrame, others: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables that change at every step: never by a broadcast, as the driver would collect one at each of the steps."""
    return some.hint("merge").join(others, on, how)


def closure(links: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node) for every node reachable from start over links (a, b): in at most `depth` steps, or in any number of them."""
    links = _settled(links.select("a", "b").distinct())
    reach = front = links.select(F.col("a").alias("start"), F.col("b").alias("node"))
    steps = 1
    while depth is None or steps < depth:
        onward = _joined(front.select("start", F.col("node").alias("a")), links, "a").select("start", F.col("b").alias("node")).distinct()
        front = _settled(_joined(onward, reach, ["start", "node"], "left_anti"))
        if front.isEmpty():
            break
        reach = reach.unionByName(front)
        steps += 1
        if steps % 8 == 0:
            reach = _settled(reach)
    return reach


def chased(links: DataFrame) -> DataFrame:
    """(a, b): for links (a, b), of which each a has one at most, where a chain of them ends that begins with a.

    Pointer jumping: each step doubles the length that a link spans, so that n steps do for chains of 2^n links. What
    still leads on when a step has ended no chain leads in a circle, and is left out.
    """
    open_links, done = _settled(links.select("a", "b").dropDuplicates(["a"])), None
    left = None
    while True:
        onward = open_links.select(F.col("a").alias("b"), F.col("b").alias("next"))
        # ended chains too must be known to those that lead into them
        ends = done.select(F.col("a").alias("b"), F.col("b").alias("end")) if done is not None else None
        step = _joined(open_links, onward, "b", "left")
        step = _joined(step, ends, "b", "left") if ends is not None else step.withColumn("end", F.lit(None).cast(links.schema["b"].dataType))
        step = _settled(step.select("a", F.coalesce("end", "next", "b").alias("b"), F.col("next").isNull().alias("ended")))
        ended = step.where("ended").select("a", "b")
        done = ended if done is None else done.unionByName(ended)
        open_links = step.where("NOT ended").select("a", "b")
        n = open_links.count()
        if n == 0 or n == left:
            return done
        left = n


def trimmed(links: DataFrame) -> DataFrame:
    """The links (a, b) that may be part of a cycle: those of nodes that nothing leads to, or that lead nowhere, go, again and again."""
    links, n = _settled(links.select("a", "b").distinct()), -1
    while True:
        m = links.count()
        if m in (0, n):
            return links
        n = m
        starts, ends = links.select(F.col("a").alias("b")).distinct(), links.select(F.col("b").alias("a")).distinct()
        links = _settled(_joined(_joined(links, starts, "b", "left_semi"), ends, "a", "left_semi").select("a", "b"))


def strong_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node on a cycle over links (a, b); component is the least node that it shares cycles with.

    Leaves go first. Then every node takes the least node that leads to it as its colour; of each colour, the nodes that
    lead back to the one that named it are a component. These go, and the rest is trimmed and coloured anew. A step
    holds one row for each node or link, whatever the number of paths.
    """
    every = links.select("a", "b").distinct()
    found = _settled(every.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")))
    core = trimmed(every.where("a <> b"))
    while not core.isEmpty():
        colour = _settled(core.select(F.col("a").alias("node")).unionByName(core.select(F.col("b").alias("node"))).distinct().withColumn("colour", F.col("node")))
        while True:
            told = _joined(core, colour.select(F.col("node").alias("a"), "colour"), "a").groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("told"))
            step = _settled(_joined(colour, told, "node", "left").select("node", F.least("colour", "told").alias("colour"), F.coalesce(F.col("told") < F.col("colour"), F.lit(False)).alias("new")))
            colour = step.select("node", "colour")
            if step.where("new").isEmpty():
                break
        coloured = _joined(_joined(core, colour.select(F.col("node").alias("a"), F.col("colour").alias("of_a")), "a"), colour.select(F.col("node").alias("b"), F.col("colour").alias("of_b")), "b")
        inner = _settled(coloured.where("of_a = of_b").select("a", "b"))
        reached = front = _settled(colour.where("node = colour"))
        while not front.isEmpty():
            more = _joined(inner, front.select(F.col("node").alias("b"), "colour"), "b").select(F.col("a").alias("node"), "colour").distinct()
            front = _settled(_joined(more, reached, ["node", "colour"], "left_anti"))
            reached = _settled(reached.unionByName(front))
        large = reached.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
        found = found.unionByName(_joined(reached, large, "colour", "left_semi").select("node", F.col("colour").alias("component")))
        gone = reached.select("node")
        core = trimmed(_joined(_joined(core, gone.withColumnRenamed("node", "a"), "a", "left_anti"), gone.withColumnRenamed("node", "b"), "b", "left_anti"))
    return found.groupBy("node").agg(F.min("component").alias("component"))


def cyclic_roots(walk: DataFrame) -> DataFrame:
    """Roots that their own walk meets again."""
    return walk.where("to_id = root_id").select("root_id").distinct()
