"""Requirements and advisory ranges as columns against the same in plain Python; resolution over levels."""

import random

from pyspark.sql import functions as F

from depscope.functions import advisory, semver
from depscope.operators import resolve

rng = random.Random(7)


def number():
    return rng.choice(["0", "1", "2", "10"])


def version():
    return f"{number()}.{number()}.{number()}" + rng.choice(["", "", "", "-alpha", "-alpha.1", "-1", "-rc.2+b"])


def comparator():
    k = rng.randint(1, 3)
    parts = [number() for _ in range(k)]
    if rng.random() < 0.15:
        parts[rng.randrange(k)] = rng.choice("*xX")
    return rng.choice(["", "^", "~", ">=", "<=", ">", "<", "="]) + rng.choice(["", " "]) + ".".join(parts) + (rng.choice(["-alpha", "-rc.2", "-2"]) if k == 3 and rng.random() < 0.3 else "")


def test_requirements(spark):
    texts = [",".join(comparator() for _ in range(rng.choice([1, 1, 1, 2, 3]))) for _ in range(600)] + ["*", "x", " * ", "", "a", ">=1.0.0, <2", "1.*.3", "*.1", ">", "1.2.3.4", "*,1", "^99999999999999999999"]
    rows = [(t, version()) for t in texts for _ in range(8)] + [(None, "1.0.0"), ("1", None), ("1", "bad")]
    found = spark.createDataFrame(rows, "r string, v string").select("r", "v", semver.satisfies(F.col("v"), F.col("r")).alias("ok")).collect()
    for x in found:
        required, at = None if x["r"] is None or "9" * 20 in x["r"] else semver.parse_requirement(x["r"]), semver.parse(x["v"])
        assert x["ok"] == (None if required is None or at is None else semver.matches(required, at)), x


def test_ranges(spark):
    event = lambda: rng.choice([f"introduced={rng.choice(['0', version(), 'bad', ''])}", f"fixed={version()}", f"last_affected={rng.choice([version(), '0'])}", f"limit={rng.choice(['*', version(), 'x'])}", "odd=1", "introduced"])
    events = lambda: f"{rng.choice(['SEMVER', 'ECOSYSTEM'])}({rng.choice(['; ', ','])[:1].join(event() for _ in range(rng.randint(0, 4)))})"
    patches = lambda: "; ".join(rng.choice([f"patched={comparator()}", f"unaffected={comparator()} | {comparator()}", "categories=x", "patched=bad", "odd=1", "patched"]) for _ in range(rng.randint(1, 3)))
    comparators = lambda: "||".join(",".join(rng.choice([f" {rng.choice(['>=', '<', '=', '>', '<='])} {version()} ", "bad", ""]) if rng.random() < 0.2 else f">= {version()}, < {version()}" for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(1, 2)))
    rows = [(s, t) for _ in range(500) for s, t in (("osv", events()), ("osv", f"GIT(x) {events()} {events()}"), ("rustsec_db", patches()), (None, patches()), ("ghsa", comparators()), ("osv", comparators()))]
    rows += [("osv", None), ("rustsec_db", ""), ("ghsa", ""), (None, "withdrawn=1"), ("osv", "SEMVER(introduced=0); withdrawn=2"), (None, None)]
    rows = [(s, t, v) for s, t in rows for v in (version(), version())] + [("osv", "SEMVER(introduced=0)", None), ("osv", "SEMVER(introduced=0)", "bad")]
    found = spark.createDataFrame(rows, "s string, t string, v string").select("*", advisory.applies(F.col("s"), F.col("t"), F.col("v")).alias("state")).collect()
    for x in found:
        assert x["state"] == advisory.applicability(x["s"], x["t"], x["v"]), x


def test_no_python_in_these_plans(spark):
    versions = spark.createDataFrame([(1, 1, "1.0.0", 5, None, False)], "version_id long, package_id long, version string, downloads long, published_at timestamp, yanked boolean")
    advisories = spark.createDataFrame([(1, 1, "A", "ghsa", ">= 1.0.0", "high")], "row_id long, package_id long, advisory_id string, source string, affected_range string, severity string")
    wanted = spark.createDataFrame([(1, "^1")], "package_id long, requirement string")
    for df in (resolve.selected(wanted, versions), resolve.advisories_of(versions, advisories), resolve.audited(wanted, versions, advisories)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_resolution_over_levels(spark):
    names = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5}
    versions = spark.createDataFrame([(10 * names[p] + i, names[p], v, None) for p, vs in {"a": ["1.0.0", "1.1.0", "2.0.0"], "b": ["1.0.0", "1.5.0"], "c": ["1.0.0", "2.0.0"], "d": ["0.1.0"]}.items() for i, v in enumerate(vs)], "version_id long, package_id long, version string, published_at timestamp").withColumn("yanked", F.lit(False)).withColumn("downloads", F.lit(0))
    edge = lambda version_id, target, requirement, optional=False: (version_id, names[target], requirement, optional)
    edges = spark.createDataFrame([edge(11, "b", "^1"), edge(11, "c", "=1"), edge(21, "c", ">=2"), edge(20, "c", "*"), edge(12, "d", "^9"), edge(31, "e", "*"), edge(11, "d", "*", True), edge(40, "a", "<1.1")], "version_id long, target_id long, requirement string, optional boolean")
    roots = spark.createDataFrame([(100, 1, "^1"), (200, 1, ">=2"), (300, 5, "*"), (400, 3, "*"), (500, 4, "*"), (500, 1, "^1")], "root_id long, package_id long, requirement string")
    rows = lambda **k: {(r["root_id"], r["package_id"]): (r["version"], r["status"]) for r in resolve.resolved(roots, versions, edges, **k).collect()}
    one = rows(levels=1)
    assert one == {(100, 1): ("1.1.0", "selected"), (200, 1): ("2.0.0", "selected"), (300, 5): (None, "unknown_package"), (400, 3): ("2.0.0", "selected"), (500, 4): ("0.1.0", "selected"), (500, 1): ("1.1.0", "selected")}
    every = rows()
    # a 1.1 wants c =1, and b 1.5, which a wants too, wants c >=2: each can be met, both can't
    assert every[100, 3] == (None, "conflict") and every[100, 2] == ("1.5.0", "selected")
    assert every[200, 4] == (None, "unsatisfied") and every[400, 5] == (None, "unknown_package")
    # what d requires of a narrows the choice that the root alone would have left
    assert every[500, 1] == ("1.0.0", "selected")
    assert resolve.resolved(roots.limit(0), versions, edges).count() == 0
