"""New names out of files that land, with repeated batches and restarts."""

from pyspark.sql import functions as F

from depscope.sources import snapshot
from depscope.streaming import arrivals, discovery

SCHEMA = "package string, version string, arrived timestamp"


def land(spark, folder, rows):
    spark.createDataFrame(rows, "package string, version string, arrived string").withColumn("arrived", F.col("arrived").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, checkpoint, known):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    discovery.discoveries(stream, f"file://{tmp_path}/out", lambda s: s.createDataFrame([(k,) for k in known], "package string"), f"file://{tmp_path}/{checkpoint}", "1 hour", ("Zed", "none")).trigger(availableNow=True).start().awaitTermination()
    return {r["package"]: (r["versions"], r["prewarm"]) for r in discovery.discovered(spark, f"file://{tmp_path}/out").collect()}


def test_discoveries(spark, tmp_path):
    assert discovery.discovered(spark, f"file://{tmp_path}/out").count() == 0
    folder = f"file://{tmp_path}/in"
    land(spark, folder, [("New", "1.0.0", "2024-01-01 00:00:00"), ("new", "1.0.0", "2024-01-01 00:00:00"), ("new", "1.1.0", "2024-01-01 00:10:00"), ("serde", "1.0.0", "2024-01-01 00:00:00"), (None, "1.0.0", "2024-01-01 00:00:00"), (" ", "1", "2024-01-01 00:00:00")])
    first = run(spark, tmp_path, "c", ["Serde"])
    assert first == {"new": (["1.0.0", "1.1.0"], False)}
    land(spark, folder, [("zed", "0.1.0", "2024-01-01 00:20:00"), ("new", "1.0.0", "2024-01-01 00:20:00"), ("new", "2.0.0", "2024-01-01 00:20:00")])
    second = run(spark, tmp_path, "c", ["serde"])
    assert second == first | {"zed": (["0.1.0"], True)}
    # a restart without anything new, and one from a new checkpoint that sees everything again
    assert run(spark, tmp_path, "c", ["serde"]) == second == run(spark, tmp_path, "other", ["serde"])
    rows = discovery.discovered(spark, f"file://{tmp_path}/out").groupBy("package").count().where("count > 1").count()
    assert rows == 0


def test_a_batch_is_published_once(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    df = spark.range(3)
    assert snapshot.publish_once(df, root, "s", 5).endswith("v000000000000")
    assert snapshot.publish_once(df, root, "s", 5) is None
    df.limit(1).write.parquet(f"{root}/v000000000001")
    (tmp_path / "t/v000000000001/_SUCCESS").unlink()  # lost half-way
    assert snapshot.publish_once(spark.range(4), root, "s", 6).endswith("v000000000001")
    assert snapshot.current(spark, root).count() == 4
    # a new checkpoint begins with batch 0 and still comes after what is there
    assert snapshot.publish_once(spark.range(9), root, "other", 0).endswith("v000000000002")
    assert snapshot.current(spark, root).count() == 9


def test_upserts_go_on_after_a_new_checkpoint(spark, tmp_path):
    folder, root = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for k, (checkpoint, rows) in enumerate([("a", [("x", "1", "2024-01-01 00:00:00")]), ("b", [("x", "2", "2024-01-02 00:00:00"), ("y", "1", "2024-01-01 00:00:00")])]):
        land(spark, folder, rows)
        arrivals.upserts(spark.readStream.schema(SCHEMA).parquet(folder), root, ["package"], "arrived", f"file://{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
        assert len(snapshot.complete(spark, root)) == k + 1
    assert {(r["package"], r["version"]) for r in snapshot.current(spark, root).collect()} == {("x", "2"), ("y", "1")}
