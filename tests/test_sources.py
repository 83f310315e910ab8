import gzip
import json

import pytest

from depscope.sources import landing, snapshot
from depscope.streaming import arrivals, telemetry


def test_landing(spark, tmp_path):
    package = {"package": {"name": "p", "max_version": "9.9.9", "categories": ["c"], "keywords": []}, "versions": [{"num": "2.0.0", "yanked": True}, {"num": "1.0.0", "yanked": False, "features": {"default": ["std", "dep:x"]}}]}
    (tmp_path / "p.json").write_text(json.dumps(package))
    assert landing.packages(spark, str(tmp_path / "p.json")).first()["shown_version"] == "1.0.0"
    assert landing.versions(spark, str(tmp_path / "p.json")).count() == 2
    found = {(r["target"], r["is_dependency"]) for r in landing.features(spark, str(tmp_path / "p.json")).collect()}
    assert found == {("std", False), ("x", True)}
    (tmp_path / "d.json").write_text(json.dumps({"package": "p", "version": "1.0.0", "dependencies": [{"name": "x", "req": "^1", "kind": None, "optional": False}, {"name": " ", "req": "*"}]}))
    assert [(r["name"], r["kind"]) for r in landing.dependencies(spark, str(tmp_path / "d.json")).collect()] == [("x", "normal")]


def test_osv(spark, tmp_path):
    vuln = {"id": "GHSA-1", "aliases": ["CVE-1", "RUSTSEC-2020-1"], "severity": [{"type": "CVSS", "score": "7.5"}], "affected": [{"ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.2.0"}]}], "versions": ["1.0.0"], "functions": ["f", "f"]}]}
    bad = {"id": "GHSA-2", "affected": [{"ranges": [{"type": "SEMVER", "events": [{"introduced": "0", "fixed": "1.0.0"}]}]}]}
    gone = {"id": "GHSA-3", "withdrawn": "2021", "aliases": ["RUSTSEC-2020-9"], "affected": []}
    with gzip.open(tmp_path / "o.json.gz", "wt") as f:
        f.write(json.dumps({"package": "p", "vulns": [vuln, bad, gone]}))
    rows = {r["advisory_id"]: r for r in landing.osv(spark, str(tmp_path / "o.json.gz")).collect()}
    assert rows["RUSTSEC-2020-1"]["affected_range"] == "SEMVER(introduced=0; fixed=1.2.0)" and rows["RUSTSEC-2020-1"]["severity"] == "high"
    assert rows["RUSTSEC-2020-1"]["fixed_versions"] == ["1.2.0"] and rows["RUSTSEC-2020-1"]["affected_functions"] == ["f"]
    assert rows["GHSA-2"]["affected_range"] == "osv_invalid_event" and rows["GHSA-3"]["affected_range"] == "withdrawn=2021"


def test_source_files_and_markdown(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rs").write_text("fn a() {}\n")
    (tmp_path / "src/b.rs").write_bytes(b"\x00bin")
    (tmp_path / "src/c.rs").write_bytes(b"\xff\xfe")
    (tmp_path / "src/d.rs").write_bytes(b"x" * 600_000)
    assert [r["path"].rsplit("/")[-1] for r in landing.source_files(spark, str(tmp_path / "src")).collect()] == ["a.rs"]
    (tmp_path / "adv").mkdir()
    (tmp_path / "adv/x.md").write_text('```toml\nid = "A"\n```\n\n# A title\nbody\n')
    row = landing.advisory_markdown(spark, str(tmp_path / "adv")).first()
    assert row["front_matter"] == 'id = "A"' and row["title"] == "A title"


def test_manifest(spark):
    name, floor, deps = landing.manifest(spark, '[package]\nname="p"\nrust-version="1.70"\n[dependencies]\na="*"\nA="1.2"\nb={version="2", optional=true}\n[target.x.dev-dependencies]\nc="3"\n')
    assert (name, floor) == ("p", "1.70")
    assert sorted(tuple(r) for r in deps.collect()) == [("A", "1.2"), ("b", "2"), ("c", "3")]


def test_snapshots(spark, tmp_path):
    old = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "k long, j string, v string")
    new = spark.createDataFrame([(1, None, None), (3, None, "c")], "k long, j string, v string")
    assert {tuple(r) for r in snapshot.upsert(old, new, ["k", "j"], coalesce=["v"]).collect()} == {(1, None, "a"), (2, "x", "b"), (3, None, "c")}
    assert {tuple(r) for r in snapshot.changed(old, new, ["k", "j"], ["v"]).collect()} == {(1, None, None), (3, None, "c")}
    root = str(tmp_path / "t")
    snapshot.publish(old, root, 1)
    snapshot.publish(new, root, 2)
    assert snapshot.current(spark, root).count() == 2 and {r["k"] for r in snapshot.current(spark, root).collect()} == {1, 3}
    with pytest.raises(Exception):
        snapshot.publish(old, root, 2)


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_streaming_windows_and_limits(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(1).write.parquet(src)
    stream = telemetry.events(spark, src)
    drain(telemetry.latency_windows(stream, "1 day").writeStream.format("memory").queryName("lat").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start())
    batch = spark.read.parquet(src)
    assert spark.table("lat").agg({"calls": "sum"}).first()[0] == batch.count()
    drain(telemetry.admitted(stream, 3600.0, 2, 86400.0).writeStream.format("memory").queryName("adm").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start())
    seen = {r["event_id"]: r["admitted"] for r in spark.table("adm").collect()}
    times: dict[int, list[float]] = {}
    for r in sorted(batch.collect(), key=lambda r: (r["ts"], r["event_id"])):
        t = (r["ts"] - __import__("datetime").datetime(1970, 1, 1)).total_seconds()
        mine = [x for x in times.get(r["user_id"], []) if t - x < 86400]
        ok = (not mine or t - mine[-1] >= 3600) and len(mine) < 2
        times[r["user_id"]] = mine + [t] * ok
        assert seen[r["event_id"]] is ok


def test_arrivals(spark, tmp_path):
    src = tmp_path / "arch"
    src.mkdir()
    (src / "some-name-1.2.3.crate").write_bytes(b"1")
    (src / "odd.crate").write_bytes(b"2")
    drain(arrivals.archives(spark, str(src)).writeStream.format("memory").queryName("arr").option("checkpointLocation", str(tmp_path / "c")).start())
    assert {(r["package"], r["version"]) for r in spark.table("arr").collect()} == {("some-name", "1.2.3"), (None, None)}
