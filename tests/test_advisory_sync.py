"""A round of feeds: what answers, what fails, what is stamped, and what a reader sees."""

import pytest
from pyspark.sql import functions as F

from depscope.operators import advisory_sync as S

COLUMNS = "package_id long, source string, advisory_id string, version_id long, affected_range string, severity string"


@pytest.fixture
def round_of(spark):
    rows = [(1, "osv", "A", None, "old", None), (1, "osv", "B", 7, "old", None), (1, "ghsa", "C", None, "old", "low"), (2, "osv", "A", None, "old", None), (3, "osv", "D", None, "old", None), (1, "manual", "M", None, "own", None)]
    feed = [(1, "osv", "A", None, "new", "high"), (1, "osv", "A", None, "new", None), (1, "osv", "E", 7, "new", "low"), (2, "osv", "A", None, "new", "high"), (1, "ghsa", "C", None, "never", "low")]
    answers = [(1, "osv", True, None), (1, "ghsa", False, "HTTP 500"), (1, "rustsec_db", True, None), (2, "osv", True, None), (2, "osv", False, "page 2"), (2, "ghsa", True, None), (2, "rustsec_db", True, None), (3, "osv", True, None), (3, "ghsa", True, None), (3, "rustsec_db", True, None), (4, "osv", None, "odd")]
    frame = lambda x, c: spark.createDataFrame(x, c)
    stamps = frame([(1, "2020-01-01 00:00:00"), (3, "2020-01-01 00:00:00")], "package_id long, checked_at string").withColumn("checked_at", F.col("checked_at").cast("timestamp_ntz"))
    return S.synced(frame(rows, COLUMNS), frame(feed, COLUMNS), frame(answers, "package_id long, source string, ok boolean, message string"), stamps, F.lit("2024-05-05 00:00:00").cast("timestamp_ntz"))


def test_round(round_of):
    assert {tuple(r) for r in round_of.rows.collect()} == {
        (1, "osv", "A", None, "new", "high"), (1, "osv", "E", 7, "new", "low"),  # answered: cleared, replaced, equal keys once
        (1, "ghsa", "C", None, "old", "low"), (2, "osv", "A", None, "old", None),  # failed, or failed in part: as before
        (1, "manual", "M", None, "own", None),  # never asked
    }
    assert {(r["package_id"], r["checked_at"].year) for r in round_of.stamps.collect()} == {(1, 2020), (3, 2024)}
    outcome = {r["source"]: r for r in round_of.outcome.collect()}
    assert (outcome["osv"]["answered"], outcome["osv"]["failed"], outcome["osv"]["cleared"], outcome["osv"]["written"], outcome["osv"]["messages"]) == (2, 2, 3, 2, ["odd", "page 2"])
    assert (outcome["ghsa"]["failed"], outcome["ghsa"]["written"], outcome["ghsa"]["messages"]) == (1, 0, ["HTTP 500"])


def test_snapshots(spark, round_of, tmp_path):
    root = f"file://{tmp_path}/sync"
    with pytest.raises(FileNotFoundError):
        S.latest(spark, root)
    round_of.publish(root, 1)
    rows, stamps = S.latest(spark, root)
    assert rows.count() == 5 and stamps.count() == 2
    # a round that was lost half-way is not seen
    rows.limit(1).write.parquet(f"{root}/v000000000002/rows")
    assert S.latest(spark, root)[0].count() == 5
    S.Synced(rows.limit(2), stamps, round_of.outcome).publish(root, 3)
    assert S.latest(spark, root)[0].count() == 2


def test_nothing_asked(spark, round_of):
    none = S.synced(round_of.rows, round_of.rows, spark.createDataFrame([], "package_id long, source string, ok boolean, message string"), round_of.stamps, F.lit(None).cast("timestamp_ntz"))
    assert none.rows.count() == 5 and none.stamps.count() == 2 and none.outcome.count() == 0
