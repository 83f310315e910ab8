"""Archives read by Python's own gzip, and what the normaliser makes of them."""

import glob
import gzip
import hashlib
from collections import Counter

import pytest

from depscope.llm import warc

SCHEMA = "page_id long, url string, html string, head string, payload int, key string, size int"
LONG = "é日<p>" * 300


def pages():
    texts = [LONG, LONG, LONG + "x", "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "y" * 1000, None, "", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\nWARC/", "\r\n\r\n" * 300, "WARC/" * 500, "a\n" * 700, "0" * (17 << 20)]
    urls = ["http://a.example/é x", None, "", "http://b\r\nWARC-Type: metadata", "plain\x00\t"]
    rows = [(i * 3 % 31, urls[i % 5], t) for i, t in enumerate(texts)]
    return [*rows, rows[1], (None, "u", LONG), (None, "u", "z" * 2000), (None, "u", "z" * 2000), (-5, "u", LONG), (90, "v", "q" * 5000), (90, "v", "q" * 5000)]


def brute(rows):
    groups = {}
    for i, _, t in rows:
        if t is not None and len(t.encode()) >= 1000:
            groups.setdefault(t, []).append(i)
    for i, _, t in rows:
        data = (t or "").encode()
        own = [x for x in groups.get(t, []) if x is not None]
        refers = max(own) if len(groups.get(t, [])) > 1 and own and i != max(own) else None
        yield i, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers


def frame(spark, rows):
    return spark.createDataFrame([(i, u, t, "h", 1, "k", 2) for i, u, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_archives(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_HEADS", broadcast)
    monkeypatch.setattr(warc, "HOT", 8 if not broadcast else 1000)
    rows = pages()
    warc.write_streams(frame(spark, rows), f"file://{tmp_path}/streams")
    index = warc.normalise(spark, f"file://{tmp_path}/streams", f"file://{tmp_path}/warc", file_bytes=4000)
    found = warc.read_archives(spark, f"file://{tmp_path}/warc", payloads=True).collect()
    number = lambda x: int(x.removeprefix(warc.PREFIX)) if x and x != warc.PREFIX else None
    assert Counter((number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in found) == Counter(brute(rows))
    # the streams are whole-file gzip, and the rewritten files hold the same bytes, also for Python's gzip
    streams = [gzip.open(f).read() for f in glob.glob(f"{tmp_path}/streams/*.gz")]
    files = {f.rpartition("/")[2]: open(f, "rb").read() for f in sorted(glob.glob(f"{tmp_path}/warc/data/part-*"))}
    assert len(files) > 3 and sum(map(len, streams)) == sum(len(gzip.decompress(x)) for x in files.values() if x)
    whole = b"".join(gzip.decompress(x) for x in files.values() if x)
    assert all(s[:2000] in whole for s in streams)
    # the index leads to each record
    placed = index.collect()
    assert len(placed) == len(rows) and not any(c in (r["uri"] or "") for r in placed for c in "\r\n \t\x00")
    for r in placed:
        data = gzip.decompress(files[r["file"]][r["offset"] : r["offset"] + r["length"]])
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n") and f"<{r['record_id']}>".encode() in data
    some = index.where("record_type = 'response' AND length > 300")
    assert Counter((r["record_id"], bytes(r["payload"])) for r in warc.read_records(some, f"file://{tmp_path}/warc").collect()) == Counter((r["record_id"], bytes(r["payload"])) for r in found if r["record_id"] in {x["record_id"] for x in some.collect()} and r["record_type"] == "response" and r["payload_bytes"] > 100)


def test_empty(spark, tmp_path):
    warc.write_streams(frame(spark, []), f"file://{tmp_path}/streams")
    assert warc.normalise(spark, f"file://{tmp_path}/streams", f"file://{tmp_path}/warc").count() == 0
    assert warc.read_archives(spark, f"file://{tmp_path}/warc").count() == 0


def record(n, payload, kind="resource", version=b"1.0", more=b""):
    return b"WARC/" + version + b"\r\nWARC-Type: " + kind.encode() + b"\r\nWARC-Record-ID: <urn:r:%d>\r\n%sX-Folded: a\r\n b\r\nContent-Length: %d\r\n\r\n" % (n, more, len(payload)) + payload + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """One stream for a file, and streams that have members already."""
    payloads = [b"", b"WARC/", b"x" * 300_000, record(7, b"inner"), bytes(range(256)) * 50, b"\n" * 9]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(gzip.compress(b"".join(record(n, p, version=b"0.18" if n % 2 else b"1.0") for n, p in enumerate(payloads))))
    (tmp_path / "in/b.warc.gz").write_bytes(b"".join(gzip.compress(record(n + 50, p)) for n, p in enumerate(payloads)))
    warc.normalise(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    found = warc.read_archives(spark, f"file://{tmp_path}/out", payloads=True).collect()
    assert Counter((r["record_id"], bytes(r["payload"]), r["payload_digest"]) for r in found) == Counter((f"urn:r:{n + k}", p, hashlib.sha1(p).hexdigest()) for n, p in enumerate(payloads) for k in (0, 50))


@pytest.mark.parametrize(("content", "what"), [(record(1, b"abc")[:-6], "cut off"), (b"junk" + record(1, b"abc"), "begin"), (record(1, b"abc") + b"junk" + record(2, b""), "longer")])
def test_broken(spark, tmp_path, content, what):
    (tmp_path / "a.gz").write_bytes(gzip.compress(content))
    with pytest.raises(Exception, match=what):
        warc.normalise(spark, f"file://{tmp_path}", f"file://{tmp_path}/out")


def test_wrong_digest():
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(record(1, b"abc", more=b"WARC-Payload-Digest: sha1:00\r\n"))


def test_query(spark, tmp_path):
    frame(spark, pages()).write.parquet(f"{tmp_path}/pages.parquet")
    made = warc.op12_warc(spark, str(tmp_path))
    assert made.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, made.collect())) == Counter(brute(pages()))
