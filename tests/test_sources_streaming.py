import io
import tarfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratakeep.functions.sizes import aligned, tar_size
from stratakeep.operators import listing
from stratakeep.sources import archives, files, metadata
from stratakeep.streaming import polls


def test_files(spark, tmp_path):
    for p in ("b1/x.txt", "b1/d/y.txt", "b2/checksums.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    found = files.listing(spark, str(tmp_path))
    assert {(r.path, r.size) for r in files.relative(found, str(tmp_path)).collect()} == {("b1/x.txt", 8), ("b1/d/y.txt", 10), ("b2/checksums.txt", 16)}
    assert {r.backup for r in files.backup_names(spark, str(tmp_path)).collect()} == {"b1", "b2"}
    assert files.without_names(found, ["checksums.txt"]).count() == 2
    assert not files.is_empty(found) and files.is_empty(found.limit(0))
    assert {bytes(r.content) for r in files.contents(spark, str(tmp_path), "y*").collect()} == {b"b1/d/y.txt"}


def test_archives(spark):
    rows = [("p1", "a.bin", b"x" * 600), ("p1", "n" * 150, b""), ("p2", "b", b"1")]
    f = spark.createDataFrame(rows, "archive string, name string, content binary")
    tar = archives.tarballs(f)
    assert sorted((r.archive, r.name, bytes(r.content)) for r in archives.members(tar).collect()) == sorted(rows)
    size = f.groupBy("archive").agg(tar_size(F.sum(aligned(F.octet_length("content"))), F.collect_list("name")).alias("n"))
    assert all(len(r.content) == r.n for r in tar.join(size, "archive").collect())
    body = bytes(tar.where("archive = 'p2'").first().content) + bytes(1024)
    assert tarfile.open(fileobj=io.BytesIO(body)).getnames() == ["b"]
    packed = archives.gzipped(f.select("name", "content"), "name")
    assert sorted(bytes(r.content) for r in archives.gunzipped(packed, "name").collect()) == sorted(c for *_, c in rows)


DOCUMENT = """{"meta": {"name": "n", "hostname": "h", "state": "created", "labels": null, "time_format": "%Y-%m-%d %H:%M:%S %z",
"start_time": "2024-01-01 03:00:00 +0300", "end_time": "2024-01-01 01:00:00 +0000", "access_controls": ["u"]}, "databases": []}"""


def test_metadata(spark, tmp_path):
    got = metadata.parse(spark.createDataFrame([(DOCUMENT,)], "document string")).first()
    assert (got.name, got.labels, got.access_control, got.schema_only, got.encrypted, got.databases) == ("n", {}, ["u"], False, True, None)
    assert got.end_time - got.start_time == timedelta(hours=1)
    full = '{"meta": {"name": "m", "state": "failed"}, "databases": {"d": {"tables": {"t": {"engine": "Log", "parts": {"p": {"checksum": "c", "bytes": 3, "link": ""}}}}}, "empty": {}}}'
    metadata.write_documents(spark.createDataFrame([("m", full), ("n", DOCUMENT.replace("\n", " "))], "backup string, document string"), str(tmp_path / "root"))
    assert spark.read.text(str(tmp_path / "root")).count() == 2
    parsed = metadata.parse(spark.createDataFrame([(full,)], "document string"))
    part = metadata.parts(parsed).first()
    assert (part.database, part.table, part.part, part.link, part.disk_name, part.tarball, part.encrypted) == ("d", "t", "p", None, "default", False, True)
    assert {r.database for r in metadata.databases(parsed).collect()} == {"d", "empty"}
    with pytest.raises(Exception, match="without name"):
        metadata.parse(spark.createDataFrame([('{"meta": {}}',)], "document string")).collect()
    (tmp_path / "root2/n").mkdir(parents=True)
    (tmp_path / "root2/n/backup_light_struct.json").write_text(DOCUMENT)
    assert metadata.parse(metadata.read_documents(spark, str(tmp_path / "root2"), light=True)).first().name == "n"


def test_valid_parts(spark):
    wanted = spark.createDataFrame([("a", ["a.tar"], True, 10), ("b", ["x", "y"], False, 0), ("c", ["c.tar"], True, 5), ("d", ["x"], False, 0)], "part string, files array<string>, tarball boolean, size long")
    stored = spark.createDataFrame([("a", "a.tar", 10), ("b", "x", 1), ("b", "y", 1), ("c", "c.tar", 6)], "part string, file string, size long")
    assert {r.part: r.valid for r in listing.valid_parts(wanted, stored, ["part"]).collect()} == {"a": True, "b": True, "c": False, "d": False}
    one, more = (spark.createDataFrame(x, "k string, path string") for x in ([("a", "single")], [("a", "piece"), ("b", "piece")]))
    assert {tuple(r) for r in listing.first_of(one, more, ["k"]).collect()} == {("a", "single"), ("b", "piece")}


def run_stream(spark, tmp_path, batches, schema, build, mode):
    source = tmp_path / "in"
    out = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = build(spark.readStream.schema(schema).parquet(str(source)))
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
        q.awaitTermination(120)
    return out


def test_stream_stalls(spark, tmp_path):
    at = [datetime(2024, 1, 1) + timedelta(seconds=k) for k in range(5)]
    batches = [[("d", at[0], 5), ("d", at[1], 5), ("d", at[2], 6)], [("d", at[3], 6), ("d", at[4], 6)]]
    got = run_stream(spark, tmp_path, batches, "database string, ts timestamp, pointer long", polls.stall_counts, "append")
    assert [r.stall_count for r in sorted(got, key=lambda r: r.ts)] == [1, 2, 0, 1, 2]


def test_stream_flushes(spark, tmp_path):
    batches = [[("b", 0.0, 0.0), ("b", 0.0, 1.0), ("b", 0.0, 2.0)], [("b", 0.0, 10.0), ("b", 0.0, 20.0)]]
    got = run_stream(spark, tmp_path, batches, "backup string, started double, seconds double", lambda s: polls.metadata_flushes(s, 5), "append")
    assert [(r.seconds, r.parts) for r in got] == [(10.0, 4), (20.0, 5)]


def test_stream_progress(spark, tmp_path):
    batches = [[("d", "t", "p", 1.0, "downloaded")], [("d", "t", "p", 2.0, "invalid"), ("d", "t", "q", 2.0, "downloaded")], [("d", "t", "q", 3.0, "restored"), ("d", "t", "q", 1.0, "invalid")]]
    got = run_stream(spark, tmp_path, batches, "database string, table string, part string, seconds double, state string", polls.restore_progress, "update")
    assert {(r.part, r.state) for r in got if r.seconds > 1} == {("p", "invalid"), ("q", "downloaded"), ("q", "restored")}
    assert [r.state for r in got if r.part == "q"][-1] == "restored"
