"""Zip archives as a source, a sink and a stream."""

import zipfile

import pytest

from citeloom.sources import archives


def test_many_members_are_many_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(10_000):
            z.writestr(f"d/{i}.xml", f"<a>{i}</a>")
        z.writestr("d/no.txt", "no")
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    found = archives.read_zip(spark, str(tmp_path), ".xml")
    assert found.rdd.getNumPartitions() == 11
    assert {(r["path"].split("!")[1], bytes(r["content"])) for r in found.collect()} == {(f"d/{i}.xml", f"<a>{i}</a>".encode()) for i in range(10_000)}
    register = spark.read.format("zip_members").option("taskBytes", 100).load(str(tmp_path / "a.zip"))
    assert register.rdd.getNumPartitions() > 1_000


def test_a_task_reads_its_own_entries(spark, tmp_path):
    """What a task reads of a directory doesn't grow with the archive, and the sink's archives need no steps over their entries."""
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(5_000):
            z.writestr(f"{i}", "x" * (i % 7))
        z.comment = b"PK at the end"
    whole = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "b.zip").write_bytes(b"bytes before" + whole)  # as of archives that unpack themselves
    held = archives._Members({"path": str(tmp_path)})
    runs = held.runs(held.archives())
    assert len(runs) == 10 and max(r.size for r in runs) < 60_000
    assert {(p.split("!")[0][-5], int(p.split("!")[1]), len(x)) for r in runs for p, x in held.members(r)} == {(a, i, i % 7) for a in "ab" for i in range(5_000)}

    path = str(tmp_path / "out")
    archives.write_zip(spark.range(2_500).selectExpr("concat(id, '.xml') AS path", "encode('text', 'utf-8') AS content").coalesce(1), path)
    written = archives._Members({"path": path})
    assert sorted(r.members for r in written.runs(written.archives())) == [500, 1_000, 1_000]
    assert archives.read_zip(spark, path).select("path").distinct().count() == 2_500


def test_odd_archives(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert archives.read_zip(spark, str(tmp_path / "none")).count() == 0
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x", "12345")
    with pytest.raises(Exception, match="has 5 bytes"):
        spark.read.format("zip_members").option("maxBytes", 4).load(str(tmp_path)).collect()


def test_written_archives_replace_earlier_ones(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (300, 7):
        rows = spark.range(n).selectExpr("concat(id, '.xml') AS path", "encode(concat('text ', id), 'utf-8') AS content")
        archives.write_zip(rows.repartition(3), path)
        found = archives.read_zip(spark, path)
        assert sorted(bytes(r["content"]) for r in found.collect()) == sorted(f"text {i}".encode() for i in range(n))
    assert [p.name for p in (tmp_path / "out").rglob("*") if p.suffix == ".zip" and "_temporary" in str(p)] == []


def test_stream_reads_every_archive_once(spark, tmp_path):
    """A second run goes on from its offsets and reads new archives only."""
    archives.register(spark)
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / "in" / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.xml", name)
        stream = spark.readStream.format("zip_members").load(str(tmp_path / "in"))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(bytes(r[0]) for r in spark.read.parquet(str(tmp_path / "out")).select("content").collect()) == [b"a", b"b"]
