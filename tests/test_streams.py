"""New files as a stream: once each, over restarts and failures."""

import pytest

from citeloom.streaming import incremental


def step(batch):
    return batch.selectExpr("path", "decode(content, 'utf-8') AS text")


@pytest.mark.parametrize("within", [None, "10 days"])
def test_items_are_done_once_over_restarts(spark, tmp_path, within):
    source, out = tmp_path / "in", tmp_path / "out"

    def run():
        stream = incremental.run_step(incremental.watch(spark, str(source / "*")), step, str(out), str(tmp_path / "log"), within=within)
        stream.awaitTermination()
        return [p for p in stream.recentProgress if p["numInputRows"]]

    for n, folder in enumerate(("one", "two", "three")):
        (source / folder).mkdir(parents=True)
        (source / folder / "same.xml").write_text(f"same {n}")
        (source / folder / f"{folder}.xml").write_text(folder)
        (source / folder / "none.txt").write_text("passed over")
        progress = run()
        # a batch reads the new files and no earlier ones, and asks the state of names
        assert sum(p["numInputRows"] for p in progress) == 2
        assert progress[-1]["stateOperators"][0]["numRowsTotal"] == n + 2
    assert sorted(r["text"] for r in spark.read.parquet(str(out)).collect()) == ["one", "same 0", "three", "two"]
    assert run() == []


def test_a_batch_that_failed_is_run_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text("a")

    def run(f):
        incremental.run_step(incremental.watch(spark, str(tmp_path / "in")), f, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()

    with pytest.raises(Exception, match="broken"):
        run(lambda batch: batch.selectExpr("path", "raise_error('broken') AS text"))
    (tmp_path / "in" / "b.xml").write_text("b")
    run(step)
    run(step)
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_counts_by_window(spark, tmp_path):
    """Windows that end before the watermark are given out; events that are late beyond it are left out."""
    rows = "id long, at timestamp, kind string"
    days = [[(1, "2020-01-01 00:10:00", "a"), (2, "2020-01-01 00:50:00", "a")], [(3, "2020-01-01 05:00:00", "b")], [(4, "2020-01-01 00:20:00", "a"), (5, "2020-01-01 09:00:00", "a")]]
    for day in days:
        made = spark.createDataFrame(day, "id long, at string, kind string").selectExpr("id", "cast(at AS timestamp) AS at", "kind")
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(rows).parquet(str(tmp_path / "in"))
        stream = incremental.count_by_window(events, "at", "1 hour", "30 minutes", "kind").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        stream.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).selectExpr("cast(window.start AS string) AS s", "kind", "n").collect()
    assert sorted(map(tuple, found)) == [("2020-01-01 00:00:00", "a", 2), ("2020-01-01 05:00:00", "b", 1)]
