import datetime as dt

from tagloom.streaming.incremental import keep_latest, loads_per_hour, table_stream, tag_totals

SCHEMA = "idx bigint, version int, loaded_at timestamp"


def test_windows_and_repeats(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10, 5)
    batches = [[(1, 1, at), (1, 1, at), (2, 1, at + dt.timedelta(minutes=20)), (3, 1, None)], [(1, 1, at), (4, 1, at + dt.timedelta(hours=3))], [(5, 1, at + dt.timedelta(hours=9))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 0:
            q = loads_per_hour(table_stream(spark, str(tmp_path / "in"), 1)).writeStream.outputMode("append").format("memory").queryName("hours").start()
        q.processAllAvailable()
    q.stop()
    rows = {r.hour.hour: r.rows for r in spark.table("hours").collect()}
    assert rows[10] == 2 and rows[13] == 1


def test_tag_totals(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string").write.parquet(str(tmp_path / "t"))
    q = tag_totals(table_stream(spark, str(tmp_path / "t"))).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert {r.k: r.rows for r in spark.table("totals").collect()} == {"a": 2, "b": 1}


def test_latest_rows(spark, tmp_path):
    target = str(tmp_path / "latest")
    for rows in ([(1, 1, dt.datetime(2024, 1, 1)), (2, 1, dt.datetime(2024, 1, 1))], [(1, 2, dt.datetime(2024, 1, 2))], [(1, 2, dt.datetime(2024, 1, 2))]):
        keep_latest(spark.createDataFrame(rows, SCHEMA), target, ["idx"], ["version", "loaded_at"])
    assert {r.idx: r.version for r in spark.read.parquet(target).collect()} == {1: 2, 2: 1}
    # a driver lost between the two renames leaves the table aside; the next call goes on from there
    (tmp_path / "latest").rename(tmp_path / "latest.before")
    keep_latest(spark.createDataFrame([(3, 1, None)], SCHEMA), target, ["idx"], ["version", "loaded_at"])
    assert {r.idx: r.version for r in spark.read.parquet(target).collect()} == {1: 2, 2: 1, 3: 1}
