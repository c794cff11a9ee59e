import datetime as dt

from inkwarp.streaming.streams import counts_by_time, scan_stream


def _run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_scan_of_a_stream(spark, tmp_path):
    rows = [("a", "첫째 또한"), ("b", "둘째"), ("c", None)]
    spark.createDataFrame(rows, "document_id string, text string").write.parquet(str(tmp_path / "docs"))
    _run(scan_stream(spark.readStream.schema("document_id string, text string").parquet(str(tmp_path / "docs"))), "found", tmp_path)
    assert sorted((r.document_id, r.rule_id) for r in spark.table("found").collect()) == [("a", "KH-S03"), ("a", "KH-S04"), ("b", "KH-S03")]


def test_counts_with_late_rows(spark, tmp_path):
    day = dt.datetime(2024, 3, 1)
    schema = "rule_id string, at timestamp"
    for n, part in enumerate(([("r", day), ("r", day + dt.timedelta(minutes=5)), ("s", None)], [("r", day + dt.timedelta(days=9))], [("s", day + dt.timedelta(days=9))], [("s", day + dt.timedelta(days=9))], [("r", day)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{n}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    _run(counts_by_time(source, "at", "1 hour", "1 day"), "counted", tmp_path)
    got = [(r.window_start, r.rule_id, r.findings) for r in spark.table("counted").collect()]
    assert got == [(day, "r", 2)]  # the null time is in no window, the late row came when its window was done
