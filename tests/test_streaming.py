from codequarry.operators.store import latest
from codequarry.session import table
from codequarry.streaming import incremental


def test_stream_counts_equal_the_batch(spark, data, tmp_path):
    files = table(spark, data, "source_files")
    files.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = incremental.file_stream(spark, str(tmp_path / "in"), files.schema, 1)
    seen = []
    query = incremental.upsert_stream(stream.select("file_id", "scanned_at"), lambda b: seen.extend(r["file_id"] for r in b.collect()), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted(set(seen)) == sorted(r["file_id"] for r in latest(files, "file_id", ["scanned_at"]).select("file_id").collect())
    counted = incremental.scans_by_window(incremental.file_stream(spark, str(tmp_path / "in"), files.schema))
    run = counted.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.sql("SELECT sum(files) AS n FROM windows").first()["n"] == files.count()
