from datetime import datetime

from specula.streaming import manifest


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [(at(0), "https://x.org/watch?v=a", "IA", "downloaded"), (at(1), "https://x.org/watch?v=a", "IA", "failed"), (at(50), "https://x.org/watch?v=b", "real", "failed")]
    schema = "ts TIMESTAMP, source_url STRING, label STRING, status STRING"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "m"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "m"))
    got = run(spark, manifest.new_records(stream()), "records")
    assert sorted((r["video_id"], r["label"]) for r in got) == [("a", "Fake"), ("b", "Real")]
    got = run(spark, manifest.status_counts(stream()), "counts", "complete")
    assert sorted((r["status"], r["n"]) for r in got) == [("downloaded", 1), ("failed", 1), ("failed", 1)]


def test_fill_by_state(spark, tmp_path):
    rows = [(1, 0, None), (1, 1, 2.0), (1, 2, None), (2, 0, 5.0)]
    schema = "video_id LONG, frame_id LONG, value DOUBLE"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "f"))
    got = run(spark, manifest.filled(spark.readStream.schema(schema).parquet(str(tmp_path / "f"))), "filled")
    assert sorted((r["video_id"], r["frame_id"], r["value"], r["source"]) for r in got if r["video_id"] == 1)[1:] == [(1, 1, 2.0, "detector"), (1, 2, 2.0, "last_bbox")]
    assert [r["source"] for r in got if r["frame_id"] == 0 and r["video_id"] == 1] == ["fallback_center"]
