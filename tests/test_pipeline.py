import hashlib
import json

import numpy as np
import pytest

from pyspark.sql import functions as F

from specula import cli
from specula.functions.scalars import nearest_metadata
from specula.operators import boxes, features
from specula.plans import pipeline
from specula.sources import adapters, video
from specula.sources.tables import Layout, append_manifest, read_manifest, read_metadata, write_metadata


def detector():
    return lambda pixels: [{"bbox": [12, 10, 40, 44], "score": 0.7}, {"bbox": [1, 1, 5, 5], "score": 0.2}] if pixels[0, 0, 0] % 2 else []


@pytest.fixture
def root(tmp_path):
    rng = np.random.default_rng(3)
    videos = tmp_path / "bronze" / "videos"
    videos.mkdir(parents=True)
    for name, n in (("a", 5), ("b", 3), ("zz", 0)):
        frames = rng.integers(0, 255, (n, 48, 56, 3), dtype=np.uint8)
        for k in range(n):
            frames[k, 0, 0, 0] = k % 2
        (videos / f"{name}.spv").write_bytes(video.encode_raw(frames) if n else b"broken")
    (tmp_path / "bronze" / "catalog.csv").write_text(
        "Filename,Video Ground Truth,Audio Ground Truth,Media\na.spv,Real,Real,https://x.org/watch?v=a\nother.spv,Fake,,https://x.org/watch?v=b\nzz.spv,Fake,,\nmissing.spv,Real,,https://x.org/watch?v=q\n"
    )
    return tmp_path


def test_build(spark, root, capsys):
    layout = Layout(str(root))
    report = pipeline.run_build(spark, layout, str(root / "bronze" / "catalog.csv"), groups="acde", detector=detector, now="2024-01-01T00:00:00+00:00")
    assert report["bronze"]["input_rows"] == 3 and report["gold"]["rows"] == 2
    gold = {r["video_id"]: r for r in spark.read.parquet(layout.gold).collect()}
    assert gold["a"]["n_frames"] == 5 and gold["b"]["target_label"] == "Fake" and gold["a"]["audio_label"] == "Real"
    assert gold["a"]["dataset_split"] in ("train", "validation", "test") and gold["a"]["missing_feature_ratio"] < 0.5
    sources = [r["source"] for r in spark.read.parquet(layout.metadata).filter("video_id = 'a'").orderBy("frame_id").collect()]
    assert sources == ["fallback_center", "detector", "last_bbox", "detector", "last_bbox"]
    contracts = {r["contract_name"]: r["status"] for r in report["contracts"]["results"]}
    assert contracts["frame_metadata"] == contracts["frame_features"] == contracts["gold_training_dataset"] == "passed"
    before = spark.read.parquet(layout.metadata).count()
    assert pipeline.run_preprocess(spark, layout, detector).count() == before  # nothing left to do
    pipeline.run_ingest(spark, layout, str(root / "bronze" / "catalog.csv"))
    assert read_manifest(spark, layout.manifest).count() == 6
    assert cli.main(["validate", "--root", str(root)], spark) == 0 and json.loads(capsys.readouterr().out)["gold"]["rows"] == 2


def test_one_video(spark, root):
    path = str(root / "bronze" / "videos" / "a.spv")
    table, row = pipeline.process_video(spark, path, groups="c", max_frames=3, detector=detector, now="t")
    assert [r["frame_id"] for r in table.orderBy("frame_id").collect()] == [0, 2, 4] and row["n_frames"] == 3 and row["video_id"] == "a"
    with pytest.raises(FileNotFoundError):
        pipeline.process_video(spark, path, generate=False)
    _, empty = pipeline.process_video(spark, str(root / "bronze" / "videos" / "zz.spv"), groups="c")
    assert empty == {}


def reference_places(n, m, wanted):
    """By the definition: the nearest of m evenly spaced positions, the first of equals."""
    at = np.linspace(0, n - 1, m).astype(int)
    return [min(f, m - 1) if m >= n - 3 else int(np.abs(at - f).argmin()) for f in wanted]


def test_sampled_frames_take_their_own_boxes(spark, tmp_path):
    path = str(tmp_path / "long.spv")
    (tmp_path / "long.spv").write_bytes(video.encode_raw(np.zeros((100, 16, 16, 3), np.uint8)))
    frames = video.read_frames(spark, path, 10)
    kept = boxes.sampled(frames, None)
    wanted = np.linspace(0, 99, 10).astype(int).tolist()
    assert {r["frame_count"] for r in kept.collect()} == {100} and "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    again = boxes.sampled(video.read_frames(spark, path), 10).select("frame_id").orderBy("frame_id")
    assert [r[0] for r in again.collect()] == wanted
    metadata = spark.createDataFrame([("long", k, (2 + k, 2, 9, 9)) for k in range(10)], "video_id STRING, metadata_idx INT, bbox STRUCT<x1: INT, y1: INT, x2: INT, y2: INT>")
    got = boxes.match_metadata(kept, metadata).orderBy("frame_id").collect()
    assert [r["metadata_idx"] for r in got] == reference_places(100, 10, wanted) == list(range(10)) and [r["bbox"]["x1"] for r in got] == list(range(2, 12))
    table, row = pipeline.process_video(spark, path, metadata.filter("metadata_idx < 7"), "c", 10, now="t")
    assert [r["metadata_idx"] for r in table.orderBy("frame_id").collect()] == reference_places(100, 7, wanted)[: row["n_frames"]]


@pytest.mark.parametrize("n, m", [(100, 10), (100, 1), (57, 19), (9, 6), (1000, 333), (5, 2), (6, 9)])
def test_nearest_metadata(spark, n, m):
    got = spark.range(n).select("id", nearest_metadata(F.col("id").cast("int"), F.lit(n), F.lit(m)).alias("k")).orderBy("id").collect()
    assert [r["k"] for r in got] == reference_places(n, m, range(n))


def test_tracker(spark, tmp_path):
    frames = np.zeros((9, 40, 40, 3), np.uint8)
    frames[:, 0, 0, 0] = np.arange(9)
    (tmp_path / "t.spv").write_bytes(video.encode_raw(frames))

    def tracker():
        return lambda pixels, box: lambda later: None if later[0, 0, 0] == 7 else [box[0] + int(later[0, 0, 0]), *box[1:]]

    seen = lambda: (lambda p: [{"bbox": [3, 4, 30, 31], "score": 0.5}] if p[0, 0, 0] in (1, 6) else [])
    rows = features.detect(video.read_frames(spark, str(tmp_path / "t.spv")), seen, detect_every=3, tracker=tracker).orderBy("frame_id").collect()
    assert [r["source"] for r in rows] == ["fallback_center", "detector", "tracker", "last_bbox", "tracker", "tracker", "detector", "last_bbox", "tracker"]
    assert [r["bbox"]["x1"] for r in rows] == [10, 3, 5, 5, 7, 8, 3, 3, 11] and [r["detector_score"] is not None for r in rows] == [k in (1, 6) for k in range(9)]


def test_adapters(spark, tmp_path):
    assert adapters.local_path("file:/a/b.mp4") == adapters.local_path("file:///a/b.mp4") == "/a/b.mp4"
    with pytest.raises(ValueError):
        adapters.local_path("s3a://a/b")

    def download(url, folder):
        if url.endswith("bad"):
            raise RuntimeError("no such video")
        path = f"{folder}/{url[-1]}.mp4"
        if url[-1] != "z":
            open(path, "wb").write(b"abc")
        return {"path": path}

    wanted = spark.createDataFrame([("u/a",), ("u/bad",), ("u/z",), ("u/a",)], "source_url STRING")
    got = {r["source_url"]: r for r in adapters.yt_dlp(str(tmp_path), download)(wanted).collect()}
    assert len(got) == 3 and got["u/a"]["sha256"] == hashlib.sha256(b"abc").hexdigest() and got["u/bad"]["error_message"] == "RuntimeError: no such video"
    assert got["u/z"]["status"] == "failed" and got["u/a"]["status"] == "downloaded"

    by_path = lambda: (lambda path, wanted: ((k, 3, np.zeros((2, 2, 3), np.uint8)) for k in (wanted if wanted is not None else range(3))))
    by_path.by_path, by_path.count = True, lambda path: 3 if path.endswith("a.mp4") else 0
    frames = video.read_frames(spark, str(tmp_path / "*.mp4"), 2, by_path).orderBy("frame_id").collect()
    assert [(r["video_id"], r["frame_id"], r["frame_count"]) for r in frames] == [("a", 0, 3), ("a", 2, 3)]


def test_a_bad_frame_does_not_end_the_job(spark, root):
    frames = video.read_frames(spark, str(root / "bronze" / "videos" / "b.spv"))
    metadata = features.detect(frames, detector, now="t")
    broken = frames.selectExpr("video_id", "frame_id", "frame_count", "height", "width", "channels", "IF(frame_id = 1, X'00', pixels) AS pixels")
    table = features.frame_features(broken, metadata, "c", now="t")
    got = {r["frame_id"]: r["error"] for r in table.collect()}
    assert got[0] is None and "ValueError" in got[1]
    assert features.video_features(table, "c").first()["n_frames"] == 2


def test_metadata_json(spark, root, tmp_path):
    (tmp_path / "a_meta.json").write_text(json.dumps([{"video_id": "a", "frame_id": 3, "bbox": [1, 2, 30, 40], "bbox_expanded": [0, 0, 36, 47], "source": "detector"}, {"video_id": "a", "frame_id": 9}]))
    rows = read_metadata(spark, str(tmp_path / "a_meta.json")).orderBy("metadata_idx").collect()
    assert [(r["metadata_idx"], r["frame_id"], r["bbox"]) for r in rows] == [(0, 3, [1, 2, 30, 40]), (1, 9, None)]
    write_metadata(read_metadata(spark, str(tmp_path / "a_meta.json")).drop("file", "metadata_idx"), str(tmp_path / "out"))
    assert read_metadata(spark, str(tmp_path / "out" / "video_id=a")).count() == 2


def test_manifest_append(spark, tmp_path):
    path = str(tmp_path / "m.parquet")
    assert read_manifest(spark, path).count() == 0
    for k in range(2):
        append_manifest(spark.createDataFrame([(f"v{k}",)], "video_id STRING"), path)
    assert read_manifest(spark, path).count() == 2


def test_raw_container():
    frames = np.arange(2 * 3 * 4 * 3, dtype=np.uint8).reshape(2, 3, 4, 3)
    data = video.encode_raw(frames)
    assert video.frame_count(data) == 2 and video.frame_count(b"x") == 0
    assert all((f == frames[k]).all() for k, _, f in video.raw()(data, None)) and [k for k, *_ in video.raw()(data, [1])] == [1]
