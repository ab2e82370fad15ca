import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from specula.functions import images
from specula.operators import exploratory as X
from specula.operators import features
from specula.operators.kernels import Frame
from specula.plans.evaluation import evaluate
from specula.sources import video


def test_names():
    assert {g: len(X.metric_names(g)) for g in "abcde"} == {"a": 99, "b": 87, "c": 57, "d": 51, "e": 111}


def test_boxes_grow():
    assert X.grown((10, 10, 10, 20), 100, 100) == (10, 10, 14, 20) and X.grown((-5, 0, 300, 2), 100, 80) == (0, 0, 100, 2)


def test_large_frames_shrink_with_their_box():
    f = X.standard(Frame(np.zeros((960, 1280, 3), np.uint8), (200, 100, 400, 300), (0, 0, 1, 1)))
    assert f.pixels.shape == (480, 640, 3) and f.face == (100, 50, 200, 150) and f.expanded == (80, 30, 220, 170)


def test_frames_shrink_fast_and_right():
    a = np.random.default_rng(1).integers(0, 255, (960, 1280, 3), dtype=np.uint8)
    start = time.time()
    out = images.resize_area(a, 640, 480)
    assert time.time() - start < 1
    assert (out == np.rint(a.reshape(480, 2, 640, 2, 3).mean((1, 3)))).all()
    odd = images.resize_area(a[:30, :50], 20, 12)
    wide = a[:30, :50].astype(float).repeat(2, 0).repeat(2, 1)  # 60 x 100 cells: 5 x 5 under each target pixel
    assert (odd == np.rint(wide.reshape(12, 5, 20, 5, 3).mean((1, 3)))).all()


def test_constant_frame():
    r = X.compute(Frame(np.full((80, 80, 3), 60, np.uint8), (25, 25, 55, 55), (0, 0, 1, 1)), "ace")
    assert r["sobel_face_energy"] == r["noise_border_rms"] == r["lap_face_kurtosis"] == 0 and r["face_bg_lbp_hist_dist"] < 0.2
    assert r["phys_face_lr_luma_diff"] == 0 and r["phys_face_grad_direction"] == 0


def test_small_regions_have_no_metrics():
    r = X.compute(Frame(np.zeros((40, 40, 3), np.uint8), (0, 0, 40, 40), (0, 0, 40, 40)), "abcde")
    assert not any("background" in k or "_bg" in k for k in r)


def test_median_residual():
    a = np.full((20, 20), 50, np.uint8)
    a[10, 10] = 200
    rest = X.residual(a, "median")
    assert rest[10, 10] == 150 and abs(rest).sum() == 150
    with pytest.raises(ValueError):
        X.residual(a, "mean")


def test_rotation():
    a = np.zeros((21, 21), np.uint8)
    a[10, 5:16] = 200
    assert (images.rotate(a, np.pi / 2, (10, 10))[5:16, 10] == 200).all() and (images.rotate(a, 0, (3, 4)) == a).all()
    tilted = np.zeros((41, 41), np.uint8)
    tilted[12, 12] = tilted[28, 28] = 255
    level = images.align_eyes(tilted, (12, 12), (28, 28)).astype(float)
    rows = level.sum(1)
    assert abs((rows * np.arange(41)).sum() / rows.sum() - 20) < 0.5 and rows[18:23].sum() > 0.9 * rows.sum()


def test_evaluation(spark, tmp_path):
    rng = np.random.default_rng(0)
    for k in range(4):
        spread = 60 if k % 2 else 8
        (tmp_path / f"v{k}.spv").write_bytes(video.encode_raw(np.clip(rng.normal(120, spread, (3, 48, 48, 3)), 0, 255).astype(np.uint8)))
    frames = video.read_frames(spark, str(tmp_path / "*.spv"))
    labels = spark.createDataFrame([(f"v{k}", "Fake" if k % 2 else "Real") for k in range(4)], "video_id STRING, label STRING")
    detector = lambda: (lambda p: [{"bbox": [14, 14, 34, 34], "score": 0.1}, {"bbox": [0, 0, 9, 9], "score": 0.9}])
    boxes = features.detect(frames, detector, pick="first")
    assert boxes.select(F.col("bbox.x1")).distinct().first()[0] == 14
    videos, report = evaluate(frames, boxes, labels, "c", 2, resamples=20)
    assert videos.count() == 4 and len(videos.columns) == 3 + 3 * 57 and videos.first()["n_frames"] == 2
    best = report.first()
    assert report.count() == 57 and best["auc_abs"] == 1.0 and best["n_fake"] == 2 and best["auc_abs_ci_low"] == 1.0
