import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specula.functions import scalars as S
from specula.sources.video import sample_indices


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_labels(spark):
    cases = {" Real\t": "Real", "VERDADEIRO": "Real", "falso": "Fake", "AI": "Fake", "other ": "other", None: "", "": ""}
    got = values(spark, [(k,) for k in cases], "x STRING", S.normalize_label("x"))
    assert [g[0] for g in got] == list(cases.values())


def test_video_ids(spark):
    cases = {
        "https://youtu.be/abc/x": "abc", "https://YOUTU.BE/abc": "abc", "https://a.com/watch?v=x%20y&t=1": "x y", "https://a.com/watch?v=": "",
        "https://a.com/shorts/q1/z": "q1", "https://a.com/shorts": "", "not a url": "", None: "", "https://a.com/w?t=1&v=k#top": "k",
    }
    got = values(spark, [(k,) for k in cases], "x STRING", S.video_id_from_url("x"))
    assert [g[0] for g in got] == list(cases.values())


def test_hash_fraction_and_splits(spark):
    keys = [f"k{i}" for i in range(300)]
    got = values(spark, [(k,) for k in keys], "x STRING", S.hash_fraction("x"))
    want = [int(hashlib.sha256(f"42:{k}".encode()).hexdigest()[:12], 16) / (16**12 - 1) for k in keys]
    assert [g[0] for g in got] == want
    splits = values(spark, [("Real", k, True) for k in keys] + [("Fake", "k0", False), ("Fake", "k0", None)], "l STRING, k STRING, t BOOLEAN", S.split_of("l", "k", "t"))
    assert {s[0] for s in splits[:-2]} == {"train", "validation", "test"} and [s[0] for s in splits[-2:]] == ["unassigned"] * 2


@pytest.mark.parametrize("row,flag", [
    (("Real", 3, 3, 0.5), "ok"), (("Real", 3, 3, 0.5000001), "review"), (("Fake", 3, 3, 1.0), "feature_failure"), (("Fake", 0, 3, 0.0), "insufficient_metadata"),
    (("Fake", 3, None, 0.0), "insufficient_metadata"), ((None, 3, 3, 0.0), "missing_label"), (("x", 3, 3, 0.0), "missing_label"), (("Real", 3, 3, None), "feature_failure"),
])
def test_flags(spark, row, flag):
    ((got, trainable),) = values(spark, [row], "l STRING, n INT, m INT, r DOUBLE", S.quality_flag("l", "n", "m", "r"), S.is_trainable("l", "n", "m", "r"))
    assert got == flag and trainable == (flag == "ok")


def test_boxes(spark):
    rows = [((0.5, 1.5, 10.5, 11.5), 100, 100), ((-5.0, -5.0, 500.0, 500.0), 40, 30), ((3.0, 3.0, 4.0, 9.0), 100, 100), (None, 9, 9)]
    got = values(spark, rows, "b STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>, w INT, h INT", S.clip_bbox("b", "w", "h"))
    assert [tuple(g[0]) if g[0] else None for g in got] == [(0, 2, 10, 12), (0, 0, 40, 30), None, None]
    got = values(spark, rows[:2], "b STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>, w INT, h INT", S.scale_bbox("b", F.lit(0.5)), S.scale_bbox("b", F.lit(0.0)))
    assert tuple(got[1][0]) == (-10, -10, 1000, 1000) and got[0][1] is None


@pytest.mark.parametrize("n,m", [(0, 5), (1, 1), (10, None), (10, 10), (10, 1), (10, 2), (11, 4), (1000, 7), (12345, 120)])
def test_sample_positions(spark, n, m):
    ((got,),) = values(spark, [(n, m)], "n INT, m INT", S.sample_positions("n", "m"))
    assert got == sample_indices(n, m)


def test_nearest_metadata(spark):
    def want(f, n, m):
        if m <= 0:
            return None
        if m >= n - 3:
            return min(f, m - 1)
        return int(np.argmin(np.abs(np.array(sample_indices(n, m)) - f)))

    cases = [(f, n, m) for n, m in ((10, 0), (10, 7), (10, 8), (10, 3), (30, 4), (9, 2)) for f in range(n)]
    got = values(spark, cases, "f INT, n INT, m INT", S.nearest_metadata("f", "n", "m"))
    assert [g[0] for g in got] == [want(*c) for c in cases]


def test_histogram_bins(spark):
    v = [0.0, 0.1, 0.999, 1.0, 1.001, -0.001, 0.5]
    got = [g[0] for g in values(spark, [(x,) for x in v], "x DOUBLE", S.histogram_bin("x", F.lit(0.0), F.lit(1.0), 4))]
    assert np.bincount([g for g in got if g is not None], minlength=4).tolist() == np.histogram(v, 4, (0, 1))[0].tolist()


def test_scopes(spark):
    names = ["face_bg_lbp_mean_diff_mean", "border_bg_x", "face_border_x", "lbp_background_x", "x_border_y", "x_face_y", "plain", "patch_face_patch_count_mean"]
    got = values(spark, [(n,) for n in names], "m STRING", S.metric_scope("m"), S.context_sensitive("m"))
    assert [g[0] for g in got] == ["face_background_diff", "border_background_diff", "face_border_diff", "background_direct", "border_direct", "face_direct", "other", "face_direct"]
    assert [g[1] for g in got] == [True, True, False, True, False, False, False, True]


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 5000), st.integers(1, 200))
def test_sampling_keeps_the_ends(n, m):
    at = sample_indices(n, m)
    assert len(at) == min(n, m) and at[0] == 0 and (m == 1 or at[-1] == n - 1) and at == sorted(set(at))
    assert not math.isnan(at[0])
