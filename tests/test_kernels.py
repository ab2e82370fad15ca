import numpy as np
import pytest

from specula.functions import images
from specula.operators import kernels as K


def frame(a, face=None, wide=None):
    a = np.asarray(a, np.uint8)
    h, w = a.shape[:2]
    face = face or (w // 4, h // 4, 3 * w // 4, 3 * h // 4)
    wide = wide or (w // 8, h // 8, 7 * w // 8, 7 * h // 8)
    return K.Frame(np.repeat(a[..., None], 3, -1) if a.ndim == 2 else a, face, wide)


def test_names():
    assert {g: len(K.metric_names(g)) for g in "abcde"} == {"a": 150, "b": 75, "c": 42, "d": 66, "e": 93}
    assert len(set(K.metric_names())) == 426


def test_groups():
    assert K.normalize_groups("EaA") == ["e", "a", "a"]
    assert K.prefixes("ab") == ("lbp", "sobel", "lap", "sift", "patch")
    with pytest.raises(ValueError, match="x"):
        K.normalize_groups("ax")


def test_constant_frame():
    r = K.compute(frame(np.full((64, 64), 90)), "abcde")
    assert r["sobel_face_mean"] == r["lap_border_energy"] == r["noise_background_rms"] == 0
    assert r["sobel_face_entropy_norm"] == 0 and np.isnan(r["sobel_face_kurtosis"])
    assert r["sift_face_kp_count"] == 0 and r["phys_face_l_std"] == 0 and r["face_bg_phys_l_mean_diff"] == 0


def test_ramp():
    gx, gy = images.sobel(np.tile(np.arange(40.0) * 3, (20, 1)))
    assert (gx[:, 1:-1] == 24).all() and (gy == 0).all()
    assert (images.laplacian(np.tile(np.arange(40.0) * 3, (20, 1)))[:, 1:-1] == 0).all()


def test_checkerboard():
    a = (np.indices((32, 32)).sum(0) % 2) * 200
    assert (np.abs(images.laplacian(a)) == 800).all()
    assert (images.sobel(a)[0][1:-1, 1:-1] == 0).all()


def test_one_frequency():
    x = np.arange(64)
    s = K.spectrum(100 + 50 * np.cos(2 * np.pi * 8 * x / 64)[None, :].repeat(64, 0))
    assert s["std_intensity"] == pytest.approx(50 / np.sqrt(2)) and s["anisotropy"] > 0.3
    assert s["low_freq_ratio"] + s["mid_freq_ratio"] + s["high_freq_ratio"] == pytest.approx(1, abs=1e-6)
    assert K.spectrum(np.zeros((7, 40))) == {} and K.spectrum(np.zeros((8, 40))) != {} and K.spectrum(None) == {}


def test_pattern_codes():
    a = np.full((9, 9), 10, np.uint8)
    a[4, 4] = 200
    codes = images.local_binary_pattern(a)
    assert codes[4, 4] == 0 and codes[2, 6] == 8 and set(np.unique(codes)) <= set(range(10))


def test_regions_partition_the_frame():
    m = frame(np.zeros((50, 70))).masks
    assert (sum(x.astype(int) for x in m.values()) == 1).all()


def test_empty_region_has_no_metrics():
    r = K.compute(frame(np.random.default_rng(0).integers(0, 255, (48, 48)), (0, 0, 48, 48), (0, 0, 48, 48)), "ace")
    assert "noise_background_mean" not in r and "phys_background_l_mean" not in r and "face_bg_noise_mean_diff" not in r
    assert np.isnan(r["face_bg_lbp_hist_dist"])


def test_colours():
    lab = images.lab(np.array([[[255, 255, 255], [0, 0, 0], [0, 0, 255]]], np.uint8))
    assert lab[0, 0].tolist() == [255, 128, 128] and lab[0, 1].tolist() == [0, 128, 128] and lab[0, 2].tolist() == [136, 208, 195]
    s, v = images.saturation_value(np.array([[[10, 20, 40]]], np.uint8))
    assert (s[0, 0], v[0, 0]) == (191, 40)


def test_smoothing_keeps_the_mean_and_edges():
    a = np.zeros((40, 40), np.uint8)
    a[:, 20:] = 255
    assert abs(images.gaussian(a, 2).mean() - a.mean()) < 1e-6
    assert np.abs(images.bilateral(a).astype(int) - a).max() <= 2


def test_area_resize():
    assert images.resize_area(np.arange(16, dtype=np.uint8).reshape(4, 4) * 10, 2, 2).tolist() == [[25, 45], [105, 125]]


def test_keypoints_find_a_blob():
    y, x = np.mgrid[0:64, 0:64]
    a = (220 * np.exp(-((x - 30) ** 2 + (y - 34) ** 2) / (2 * 4.0**2))).astype(np.uint8)
    points = images.Keypoints(a).points
    assert len(points) and min(np.hypot(points[:, 0] - 30, points[:, 1] - 34)) <= 2


def test_patches():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 255, (64, 64)).astype(np.uint8)
    p = K.patches(g, np.ones((64, 64), bool))
    assert p.shape[1] == 256 and np.allclose(p.mean(1), 0, atol=1e-9) and K.patches(g, np.zeros((64, 64), bool)).shape == (0, 256)


def test_mean_distance_is_that_of_all_pairs():
    rng = np.random.default_rng(2)
    a, b = rng.random((5, 8)), rng.random((7, 8))
    pairs = [1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y) for x in a for y in b]
    assert K.mean_distance(a, b) == pytest.approx(np.mean(pairs))
