"""Frame metrics of the exploratory profile. Names are those of the production profile, formulas are not.

Frames are shrunk to a longer side of 640 first and boxes with them; a box without area grows instead of dropping out.
Differences of regions are absolute, regions with too few pixels have no metrics, entropies use the natural logarithm.
``compute`` and ``metric_names`` take the place of production's in ``features.frame_features``.
"""

from __future__ import annotations

import numpy as np

from specula.functions import images
from specula.operators.kernels import NAN, PAIRS, REGIONS, Frame, normalize_groups

SIZE, TINY = 640, 1e-12


def grown(bbox, width: int, height: int, least: int = 4) -> tuple[int, int, int, int]:
    """Rounded and clamped; a side of nothing becomes ``least`` long as far as the frame goes."""
    x1, y1, x2, y2 = (int(round(v)) for v in bbox)
    x1, x2 = max(0, min(width - 1, x1)), max(0, min(width, x2))
    y1, y2 = max(0, min(height - 1, y1)), max(0, min(height, y2))
    return x1, y1, min(width, x1 + least) if x2 <= x1 else x2, min(height, y1 + least) if y2 <= y1 else y2


def standard(frame: Frame, padding: float = 0.2) -> Frame:
    """The frame at the profile's size, with the box scaled by the same factor and widened anew."""
    h, w = frame.pixels.shape[:2]
    scale = min(SIZE / max(h, w), 1.0)
    pixels = frame.pixels if scale == 1 else images.resize_area(frame.pixels, int(w * scale), int(h * scale))
    h, w = pixels.shape[:2]
    x1, y1, x2, y2 = grown([round(v * scale) for v in frame.face], w, h)
    px, py = int((x2 - x1) * padding), int((y2 - y1) * padding)
    return Frame(pixels, (x1, y1, x2, y2), (max(0, x1 - px), max(0, y1 - py), min(w, x2 + px), min(h, y2 + py)))


def shares(values: np.ndarray, bins: int, span=None) -> np.ndarray:
    h = np.histogram(values, bins=bins, range=span)[0].astype(float)
    return h / (h.sum() + TINY)


def entropy(p: np.ndarray) -> float:
    """Of shares, from 0 to 1."""
    return float(-(p * np.log(p + TINY)).sum() / np.log(len(p)))


def hist_distance(a: np.ndarray, b: np.ndarray) -> float:
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return 1.0 if na < TINY or nb < TINY else float(1 - a @ b / (na * nb))


def collect(signal: str, regions: dict, compared, distance=None) -> dict[str, float]:
    """regions: of each name its numbers and what ``distance`` (name, function) compares, or None."""
    out = {f"{signal}_{r}_{k}": float(v) for r in REGIONS if regions[r] for k, v in regions[r][0].items()}
    for pair, a, b in PAIRS:
        if regions[a] and regions[b]:
            (left, x), (right, y) = regions[a], regions[b]
            out.update({f"{pair}_{signal}_{k}_diff": abs(float(left[k] - right[k])) for k in compared})
            if distance:
                out[f"{pair}_{signal}_{distance[0]}"] = distance[1](x, y)
    return out


def lbp(f: Frame) -> dict[str, float]:
    codes = images.local_binary_pattern(f.gray)

    def region(mask):
        if mask.sum() < 10:
            return None
        p = shares(codes[mask], 10, (0, 10))
        return {"entropy_norm": entropy(p), "uniformity": (p**2).sum(), "sparsity": (p > 0.01).mean()}, p

    return collect("lbp", {r: region(m) for r, m in f.masks.items()}, ("entropy_norm", "uniformity", "sparsity"), ("hist_dist", hist_distance))


def _weighted_direction(power: np.ndarray, angle: np.ndarray) -> tuple[float, float]:
    """(length, angle) of the mean direction, weighted by power."""
    w = power / (power.sum() + TINY)
    s, c = float((w * np.sin(angle)).sum()), float((w * np.cos(angle)).sum())
    return float(np.hypot(s, c)), float(np.arctan2(s, c))


def sobel(f: Frame) -> dict[str, float]:
    gx, gy = images.sobel(f.gray)
    power, angle = np.hypot(gx, gy), np.arctan2(gy, gx) % (2 * np.pi)

    def region(mask):
        if mask.sum() < 20:
            return None
        v, a = power[mask], angle[mask]
        p = shares(a, 12, (0, 2 * np.pi))
        return {"entropy_norm": entropy(p), "coherence": _weighted_direction(v, a)[0], "energy": v.mean(), "std": v.std(), "p95": np.percentile(v, 95)}, p

    return collect("sobel", {r: region(m) for r, m in f.masks.items()}, ("entropy_norm", "coherence", "energy", "std", "p95"), ("hist_dist", hist_distance))


def _laplacian3(a: np.ndarray) -> np.ndarray:
    """The 3 x 3 kernel of size 3: twice the four diagonal neighbours less eight times the pixel."""
    p = images.mirrored(a.astype(float), 1)
    return 2 * (p[:-2, :-2] + p[:-2, 2:] + p[2:, :-2] + p[2:, 2:]) - 8 * p[1:-1, 1:-1]


def laplacian(f: Frame) -> dict[str, float]:
    signed = _laplacian3(f.gray)

    def region(mask):
        n = int(mask.sum())
        if n < 20:
            return None
        v = signed[mask]
        std = v.std()
        z = (v - v.mean()) / std if std >= 1e-6 else np.zeros_like(v)
        k = 0.0
        if std >= 1e-6:
            g2 = (z**4).mean() / (z**2).mean() ** 2 - 3
            k = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
        p = shares(z, 40, (-5, 5))
        size = np.abs(v)
        return {
            "energy": (v * v).mean(), "variance": v.var(), "mean_abs": size.mean(), "p95_abs": np.percentile(size, 95),
            "entropy_norm": entropy(p), "kurtosis": k, "sparsity": (np.abs(z) > 1).mean(),
        }, p

    names = ("energy", "variance", "mean_abs", "p95_abs", "entropy_norm", "kurtosis", "sparsity")
    return collect("lap", {r: region(m) for r, m in f.masks.items()}, names, ("hist_dist", hist_distance))


def _spaced(a: np.ndarray, most: int) -> np.ndarray:
    return a if len(a) <= most else a[np.linspace(0, len(a) - 1, most).astype(int)]


def _cosines(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """Distances of all pairs, 1 where a vector is none."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        d = 1 - unit(a) @ unit(a if b is None else b).T
    d = d[np.triu_indices(len(a), 1)] if b is None else d.ravel()
    return np.nan_to_num(d, nan=1.0, posinf=1.0, neginf=1.0)


KEYPOINTS, DESCRIPTORS = 500, 80
SIFT = ("kp_count", "kp_density", "desc_entropy_norm", "desc_self_similarity", "desc_mean", "desc_std", "response_mean", "response_std", "has_kp")


def sift(f: Frame) -> dict[str, float]:
    whole = images.Keypoints(f.gray)

    def region(mask):
        area = float(mask.sum())
        if area < 25:
            return None
        inside = mask[whole.points[:, 1].astype(int), whole.points[:, 0].astype(int)] if len(whole.points) else np.zeros(0, bool)
        points, d = whole.points[inside], whole.descriptors[inside]
        strongest = np.sort(np.argsort(-points[:, 3], kind="stable")[:KEYPOINTS])
        points, d = points[strongest], d[strongest]
        if not len(d):
            return dict.fromkeys(SIFT, 0.0), None
        few = _spaced(d, DESCRIPTORS)
        own = float(1 - _cosines(few).mean()) if len(few) > 1 else 1.0
        numbers = (len(d), len(d) / (area + 1e-6), entropy(shares(d.ravel(), 64, (0, 255))), own, d.mean(), d.std(), points[:, 3].mean(), points[:, 3].std(), 1.0)
        return dict(zip(SIFT, numbers)), few

    between = lambda a, b: 1.0 if a is None or b is None else float(_cosines(a, b).mean())
    return collect("sift", {r: region(m) for r, m in f.masks.items()}, SIFT, ("desc_dist", between))


PATCH, STRIDE, COVER, PATCHES = 16, 8, 0.6, 80
PATCH_STATS = ("sim_mean", "sim_std", "sim_median", "sim_p95", "patch_count")


def patch(f: Frame) -> dict[str, float]:
    gray = f.gray.astype(float)
    h, w = gray.shape

    def region(mask):
        found = []
        for y in range(0, h - PATCH + 1, STRIDE):
            for x in range(0, w - PATCH + 1, STRIDE):
                if mask[y : y + PATCH, x : x + PATCH].mean() >= COVER:
                    v = gray[y : y + PATCH, x : x + PATCH].ravel()
                    if v.std() >= 1e-6:
                        found.append((v - v.mean()) / v.std())
        if len(found) < 2:
            return None
        few = _spaced(np.array(found), PATCHES)
        s = 1 - _cosines(few)
        return dict(zip(PATCH_STATS, (s.mean(), s.std(), np.median(s), np.percentile(s, 95), len(few)))), None

    return collect("patch", {r: region(m) for r, m in f.masks.items()}, PATCH_STATS)


NOISE = ("variance", "std", "energy", "rms", "entropy_norm", "skewness", "kurtosis", "mad", "p95_abs")


def residual(gray: np.ndarray, method: str = "bilateral", size: int = 9) -> np.ndarray:
    """The frame less its smoothing, by bilateral filter or by median."""
    if method == "bilateral":
        smooth = images.bilateral(gray, size)
    elif method == "median":
        p = np.pad(gray, size // 2, mode="edge")
        smooth = np.median(np.lib.stride_tricks.sliding_window_view(p, (size, size)), axis=(2, 3))
    else:
        raise ValueError(f"unknown method: {method}")
    return gray.astype(float) - smooth


def noise(f: Frame, method: str = "bilateral") -> dict[str, float]:
    rest = residual(f.gray, method)

    def region(mask):
        if mask.sum() < 25:
            return None
        v = rest[mask]
        d, size, var = v - v.mean(), np.abs(v), v.var()
        std = np.sqrt(var)
        skew, kurt = ((d**3).mean() / std**3, (d**4).mean() / (var**2 + TINY)) if std >= 1e-6 else (0.0, 0.0)
        numbers = (var, std, size.mean(), np.sqrt((v * v).mean()), entropy(shares(v, 64)), skew, kurt, np.median(np.abs(v - np.median(v))), np.percentile(size, 95))
        return {"mean": v.mean()} | dict(zip(NOISE, numbers)), None

    return collect("noise", {r: region(m) for r, m in f.masks.items()}, NOISE)


FFT = ("low_freq_ratio", "mid_freq_ratio", "high_freq_ratio", "entropy_norm", "anisotropy", "radial_centroid", "flatness", "std_intensity")
FFT_SIZE, BANDS, SECTORS = 128, (0.25, 0.60), 8


def _resampled(gray: np.ndarray) -> np.ndarray:
    """To a square of FFT_SIZE: by area along a side that shrinks, linearly along one that grows."""

    def weights(n: int, m: int) -> np.ndarray:
        if n >= m:
            edges, cell = np.arange(m + 1) * (n / m), np.arange(n)
            return np.clip(np.minimum(edges[1:, None], cell + 1) - np.maximum(edges[:-1, None], cell), 0, None) / (n / m)
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        return np.clip(1 - np.abs(at[:, None] - np.arange(n)), 0, None)

    return weights(gray.shape[0], FFT_SIZE) @ gray.astype(float) @ weights(gray.shape[1], FFT_SIZE).T


def _spectrum(gray: np.ndarray | None):
    if gray is None or min(gray.shape) < 8:
        return None
    level = _resampled(gray)
    level = (level - level.mean()) * np.outer(np.hanning(FFT_SIZE), np.hanning(FFT_SIZE))
    power = np.abs(np.fft.fftshift(np.fft.fft2(level))) ** 2
    dy, dx = np.mgrid[: FFT_SIZE, : FFT_SIZE] - FFT_SIZE // 2
    far = np.hypot(dy, dx)
    most, total = far.max(), power.sum() + TINY
    part = lambda lo, hi: power[(far > lo) & (far <= hi)].sum() / total
    p = power.ravel() / total
    p = p[p > TINY]
    edges = np.linspace(-np.pi, np.pi, SECTORS + 1)
    angle = np.arctan2(dy, dx)
    by_sector = np.array([power[(angle >= a) & (angle < b)].sum() for a, b in zip(edges[:-1], edges[1:])])
    flat = np.exp(np.log(power + TINY).mean()) / (power.mean() + TINY)
    numbers = (
        part(1, BANDS[0] * most), part(BANDS[0] * most, BANDS[1] * most), part(BANDS[1] * most, most), -(p * np.log(p)).sum() / np.log(power.size),
        by_sector.std() / (by_sector.mean() + TINY), (power * far).sum() / (total * most + TINY), flat, gray.std(),
    )
    return dict(zip(FFT, numbers)) | {"mean_intensity": gray.mean()}, None


def fft(f: Frame) -> dict[str, float]:
    h, w = f.gray.shape
    x1, y1, x2, y2 = f.face

    def ring(share):
        px, py = int((x2 - x1) * share), int((y2 - y1) * share)
        return max(0, x1 - px), max(0, y1 - py), min(w, x2 + px), min(h, y2 + py)

    def largest(outer, inner):
        """The largest strip of at least 8 x 8: above and below over the outer width, at the sides along the inner height."""
        (ox1, oy1, ox2, oy2), (ix1, iy1, ix2, iy2) = outer, inner
        strips = [f.gray[oy1:iy1, ox1:ox2], f.gray[iy2:oy2, ox1:ox2], f.gray[iy1:iy2, ox1:ix1], f.gray[iy1:iy2, ix2:ox2]]
        return max((s for s in strips if min(s.shape) >= 8), key=lambda s: s.size, default=None)

    near, wide = ring(0.25), ring(0.90)
    parts = {"face": f.gray[y1:y2, x1:x2], "border": largest(near, f.face), "background": largest(wide, near)}
    return collect("fft", {r: _spectrum(c) for r, c in parts.items()}, FFT)


LIGHT_SIGMA, BRIGHT, DARK, LEAST = 15, 220.0, 35.0, 25
PHYS = "l_mean l_std l_contrast l_range l_entropy_norm highlight_ratio shadow_ratio a_mean b_mean sat_mean illum_mean illum_std grad_energy grad_std grad_coherence".split()


def physics(f: Frame) -> dict[str, float]:
    lab = images.lab(f.pixels).astype(float)
    sat, value = (x.astype(float) for x in images.saturation_value(f.pixels))
    smooth = np.rint(images.gaussian(lab[..., 0], LIGHT_SIGMA))
    gx, gy = images.sobel(smooth)
    power, angle = np.hypot(gx, gy), np.arctan2(gy, gx)

    def region(m):
        if m.sum() < LEAST:
            return None
        light, a, b, g = lab[..., 0][m], lab[..., 1][m], lab[..., 2][m], power[m]
        low, high = np.percentile(light, (5, 95))
        coherence, direction = _weighted_direction(g, angle[m]) if g.sum() > 1e-6 else (0.0, 0.0)
        return {
            "l_mean": light.mean(), "l_std": light.std(), "l_contrast": light.std() / (light.mean() + 1e-6), "l_range": high - low,
            "l_entropy_norm": entropy(shares(light, 64, (0, 255))), "highlight_ratio": (light >= max(BRIGHT, high)).mean(),
            "shadow_ratio": (light <= min(DARK, low)).mean(), "a_mean": a.mean(), "b_mean": b.mean(), "a_std": a.std(), "b_std": b.std(),
            "sat_mean": sat[m].mean(), "sat_std": sat[m].std(), "value_mean": value[m].mean(), "illum_mean": smooth[m].mean(), "illum_std": smooth[m].std(),
            "grad_energy": g.mean(), "grad_std": g.std(), "grad_coherence": coherence, "grad_direction": direction,
        }, direction

    turn = lambda a, b: abs(float(np.arctan2(np.sin(a - b), np.cos(a - b))))
    out = collect("phys", {r: region(m) for r, m in f.masks.items()}, PHYS, ("grad_direction_diff", turn))
    return out | asymmetry(lab[..., 0], f.face)


def asymmetry(light: np.ndarray, face) -> dict[str, float]:
    """Differences of halves by their sum, and the deviation of the quadrants by their mean."""
    x1, y1, x2, y2 = face
    cx, cy = (x1 + x2) // 2, (y1 + y2) // 2
    mean = lambda a, b, c, d: float(light[b:d, a:c].mean()) if max(0, c - a) * max(0, d - b) >= LEAST else NAN
    apart = lambda u, v: abs(u - v) / (abs(u) + abs(v) + 1e-6)
    quarters = np.array([mean(x1, y1, cx, cy), mean(cx, y1, x2, cy), mean(x1, cy, cx, y2), mean(cx, cy, x2, y2)])
    quarters = quarters[~np.isnan(quarters)]
    return {
        "phys_face_lr_luma_diff": apart(mean(x1, y1, cx, y2), mean(cx, y1, x2, y2)),
        "phys_face_tb_luma_diff": apart(mean(x1, y1, x2, cy), mean(x1, cy, x2, y2)),
        "phys_face_luma_quadrant_imbalance": float(quarters.std() / (np.abs(quarters).mean() + 1e-6)) if len(quarters) else NAN,
    }


GROUPS = {"a": (lbp, sobel, laplacian), "b": (sift, patch), "c": (noise,), "d": (fft,), "e": (physics,)}


def compute(frame: Frame, groups) -> dict[str, float]:
    f = standard(frame)
    out: dict[str, float] = {}
    for g in dict.fromkeys(normalize_groups(groups)):
        for kernel in GROUPS[g]:
            out.update(kernel(f))
    return out


def metric_names(groups="abcde") -> list[str]:
    y, x = np.mgrid[0:160, 0:160]
    pixels = np.stack([(x * 7 + y * y) % 251, (x * y) % 241, (x * 3 + y * 5) % 239], -1).astype(np.uint8)
    probe = Frame(pixels, (56, 56, 104, 104), (46, 46, 114, 114))
    return list(compute(probe, groups))
