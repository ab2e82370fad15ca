"""Image primitives in NumPy, from their published definitions: colour spaces, gradients, LBP, smoothing, keypoints.

Frames are height x width x 3 arrays of bytes in the order blue, green, red. Borders are mirrored without the edge pixel.
"""

from __future__ import annotations

import numpy as np

# Weights and matrices of the colour spaces' definitions (ITU-R BT.601 luma, sRGB to CIE XYZ, D65 white).
LUMA = (0.114, 0.587, 0.299)
XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])


def gray(frame: np.ndarray) -> np.ndarray:
    """Luma as bytes; a frame of one channel is it already."""
    if frame.ndim == 2:
        return frame
    weights = np.rint(np.array(LUMA) * (1 << 14)).astype(np.int64)
    return ((frame.astype(np.int64) @ weights + (1 << 13)) >> 14).astype(np.uint8)


def lab(frame: np.ndarray) -> np.ndarray:
    """CIE L*a*b* scaled to bytes: L by 255/100, a and b shifted by 128."""
    rgb = frame[..., ::-1].astype(float) / 255
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    xyz = linear @ XYZ.T / WHITE
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
    out = np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def saturation_value(frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S and V of HSV as bytes."""
    most, least = frame.max(-1).astype(float), frame.min(-1).astype(float)
    s = np.where(most > 0, 255 * (most - least) / np.maximum(most, 1), 0)
    return np.rint(s).astype(np.uint8), most.astype(np.uint8)


def mirrored(a: np.ndarray, by: int) -> np.ndarray:
    """Padded by mirroring; along a side of one pixel that pixel repeats."""
    for axis in (0, 1):
        width = [(by, by) if k == axis else (0, 0) for k in range(a.ndim)]
        a = np.pad(a, width, mode="reflect" if a.shape[axis] > 1 else "edge")
    return a


def sobel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """3 x 3 gradients along x and y."""
    p = mirrored(a.astype(float), 1)
    down = p[:-2] + 2 * p[1:-1] + p[2:]
    across = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return down[:, 2:] - down[:, :-2], across[2:] - across[:-2]


def laplacian(a: np.ndarray) -> np.ndarray:
    """Sum of the four neighbours less four times the pixel."""
    p = mirrored(a.astype(float), 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def gaussian(a: np.ndarray, sigma: float, reach: float = 3.0) -> np.ndarray:
    """Separable smoothing with a kernel of 2 * reach * sigma + 1 taps, made odd."""
    size = int(round(sigma * reach * 2 + 1)) | 1
    r = size // 2
    taps = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    taps /= taps.sum()
    p = mirrored(a.astype(float), r)
    from numpy.lib.stride_tricks import sliding_window_view

    p = sliding_window_view(p, size, axis=0) @ taps
    return sliding_window_view(p, size, axis=1) @ taps


def bilateral(a: np.ndarray, diameter: int = 9, sigma_colour: float = 75, sigma_space: float = 75) -> np.ndarray:
    """Edge-preserving mean over a disc, weighted by distance and by difference of level; bytes in, bytes out."""
    r = diameter // 2
    p = mirrored(a.astype(float), r)
    h, w = a.shape
    here = a.astype(float)
    total, weights = np.zeros((h, w)), np.zeros((h, w))
    by_level = np.exp(-0.5 * (np.arange(256) / sigma_colour) ** 2)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dx * dx + dy * dy > r * r:
                continue
            near = p[r + dy : r + dy + h, r + dx : r + dx + w]
            k = by_level[np.abs(near - here).astype(np.int64)] * np.exp(-0.5 * (dx * dx + dy * dy) / sigma_space**2)
            total += k * near
            weights += k
    return np.rint(total / weights).astype(np.uint8)


def local_binary_pattern(a: np.ndarray) -> np.ndarray:
    """Uniform patterns of 8 points at radius 1: the number of points not darker than the centre, 9 if not uniform.

    Points between pixels are interpolated, outside the frame is black.
    """
    h, w = a.shape
    p = np.pad(a.astype(float), 1)
    y, x = np.mgrid[0:h, 0:w]
    bits = []
    for k in range(8):
        dy, dx = round(-np.sin(2 * np.pi * k / 8), 5), round(np.cos(2 * np.pi * k / 8), 5)
        y0, x0 = int(np.floor(dy)), int(np.floor(dx))
        fy, fx = dy - y0, dx - x0
        at = lambda i, j: p[np.clip(y + 1 + i, 0, h + 1), np.clip(x + 1 + j, 0, w + 1)]
        top = at(y0, x0) * (1 - fx) + (at(y0, x0 + 1) * fx if fx else 0)
        low = (at(y0 + 1, x0) * (1 - fx) + (at(y0 + 1, x0 + 1) * fx if fx else 0)) if fy else 0
        bits.append(top * (1 - fy) + low * fy - a >= 0)
    bits = np.array(bits, np.int64)
    changes = (bits != np.roll(bits, -1, axis=0)).sum(0)
    return np.where(changes <= 2, bits.sum(0), 9).astype(float)


def resize_area(frame: np.ndarray, width: int, height: int) -> np.ndarray:
    """Shrink by averaging the source area under each target pixel."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * (n / m)
        cell = np.arange(n)
        return np.clip(np.minimum(edges[1:, None], cell + 1) - np.maximum(edges[:-1, None], cell), 0, None) / (n / m)

    # Rows first, then columns: two matrix products.
    rows = np.tensordot(weights(frame.shape[0], height), np.atleast_3d(frame).astype(float), axes=(1, 0))
    out = np.tensordot(rows, weights(frame.shape[1], width), axes=(1, 1)).transpose(0, 2, 1)
    return np.rint(out).astype(np.uint8).reshape(height, width, *frame.shape[2:])


def rotate(frame: np.ndarray, angle: float, centre: tuple[float, float]) -> np.ndarray:
    """Turned by an angle around (x, y), interpolated between pixels, black outside."""
    h, w = frame.shape[:2]
    a = np.atleast_3d(frame).astype(float)
    y, x = np.mgrid[0:h, 0:w]
    dx, dy = x - centre[0], y - centre[1]
    sx, sy = np.cos(angle) * dx - np.sin(angle) * dy + centre[0], np.sin(angle) * dx + np.cos(angle) * dy + centre[1]
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros_like(a)
    for i in (0, 1):
        for j in (0, 1):
            px, py = x0 + i, y0 + j
            inside = (px >= 0) & (px < w) & (py >= 0) & (py < h)
            share = np.abs(1 - i - (sx - x0)) * np.abs(1 - j - (sy - y0)) * inside
            out += share[..., None] * a[np.clip(py, 0, h - 1), np.clip(px, 0, w - 1)]
    return np.rint(out).astype(np.uint8).reshape(frame.shape)


def align_eyes(frame: np.ndarray, left: tuple[float, float], right: tuple[float, float]) -> np.ndarray:
    """Turned so that the eyes are level."""
    return rotate(frame, float(np.arctan2(right[1] - left[1], right[0] - left[0])), ((left[0] + right[0]) / 2, (left[1] + right[1]) / 2))


class Keypoints:
    """Scale-space keypoints with 128-value descriptors, after Lowe (2004): extrema of differences of Gaussians over three
    scales an octave, thresholds on contrast and edges, main orientations, 4 x 4 x 8 histograms of gradients.
    """

    # Parameters of the publication.
    SCALES, SIGMA, CONTRAST, EDGE, BLUR = 3, 1.6, 0.04, 10.0, 0.5

    def __init__(self, a: np.ndarray, mask: np.ndarray | None = None):
        """Keypoints of a grey frame whose place the mask holds: x, y, size, response and descriptors."""
        found, described = [], []
        base = gaussian(a.astype(float) / 255, float(np.sqrt(self.SIGMA**2 - self.BLUR**2)), 4)
        octave = 0
        while min(base.shape) >= 16:
            levels = [base]
            for k in range(1, self.SCALES + 3):
                s0 = self.SIGMA * 2 ** ((k - 1) / self.SCALES)
                levels.append(gaussian(levels[-1], s0 * float(np.sqrt(2 ** (2 / self.SCALES) - 1)), 4))
            stack = np.array(levels)
            dogs = stack[1:] - stack[:-1]
            for k, y, x, response in self._extrema(dogs):
                py, px = y << octave, x << octave
                if mask is not None and not mask[min(py, mask.shape[0] - 1), min(px, mask.shape[1] - 1)]:
                    continue
                scale = self.SIGMA * 2 ** (k / self.SCALES)
                dy, dx = self._gradients(levels[k])
                for angle in self._orientations(dy, dx, y, x, scale):
                    found.append((px, py, 2 * scale * (1 << octave), response))
                    described.append(self._describe(dy, dx, y, x, scale, angle))
            base, octave = levels[self.SCALES][::2, ::2], octave + 1
        self.points = np.array(found, float).reshape(-1, 4)
        self.descriptors = np.array(described, float).reshape(-1, 128)

    def _extrema(self, d: np.ndarray):
        """(scale, y, x, response) of the extrema among the 26 neighbours that pass both thresholds."""
        c = d[1:-1, 1:-1, 1:-1]
        if not c.size:
            return
        near = [d[1 + i : d.shape[0] - 1 + i, 1 + j : d.shape[1] - 1 + j, 1 + k : d.shape[2] - 1 + k] for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) != (0, 0, 0)]
        high, low = c > np.max(near, axis=0), c < np.min(near, axis=0)
        strong = np.abs(c) > 0.5 * self.CONTRAST / self.SCALES
        for i, y, x in np.argwhere((high | low) & strong):
            k, y, x = i + 1, y + 1, x + 1
            g = np.array([d[k, y, x + 1] - d[k, y, x - 1], d[k, y + 1, x] - d[k, y - 1, x], d[k + 1, y, x] - d[k - 1, y, x]]) / 2
            v = d[k, y, x]
            xx, yy, ss = d[k, y, x + 1] + d[k, y, x - 1] - 2 * v, d[k, y + 1, x] + d[k, y - 1, x] - 2 * v, d[k + 1, y, x] + d[k - 1, y, x] - 2 * v
            xy = (d[k, y + 1, x + 1] - d[k, y + 1, x - 1] - d[k, y - 1, x + 1] + d[k, y - 1, x - 1]) / 4
            xs = (d[k + 1, y, x + 1] - d[k + 1, y, x - 1] - d[k - 1, y, x + 1] + d[k - 1, y, x - 1]) / 4
            ys = (d[k + 1, y + 1, x] - d[k + 1, y - 1, x] - d[k - 1, y + 1, x] + d[k - 1, y - 1, x]) / 4
            trace, det = xx + yy, xx * yy - xy * xy
            if det <= 0 or trace * trace * self.EDGE >= (self.EDGE + 1) ** 2 * det:
                continue
            hessian = np.array([[xx, xy, xs], [xy, yy, ys], [xs, ys, ss]])
            try:
                shift = -np.linalg.solve(hessian, g)
            except np.linalg.LinAlgError:
                continue
            peak = abs(v + g @ shift / 2)
            if np.abs(shift).max() < 1.5 and peak * self.SCALES >= self.CONTRAST:
                yield k, int(y), int(x), float(peak)

    @staticmethod
    def _gradients(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.gradient(a) if min(a.shape) > 1 else (np.zeros_like(a), np.zeros_like(a))

    def _window(self, dy, dx, y: int, x: int, radius: int):
        y0, y1, x0, x1 = max(y - radius, 0), min(y + radius + 1, dy.shape[0]), max(x - radius, 0), min(x + radius + 1, dy.shape[1])
        gy, gx = dy[y0:y1, x0:x1], dx[y0:y1, x0:x1]
        ys, xs = np.mgrid[y0 - y : y1 - y, x0 - x : x1 - x]
        return np.hypot(gy, gx), np.arctan2(gy, gx), ys, xs

    def _orientations(self, dy, dx, y, x, scale) -> list[float]:
        size = 1.5 * scale
        power, angle, ys, xs = self._window(dy, dx, y, x, int(round(3 * size)))
        weight = power * np.exp(-(ys**2 + xs**2) / (2 * size**2))
        hist = np.bincount((np.rint(angle * 36 / (2 * np.pi)).astype(int) % 36).ravel(), weight.ravel(), 36)
        for _ in range(2):
            hist = (np.roll(hist, 1) + hist + np.roll(hist, -1)) / 3
        if not hist.max() > 0:
            return []
        peaks = (hist > np.roll(hist, 1)) & (hist > np.roll(hist, -1)) & (hist >= 0.8 * hist.max())
        out = []
        for k in np.flatnonzero(peaks):
            a, b, c = hist[k - 1], hist[k], hist[(k + 1) % 36]
            out.append(float((k + 0.5 * (a - c) / (a - 2 * b + c)) * 2 * np.pi / 36))
        return out

    def _describe(self, dy, dx, y, x, scale, angle) -> np.ndarray:
        cell = 3 * scale
        power, direction, ys, xs = self._window(dy, dx, y, x, int(round(cell * np.sqrt(2) * 2.5)))
        c, s = np.cos(angle), np.sin(angle)
        u, v = (c * xs + s * ys) / cell, (-s * xs + c * ys) / cell
        column, line, turn = u + 1.5, v + 1.5, ((direction - angle) % (2 * np.pi)) * 8 / (2 * np.pi)
        inside = (column > -1) & (column < 4) & (line > -1) & (line < 4)
        weight = (power * np.exp(-(u**2 + v**2) / 8))[inside]
        column, line, turn = column[inside], line[inside], turn[inside]
        out = np.zeros((6, 6, 8))
        c0, l0, t0 = np.floor(column).astype(int), np.floor(line).astype(int), np.floor(turn).astype(int)
        for i in (0, 1):
            for j in (0, 1):
                for k in (0, 1):
                    share = np.abs(1 - i - (line - l0)) * np.abs(1 - j - (column - c0)) * np.abs(1 - k - (turn - t0))
                    np.add.at(out, (l0 + i + 1, c0 + j + 1, (t0 + k) % 8), weight * share)
        flat = out[1:5, 1:5].ravel()
        size = np.linalg.norm(flat)
        if not size:
            return flat
        flat = np.minimum(flat, 0.2 * size)
        return np.minimum(np.rint(512 * flat / np.linalg.norm(flat)), 255)
