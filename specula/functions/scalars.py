"""Scalar functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the two labels and the names of the metric scopes.
REAL = ("real", "true", "verdadeiro")
FAKE = ("fake", "false", "falso", "ia", "ai")
SCOPES = (
    ("face_bg_", "face_background_diff"),
    ("border_bg_", "border_background_diff"),
    ("face_border_", "face_border_diff"),
    ("_background_", "background_direct"),
    ("_border_", "border_direct"),
    ("_face_", "face_direct"),
)
CONTEXT_SCOPES = ("background_direct", "face_background_diff", "border_background_diff")

#: All white space at both ends, as opposed to trim(), which takes blanks only.
_ENDS = r"^\s+|\s+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text) -> Column:
    return F.regexp_replace(_c(text), _ENDS, "")


def text_or_empty(text) -> Column:
    return strip(F.coalesce(_c(text).cast("string"), F.lit("")))


def normalize_label(label) -> Column:
    """Real, Fake, or the stripped original; null becomes an empty string."""
    value = text_or_empty(label)
    key = F.lower(value)
    return F.when(key.isin(*REAL), "Real").when(key.isin(*FAKE), "Fake").otherwise(value)


def video_id_from_url(url, parameter: str = "v") -> Column:
    """First path segment of a short host, else the query parameter, else the segment behind ``shorts``, else empty."""
    part = lambda *what: F.coalesce(F.try_parse_url(_c(url), *map(F.lit, what)), F.lit(""))
    host, path, query = part("HOST"), part("PATH"), part("QUERY", parameter)
    segments = F.filter(F.split(path, "/"), lambda p: p != "")
    behind = F.get(segments, F.array_position(segments, "shorts").cast("int"))
    first = F.element_at(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/"), 1)
    return (
        F.when(F.contains(F.lower(host), F.lit("youtu.be")), first)
        .when(query != "", F.try_url_decode(query))
        .when(F.array_contains(segments, "shorts"), F.coalesce(behind, F.lit("")))
        .otherwise(F.lit(""))
    )


def hash_fraction(value, seed: int = 42) -> Column:
    """A stable number from 0 to 1: the first 12 hexadecimal digits of a SHA-256 over seed and value."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), _c(value)).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12 - 1))


def split_of(label, key, trainable, train: float = 0.7, validation: float = 0.15, seed: int = 42) -> Column:
    """train, validation or test by hash alone, so a row keeps its split whatever else the table holds."""
    x = hash_fraction(F.concat(_c(label), F.lit(":"), _c(key)), seed)
    return (
        F.when(~F.coalesce(_c(trainable), F.lit(False)), "unassigned")
        .when(x < F.lit(train), "train")
        .when(x < F.lit(train + validation), "validation")
        .otherwise("test")
    )


def quality_flag(label, n_frames, rows_used, ratio, threshold: float = 0.5) -> Column:
    """The first reason that applies; a null count is none, a null ratio all missing."""
    known = F.coalesce(_c(label).isin("Real", "Fake"), F.lit(False))
    few = (F.coalesce(_c(n_frames), F.lit(0)) <= 0) | (F.coalesce(_c(rows_used), F.lit(0)) <= 0)
    share = F.coalesce(_c(ratio), F.lit(1.0))
    return (
        F.when(~known, "missing_label")
        .when(few, "insufficient_metadata")
        .when(share >= 1.0, "feature_failure")
        .when(share > threshold, "review")
        .otherwise("ok")
    )


def is_trainable(label, n_frames, rows_used, ratio, threshold: float = 0.5) -> Column:
    return F.coalesce(
        _c(label).isin("Real", "Fake")
        & (_c(n_frames) > 0)
        & (_c(rows_used) > 0)
        & (_c(ratio) <= threshold)
        & (quality_flag(label, n_frames, rows_used, ratio, threshold) == "ok"),
        F.lit(False),
    )


BOX = ("x1", "y1", "x2", "y2")


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(_c(v).cast("int").alias(k) for k, v in zip(BOX, (x1, y1, x2, y2))))


def clip_bbox(bbox, width, height, min_size: int = 2) -> Column:
    """Half-even rounding, clamped into the frame; null for a side under min_size."""
    b, w, h = _c(bbox), _c(width), _c(height)
    edge = lambda k, most: F.greatest(F.lit(0), F.least(F.rint(b[k]).cast("int"), most))
    out = box(edge("x1", w - 1), edge("y1", h - 1), edge("x2", w), edge("y2", h))
    return F.when((out["x2"] - out["x1"] >= min_size) & (out["y2"] - out["y1"] >= min_size), out)


def scale_bbox(bbox, scale) -> Column:
    """Back to the size before scaling, towards zero; null for a scale of 0."""
    s = F.nullif(_c(scale), F.lit(0.0))
    return F.when(s.isNotNull(), box(*((_c(bbox)[k] / s).cast("int") for k in BOX)))


def frame_scale(width, height, most: int = 640) -> Column:
    """(scale, width, height) that fits the longer side into ``most``, never enlarging."""
    w, h = _c(width), _c(height)
    scale = F.least(F.lit(float(most)) / F.greatest(h, w), F.lit(1.0))
    return F.struct(scale.alias("scale"), (w * scale).cast("int").alias("width"), (h * scale).cast("int").alias("height"))


def fallback_bbox(width, height) -> Column:
    """A box around the centre, half of it a quarter of the shorter side."""
    w, h = _c(width), _c(height)
    half = lambda v: F.floor(v / 2).cast("int")
    size = F.greatest(F.lit(2), F.floor(F.least(w, h) / 4).cast("int"))
    return clip_bbox(box(half(w) - size, half(h) - size, half(w) + size, half(h) + size), w, h)


def expand_bbox(face, width, height, padding: float = 0.2) -> Column:
    """A box widened by a share of its own sides, within the frame. Give it a column, not an expression: it is named often."""
    face, w, h = _c(face), _c(width), _c(height)
    px, py = ((face["x2"] - face["x1"]) * padding).cast("int"), ((face["y2"] - face["y1"]) * padding).cast("int")
    wide = box(
        F.greatest(F.lit(0), face["x1"] - px), F.greatest(F.lit(0), face["y1"] - py), F.least(w, face["x2"] + px), F.least(h, face["y2"] + py)
    )
    return F.when(face.isNotNull(), wide)


def face_regions(bbox, width, height, padding: float = 0.2) -> Column:
    """(face, expanded) rectangles of a frame; null where the box is no box. Masks are predicates over them."""
    face = clip_bbox(bbox, width, height)
    return F.when(face.isNotNull(), F.struct(face.alias("face"), expand_bbox(face, width, height, padding).alias("expanded")))


def region_of(regions, x, y) -> Column:
    """The region that a pixel belongs to."""
    r = _c(regions)
    inside = lambda b: (_c(x) >= b["x1"]) & (_c(x) < b["x2"]) & (_c(y) >= b["y1"]) & (_c(y) < b["y2"])
    return F.when(inside(r["face"]), "face").when(inside(r["expanded"]), "border").otherwise("background")


def sample_positions(n, most) -> Column:
    """Places of at most ``most`` evenly spaced frames among n: all if they fit, else from the first to the last."""
    n, m = _c(n), _c(most).cast("int")
    step = (n - 1).cast("double") / F.nullif(m - 1, F.lit(0))
    spaced = F.transform(
        F.sequence(F.lit(0), m - 1), lambda i: F.when(m == 1, 0).when(i == m - 1, n - 1).otherwise(F.floor(i * step)).cast("int")
    )
    every = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(m.isNull() | (n <= m), every).otherwise(spaced)


def nearest_metadata(frame, n, m) -> Column:
    """Which of m metadata rows a frame of n takes: its own while there is about one a frame, else the nearest sampled one.

    The positions of m < n rows grow by more than one each, so the nearest is at the frame over the step or the next one.
    """
    frame, n, m = _c(frame), _c(n), _c(m)
    step = (n - 1).cast("double") / F.nullif(m - 1, F.lit(0))
    at = lambda i: F.when(i == m - 1, n - 1).otherwise(F.floor(i * step).cast("int"))
    low = F.least(F.coalesce(F.floor(frame / F.nullif(step, F.lit(0.0))), F.lit(0)).cast("int"), m - 1)
    high = F.least(low + 1, m - 1)
    best = F.when(F.abs(frame - at(low)) <= F.abs(at(high) - frame), low).otherwise(high)
    return F.when(m <= 0, F.lit(None)).when(m >= n - 3, F.least(frame, m - 1)).otherwise(best).cast("int")


def metric_scope(metric) -> Column:
    name = _c(metric)
    found = reduce(lambda w, x: w.when(F.contains(name, F.lit(x[0])), x[1]), SCOPES, F)
    return found.otherwise("other")


def context_sensitive(metric) -> Column:
    return metric_scope(metric).isin(*CONTEXT_SCOPES) | F.endswith(_c(metric), F.lit("patch_count_mean"))


def matches_prefix(metric, prefixes) -> Column:
    """Names that start with a prefix or hold it between underscores."""
    tests = [F.startswith(_c(metric), F.lit(p)) | F.contains(_c(metric), F.lit(f"_{p}_")) for p in prefixes]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def histogram_bin(value, low, high, bins: int) -> Column:
    """The bin of a value in [low, high], the last one closed; null outside."""
    v, lo, hi = _c(value), _c(low), _c(high)
    at = F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins).cast("int")
    return F.when((v >= lo) & (v <= hi), F.least(at, F.lit(bins - 1)))


def finite(value) -> Column:
    """NaN as null, so that aggregates pass over it."""
    v = _c(value)
    return F.when(~F.isnan(v), v)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a) -> Column:
    """The vector of length 1; null for a vector of zeros."""
    size = F.nullif(norm(a), F.lit(0.0))
    return F.when(size.isNotNull(), F.transform(_c(a), lambda x: x.cast("double") / size))


def cosine_distance(a, b) -> Column:
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def json_number(value) -> Column:
    """A number that JSON can hold; NaN and infinities are null."""
    v = _c(value).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
