"""Queries that run the frame kernels over frames made of the tables, a frame an embedding or label, with SQL for their numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.functions import images
from specula.operators import kernels

SIDE = 32
#: Shares of squares are rounded later, as the fifth digit of such may be a tie.
DIGITS = {"uniformity": 12}
#: Added before other numbers are rounded on both sides: means over a power of two of pixels are often ties.
SHIFT = 1e-7


def _rectangles(key: int) -> tuple[tuple, tuple]:
    x2, y2 = 20 + key % 4, 17 + key % 5
    return (8, 6, x2, y2), (4, 3, x2 + 4, y2 + 3)


def _frame(key: int, vector: np.ndarray) -> kernels.Frame:
    """An embedding as 8 x 8 levels, repeated to 32 x 32 with a slope of its own."""
    level = np.tile(np.floor(vector.astype(float) * 40 + 128).reshape(8, 8), (4, 4))
    y, x = np.mgrid[0:SIDE, 0:SIDE]
    gray = ((level + 3 * x + 5 * y) % 256).astype(np.uint8)
    return kernels.Frame(np.repeat(gray[..., None], 3, -1), *_rectangles(key))


def _numbers(spark, d, names: list[str], compute) -> DataFrame:
    """(vec_id, names): compute's numbers of every embedding's frame, null where there are none."""

    def run(batches):
        for batch in batches:
            keys = batch.column("vec_id").to_numpy()
            vectors = batch.column("embedding").flatten().to_numpy().reshape(len(keys), -1)
            found = [compute(_frame(int(k), v)) for k, v in zip(keys, vectors)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *(pa.array([f.get(n) for f in found], pa.float64()) for n in names)], ["vec_id", *names])

    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(run, "vec_id long, " + ", ".join(f"{n} double" for n in names))


def _regions(spark, d, signal: str, kernel, stats: list[str]) -> DataFrame:
    """(vec_id, region, stats) of a kernel's direct metrics."""
    names = [f"{signal}_{r}_{k}" for r in kernels.REGIONS for k in stats]
    wide = _numbers(spark, d, names, kernel)
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("region"), *((F.round(f"{signal}_{r}_{k}", DIGITS[k]) if k in DIGITS else F.round(F.col(f"{signal}_{r}_{k}") + SHIFT, 5)).alias(k) for k in stats)) for r in kernels.REGIONS)))
    return wide.select("vec_id", rows.alias("r")).select("vec_id", "r.*")


FRAMES = f"""fr AS (SELECT vec_id, 20 + vec_id % 4 AS x2, 17 + vec_id % 5 AS y2, embedding FROM embeddings),
px AS (SELECT vec_id, x2, y2, y::INT AS y, x::INT AS x, ((floor(embedding[(y % 8) * 8 + x % 8 + 1]::DOUBLE * 40 + 128)::INT + 3 * x + 5 * y) % 256 + 256)::INT % 256 AS v FROM fr, range(0, {SIDE}) a(y), range(0, {SIDE}) b(x)),
rg AS (SELECT *, CASE WHEN x >= 8 AND x < x2 AND y >= 6 AND y < y2 THEN 'face' WHEN x >= 4 AND x < x2 + 4 AND y >= 3 AND y < y2 + 3 THEN 'border' ELSE 'background' END AS region FROM px)"""


def _basic(source: str, value: str) -> str:
    """The six basic numbers of a region's values."""
    return f"""round(avg({value}) + 1e-7, 5) AS mean, round(stddev_pop({value}) + 1e-7, 5) AS std, round(median({value}) + 1e-7, 5) AS median, round(quantile_cont({value}, 0.95) + 1e-7, 5) AS p95,
    round(avg({value} * {value}) + 1e-7, 5) AS energy, round(kurtosis_pop({value}) + 1e-7, 5) AS kurtosis FROM {source} GROUP BY vec_id, region"""


def _neighbours(reach: int, keep: str = "true") -> str:
    """Pixels with their neighbours up to reach away, mirrored at the borders without the edge pixel."""
    last = SIDE - 1
    return f"""nb AS (SELECT a.vec_id, a.region, a.y, a.x, a.v AS own, dy, dx, b.v FROM rg a, range(-{reach}, {reach + 1}) s(dy), range(-{reach}, {reach + 1}) t(dx), px b
    WHERE {keep} AND b.vec_id = a.vec_id AND b.y = {last} - abs({last} - abs(a.y + dy)) AND b.x = {last} - abs({last} - abs(a.x + dx)))"""


def _lbp_sql() -> str:
    """Codes of eight points at radius 1, those between pixels interpolated, outside is 0."""
    tests = []
    for k in range(8):
        dy, dx = round(-np.sin(2 * np.pi * k / 8), 5), round(np.cos(2 * np.pi * k / 8), 5)
        y0, x0 = int(np.floor(dy)), int(np.floor(dx))
        fy, fx = repr(float(dy - y0)) + "::DOUBLE", repr(float(dx - x0)) + "::DOUBLE"
        at = lambda i, j: f"n[{(i + 1) * 4 + j + 2}]"
        top = f"({at(y0, x0)} * (1 - {fx}) + {at(y0, x0 + 1)} * {fx})" if dx != x0 else f"({at(y0, x0)} * 1.0::DOUBLE)"
        low = (f"({at(y0 + 1, x0)} * (1 - {fx}) + {at(y0 + 1, x0 + 1)} * {fx})" if dx != x0 else f"({at(y0 + 1, x0)} * 1.0::DOUBLE)") if dy != y0 else "0.0::DOUBLE"
        tests.append(f"({top} * (1 - {fy}) + {low} * {fy} - v >= 0)::INT")
    # n: the 4 x 4 pixels from one above and left on, of which the point needs a part.
    return f"""WITH {FRAMES}, g AS (SELECT a.vec_id, a.region, a.y, a.x, a.v, list(coalesce(b.v, 0)::DOUBLE ORDER BY dy, dx) AS n
    FROM rg a CROSS JOIN range(-1, 3) s(dy) CROSS JOIN range(-1, 3) t(dx) LEFT JOIN px b ON b.vec_id = a.vec_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL),
    b AS (SELECT vec_id, region, [{", ".join(tests)}] AS b FROM g),
    c AS (SELECT vec_id, region, CASE WHEN list_sum([(b[i] <> b[i % 8 + 1])::INT FOR i IN range(1, 9)]) <= 2 THEN list_sum(b) ELSE 9 END::DOUBLE AS c FROM b),
    h AS (SELECT vec_id, region, c, count(*) AS k FROM c GROUP BY ALL), t AS (SELECT vec_id, region, sum(k) AS s FROM h GROUP BY ALL),
    e AS (SELECT vec_id, region, round(-sum(k / s * log2(k / s)) / log2(10) + 1e-7, 5) AS entropy_norm, round(sum(power(k / s, 2)), 12) AS uniformity, round((10 - count(*)) / 10.0::DOUBLE + 1e-7, 5) AS sparsity FROM h JOIN t USING (vec_id, region) GROUP BY ALL),
    m AS (SELECT vec_id, region, {_basic("c", "c")})
    SELECT vec_id, region, mean, std, median, p95, energy, kurtosis, entropy_norm, uniformity, sparsity FROM m JOIN e USING (vec_id, region)"""


SOBEL = f"""WITH {FRAMES}, {_neighbours(1)}, m AS (SELECT vec_id, region, y, x, sqrt(power(sum(v * dx * (2 - abs(dy))), 2) + power(sum(v * dy * (2 - abs(dx))), 2)) AS p FROM nb GROUP BY ALL),
z AS (SELECT vec_id, avg(p) AS a FROM m GROUP BY 1), co AS (SELECT vec_id, region, round(avg((p > a)::INT) + 1e-7, 5) AS coherence FROM m JOIN z USING (vec_id) GROUP BY ALL),
st AS (SELECT vec_id, region, {_basic("m", "p")}) SELECT st.*, coherence FROM st JOIN co USING (vec_id, region)"""

LAPLACIAN = f"""WITH {FRAMES}, {_neighbours(1)}, m AS (SELECT vec_id, region, y, x, abs(sum(v * CASE abs(dy) + abs(dx) WHEN 0 THEN -4 WHEN 1 THEN 1 ELSE 0 END)) AS p FROM nb GROUP BY ALL),
va AS (SELECT vec_id, region, round(var_pop(p) + 1e-7, 5) AS variance FROM m GROUP BY ALL), st AS (SELECT vec_id, region, {_basic("m", "p")}) SELECT st.*, variance FROM st JOIN va USING (vec_id, region)"""

# Weights of the bilateral mean: by level with a deviation of 75, by distance with one of 75, over a disc of radius 4.
NOISE = f"""WITH {FRAMES}, {_neighbours(4, "dy * dy + dx * dx <= 16")}, w AS (SELECT vec_id, region, y, x, own, v, exp(-0.5::DOUBLE * power(abs(v - own) / 75.0::DOUBLE, 2)) * exp(-0.5::DOUBLE * (dx * dx + dy * dy) / 5625.0::DOUBLE) AS k FROM nb),
m AS (SELECT vec_id, region, own - round_even(sum(k * v) / sum(k), 0) AS p FROM w GROUP BY vec_id, region, y, x, own), md AS (SELECT vec_id, region, median(p) AS md FROM m GROUP BY ALL)
SELECT vec_id, region, round(avg(p) + 1e-7, 5) AS mean, round(stddev_pop(p) + 1e-7, 5) AS std, round(var_pop(p) + 1e-7, 5) AS variance, round(sqrt(avg(p * p)) + 1e-7, 5) AS rms, round(median(abs(p - md)) + 1e-7, 5) AS mad, round(quantile_cont(abs(p), 0.95) + 1e-7, 5) AS p95_abs
FROM m JOIN md USING (vec_id, region) GROUP BY vec_id, region"""

# Lightness of a grey level on 255 steps.
LIGHT = f"""{FRAMES}, li AS (SELECT *, CASE WHEN v / 255.0::DOUBLE <= 0.04045 THEN v / 255.0::DOUBLE / 12.92 ELSE power((v / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS c FROM rg),
m AS (SELECT vec_id, x2, y2, region, y, x, v, round_even((CASE WHEN c > 0.008856 THEN 116 * cbrt(c) - 16 ELSE 903.3 * c END) * 255 / 100, 0)::INT AS p FROM li)"""
PHYSICS = f"""WITH {LIGHT}, q AS (SELECT vec_id, region, quantile_cont(p, 0.2) AS dark, quantile_cont(p, 0.8) AS bright FROM m GROUP BY ALL)
SELECT vec_id, region, round(avg(p) + 1e-7, 5) AS l_mean, round(stddev_pop(p) + 1e-7, 5) AS l_std, round(any_value(bright - dark) + 1e-7, 5) AS l_contrast, 0.0::DOUBLE AS sat_mean, round(avg(v) + 1e-7, 5) AS value_mean,
  round(avg((p < dark)::INT) + 1e-7, 5) AS shadow_ratio, round(avg((p > bright)::INT) + 1e-7, 5) AS highlight_ratio FROM m JOIN q USING (vec_id, region) GROUP BY ALL"""
_HALVES = {"l": "x < (7 + x2) // 2", "r": "x >= (7 + x2) // 2", "t": "y < (5 + y2) // 2", "b": "y >= (5 + y2) // 2"}
ASYMMETRY = f"""WITH {LIGHT}, f AS (SELECT vec_id, {", ".join(f"avg(p) FILTER ({w}) AS {k}" for k, w in _HALVES.items())} FROM m WHERE region = 'face' GROUP BY 1)
SELECT vec_id, round(l - r + 1e-7, 5) AS phys_face_lr_luma_diff, round(t - b + 1e-7, 5) AS phys_face_tb_luma_diff, round((SELECT stddev_pop(z) FROM unnest([l, r, t, b]) u(z)) + 1e-7, 5) AS phys_face_luma_quadrant_imbalance FROM f"""


def _crops(spark, d) -> DataFrame:
    """Area and sum of the face and of the strips around it that ``crops`` picks, 0 where there is none."""

    def run(batches):
        for batch in batches:
            keys = batch.column("vec_id").to_numpy()
            vectors = batch.column("embedding").flatten().to_numpy().reshape(len(keys), -1)
            rows = []
            for k, v in zip(keys, vectors):
                gray = np.tile(_frame(int(k), v).gray, (2, 2))
                found = kernels.crops(gray, _wide_face(int(k)))
                rows += [(int(k), r, 0 if c is None else c.size, 0 if c is None else int(c.astype(int).sum())) for r, c in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["vec_id", "region", "area", "total"])

    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(run, "vec_id long, region string, area long, total long")


def _wide_face(key: int) -> tuple[int, int, int, int]:
    return 14 + key % 9, 12 + key % 7, 50 - key % 6, 54 - key % 11


# Strips close to the face (a quarter of its sides) and further out (nine tenths), the first largest of each ring.
CROPS = f"""WITH {FRAMES}, k AS (SELECT DISTINCT vec_id, 14 + vec_id % 9 AS x1, 12 + vec_id % 7 AS y1, 50 - vec_id % 6 AS x2, 54 - vec_id % 11 AS y2 FROM fr),
w AS (SELECT *, greatest(0, x1 - trunc((x2 - x1) * 0.25::DOUBLE)::INT) AS ax1, greatest(0, y1 - trunc((y2 - y1) * 0.25::DOUBLE)::INT) AS ay1, least(64, x2 + trunc((x2 - x1) * 0.25::DOUBLE)::INT) AS ax2, least(64, y2 + trunc((y2 - y1) * 0.25::DOUBLE)::INT) AS ay2,
  greatest(0, x1 - trunc((x2 - x1) * 0.9::DOUBLE)::INT) AS bx1, greatest(0, y1 - trunc((y2 - y1) * 0.9::DOUBLE)::INT) AS by1, least(64, x2 + trunc((x2 - x1) * 0.9::DOUBLE)::INT) AS bx2, least(64, y2 + trunc((y2 - y1) * 0.9::DOUBLE)::INT) AS by2 FROM k),
s AS (SELECT vec_id, 'face' AS region, 0 AS i, y1 AS ya, y2 AS yb, x1 AS xa, x2 AS xb FROM w
  UNION ALL SELECT vec_id, 'border', 1, ay1, y1, ax1, ax2 FROM w UNION ALL SELECT vec_id, 'border', 2, y2, ay2, ax1, ax2 FROM w UNION ALL SELECT vec_id, 'border', 3, y1, y2, ax1, x1 FROM w UNION ALL SELECT vec_id, 'border', 4, y1, y2, x2, ax2 FROM w
  UNION ALL SELECT vec_id, 'background', 1, by1, ay1, bx1, bx2 FROM w UNION ALL SELECT vec_id, 'background', 2, ay2, by2, bx1, bx2 FROM w UNION ALL SELECT vec_id, 'background', 3, by1, by2, bx1, ax1 FROM w UNION ALL SELECT vec_id, 'background', 4, by1, by2, ax2, bx2 FROM w),
p AS (SELECT *, (yb - ya) * (xb - xa) AS area, row_number() OVER (PARTITION BY vec_id, region ORDER BY (yb - ya) * (xb - xa) DESC, i) AS n FROM s WHERE region = 'face' OR least(yb - ya, xb - xa) >= 8),
b AS (SELECT * FROM p WHERE n = 1),
q AS (SELECT b.vec_id, b.region, b.area, sum(px.v)::BIGINT AS total FROM b, (VALUES (0), (32)) a(oy), (VALUES (0), (32)) c(ox), px WHERE px.vec_id = b.vec_id AND px.y + oy >= ya AND px.y + oy < yb AND px.x + ox >= xa AND px.x + ox < xb GROUP BY ALL)
SELECT k.vec_id, r.region, coalesce(q.area, 0)::BIGINT AS area, coalesce(q.total, 0)::BIGINT AS total FROM k CROSS JOIN (VALUES ('face'), ('border'), ('background')) r(region) LEFT JOIN q ON q.vec_id = k.vec_id AND q.region = r.region"""

GRID = 224


def _label_frames(spark, d, emit, schema: str) -> DataFrame:
    """emit(key, grey frame, mask) for every label: a frame of 14 x 14 squares, of which the mask leaves out the first rows."""

    def run(batches):
        for batch in batches:
            for key in batch.column("label").to_pylist():
                y, x = np.mgrid[0:GRID, 0:GRID]
                yield emit(key, ((x * 7 + y * y + key * 13) % 251).astype(np.uint8), y >= key % 16)

    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").cast("int").alias("label")).distinct().mapInArrow(run, schema)


def _patch_cap(spark, d) -> DataFrame:
    def emit(key, gray, mask):
        p = kernels.patches(gray, mask)
        return pa.RecordBatch.from_arrays([pa.array([key] * len(p), pa.int32()), pa.array(range(len(p)), pa.int32()), pa.array(p[:, 0]), pa.array(p[:, 136])], ["label", "k", "first", "middle"])

    return _label_frames(spark, d, emit, "label int, k int, first double, middle double").select("label", "k", F.round(F.col("first") + SHIFT, 5).alias("first"), F.round(F.col("middle") + SHIFT, 5).alias("middle"))


def _patch_similarity(spark, d) -> DataFrame:
    names = ["sim_mean", "sim_std", "sim_median", "sim_p95", "patch_count"]

    def emit(key, gray, mask):
        y1 = key % 16
        frame = kernels.Frame(np.repeat(gray[..., None], 3, -1), (0, y1, GRID, GRID), (0, y1, GRID, GRID))
        r = kernels.patch(frame)
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), *(pa.array([r[f"patch_face_{n}"]], pa.float64()) for n in names)], ["label", *names])

    return _label_frames(spark, d, emit, "label int, " + ", ".join(f"{n} double" for n in names)).select("label", *(F.round(F.col(n) + SHIFT, 5).alias(n) for n in names))


PATCHES = f"""lb AS (SELECT DISTINCT label::INT AS label FROM embeddings), px AS (SELECT label, label % 16 AS y0, y, x, (x * 7 + y * y + label * 13) % 251 AS v FROM lb, range(0, {GRID}) a(y), range(0, {GRID}) b(x) WHERE y >= label % 16),
sq AS (SELECT label, (y - y0) // 16 AS i, x // 16 AS j, (y - y0) % 16 * 16 + x % 16 AS c, v FROM px WHERE x < {GRID - 16} AND (y - y0) // 16 * 16 < {GRID - 1} - y0 - 15),
nm AS (SELECT label, i, j, avg(v) AS a, stddev_pop(v) AS s FROM sq GROUP BY ALL), od AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY i, j) - 1)::INT AS k FROM nm),
st AS (SELECT label, k, c, (v - a) / (s + 1e-6) AS z FROM sq JOIN od USING (label, i, j) WHERE k < {kernels.MOST_PATCHES})"""
PATCH_CAP = f"WITH {PATCHES} SELECT label, k, round(max(z) FILTER (c = 0) + 1e-7, 5) AS first, round(max(z) FILTER (c = 136) + 1e-7, 5) AS middle FROM st GROUP BY label, k"
PATCH_SIMILARITY = f"""WITH {PATCHES}, v AS (SELECT label, k, list(z ORDER BY c) AS z FROM st GROUP BY ALL), u AS (SELECT label, k, z, sqrt(list_dot_product(z, z)) AS n FROM v),
s AS (SELECT a.label, list_dot_product(a.z, b.z) / (a.n * b.n) AS s FROM u a JOIN u b ON a.label = b.label AND a.k < b.k)
SELECT label, round(avg(s) + 1e-7, 5) AS sim_mean, round(stddev_pop(s) + 1e-7, 5) AS sim_std, round(median(s) + 1e-7, 5) AS sim_median, round(quantile_cont(s, 0.95) + 1e-7, 5) AS sim_p95, (SELECT count(*) FROM u WHERE u.label = s.label)::DOUBLE AS patch_count FROM s GROUP BY label"""

BASIC = list(kernels.BASIC)
_PHYSICS = ["l_mean", "l_std", "l_contrast", "sat_mean", "value_mean", "shadow_ratio", "highlight_ratio"]
_FACE = ["phys_face_lr_luma_diff", "phys_face_tb_luma_diff", "phys_face_luma_quadrant_imbalance"]

QUERIES = {
    "lbp_frames": (lambda s, d: _regions(s, d, "lbp", kernels.lbp, [*BASIC, "entropy_norm", "uniformity", "sparsity"]), _lbp_sql()),
    "sobel_frames": (lambda s, d: _regions(s, d, "sobel", kernels.sobel, [*BASIC, "coherence"]), SOBEL),
    "laplacian_frames": (lambda s, d: _regions(s, d, "lap", kernels.laplacian, [*BASIC, "variance"]), LAPLACIAN),
    "noise_frames": (lambda s, d: _regions(s, d, "noise", kernels.noise, ["mean", "std", "variance", "rms", "mad", "p95_abs"]), NOISE),
    "physics_frames": (lambda s, d: _regions(s, d, "phys", kernels.physics, _PHYSICS), PHYSICS),
    "asymmetry_frames": (lambda s, d: _numbers(s, d, _FACE, kernels.physics).select("vec_id", *(F.round(F.col(n) + SHIFT, 5).alias(n) for n in _FACE)), ASYMMETRY),
    "largest_patch": (_crops, CROPS),
    "patch_cap": (_patch_cap, PATCH_CAP),
    "patch_similarity": (_patch_similarity, PATCH_SIMILARITY),
}
