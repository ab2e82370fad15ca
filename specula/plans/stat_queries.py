"""Queries over lineitem (separation of two classes), embeddings (descriptors, 8 x 8 frames) and the video table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.functions import images
from specula.functions import scalars as S
from specula.operators import aggregate, kernels, stats
from specula.plans import frame_queries

NAMES = {"l_quantity": "face_bg_quantity_mean", "l_extendedprice": "lbp_background_price_mean", "l_discount": "x_border_discount_mean", "l_tax": "tax_patch_count_mean"}


def measures(spark, d) -> DataFrame:
    """lineitem as (metric, label, value): returned is Fake, accepted Real, other lines have no label."""
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    label = F.when(F.col("l_returnflag") == "R", "Fake").when(F.col("l_returnflag") == "A", "Real")
    wide = line.select(label.alias("label"), *(F.col(c).alias(n) for c, n in NAMES.items()))
    return wide.unpivot(["label"], list(NAMES.values()), "metric", "value")


_PARTS = " UNION ALL ".join(f"SELECT '{n}' AS metric, l_returnflag AS flag, {c} AS v FROM lineitem" for c, n in NAMES.items())
LONG = f"""lg AS (SELECT metric, CASE flag WHEN 'R' THEN 'Fake' WHEN 'A' THEN 'Real' END AS label, coalesce(flag = 'R', false) AS pos, v FROM ({_PARTS})),
ct AS (SELECT metric, v, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM lg GROUP BY 1, 2),
cm AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY metric ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ct),
au AS (SELECT metric, (sum(p * (below + n / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)::DOUBLE))::DOUBLE AS auc FROM cm GROUP BY 1),
se AS (SELECT metric, count(*) FILTER (pos) AS n_fake, count(*) FILTER (label = 'Real') AS n_real, avg(v) FILTER (label = 'Real') AS real_mean, avg(v) FILTER (pos) AS fake_mean,
       (avg(v) FILTER (pos) - avg(v) FILTER (NOT pos)) / sqrt((var_samp(v) FILTER (pos) + var_samp(v) FILTER (NOT pos)) / 2) AS d FROM lg GROUP BY 1)"""
_SCOPE = """CASE WHEN contains(metric, 'face_bg_') THEN 'face_background_diff' WHEN contains(metric, 'border_bg_') THEN 'border_background_diff' WHEN contains(metric, 'face_border_') THEN 'face_border_diff'
  WHEN contains(metric, '_background_') THEN 'background_direct' WHEN contains(metric, '_border_') THEN 'border_direct' WHEN contains(metric, '_face_') THEN 'face_direct' ELSE 'other' END"""
_SENSITIVE = f"({_SCOPE} IN ('background_direct', 'face_background_diff', 'border_background_diff') OR metric LIKE '%patch\\_count\\_mean' ESCAPE '\\')"
REPORT = f"""WITH {LONG} SELECT metric, {_SCOPE} AS scope, {_SENSITIVE} AS context_sensitive, CASE WHEN auc >= 0.5 THEN 'higher_fake' ELSE 'higher_real' END AS direction, round(auc, 8) AS auc_fake,
  round(greatest(auc, 1 - auc), 8) AS auc_abs, round(d, 8) AS cohen_d_fake_minus_real, n_fake, n_real, 0.0::DOUBLE AS missing_rate, round(real_mean, 8) AS real_mean, round(fake_mean, 8) AS fake_mean FROM au JOIN se USING (metric)"""


def _report(spark, d):
    r = stats.report(measures(spark, d))
    numbers = ("auc_fake", "auc_abs", "cohen_d_fake_minus_real", "missing_rate", "real_mean", "fake_mean")
    return r.select("metric", "scope", "context_sensitive", "direction", "n_fake", "n_real", *(F.round(c, 8).alias(c) for c in numbers))


def video_measures(spark, d) -> DataFrame:
    """(metric, label, value, video_id): region means of a video; videos of a higher mean are Fake."""
    f = frame_queries.frames(spark, d)
    labels = f.groupBy("video_id").agg(F.when(F.max("value") >= 200, "Fake").otherwise("Real").alias("label"))
    means = f.groupBy("video_id", F.concat("region", F.lit("_mean")).alias("metric")).agg(F.avg("value").alias("value"))
    return means.join(labels, "video_id")


def _report_ci(spark, d):
    """The report with its interval; the interval, which SQL can't tell, must hold the resampled value's own bounds."""
    r = stats.report(video_measures(spark, d), "video_id")
    known = (F.col("auc_abs_ci_low") >= 0.5) & (F.col("auc_abs_ci_low") <= F.col("auc_abs_ci_high")) & (F.col("auc_abs_ci_high") <= 1) & (F.col("auc_abs_bootstrap_std") >= 0)
    return r.select("metric", "direction", F.round("auc_fake", 8).alias("auc_fake"), F.round("cohen_d_fake_minus_real", 8).alias("cohen_d"), "n_fake", "n_real", F.round("missing_rate", 8).alias("missing_rate"), known.alias("interval_holds"))


REPORT_CI = f"""WITH {frame_queries.FRAMES}, lb AS (SELECT video_id, CASE WHEN max(value) >= 200 THEN 'Fake' ELSE 'Real' END AS label FROM fr GROUP BY 1),
lg AS (SELECT fr.video_id, region || '_mean' AS metric, any_value(label) AS label, avg(value) AS v FROM fr JOIN lb USING (video_id) GROUP BY 1, 2),
au AS (SELECT p.metric, avg(CASE WHEN p.v > n.v THEN 1.0::DOUBLE WHEN p.v = n.v THEN 0.5 ELSE 0 END) AS auc FROM lg p JOIN lg n ON p.metric = n.metric AND p.label = 'Fake' AND n.label = 'Real' GROUP BY 1),
se AS (SELECT metric, count(*) FILTER (label = 'Fake') AS n_fake, count(*) FILTER (label = 'Real') AS n_real, (avg(v) FILTER (label = 'Fake') - avg(v) FILTER (label = 'Real')) / sqrt((var_samp(v) FILTER (label = 'Fake') + var_samp(v) FILTER (label = 'Real')) / 2) AS d FROM lg GROUP BY 1)
SELECT metric, CASE WHEN auc >= 0.5 THEN 'higher_fake' ELSE 'higher_real' END AS direction, round(auc, 8) AS auc_fake, round(d, 8) AS cohen_d, n_fake, n_real, 0.0::DOUBLE AS missing_rate, true AS interval_holds FROM au JOIN se USING (metric)"""


def _bootstrap(spark, d):
    return stats.bootstrap(video_measures(spark, d), "video_id")


def _embeddings(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _within(spark, d):
    return aggregate.cosine_within(_embeddings(spark, d), "label", "embedding").select("label", "n", F.round("sim_mean", 6).alias("sim_mean"), F.round("sim_std", 6).alias("sim_std"))


def _between(spark, d):
    return aggregate.mean_cosine_between(_embeddings(spark, d), "label", "embedding").select("left", "right", F.round("distance", 6).alias("distance"))


def squares(spark, d, kernel: str) -> DataFrame:
    """Numbers of each embedding read as an 8 x 8 frame of levels."""
    kinds = {"sobel": ("mean", "energy", "most"), "laplacian": ("mean", "energy", "most"), "fft": ("mean_power", "std_power", "low_freq_ratio", "mid_freq_ratio", "high_freq_ratio", "radial_centroid", "entropy_norm", "flatness", "anisotropy", "mean_intensity", "std_intensity")}
    names = kinds[kernel]

    def run(batches):
        for batch in batches:
            v = batch.column("embedding").flatten().to_numpy().astype(float).reshape(-1, 8, 8)
            if kernel == "fft":
                rows = [[kernels.spectrum(a)[k] for k in names] for a in v]
            else:
                power = [np.hypot(*images.sobel(a)) if kernel == "sobel" else np.abs(images.laplacian(a)) for a in v]
                rows = [[p.mean(), (p * p).mean(), p.max()] for p in power]
            columns = np.array(rows, float).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *(pa.array(c) for c in columns)], ["vec_id", *names])

    schema = "vec_id long, " + ", ".join(f"{n} double" for n in names)
    return _embeddings(spark, d).select("vec_id", "embedding").mapInArrow(run, schema).select("vec_id", *((F.round(n, 5) + F.lit(0.0)).alias(n) for n in names))


_PX = """px AS (SELECT vec_id, (i // 8)::INT AS y, (i % 8)::INT AS x, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(0, 64) t(i)),
nb AS (SELECT a.vec_id, a.y, a.x, dy, dx, b.v FROM px a, (VALUES (-1), (0), (1)) s(dy), (VALUES (-1), (0), (1)) t(dx), px b
       WHERE b.vec_id = a.vec_id AND b.y = 7 - abs(7 - abs(a.y + dy)) AND b.x = 7 - abs(7 - abs(a.x + dx)))"""
_STATS = "SELECT vec_id, round(avg(p), 5) AS mean, round(avg(p * p), 5) AS energy, round(max(p), 5) AS most FROM m GROUP BY 1"
SOBEL = f"WITH {_PX}, m AS (SELECT vec_id, y, x, sqrt(power(sum(v * dx * (2 - abs(dy))), 2) + power(sum(v * dy * (2 - abs(dx))), 2)) AS p FROM nb GROUP BY 1, 2, 3) {_STATS}"
LAPLACIAN = f"WITH {_PX}, m AS (SELECT vec_id, y, x, abs(sum(v * CASE abs(dy) + abs(dx) WHEN 0 THEN -4 WHEN 1 THEN 1 ELSE 0 END)) AS p FROM nb GROUP BY 1, 2, 3) {_STATS}"
FFT = f"""WITH {_PX.split("nb AS")[0].rstrip().rstrip(",")}, av AS (SELECT vec_id, avg(v) AS a FROM px GROUP BY 1), k AS (SELECT px.vec_id, y, x, v - a AS v FROM px JOIN av USING (vec_id)),
rw AS (SELECT vec_id, y, u, sum(v * cos(2 * pi() * x * u / 8)) AS re, -sum(v * sin(2 * pi() * x * u / 8)) AS im FROM k, range(0, 8) t(u) GROUP BY 1, 2, 3),
ft AS (SELECT vec_id, u, w, sum(re * cos(2 * pi() * y * w / 8) + im * sin(2 * pi() * y * w / 8)) AS re, sum(im * cos(2 * pi() * y * w / 8) - re * sin(2 * pi() * y * w / 8)) AS im FROM rw, range(0, 8) t(w) GROUP BY 1, 2, 3),
pw AS (SELECT vec_id, (w + 4) % 8 - 4 AS dy, (u + 4) % 8 - 4 AS dx, ln(1 + sqrt(re * re + im * im)) AS p FROM ft),
rr AS (SELECT *, sqrt(dy * dy + dx * dx) / (sqrt(32) + 1e-6) AS r FROM pw),
bn AS (SELECT vec_id, least(floor((p - lo) / (hi - lo) * 32)::INT, 31) AS i FROM rr JOIN (SELECT vec_id, min(p) AS lo, max(p) AS hi FROM pw GROUP BY 1) USING (vec_id)),
en AS (SELECT vec_id, -sum(k / 64.0 * log2(k / 64.0)) / 5 AS e FROM (SELECT vec_id, i, count(*) AS k FROM bn GROUP BY 1, 2) GROUP BY 1),
sm AS (SELECT vec_id, avg(p) AS mean_power, stddev_pop(p) AS std_power, sum(p) + 1e-6 AS t, coalesce(sum(p) FILTER (r < 0.2), 0) AS low, coalesce(sum(p) FILTER (r >= 0.2 AND r < 0.55), 0) AS mid, coalesce(sum(p) FILTER (r >= 0.55), 0) AS high,
  sum(r * p) AS rp, avg(ln(p + 1e-6)) AS lg, coalesce(sum(p) FILTER (dy = 0), 0) AS across, coalesce(sum(p) FILTER (dx = 0), 0) AS down FROM rr GROUP BY 1)
SELECT sm.vec_id, round(mean_power, 5) AS mean_power, round(std_power, 5) AS std_power, round(low / t, 5) AS low_freq_ratio, round(mid / t, 5) AS mid_freq_ratio, round(high / t, 5) AS high_freq_ratio, round(rp / t, 5) AS radial_centroid, round(e, 5) AS entropy_norm,
  round(exp(lg) / (mean_power + 1e-6), 5) AS flatness, round(abs(across - down) / (across + down + 1e-6), 5) AS anisotropy, 0.0::DOUBLE AS mean_intensity, round((SELECT stddev_pop(v) FROM k WHERE k.vec_id = sm.vec_id), 5) AS std_intensity FROM sm JOIN en ON en.vec_id = sm.vec_id"""

_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings)"

QUERIES = {
    "auc_rank": (lambda s, d: stats.auc(measures(s, d)).select("metric", F.round("auc", 8).alias("auc")), f"WITH {LONG} SELECT metric, round(auc, 8) AS auc FROM au"),
    "cohen_d": (lambda s, d: stats.separation(measures(s, d)).select("metric", F.round("cohen_d", 8).alias("cohen_d")), f"WITH {LONG} SELECT metric, round(d, 8) AS cohen_d FROM se"),
    "metric_scope": (
        lambda s, d: measures(s, d).groupBy("metric").count().select("metric", S.metric_scope("metric").alias("scope"), S.context_sensitive("metric").alias("context_sensitive"), F.col("count").alias("n")),
        f"WITH {LONG} SELECT metric, {_SCOPE} AS scope, {_SENSITIVE} AS context_sensitive, count(*) AS n FROM lg GROUP BY metric",
    ),
    "metric_report": (_report, REPORT),
    "report_topk": (lambda s, d: stats.top(stats.report(measures(s, d)), 2).select("metric", F.round("auc_abs", 8).alias("auc_abs")), f"SELECT metric, auc_abs FROM ({REPORT}) ORDER BY auc_abs DESC, abs(cohen_d_fake_minus_real) DESC LIMIT 2"),
    "auc_bootstrap": (_bootstrap, None),
    "metric_report_ci": (_report_ci, REPORT_CI),
    "cdist_cosine": (_between, f"WITH {_UNIT} SELECT a.label AS left, b.label AS right, round(avg(1 - list_dot_product(a.e, b.e)), 6) AS distance FROM u a JOIN u b ON a.label < b.label GROUP BY 1, 2"),
    "pdist_cosine": (_within, f"WITH {_UNIT}, n AS (SELECT label, count(*) AS n FROM u GROUP BY 1), p AS (SELECT a.label, list_dot_product(a.e, b.e) AS s FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT label, any_value(n.n) AS n, round(avg(s), 6) AS sim_mean, round(stddev_pop(s), 6) AS sim_std FROM p JOIN n USING (label) GROUP BY 1"),
    "sobel_8x8": (lambda s, d: squares(s, d, "sobel"), SOBEL),
    "laplacian_8x8": (lambda s, d: squares(s, d, "laplacian"), LAPLACIAN),
    "fft_8x8": (lambda s, d: squares(s, d, "fft"), FFT),
}
