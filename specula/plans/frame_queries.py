"""Queries over events as frames: a user is a video, an event a frame, its type the region and its value the metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specula.functions import scalars as S
from specula.operators import aggregate, boxes, gold, quality

METRICS = ("face", "border", "background")
REGION = {"view": "face", "click": "border", "purchase": "background"}


def frames(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v, none = F.col("value"), F.col("event_type") == "error"
    region = F.create_map(*[F.lit(x) for kv in REGION.items() for x in kv])
    return e.select(
        F.col("user_id").alias("video_id"),
        (F.row_number().over(w) - 1).cast("int").alias("frame_id"),
        "event_id",
        F.col("event_type"),
        F.coalesce(F.try_element_at(region, F.col("event_type")), F.lit("other")).alias("region"),
        v.alias("value"),
        (F.lit(160) + F.col("user_id") % 500).cast("int").alias("frame_width"),
        (F.lit(120) + F.col("user_id") * 7 % 400).cast("int").alias("frame_height"),
        F.when(~none, F.struct((v - 20).alias("x1"), (v / 2).alias("y1"), (v + 60).alias("x2"), (v * 1.5 + 10).alias("y2"))).alias("bbox"),
        F.when(~none, F.round(v / 500, 3)).alias("detector_score"),
    )


FRAMES = """fr AS (
  SELECT user_id AS video_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame_id, event_id, event_type,
         CASE event_type WHEN 'view' THEN 'face' WHEN 'click' THEN 'border' WHEN 'purchase' THEN 'background' ELSE 'other' END AS region, value,
         (160 + user_id % 500)::INT AS w, (120 + user_id * 7 % 400)::INT AS h, event_type = 'error' AS none,
         value - 20 AS bx1, value / 2 AS by1, value + 60 AS bx2, value * 1.5 + 10 AS by2, CASE WHEN event_type <> 'error' THEN round(value / 500, 3) END AS score
  FROM events
), cl AS (
  SELECT *, greatest(0, least(round_even(bx1, 0)::INT, w - 1)) AS x1, greatest(0, least(round_even(by1, 0)::INT, h - 1)) AS y1,
         greatest(0, least(round_even(bx2, 0)::INT, w)) AS x2, greatest(0, least(round_even(by2, 0)::INT, h)) AS y2 FROM fr
), own AS (
  SELECT *, CASE WHEN NOT none AND x2 - x1 >= 2 AND y2 - y1 >= 2 THEN {'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} END AS b,
         {'x1': greatest(0, w // 2 - greatest(2, least(w, h) // 4)), 'y1': greatest(0, h // 2 - greatest(2, least(w, h) // 4)),
          'x2': least(w, w // 2 + greatest(2, least(w, h) // 4)), 'y2': least(h, h // 2 + greatest(2, least(w, h) // 4))} AS fb FROM cl
), filled AS (
  SELECT *, last_value(b IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lb FROM own
), src AS (
  SELECT *, coalesce(lb, fb) AS f, CASE WHEN b IS NOT NULL THEN 'detector' WHEN lb IS NOT NULL THEN 'last_bbox' ELSE 'fallback_center' END AS source FROM filled
), exp AS (
  SELECT *, greatest(0, f.x1 - trunc((f.x2 - f.x1) * 0.2::DOUBLE)::INT) AS ex1, greatest(0, f.y1 - trunc((f.y2 - f.y1) * 0.2::DOUBLE)::INT) AS ey1,
         least(w, f.x2 + trunc((f.x2 - f.x1) * 0.2::DOUBLE)::INT) AS ex2, least(h, f.y2 + trunc((f.y2 - f.y1) * 0.2::DOUBLE)::INT) AS ey2 FROM src
), cnt AS (SELECT video_id, count(*)::INT AS n FROM fr GROUP BY 1)"""

#: The i-th of m positions among n, as an expression of n, m and i.
POSITION = "CASE WHEN {m} = 1 THEN 0 WHEN i = {m} - 1 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / ({m} - 1)))::INT END"


def _r(c: str, name: str | None = None, digits: int = 8):
    return F.round(F.col(c), digits).alias(name or c)


def _long(spark, d, metric: str = "region"):
    return frames(spark, d).select("video_id", "frame_id", F.col(metric).alias("metric"), "value")


def _box(c: str, prefix: str = ""):
    return [F.col(f"{c}.{k}").alias(f"{prefix}{k}") for k in S.BOX]


def _metadata(spark, d):
    return boxes.flatten(boxes.fill(frames(spark, d)).withColumn("processed_at", F.lit("t")), "1")


def _per_user(spark, d):
    """Metadata rows of a video: its purchases, numbered."""
    f = frames(spark, d).filter("event_type = 'purchase'")
    return f.select("video_id", (F.row_number().over(Window.partitionBy("video_id").orderBy("frame_id")) - 1).cast("int").alias("metadata_idx"), F.col("frame_id").alias("place"), "frame_id")


def _nearest(spark, d):
    f = frames(spark, d).select("video_id", "frame_id", F.count(F.lit(1)).over(Window.partitionBy("video_id")).cast("int").alias("frame_count"))
    return boxes.match_metadata(f, _per_user(spark, d)).select("video_id", "frame_id", "metadata_idx", "place")


def _detections(spark, d):
    one = F.struct(F.col("value").alias("score"), F.col("frame_id"))
    return frames(spark, d).groupBy("video_id").agg(F.array_sort(F.collect_list(one), lambda a, b: a["frame_id"] - b["frame_id"]).alias("found"))


def _diffs(spark, d):
    f = frames(spark, d).filter("region <> 'other'")
    means = f.groupBy("video_id", "region").agg(F.avg("value").alias("mean"), F.max("value").alias("most"))
    return aggregate.region_diffs(means.unpivot(["video_id", "region"], ["mean", "most"], "metric", "value"), ["video_id"]).select("video_id", "metric", _r("value"))


def _wide(spark, d, *more):
    """Frame features: a metric per region, null where the frame has another; errors can't tell theirs."""
    f = frames(spark, d)
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    cols = {f"sobel_{r}_mean": F.when((F.col("region") == r) | (F.col("event_type") == "error"), value) for r in METRICS}
    return f.select("video_id", "frame_id", (F.col("frame_id") % 9).cast("int").alias("metadata_idx"), *more, *(c.alias(k) for k, c in cols.items()))


WIDE = f"WITH {FRAMES}, lg AS (SELECT video_id, 'sobel_' || r || '_mean' AS metric, CASE WHEN event_type <> 'error' THEN value END AS v FROM fr, (VALUES ('face'), ('border'), ('background')) t(r) WHERE region = r OR event_type = 'error'), st AS (SELECT video_id, metric, avg(v) AS mean, stddev_samp(v) AS std, median(v) AS median FROM lg GROUP BY 1, 2)"


def _features(spark, d):
    cols = [f"sobel_{r}_mean" for r in METRICS]
    return aggregate.video_features(_wide(spark, d), cols, "a", "t", "1")


def _governance(spark, d):
    return aggregate.governance(_wide(spark, d), "a", "t", "1").select("video_id", "n_frames", "metadata_rows_used", "feature_groups_used")


def _features_query(spark, d):
    f = _features(spark, d)
    return f.select("video_id", "n_frames", _r("missing_feature_ratio"), *(F.round(S.finite(c), 8).alias(c) for c in f.columns if c.startswith("sobel_")))


def _hist(spark, d):
    f = frames(spark, d)
    return aggregate.histogram(f, ["region"], S.histogram_bin("value", F.lit(0.0), F.lit(250.0), 32), 32)


HIST = f"""WITH {FRAMES}, b AS (SELECT region, least(floor(value / 250 * 32)::INT, 31) AS i FROM fr WHERE value BETWEEN 0 AND 250),
c AS (SELECT region, i, count(*) AS k FROM b GROUP BY 1, 2), t AS (SELECT region, sum(k) AS s FROM c GROUP BY 1)"""


def _hist_cosine(spark, d):
    h = _hist(spark, d)
    pairs = h.alias("a").join(h.alias("b"), F.col("a.region") < F.col("b.region"))
    return pairs.select(F.col("a.region").alias("l"), F.col("b.region").alias("r"), F.round(S.cosine_distance("a.hist", "b.hist"), 8).alias("distance"))


def _silver(spark, d):
    q = quality.silver_metadata(_metadata(spark, d))
    return q.select("videos_processed", "frames_processados", "coverage_ratio", *(_r(f"percentual_{s}") for s in ("detector", "last_bbox", "fallback_center")))


def _silver_features(spark, d):
    q = quality.silver_features(_wide(spark, d), _features(spark, d))
    return q.select("frame_rows", "videos_with_frame_features", "videos_processed", _r("avg_missing_feature_ratio"))


def flagship(spark, d) -> DataFrame:
    """Frame metrics to video features to the gold table with its splits, best-covered videos first.

    Means are added up in the order of the frames: of a video whose mean is 50 but for the last bits, they decide its label.
    """
    cols = [f"sobel_{r}_mean" for r in METRICS]
    means = aggregate.means_in_order(_wide(spark, d, "value"), {"value": F.col("value")} | {c: S.finite(c) for c in cols}, ["frame_id"])
    label = F.when(F.col("value") >= 50, "Fake").otherwise("Real").alias("label")
    own = means.select("video_id", label, *(F.col(c).alias(f"{c}_mean") for c in cols))
    out = gold.gold(_features(spark, d).drop(*(f"{c}_mean" for c in cols)).join(own, "video_id"))
    return out.select("video_id", "label", "n_frames", "metadata_rows_used", _r("missing_feature_ratio"), "quality_flag", "is_trainable", "dataset_split", *(F.round(S.finite(f"sobel_{r}_mean_mean"), 8).alias(r) for r in METRICS)).orderBy(
        F.col("missing_feature_ratio"), "video_id"
    )


FLAGSHIP = (
    WIDE
    + """, g AS (SELECT video_id, count(*)::INT AS n_frames, count(DISTINCT frame_id % 9)::INT AS metadata_rows_used, CASE WHEN avg(value) >= 50 THEN 'Fake' ELSE 'Real' END AS label FROM fr GROUP BY 1),
m AS (SELECT video_id, (sum((mean IS NULL)::INT + (std IS NULL)::INT + (median IS NULL)::INT)::DOUBLE / (3 * count(*) + 2)) AS ratio,
      max(mean) FILTER (metric = 'sobel_face_mean') AS face, max(mean) FILTER (metric = 'sobel_border_mean') AS border, max(mean) FILTER (metric = 'sobel_background_mean') AS background FROM st GROUP BY 1),
j AS (SELECT video_id, label, n_frames, metadata_rows_used, coalesce(ratio, 0) AS ratio, face, border, background, ('0x' || substr(sha256('42:' || label || ':' || video_id), 1, 12))::BIGINT / 281474976710655.0::DOUBLE AS x FROM g LEFT JOIN m USING (video_id))
SELECT video_id, label, n_frames, metadata_rows_used, round(ratio, 8) AS missing_feature_ratio, CASE WHEN ratio > 0.5 THEN 'review' ELSE 'ok' END AS quality_flag, ratio <= 0.5 AS is_trainable,
  CASE WHEN ratio > 0.5 THEN 'unassigned' WHEN x < 0.7::DOUBLE THEN 'train' WHEN x < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS dataset_split,
  round(face, 8) AS face, round(border, 8) AS border, round(background, 8) AS background FROM j"""
)

ANGLE = "value / 100"

QUERIES = {
    "flagship": (flagship, FLAGSHIP),
    "frame_sample": (
        lambda s, d: boxes.sampled(frames(s, d).select("video_id", "frame_id"), 40),
        f"""WITH {FRAMES}, p AS (SELECT video_id, n, unnest(range(0, least(n, 40))) AS i FROM cnt)
            SELECT DISTINCT video_id, CASE WHEN n <= 40 THEN i::INT ELSE {POSITION.format(m=40)} END AS frame_id, n AS frame_count FROM p""",
    ),
    "nearest_metadata": (
        _nearest,
        f"""WITH {FRAMES}, md AS (SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1)::INT AS k, frame_id AS place FROM fr WHERE event_type = 'purchase'),
            c AS (SELECT video_id, count(*)::INT AS m FROM md GROUP BY 1), p AS (SELECT video_id, n, m, unnest(range(0, m))::INT AS i FROM c JOIN cnt USING (video_id)),
            q AS (SELECT video_id, n, m, i, {POSITION.format(m="m")} AS pos FROM p),
            x AS (SELECT f.video_id, f.frame_id, any_value(n) AS n, any_value(m) AS m, arg_min(i, abs(pos - f.frame_id) * 1000000 + i) AS i FROM fr f JOIN q USING (video_id) GROUP BY 1, 2)
            SELECT x.video_id, x.frame_id, k AS metadata_idx, place FROM x JOIN md ON md.video_id = x.video_id AND md.k = CASE WHEN m >= n - 3 THEN least(x.frame_id, m - 1) ELSE x.i END""",
    ),
    "detect_schedule": (
        lambda s, d: boxes.schedule(frames(s, d).withColumn("found", F.col("event_type") == "purchase"), 5, has_tracker=True).select("video_id", "frame_id", "use_detection"),
        f"""WITH {FRAMES} SELECT video_id, frame_id, frame_id % 5 = 0 OR NOT coalesce(bool_or(event_type = 'purchase') OVER (PARTITION BY video_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS use_detection FROM fr""",
    ),
    "bbox_ffill": (
        lambda s, d: boxes.fill(frames(s, d)).select("video_id", "frame_id", "source", *_box("bbox"), *_box("bbox_expanded", "e"), "detector_score"),
        f"WITH {FRAMES} SELECT video_id, frame_id, source, f.x1, f.y1, f.x2, f.y2, ex1, ey1, ex2, ey2, score AS detector_score FROM exp",
    ),
    "fallback_bbox": (
        lambda s, d: frames(s, d).select("event_id", S.fallback_bbox("frame_width", "frame_height").alias("b")).select("event_id", *_box("b")),
        f"WITH {FRAMES} SELECT event_id, fb.x1, fb.y1, fb.x2, fb.y2 FROM own",
    ),
    "bbox_clip": (
        lambda s, d: frames(s, d).select("event_id", S.clip_bbox("bbox", "frame_width", "frame_height").alias("b")).select("event_id", *_box("b")),
        f"WITH {FRAMES} SELECT event_id, b.x1, b.y1, b.x2, b.y2 FROM own",
    ),
    "bbox_scale": (
        lambda s, d: frames(s, d).select("event_id", S.scale_bbox("bbox", F.when(F.col("region") != "border", F.lit(0.6)).otherwise(0.0)).alias("b")).select("event_id", *_box("b")),
        f"WITH {FRAMES} SELECT event_id, "
        + ", ".join(f"CASE WHEN NOT none AND region <> 'border' THEN trunc(b{k} / 0.6::DOUBLE)::INT END AS {k}" for k in S.BOX)
        + " FROM fr",
    ),
    "frame_scale": (
        lambda s, d: frames(s, d).select("event_id", S.frame_scale(F.col("frame_width") * 3, F.col("frame_height") * 2).alias("f")).select("event_id", _r("f.scale", "scale"), "f.width", "f.height"),
        f"""WITH {FRAMES}, z AS (SELECT *, least(640.0::DOUBLE / greatest(h * 2, w * 3), 1.0::DOUBLE) AS s FROM fr)
            SELECT event_id, round(s, 8) AS scale, trunc(w * 3 * s)::INT AS width, trunc(h * 2 * s)::INT AS height FROM z""",
    ),
    "face_regions": (
        lambda s, d: frames(s, d).withColumn("r", S.face_regions("bbox", "frame_width", "frame_height")).select("event_id", *_box("r.expanded", "e"), F.when(F.col("r").isNotNull(), S.region_of("r", F.col("frame_width") / 2, F.col("frame_height") / 2)).alias("centre")),
        f"""WITH {FRAMES}, z AS (SELECT * FROM exp WHERE b IS NOT NULL)
            SELECT o.event_id, ex1, ey1, ex2, ey2, CASE WHEN z.event_id IS NULL THEN NULL WHEN z.w / 2 >= f.x1 AND z.w / 2 < f.x2 AND z.h / 2 >= f.y1 AND z.h / 2 < f.y2 THEN 'face'
              WHEN z.w / 2 >= ex1 AND z.w / 2 < ex2 AND z.h / 2 >= ey1 AND z.h / 2 < ey2 THEN 'border' ELSE 'background' END AS centre FROM own o LEFT JOIN z ON o.event_id = z.event_id""",
    ),
    "metadata_flatten": (
        _metadata,
        f"""WITH {FRAMES} SELECT video_id::VARCHAR AS video_id, frame_id, f.x1 AS bbox_x1, f.y1 AS bbox_y1, f.x2 AS bbox_x2, f.y2 AS bbox_y2, ex1 AS bbox_expanded_x1, ey1 AS bbox_expanded_y1, ex2 AS bbox_expanded_x2,
            ey2 AS bbox_expanded_y2, source, score AS detector_score, w AS frame_width, h AS frame_height, 't' AS processed_at, '1' AS pipeline_version FROM exp""",
    ),
    "best_detection": (
        lambda s, d: _detections(s, d).select("video_id", boxes.best_detection(F.col("found")).alias("b")).select("video_id", "b.score", "b.frame_id"),
        f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY value DESC, frame_id) AS k FROM fr) SELECT video_id, value AS score, frame_id FROM r WHERE k = 1",
    ),
    "region_diff": (
        _diffs,
        f"""WITH {FRAMES}, a AS (SELECT video_id, region, avg(value) AS mean, max(value) AS most FROM fr GROUP BY 1, 2), u AS (SELECT video_id, region, 'mean' AS metric, mean AS v FROM a UNION ALL SELECT video_id, region, 'most', most FROM a)
            SELECT l.video_id, p || '_' || l.metric || '_diff' AS metric, round(l.v - r.v, 8) AS value FROM (VALUES ('face_bg', 'face', 'background'), ('face_border', 'face', 'border'), ('border_bg', 'border', 'background')) t(p, a, b)
            JOIN u l ON l.region = a JOIN u r ON r.region = b AND l.video_id = r.video_id AND l.metric = r.metric""",
    ),
    "metric_projection": (
        lambda s, d: aggregate.project(frames(s, d).select("event_id", F.concat(F.lit("x_"), "event_type", F.lit("_mean")).alias("metric")).unionByName(frames(s, d).select("event_id", F.concat("event_type", F.lit("_std")).alias("metric"))), ("view", "click")),
        f"WITH {FRAMES} SELECT event_id, 'x_' || event_type || '_mean' AS metric FROM fr WHERE event_type IN ('view', 'click') UNION ALL SELECT event_id, event_type || '_std' FROM fr WHERE event_type IN ('view', 'click')",
    ),
    "video_agg": (
        lambda s, d: aggregate.video_stats(_long(s, d)).select("video_id", "metric", "n", *(F.round(S.finite(x), 8).alias(x) for x in aggregate.STATS)),
        f"WITH {FRAMES} SELECT video_id, region AS metric, count(*) AS n, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS std, round(median(value), 8) AS median FROM fr GROUP BY 1, 2",
    ),
    "video_features": (
        _features_query,
        WIDE + """, g AS (SELECT video_id, count(*)::INT AS n_frames FROM fr GROUP BY 1), m AS (SELECT video_id, sum((mean IS NULL)::INT + (std IS NULL)::INT + (median IS NULL)::INT)::DOUBLE / (3 * count(*) + 2) AS ratio, """
        + ", ".join(f"round(max({x}) FILTER (metric = 'sobel_{r}_mean'), 8) AS sobel_{r}_mean_{x}" for r in METRICS for x in aggregate.STATS)
        + " FROM st GROUP BY 1) SELECT video_id, n_frames, round(coalesce(ratio, 0), 8) AS missing_feature_ratio, m.* EXCLUDE (video_id, ratio) FROM g LEFT JOIN m USING (video_id)",
    ),
    "video_governance": (_governance, f"WITH {FRAMES} SELECT video_id, count(*)::INT AS n_frames, count(DISTINCT frame_id % 9)::INT AS metadata_rows_used, 'a' AS feature_groups_used FROM fr GROUP BY 1"),
    "missing_ratio": (
        lambda s, d: aggregate.missing_ratio(aggregate.video_stats(aggregate.to_long(_wide(s, d), [f"sobel_{r}_mean" for r in METRICS], ["video_id"]))).select("video_id", _r("missing_feature_ratio")),
        WIDE + " SELECT video_id, round(sum((mean IS NULL)::INT + (std IS NULL)::INT + (median IS NULL)::INT)::DOUBLE / (3 * count(*) + 2), 8) AS missing_feature_ratio FROM st GROUP BY 1",
    ),
    "basic_stats": (
        lambda s, d: aggregate.basic_stats(frames(s, d), ["region"], "value").select("region", *(_r(x) for x in ("mean", "std", "median", "p95", "energy", "kurtosis"))),
        f"""WITH {FRAMES} SELECT region, round(avg(value), 8) AS mean, round(stddev_pop(value), 8) AS std, round(median(value), 8) AS median, round(quantile_cont(value, 0.95), 8) AS p95,
            round(avg(value * value), 8) AS energy, round(kurtosis_pop(value), 8) AS kurtosis FROM fr GROUP BY 1""",
    ),
    "histogram": (
        lambda s, d: _hist(s, d).select("region", F.posexplode("hist").alias("bin", "k")),
        HIST + " SELECT t.region, g.i::INT AS bin, coalesce(k, 0) AS k FROM t CROSS JOIN range(0, 32) g(i) LEFT JOIN c ON c.region = t.region AND c.i = g.i",
    ),
    "hist_entropy": (
        lambda s, d: _hist(s, d).select("region", F.round(aggregate.entropy(F.col("hist")), 8).alias("entropy"), F.round(aggregate.entropy(F.col("hist")) / 5, 8).alias("entropy_norm")),
        HIST + ", e AS (SELECT region, -sum(k / s * log2(k / s)) AS x FROM c JOIN t USING (region) GROUP BY 1) SELECT region, round(x, 8) AS entropy, round(x / 5, 8) AS entropy_norm FROM e",
    ),
    "hist_cosine": (
        _hist_cosine,
        HIST + """, n AS (SELECT region, sqrt(sum(k * k)) AS z FROM c GROUP BY 1) SELECT a.region AS l, b.region AS r, round(1 - coalesce((SELECT sum(x.k * y.k) FROM c x JOIN c y ON x.i = y.i WHERE x.region = a.region AND y.region = b.region), 0) / (a.z * b.z), 8) AS distance
        FROM n a JOIN n b ON a.region < b.region""",
    ),
    "mad": (
        lambda s, d: aggregate.mad(frames(s, d), ["region"], "value").select("region", _r("mad")),
        f"WITH {FRAMES}, m AS (SELECT region, median(value) AS m FROM fr GROUP BY 1) SELECT region, round(median(abs(value - m)), 8) AS mad FROM fr JOIN m USING (region) GROUP BY 1",
    ),
    "circular_mean": (
        lambda s, d: aggregate.circular_mean(frames(s, d).withColumn("angle", F.expr(ANGLE)), ["video_id"], "angle").select("video_id", _r("angle")),
        f"WITH {FRAMES} SELECT video_id, round(atan2(avg(sin({ANGLE})), avg(cos({ANGLE}))), 8) AS angle FROM fr GROUP BY 1",
    ),
    "silver_meta_quality": (
        _silver,
        f"""WITH {FRAMES} SELECT count(DISTINCT video_id) AS videos_processed, count(*) AS frames_processados, 1.0::DOUBLE AS coverage_ratio,
            """ + ", ".join(f"round(avg((source = '{x}')::INT), 8) AS percentual_{x}" for x in ("detector", "last_bbox", "fallback_center")) + " FROM exp",
    ),
    "silver_feat_quality": (
        _silver_features,
        WIDE + """, r AS (SELECT video_id, sum((mean IS NULL)::INT + (std IS NULL)::INT + (median IS NULL)::INT)::DOUBLE / (3 * count(*) + 2) AS x FROM st GROUP BY 1), v AS (SELECT video_id, coalesce(x, 0) AS x FROM (SELECT DISTINCT video_id FROM fr) LEFT JOIN r USING (video_id))
        SELECT (SELECT count(*) FROM fr) AS frame_rows, count(*) AS videos_with_frame_features, count(*) AS videos_processed, round(avg(x), 8) AS avg_missing_feature_ratio FROM v""",
    ),
}


