"""From frame metrics to video features. Metrics are long (video, metric, value) inside and wide at the sink only.

A metric that a frame doesn't have is null there; one that it has but that can't be told is NaN. Aggregates pass over NaN;
a metric counts for a video if any of its frames has it, NaN or not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from specula.functions.scalars import dot, finite, matches_prefix

STATS = ("mean", "std", "median")
PAIRS = (("face_bg", "face", "background"), ("face_border", "face", "border"), ("border_bg", "border", "background"))


def to_long(frames: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """(keys, metric, value); metrics that are null aren't there."""
    return frames.unpivot(keys, metrics, "metric", "value").filter("value IS NOT NULL")


def numeric(df: DataFrame) -> DataFrame:
    """The columns that hold numbers; booleans count as such."""
    return df.select(*(f.name for f in df.schema.fields if isinstance(f.dataType, (NumericType, BooleanType))))


def project(long: DataFrame, prefixes) -> DataFrame:
    return long.filter(matches_prefix("metric", prefixes))


def video_stats(long: DataFrame, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """(keys, metric, n, mean, std, median) over values that aren't NaN; what can't be told is NaN."""
    v, nan = finite("value"), F.lit(float("nan"))
    return long.groupBy(*keys, "metric").agg(
        F.count(v).alias("n"),
        F.coalesce(F.avg(v), nan).alias("mean"),
        F.coalesce(F.stddev_samp(v), nan).alias("std"),
        F.coalesce(F.median(v), nan).alias("median"),
    )


def means_in_order(frames: DataFrame, values: dict[str, Column], order: list[str], video: str = "video_id") -> DataFrame:
    """(video, names of values): their means, added up in ``order``, so that last bits don't hang on how rows are dealt out."""
    every = Window.partitionBy(video).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    means = frames.select(video, *(F.avg(v).over(every).alias(k) for k, v in values.items()))
    return means.groupBy(video).agg(*(F.first(k).alias(k) for k in values))


def missing_ratio(stats: DataFrame, video: str = "video_id") -> DataFrame:
    """(video, missing_feature_ratio): the share of NaN among the stats and the two counts, which are never missing."""
    holes = sum((F.when(F.isnan(s), 1).otherwise(0) for s in STATS), F.lit(0))
    return stats.groupBy(video).agg((F.sum(holes) / (len(STATS) * F.count(F.lit(1)) + 2)).alias("missing_feature_ratio"))


def governance(frames: DataFrame, groups: str, now: str, version: str, video: str = "video_id") -> DataFrame:
    return frames.groupBy(video).agg(
        F.count(F.lit(1)).cast("int").alias("n_frames"),
        F.count_distinct("metadata_idx").cast("int").alias("metadata_rows_used"),
        F.lit(groups).alias("feature_groups_used"),
        F.lit(now).alias("aggregated_at"),
        F.lit(version).alias("pipeline_version"),
    )


def to_wide(stats: DataFrame, metrics: list[str], video: str = "video_id") -> DataFrame:
    """A column {metric}_{stat} each, in the order of metrics; the values of the pivot are named, so it is one pass."""
    each = stats.select(video, F.explode(F.create_map(*[x for s in STATS for x in (F.lit(s), F.col(s))])).alias("stat", "value"), "metric")
    named = each.select(video, F.concat_ws("_", "metric", "stat").alias("name"), "value")
    return named.groupBy(video).pivot("name", [f"{m}_{s}" for m in metrics for s in STATS]).agg(F.first("value"))


def video_features(frames: DataFrame, metrics: list[str], groups: str, now: str, version: str, videos: DataFrame | None = None) -> DataFrame:
    """The video_features table: governance, ratio and wide stats. Videos without a frame, of ``videos``, have 0 frames."""
    stats = video_stats(to_long(frames, metrics, ["video_id"]))
    out = governance(frames, groups, now, version).join(missing_ratio(stats), "video_id", "left").join(to_wide(stats, metrics), "video_id", "left")
    if videos is not None:
        out = videos.join(out, "video_id", "left").withColumns(
            {
                "n_frames": F.coalesce("n_frames", F.lit(0)),
                "feature_groups_used": F.coalesce("feature_groups_used", F.lit(groups)),
                "aggregated_at": F.coalesce("aggregated_at", F.lit(now)),
                "pipeline_version": F.coalesce("pipeline_version", F.lit(version)),
            }
        )
    return out.withColumn("missing_feature_ratio", F.coalesce("missing_feature_ratio", F.lit(0.0)))


def region_diffs(regions: DataFrame, keys: list[str], region: str = "region", metric: str = "metric", value: str = "value") -> DataFrame:
    """(keys, metric, value): left minus right of the three region pairs, where both regions have the metric.

    One aggregation brings the regions of a metric together; no self-join.
    """
    at = lambda r: F.max(F.when(F.col(region) == r, F.col(value)))
    sides = regions.groupBy(*keys, metric).agg(at("face").alias("face"), at("border").alias("border"), at("background").alias("background"))
    rows = [
        F.struct(F.concat_ws("_", F.lit(p), F.col(metric), F.lit("diff")).alias("metric"), (F.col(a) - F.col(b)).alias("value")) for p, a, b in PAIRS
    ]
    return sides.select(*keys, F.inline(F.filter(F.array(*rows), lambda x: x["value"].isNotNull())))


def basic_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, std (population), median, p95, energy and excess kurtosis (NaN for constant values) of each group."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.median(v).alias("median"),
        F.percentile(v, F.lit(0.95)).alias("p95"),
        F.avg(v * v).alias("energy"),
        F.coalesce(F.kurtosis(v), F.lit(float("nan"))).alias("kurtosis"),
    )


def histogram(df: DataFrame, keys: list[str], bin_column: Column, bins: int) -> DataFrame:
    """(keys, hist): counts of every bin as an array, also of empty ones; rows without a bin don't count."""
    counted = df.withColumn("bin", bin_column).filter("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("k"))
    counts = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("m"))  # at most bins entries
    return counts.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0).cast("long"))).alias("hist"))


def entropy(hist: Column) -> Column:
    """In bits; NaN for a histogram without a count."""
    total = F.aggregate(hist, F.lit(0.0), lambda a, x: a + x)
    term = lambda x: F.when(x > 0, -(x / total) * F.log2(x / total)).otherwise(0.0)
    return F.when(total > 0, F.aggregate(hist, F.lit(0.0), lambda a, x: a + term(x))).otherwise(F.lit(float("nan")))


def mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mad): the median distance from the median. The medians are joined back, so a large group is not one task's."""
    middle = df.groupBy(*keys).agg(F.median(value).alias("_middle"))
    return df.join(middle, keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_middle"))).alias("mad"))


def circular_mean(df: DataFrame, keys: list[str], angle: str) -> DataFrame:
    a = F.col(angle)
    return df.groupBy(*keys).agg(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))).alias("angle"))


#: Numbers of partial sums that a task holds before it hands them on.
HELD = 4_000_000


def _unit_partials(df: DataFrame, key: str, vector: str, products: bool) -> DataFrame:
    """(key, d, n, sums): per task and group, of the vectors at length 1, how many (n) and their sum (d = -1); with
    ``products`` also the rows d of the sum of their outer products, a matrix product an Arrow batch.

    Null vectors and such of zeros are left out; a null element makes its vector null. Vectors are of one size.
    """

    def run(batches):
        held: dict = {}

        def rows():
            for k, (n, total, gram) in held.items():
                listed = [total] if gram is None else [total, *gram]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(listed), kind), pa.array(range(-1, len(listed) - 1), pa.int32()), pa.array([n] * len(listed), pa.int64()), pa.array(listed, pa.list_(pa.float64()))],
                    ["key", "d", "n", "sums"],
                )
            held.clear()

        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, values = batch.column(0).type, batch.column(1)
            v = values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            size = np.sqrt((v * v).sum(1))
            fits = size > 0
            u = v[fits] / size[fits, None]
            codes = batch.column(0).filter(pa.array(fits)).dictionary_encode(null_encoding="encode")
            code, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            for c in np.unique(code):
                own = u[code == c]
                n, total, gram = held.get(names[c], (0, 0.0, 0.0))
                held[names[c]] = (n + len(own), total + own.sum(0), gram + own.T @ own if products else None)
            if len(held) * v.shape[1] * (v.shape[1] + 1 if products else 1) > HELD:
                yield from rows()
        yield from rows()

    of = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).filter("vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    return of.mapInArrow(run, f"key {of.schema['key'].dataType.simpleString()}, d int, n long, sums array<double>")


def _unit_sums(partials: DataFrame) -> DataFrame:
    """(key, n, sums) of _unit_partials."""
    one = partials.filter("d = -1")
    sums = one.select("key", F.posexplode("sums").alias("e", "x")).groupBy("key", "e").agg(F.sum("x").alias("s"))
    listed = sums.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("e", "s"))), lambda x: x["s"]).alias("sums"))  # a vector's size
    return one.groupBy("key").agg(F.sum("n").alias("n")).join(listed.withColumnRenamed("key", "_k"), F.col("key").eqNullSafe(F.col("_k"))).drop("_k")


def mean_cosine_between(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(left, right, distance) for each pair of groups: the mean cosine distance over all pairs of their vectors.

    It is 1 minus the dot product of the means of the vectors at length 1, so no vector meets another one.
    """
    means = _unit_sums(_unit_partials(df, key, vector, False)).select("key", F.transform("sums", lambda s: s / F.col("n")).alias("m"))
    a, b = means.alias("a"), means.alias("b")
    return a.join(b, F.col("a.key") < F.col("b.key")).select(F.col("a.key").alias("left"), F.col("b.key").alias("right"), (1 - dot("a.m", "b.m")).alias("distance"))


def cosine_within(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, sim_mean, sim_std): mean and population deviation of the cosine similarity of all pairs within a group.

    From the sum of the vectors at length 1 and of their outer products: the squares of the products of all pairs sum up to
    the squares of that matrix. Groups of fewer than two vectors are NaN.
    """
    partials = _unit_partials(df, key, vector, True)
    cells = partials.filter("d >= 0").select("key", "d", F.posexplode("sums").alias("e", "x")).groupBy("key", "d", "e").agg(F.sum("x").alias("g"))
    squares = cells.groupBy(F.col("key").alias("_g")).agg(F.sum(F.col("g") * F.col("g")).alias("g2"))
    sums = _unit_sums(partials).join(squares, F.col("key").eqNullSafe(F.col("_g")))
    n = F.col("n").cast("double")
    pairs = F.nullif(n * (n - 1), F.lit(0.0))
    total = F.aggregate("sums", F.lit(0.0), lambda t, s: t + s * s)
    mean, square = (total - n) / pairs, (F.col("g2") - n) / pairs
    nan = F.lit(float("nan"))
    return sums.select(
        F.col("key").alias(key), "n", F.coalesce(mean, nan).alias("sim_mean"), F.coalesce(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), nan).alias("sim_std")
    )
