"""Which metrics separate the classes: frame metrics, their aggregates per video, and the ranked report over the means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.operators import aggregate, exploratory, features, kernels, stats

PROFILES = {"production": (kernels.compute, kernels.metric_names), "exploratory": (exploratory.compute, exploratory.metric_names)}


def evaluate(frames: DataFrame, metadata: DataFrame, labels: DataFrame, groups: str = "abcde", max_frames: int | None = 120, profile: str = "exploratory", resamples: int = stats.RESAMPLES) -> tuple[DataFrame, DataFrame]:
    """(video metrics, report) of the videos that have metadata and a row in labels (video_id, label)."""
    compute, names = PROFILES[profile]
    table = features.frame_features(frames, metadata, groups, max_frames, compute=compute, names=names).filter("error IS NULL")
    long = aggregate.video_stats(aggregate.to_long(table, names(groups), ["video_id"]))
    counts = table.groupBy("video_id").agg(F.count(F.lit(1)).cast("int").alias("n_frames"))
    videos = labels.join(counts, "video_id").join(aggregate.to_wide(long, names(groups)), "video_id")
    means = long.select("video_id", F.concat("metric", F.lit("_mean")).alias("metric"), F.col("mean").alias("value")).join(labels, "video_id")
    return videos, stats.report(means, "video_id", resamples=resamples)
