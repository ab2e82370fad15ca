"""Quality reports: one row per layer, each from one pass over its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specula.contracts import SOURCES


def bronze(manifest: DataFrame) -> DataFrame:
    """input_rows, downloaded, failed, skipped, unique_videos."""
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    return manifest.agg(
        F.count(F.lit(1)).alias("input_rows"),
        status("downloaded"),
        status("failed"),
        status("skipped"),
        F.count_distinct(F.nullif(F.col("video_id").cast("string"), F.lit(""))).alias("unique_videos"),
    )


def distribution(df: DataFrame, column: str, share: bool) -> Column | DataFrame:
    """(value, n, share) of a column's values, null as an empty string, by one small aggregation."""
    counted = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if not share:
        return counted
    return counted.join(counted.agg(F.sum("n").alias("total")), how="cross").select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def silver_metadata(metadata: DataFrame, json_files: int = 0) -> DataFrame:
    """Frames, videos and the shares of box sources. Every row has a box, so the coverages are 1 unless there is none."""
    counts = metadata.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    by_source = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("m")
    )
    videos = metadata.agg(F.count_distinct("video_id").alias("videos_processed"))
    total = F.col("total")
    share = lambda s: F.coalesce(F.try_element_at("m", F.lit(s)) / F.nullif(total, F.lit(0).cast("long")), F.lit(0.0))
    covered = F.when(total > 0, 1.0).otherwise(0.0)
    return videos.join(by_source, how="cross").select(
        "videos_processed",
        F.lit(json_files).cast("long").alias("json_files"),
        total.alias("frames_processados"),
        total.alias("frames_com_face"),
        covered.alias("avg_face_coverage"),
        covered.alias("coverage_ratio"),
        *(share(s).alias(f"percentual_{s}") for s in SOURCES),
        share("fallback_center").alias("fallback_center_ratio"),
        F.when(total > 0, F.transform_values("m", lambda k, v: v / total)).otherwise(F.create_map().cast("map<string,double>")).alias("source_distribution"),
    )


def silver_features(frames: DataFrame, videos: DataFrame, files: int = 0) -> DataFrame:
    one = frames.agg(F.count(F.lit(1)).alias("frame_rows"), F.count_distinct("video_id").alias("videos_with_frame_features"))
    ratio = F.col("missing_feature_ratio")
    two = videos.agg(F.count(F.lit(1)).alias("videos_processed"), F.coalesce(F.avg(F.when(~F.isnan(ratio), ratio)), F.lit(0.0)).alias("avg_missing_feature_ratio"))
    return one.join(two, how="cross").select(F.lit(files).cast("long").alias("frame_feature_files"), "*")


def gold(table: DataFrame) -> DataFrame:
    splits = distribution(table, "dataset_split", share=False).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("split_distribution"))
    label = F.coalesce("target_label", F.lit(""))
    counts = table.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce("is_trainable", F.lit(False))).alias("trainable_rows"),
        F.count_if(label == "Real").alias("real_count"),
        F.count_if(label == "Fake").alias("fake_count"),
    )
    return counts.join(splits, how="cross")
