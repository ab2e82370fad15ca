"""Face boxes of sampled frames: detection schedule, forward fill, fallback, and the flat metadata table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specula.contracts import FRAME_METADATA
from specula.functions.scalars import BOX, clip_bbox, expand_bbox, fallback_bbox, nearest_metadata, sample_positions


def sampled(frames: DataFrame, most: int | None, video: str = "video_id") -> DataFrame:
    """The frames (video, frame_id) that sampling keeps, with frame_count.

    The positions of a video follow from its count alone, so each frame is tested by itself: it stays if it is the floor of
    some multiple of the step. A frame_count that frames have is the decoder's and stays, also where frames were sampled
    before; then nothing is shuffled. Without one the rows are counted by video and the counts joined.
    """
    if "frame_count" not in frames.columns:
        frames = frames.join(frames.groupBy(video).agg(F.count(F.lit(1)).cast("int").alias("frame_count")), video)
    if most is None:
        return frames
    f, n, m = F.col("frame_id"), F.col("frame_count"), F.lit(most)
    step = (n - 1).cast("double") / F.nullif(m - 1, F.lit(0))
    at = lambda i: F.floor(i * step).cast("int")
    guess = F.floor(f / step)
    hit = F.lit(False)
    for k in (-1, 0, 1):  # the quotient may be off by a rounding
        i = guess + k
        hit = hit | ((i >= 0) & (i < m - 1) & (at(i) == f))
    keep = (n <= m) | F.when(m == 1, f == 0).otherwise(hit | (f == n - 1))
    return frames.filter(F.coalesce(keep, F.lit(True)))


def best_detection(detections: Column) -> Column:
    """The detection (score, bbox, ...) of the highest score in an array, the first of equals; null of none."""
    ranked = F.transform(detections, lambda d, i: F.struct(F.coalesce(d["score"], F.lit(float("-inf"))).alias("score"), (-i).alias("first"), d.alias("d")))
    return F.array_max(ranked)["d"]


def schedule(samples: DataFrame, every: int = 1, has_tracker: bool = False, video: str = "video_id", found: str = "found", order: str = "frame_id") -> DataFrame:
    """samples with sample_idx and use_detection: every n-th sample, and all while there is no tracker.

    Without a tracker every frame is detected; with one, all frames up to the first one on which detection succeeded.
    """
    w = Window.partitionBy(video).orderBy(order)
    samples = samples.withColumn("sample_idx", F.row_number().over(w) - 1)
    due = F.col("sample_idx") % max(1, every) == 0
    if not has_tracker:
        return samples.withColumn("use_detection", F.lit(True))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    tracked = F.coalesce(F.max(F.col(found)).over(before), F.lit(False))
    return samples.withColumn("use_detection", due | ~tracked)


def fill(samples: DataFrame, video: str = "video_id", order: str = "frame_id", box: str = "bbox", source: str = "detector", allow_fallback: bool = True, padding: float = 0.2) -> DataFrame:
    """samples (video, order, width, height, box or null) with bbox, bbox_expanded and source of every frame.

    A frame without a box takes the last one of its video before it, then a box around the centre. A found box is clipped
    to its frame first; one of which nothing is left counts as none, while its detector_score stays. Frames whose filled
    box is none in them drop out. One window by video, sorted once; a video is in one task, as its frames are a sequence.
    """
    w = Window.partitionBy(video).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    width, height = F.col("frame_width"), F.col("frame_height")
    samples = samples.withColumn("_own", clip_bbox(box, width, height))
    samples = samples.withColumn("_last", F.last("_own", ignorenulls=True).over(w))
    named = F.col("_source") if "_source" in samples.columns else F.lit(source)
    # One column a step: each names the one before several times, and Spark doesn't merge such projections.
    centre = fallback_bbox(width, height) if allow_fallback else F.lit(None)
    out = samples.withColumn("source", F.when(F.col("_own").isNotNull(), named).when(F.col("_last").isNotNull(), "last_bbox").otherwise("fallback_center"))
    out = out.withColumn("_filled", F.coalesce(F.col("_last"), centre)).withColumn("bbox", clip_bbox("_filled", width, height)).filter("bbox IS NOT NULL")
    out = out.withColumn("bbox_expanded", expand_bbox("bbox", width, height, padding))
    return out.drop("_own", "_last", "_filled", "_source")


def flatten(rows: DataFrame, version: str) -> DataFrame:
    """The frame_metadata table from rows with bbox and bbox_expanded as structs or arrays of four."""
    have = dict(rows.dtypes)

    def part(column: str, k: int) -> Column:
        if column not in have:
            return F.lit(None).cast("int")
        return F.get(F.col(column), F.lit(k)) if have[column].startswith("array") else F.col(column)[BOX[k]]

    defaults = {"video_id": F.lit(""), "source": F.lit(""), "processed_at": F.lit(""), "pipeline_version": F.lit(version)}
    out = {f"{c}_{e}": part(c, k).cast("int") for c in ("bbox", "bbox_expanded") for k, e in enumerate(BOX)}
    kinds = {"frame_id": "int", "detector_score": "double", "frame_width": "int", "frame_height": "int"}
    for c in FRAME_METADATA:
        if c not in out:
            value = F.col(c) if c in have else F.lit(None)
            out[c] = value.cast(kinds[c]) if c in kinds else F.coalesce(value.cast("string"), defaults[c])
    return rows.select(*(out[c].alias(c) for c in FRAME_METADATA))


def match_metadata(frames: DataFrame, metadata: DataFrame, video: str = "video_id") -> DataFrame:
    """frames (video, frame_id, frame_count, ...) with metadata_idx and the metadata row that each takes.

    Metadata go by position: metadata_idx is a row's place in its video. A video's rows become one array, of some numbers
    a frame, so frames with their pixels meet them in one join on the video; what a frame takes is computed from the counts.
    """
    names = [c for c in metadata.columns if c not in (video, "metadata_idx", "frame_id")]
    rows = metadata.groupBy(video).agg(F.sort_array(F.collect_list(F.struct("metadata_idx", F.struct(*names).alias("row")))).alias("_rows"))
    # Of m > 0 rows the place is always one of them. The row is taken in one projection, so that the place is told once.
    found = frames.join(rows, video).withColumn("metadata_idx", nearest_metadata("frame_id", "frame_count", F.size("_rows")))
    return found.select(*frames.columns, "metadata_idx", *(F.get("_rows", F.col("metadata_idx"))["row"][c].alias(c) for c in names))


__all__ = ["best_detection", "fill", "flatten", "match_metadata", "sample_positions", "sampled", "schedule"]
