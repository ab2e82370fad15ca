"""Running frame kernels over a table of frames.

frames: video_id, frame_id, frame_count, height, width, channels, pixels (bytes, row by row). The only step in Python is one
mapInArrow; it gets the columns that it needs, one row a frame, and the groups are chosen before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from specula import __version__
from specula.operators import aggregate, boxes, kernels
from specula.functions.images import resize_area
from specula.functions.scalars import BOX, face_regions

FRAMES = "video_id STRING, frame_id INT, frame_count INT, height INT, width INT, channels INT, pixels BINARY"


def frame_features(frames: DataFrame, metadata: DataFrame, groups: str = "abcde", max_frames: int | None = None, now: str = "", version: str = __version__, padding: float = 0.2, compute=kernels.compute, names=kernels.metric_names) -> DataFrame:
    """A row per sampled frame: ids, governance and a double per metric, null where the frame doesn't have it.

    metadata (video_id, metadata_idx, bbox as a struct) gives a frame its box by position. Frames without one, or whose box
    is none in them, drop out. A frame that a kernel fails on has its reason in ``error`` and no metrics; the task goes on.
    """
    metrics = names(groups)
    rows = boxes.match_metadata(boxes.sampled(frames, max_frames), metadata.select("video_id", "metadata_idx", "bbox"))
    rows = rows.withColumn("regions", face_regions("bbox", "width", "height", padding)).filter("regions IS NOT NULL")
    rows = rows.select("video_id", "frame_id", "metadata_idx", "height", "width", "channels", "pixels", "regions.face", "regions.expanded")

    def run(batches):
        for batch in batches:
            table: dict[str, list] = {m: [] for m in metrics}
            errors: list[str | None] = []
            for r in batch.select(["height", "width", "channels", "pixels", "face", "expanded"]).to_pylist():
                found, error = {}, None
                try:
                    shape = (r["height"], r["width"], r["channels"])
                    pixels = np.frombuffer(r["pixels"], np.uint8).reshape(shape)
                    pixels = np.repeat(pixels, 3, axis=2) if shape[2] == 1 else pixels
                    found = compute(kernels.Frame(pixels, *([r[k][c] for c in ("x1", "y1", "x2", "y2")] for k in ("face", "expanded"))), groups)
                except Exception as e:  # noqa: BLE001  one bad frame must not end the job
                    error = f"{type(e).__name__}: {e}"
                errors.append(error)
                for m in metrics:
                    v = found.get(m)
                    table[m].append(None if v is None else float(v))
            ids = [batch.column(c) for c in ("video_id", "frame_id", "metadata_idx")]
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(errors, pa.string()), *(pa.array(table[m], pa.float64()) for m in metrics)], ["video_id", "frame_id", "metadata_idx", "error", *metrics]
            )

    schema = StructType([*rows.select("video_id", "frame_id", "metadata_idx").schema.fields]).add("error", "string")
    schema = StructType([*schema.fields, *(StructField(m, DoubleType()) for m in metrics)])
    return rows.mapInArrow(run, schema).withColumns(
        {"feature_groups_used": F.lit("".join(kernels.normalize_groups(groups))), "processed_at": F.lit(now), "pipeline_version": F.lit(version)}
    )


def video_features(frame_table: DataFrame, groups: str = "abcde", now: str = "", version: str = __version__, videos: DataFrame | None = None, names=kernels.metric_names) -> DataFrame:
    """The video_features table of a frame_features table; failed frames don't count."""
    frames = frame_table.filter("error IS NULL") if "error" in frame_table.columns else frame_table
    return aggregate.video_features(frames, names(groups), "".join(kernels.normalize_groups(groups)), now, version, videos)


def _clipped(box, width: int, height: int) -> list[int] | None:
    """Rounded and within the frame; None for a side under 2."""
    x1, y1, x2, y2 = (int(round(v)) for v in box)
    x1, y1, x2, y2 = max(0, min(x1, width - 1)), max(0, min(y1, height - 1)), max(0, min(x2, width)), max(0, min(y2, height))
    return [x1, y1, x2, y2] if x2 - x1 >= 2 and y2 - y1 >= 2 else None


def detect(frames: DataFrame, detector=None, max_frames: int | None = None, now: str = "", version: str = __version__, max_size: int = 640, allow_fallback: bool = True, pick: str = "best", detect_every: int = 1, tracker=None) -> DataFrame:
    """Box metadata of sampled frames, with metadata_idx, from a detector that a task loads: a callable without arguments
    that returns a function from a frame to a list of {"bbox": [x1, y1, x2, y2], "score": number}; of it the best by score
    is taken, or with pick="first" the first. Without one, or where it finds nothing, boxes are filled as ``boxes.fill`` does.

    A tracker is such a callable, too: it returns a function (frame, box) that starts tracking and returns a function from
    the next frame to its box or None (or None if it can't start). With one, detection runs on every detect_every-th sample
    and until it first found something; the tracker tells the boxes between. Frames of a video then pass one task in order.
    Without one every frame is detected, and frames stay where they are.
    """
    rows = boxes.sampled(frames, max_frames).select("video_id", "frame_id", "height", "width", "channels", "pixels")
    if tracker:
        rows = rows.repartition("video_id").sortWithinPartitions("video_id", "frame_id")

    def run(batches):
        find = detector() if detector else (lambda pixels: [])
        start = tracker() if tracker else None
        video, at, follow = None, 0, None

        def detected(pixels, w, h):
            scale = min(max_size / max(pixels.shape[:2]), 1.0)
            seen = find(resize_area(pixels, int(w * scale), int(h * scale)) if scale < 1 else pixels)
            best = next(iter(seen), None) if pick == "first" else max(seen, key=lambda d: d["score"], default=None)
            return ([int(v / scale) for v in best["bbox"]], float(best["score"])) if best else (None, None)

        for batch in batches:
            found = []
            for r in batch.select(["video_id", "height", "width", "channels", "pixels"]).to_pylist():
                if r["video_id"] != video:
                    video, at, follow = r["video_id"], 0, None
                w, h = r["width"], r["height"]
                pixels = np.frombuffer(r["pixels"], np.uint8).reshape(h, w, r["channels"])
                if follow is None or at % max(1, detect_every) == 0:
                    source, (box, score) = "detector", detected(pixels, w, h)
                    if start and box and (own := _clipped(box, w, h)):
                        follow = start(pixels, own)
                else:
                    source, box, score = "tracker", follow(pixels), None
                at += 1
                found.append((dict(zip(BOX, map(int, box))) if box else None, score, source))
            box, score, source = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("video_id", "frame_id", "width", "height")),
                    pa.array(box, pa.struct([(k, pa.int32()) for k in BOX])),
                    pa.array(score, pa.float64()),
                    pa.array(source, pa.string()),
                ],
                ["video_id", "frame_id", "frame_width", "frame_height", "bbox", "detector_score", "_source"],
            )

    schema = "video_id string, frame_id int, frame_width int, frame_height int, bbox struct<x1:int,y1:int,x2:int,y2:int>, detector_score double, _source string"
    filled = boxes.fill(rows.mapInArrow(run, schema), allow_fallback=allow_fallback)
    return number(filled.withColumns({"processed_at": F.lit(now), "pipeline_version": F.lit(version)}))


def number(metadata: DataFrame) -> DataFrame:
    """metadata_idx: a row's place among its video's rows."""
    from pyspark.sql import Window

    return metadata.withColumn("metadata_idx", (F.row_number().over(Window.partitionBy("video_id").orderBy("frame_id")) - 1).cast("int"))
