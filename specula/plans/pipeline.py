"""The stages of the engine: ingest, preprocess, gold, validate, and build, which runs them in order.

Each stage reads its tables from a Layout, writes its own and returns it. The clock is a parameter.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specula import __version__, contracts
from specula.functions.scalars import video_id_from_url
from specula.operators import boxes, features, gold, ingest, quality
from specula.sources import tables, video


def now_iso() -> str:
    return datetime.now(timezone.utc).isoformat()


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, path, sha256) of the videos that are there."""
    if not tables.exists(spark, folder):
        return spark.createDataFrame([], "video_id STRING, path STRING, sha256 STRING")
    return tables.content_hashes(spark, folder).select(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("video_id"), "path", "sha256")


def run_ingest(spark: SparkSession, layout: tables.Layout, source: str, links: list[str] = (), limit: int | None = None, fetch=None, now: str | None = None, dedup_within_batch: bool = False) -> DataFrame:
    """The manifest rows of one batch, appended to the manifest. Without ``fetch`` only videos that lie there are found."""
    if source:
        records = tables.read_sources(spark, source)
    else:
        records = spark.createDataFrame([(k, u) for k, u in enumerate(links)], "pos INT, source_url STRING").groupBy("source_url").agg(F.min("pos").alias("pos"))
        records = records.orderBy("pos").select("source_url", F.lit("").alias("label"), F.lit("youtube").alias("source_type"))
    records = tables.first_rows(records, limit)
    files = _files(spark, layout.videos)
    rows = ingest.ingest(records, tables.read_manifest(spark, layout.manifest), files, fetch or ingest.local_fetch(files), now or now_iso(), dedup_within_batch)
    tables.append_manifest(rows, layout.manifest)
    return rows


def catalog(spark: SparkSession, layout: tables.Layout, limit: int | None = None) -> DataFrame:
    """The catalog's videos that are there, with video_id; files are matched by name or by the id in the URL."""
    rows = tables.read_catalog(spark, layout.catalog, layout.videos)
    rows = tables.first_rows(rows, limit)
    stem = F.regexp_replace("Filename", r"\.[^.]*$", "")
    by_url = video_id_from_url("Media") if "Media" in rows.columns else F.lit("")
    there = _files(spark, layout.videos).select(F.col("video_id").alias("_file"), "path").distinct()
    rows = rows.withColumns({"_stem": stem, "_url": by_url})
    one = rows.join(there, rows["_stem"] == there["_file"], "left").withColumnRenamed("path", "_a").drop("_file")
    two = one.join(there, one["_url"] == there["_file"], "left").withColumnRenamed("path", "_b")
    found = two.withColumns({"video_id": F.when(F.col("_a").isNotNull(), F.col("_stem")).otherwise(F.col("_url")), "video_path": F.coalesce("_a", "_b")})
    return found.filter("video_path IS NOT NULL").drop("_stem", "_url", "_a", "_b", "_file")


def run_preprocess(spark: SparkSession, layout: tables.Layout, detector=None, max_frames: int | None = None, overwrite: bool = False, limit: int | None = None, decoder=video.raw, count=None, now: str | None = None, detect_every: int = 1, tracker=None) -> DataFrame:
    """Boxes of the videos that have none yet (all with overwrite), as the flat metadata table."""
    videos = catalog(spark, layout, limit).select("video_id").distinct()
    old = tables.exists(spark, layout.metadata) and not overwrite
    if old:
        videos = ingest.without_output(videos, spark.read.parquet(layout.metadata))
    frames = video.read_frames(spark, layout.videos, max_frames, decoder, count).join(videos, "video_id", "left_semi")
    found = features.detect(frames, detector, None, now or now_iso(), detect_every=detect_every, tracker=tracker)
    boxes.flatten(found, __version__).write.mode("append" if old else "overwrite").parquet(layout.metadata)
    return spark.read.parquet(layout.metadata)


def metadata_table(spark: SparkSession, layout: tables.Layout) -> DataFrame:
    """The flat table with bbox as a struct and metadata_idx."""
    flat = spark.read.parquet(layout.metadata)
    return features.number(flat.withColumn("bbox", F.struct(*(F.col(f"bbox_{k}").alias(k) for k in ("x1", "y1", "x2", "y2")))))


def run_gold(spark: SparkSession, layout: tables.Layout, groups: str = "abcde", max_frames: int | None = None, limit: int | None = None, train: float = 0.7, validation: float = 0.15, threshold: float = 0.5, decoder=video.raw, count=None, now: str | None = None) -> DataFrame:
    """Frame features, video features and the gold table of catalog videos that have a file and metadata."""
    now = now or now_iso()
    metadata = metadata_table(spark, layout)
    videos = catalog(spark, layout, limit).join(metadata.select("video_id").distinct(), "video_id", "left_semi")
    frames = video.read_frames(spark, layout.videos, max_frames, decoder, count).join(videos.select("video_id"), "video_id", "left_semi")
    labels = videos.select("video_id", F.col("Video Ground Truth").alias("label"))
    table = features.frame_features(frames, metadata, groups, None, now).join(labels, "video_id", "left")
    table.write.mode("overwrite").parquet(layout.frame_features)
    table = spark.read.parquet(layout.frame_features)
    named = {"Filename": "filename", "Video Ground Truth": "label", "Audio Ground Truth": "audio_label", "Media": "media"}
    info = videos.select("video_id", *(F.col(c).alias(n) for c, n in named.items() if c in videos.columns))
    wide = features.video_features(table, groups, now, __version__, info)
    wide.write.mode("overwrite").parquet(layout.video_features)
    out = gold.gold(spark.read.parquet(layout.video_features), train, validation, threshold)
    out.write.mode("overwrite").parquet(layout.gold)
    return spark.read.parquet(layout.gold)


def run_validate(spark: SparkSession, layout: tables.Layout, stamp: str | None = None) -> dict:
    """The quality report, also written as JSON: counts of every layer and the contracts' results."""
    empty = lambda name, more="": spark.createDataFrame([], contracts.CONTRACTS[name].ddl() + more)
    get = lambda path, name: spark.read.parquet(path) if tables.exists(spark, path) else empty(name)
    manifest, metadata = tables.read_manifest(spark, layout.manifest), get(layout.metadata, "frame_metadata")
    frames, videos, gold_table = get(layout.frame_features, "frame_features"), get(layout.video_features, "video_features"), get(layout.gold, "gold_training_dataset")
    first = lambda df: df.first().asDict(recursive=True)
    parts = [("bronze_manifest", layout.manifest, manifest, True), ("frame_metadata", layout.metadata, metadata, False), ("frame_features", layout.frame_features, frames, False)]
    parts += [("video_features", layout.video_features, videos, True), ("gold_training_dataset", layout.gold, gold_table, True)]
    results = [
        contracts.validate(df, name, path) if tables.exists(spark, path) else contracts.absent(spark, name, path)
        for name, path, df, needed in parts
        if needed or tables.exists(spark, path)
    ]
    checked = tables.union_tables(results)
    report = {
        "bronze": first(quality.bronze(manifest)) | {"manifest_path": layout.manifest},
        "silver_metadata": first(quality.silver_metadata(metadata, len(tables.list_files(spark, layout.metadata_json, "_meta.json")))),
        "silver_features": first(quality.silver_features(frames, videos, len(tables.list_files(spark, layout.frame_features, ".parquet")))),
        "gold": first(quality.gold(gold_table)),
        "contracts": first(contracts.summarize(checked)) | {"results": [r.asDict(recursive=True) for r in checked.collect()]},
    }
    tables.write_json(spark, report, layout.report(stamp or now_iso().replace(":", "-")))
    return tables.plain(report)


def run_build(spark: SparkSession, layout: tables.Layout, source: str | None = None, skip: tuple[str, ...] = (), **options) -> dict:
    """All stages in order but those in skip; each takes what it knows of the options."""
    import inspect

    known = lambda f: {k: v for k, v in options.items() if k in inspect.signature(f).parameters}
    if "ingest" not in skip and source:
        run_ingest(spark, layout, source, **known(run_ingest))
    if "preprocess" not in skip:
        run_preprocess(spark, layout, **known(run_preprocess))
    if "gold" not in skip:
        run_gold(spark, layout, **known(run_gold))
    return run_validate(spark, layout) if "validate" not in skip else {}


def process_video(spark: SparkSession, path: str, metadata: DataFrame | None = None, groups: str = "abcde", max_frames: int | None = None, detector=None, generate: bool = True, decoder=video.raw, count=None, now: str | None = None, detect_every: int = 1, tracker=None) -> tuple[DataFrame, dict]:
    """(frame features, video features) of one file, by the plan that the batch uses."""
    now = now or now_iso()
    frames = video.read_frames(spark, path, max_frames, decoder, count)
    if metadata is None:
        if not generate:
            raise FileNotFoundError(f"no metadata for {path}")
        metadata = features.detect(frames, detector, None, now, detect_every=detect_every, tracker=tracker)
    table = features.frame_features(frames, metadata, groups, None, now)
    row = features.video_features(table, groups, now, __version__, frames.select("video_id").distinct()).first()
    return table, row.asDict(recursive=True) if row else {}


def to_json(value: dict) -> str:
    return json.dumps(tables.plain(value), ensure_ascii=False, indent=2)


