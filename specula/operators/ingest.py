"""Ingestion: which source records are new, and what the manifest says of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specula.functions.scalars import normalize_label, strip, video_id_from_url

# Reasons as the manifest states them.
URL_SEEN, ID_SEEN = "source_url already present in manifest", "video_id already present in manifest"
FILE_SEEN, HASH_SEEN = "video file already exists in Bronze", "sha256 already present in manifest"


def distinct_links(first: DataFrame, more: DataFrame) -> DataFrame:
    """(link, pos): the links of both tables (pos, link), stripped in the second, each at its first place.

    The earliest place of a link is a minimum that is combined before the shuffle.
    """
    lines = more.select(F.struct(F.lit(1).alias("part"), F.col("pos")).alias("at"), strip("link").alias("link")).filter("link <> ''")
    both = first.select(F.struct(F.lit(0).alias("part"), F.col("pos")).alias("at"), "link").unionByName(lines)
    return both.groupBy("link").agg(F.min("at").alias("at")).select("link", "at.part", "at.pos")


def success_index(manifest: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column in rows that were downloaded or skipped; no nulls, no empty strings."""
    return manifest.filter(F.col("status").isin("downloaded", "skipped") & (F.col(column) != "")).select(column).distinct()


def latest_rows(manifest: DataFrame, order: str = "downloaded_at") -> DataFrame:
    """The last row of each video of an append-only manifest."""
    w = Window.partitionBy("video_id").orderBy(F.col(order).desc_nulls_last())
    return manifest.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def decide(records: DataFrame, manifest: DataFrame, files: DataFrame, url_parameter: str = "v") -> DataFrame:
    """records with video_id, the normalised label, existing_file and decision: a reason to skip, or null to fetch.

    The first reason holds: URL seen, id seen, file there. files has (video_id, path, sha256); of several files of an id
    the first by path counts. The three indexes hold one row a key, so the joins add no rows, and Spark broadcasts them
    only as its own size limit allows.
    """
    if "video_id" not in records.columns:
        records = records.withColumn("video_id", video_id_from_url("source_url", url_parameter))
    records = records.withColumn("label", normalize_label("label"))
    urls = success_index(manifest, "source_url").withColumn("_url", F.lit(True))
    ids = success_index(manifest, "video_id").withColumn("_id", F.lit(True))
    there = files.groupBy("video_id").agg(F.min(F.struct("path", "sha256")).alias("existing_file"))
    out = records.join(urls, "source_url", "left").join(ids, "video_id", "left").join(there, "video_id", "left")
    reason = F.when(F.col("_url"), URL_SEEN).when(F.col("_id"), ID_SEEN).when(F.col("existing_file").isNotNull(), FILE_SEEN)
    return out.withColumn("decision", reason).drop("_url", "_id")


def conclude(decided: DataFrame, fetched: DataFrame, manifest: DataFrame, now: str, dedup_within_batch: bool = False) -> DataFrame:
    """Manifest rows of a batch. fetched has (source_url, status, error_message, path, sha256) of what was fetched.

    A download whose hash the manifest knows becomes skipped. Equal contents within a batch aren't compared, unless
    dedup_within_batch says so: then all but the first URL of a hash are skipped too.
    """
    hashes = success_index(manifest, "sha256").withColumn("_sha", F.lit(True))
    got = fetched.select("source_url", F.col("status").alias("_status"), F.col("error_message").alias("_error"), F.col("path").alias("_path"), "sha256")
    rows = decided.join(got, "source_url", "left").join(hashes, "sha256", "left")
    again = (F.col("_status") == "downloaded") & F.coalesce(F.col("_sha"), F.lit(False))
    if dedup_within_batch:
        w = Window.partitionBy("sha256").orderBy("source_url")
        again = again | ((F.col("_status") == "downloaded") & (F.row_number().over(w) > 1))
    held = F.col("existing_file.path")
    path = F.when(F.col("decision").isNotNull(), held).otherwise(F.col("_path"))
    return rows.select(
        "video_id",
        "source_url",
        F.coalesce(F.element_at(F.split(path, "/"), -1), F.lit("")).alias("filename"),
        F.coalesce(path, F.lit("")).alias("storage_path"),
        F.coalesce(F.when(F.col("decision").isNotNull(), F.col("existing_file.sha256")).otherwise(F.col("sha256")), F.lit("")).alias("sha256"),
        F.lit(now).alias("downloaded_at"),
        "label",
        F.when(F.col("decision").isNotNull() | again, "skipped").otherwise(F.coalesce("_status", F.lit("failed"))).alias("status"),
        F.coalesce("decision", F.when(again, HASH_SEEN), "_error", F.lit("")).alias("error_message"),
        "source_type",
    )


def ingest(records: DataFrame, manifest: DataFrame, files: DataFrame, fetch: Callable[[DataFrame], DataFrame], now: str, dedup_within_batch: bool = False) -> DataFrame:
    """The manifest rows of a batch; ``fetch`` turns the records to fetch into what ``conclude`` wants of them."""
    decided = decide(records, manifest, files)
    return conclude(decided, fetch(decided.filter("decision IS NULL")), manifest, now, dedup_within_batch)


def local_fetch(listing: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetcher for videos that already lie in a store: listing has (video_id, path, sha256)."""

    def fetch(wanted: DataFrame) -> DataFrame:
        there = listing.groupBy("video_id").agg(F.min(F.struct("path", "sha256")).alias("f"))
        out = wanted.select("source_url", "video_id").join(there, "video_id", "left")
        return out.select(
            "source_url",
            F.when(F.col("f").isNull(), "failed").otherwise("downloaded").alias("status"),
            F.when(F.col("f").isNull(), "not found").otherwise("").alias("error_message"),
            F.col("f.path").alias("path"),
            F.col("f.sha256").alias("sha256"),
        )

    return fetch


def with_files(catalog: DataFrame, files: DataFrame, key: str = "video_path") -> DataFrame:
    """Catalog rows whose file is there."""
    return catalog.join(files.select(F.col("path").alias(key)).distinct(), key, "left_semi")


def without_output(catalog: DataFrame, done: DataFrame, key: str = "video_id") -> DataFrame:
    """The work list: catalog rows of which there is no output yet."""
    return catalog.join(done.select(key).distinct(), key, "left_anti")
