"""The gold table: quality flag, trainable rows and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.functions.scalars import is_trainable, quality_flag, split_of


def gold(features: DataFrame, train: float = 0.7, validation: float = 0.15, threshold: float = 0.5, seed: int = 42, row_key: str | None = None) -> DataFrame:
    """features with target_label, quality_flag, is_trainable and dataset_split.

    The key of a split is the video's id, else its file name, else ``row_key``, a column that tells rows apart. Nothing is
    shuffled: every row is decided by itself.
    """
    have = set(features.columns)
    names = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("video_id", "filename", row_key) if c in have]
    args = ("target_label", "n_frames", "metadata_rows_used", "missing_feature_ratio", threshold)
    out = features.withColumn("target_label", F.col("label"))
    out = out.withColumns({"quality_flag": quality_flag(*args), "is_trainable": is_trainable(*args)})
    return out.withColumn("dataset_split", split_of("target_label", F.coalesce(*names, F.lit("")), "is_trainable", train, validation, seed))


def assign_splits(rows: DataFrame, train: float = 0.7, validation: float = 0.15, seed: int = 42, row_key: str | None = None) -> DataFrame:
    """dataset_split for rows that already have target_label and is_trainable."""
    names = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("video_id", "filename", row_key) if c in rows.columns]
    return rows.withColumn("dataset_split", split_of("target_label", F.coalesce(*names, F.lit("")), "is_trainable", train, validation, seed))
