"""Data contracts: what columns a table must have and which values some of them may take."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.functions.scalars import text_or_empty

# Columns of the pipeline's tables and accepted values.
MANIFEST = "video_id source_url filename storage_path sha256 downloaded_at label status error_message source_type".split()
MANIFEST_EXTRA = "title duration uploader webpage_url".split()
FRAME_METADATA = (
    "video_id frame_id bbox_x1 bbox_y1 bbox_x2 bbox_y2 bbox_expanded_x1 bbox_expanded_y1 bbox_expanded_x2 bbox_expanded_y2"
    " source detector_score frame_width frame_height processed_at pipeline_version"
).split()
FRAME_FEATURES = "video_id frame_id metadata_idx label feature_groups_used processed_at pipeline_version".split()
VIDEO_FEATURES = "video_id label n_frames metadata_rows_used feature_groups_used aggregated_at pipeline_version missing_feature_ratio".split()
GOLD = "video_id target_label dataset_split is_trainable quality_flag missing_feature_ratio pipeline_version".split()
PREDICTION = (
    "video_id prediction score_fake score_real model_version feature_pipeline_version processed_at top_signals processing_status error_message"
).split()
SOURCES = ("detector", "tracker", "last_bbox", "fallback_center")
SPLITS = ("train", "validation", "test", "unassigned")
FLAGS = ("ok", "review", "insufficient_metadata", "missing_label", "feature_failure")

#: SQL types of contract columns; any other is a string.
TYPES = {
    **dict.fromkeys("frame_id metadata_idx n_frames metadata_rows_used frame_width frame_height".split(), "INT"),
    **{c: "INT" for c in FRAME_METADATA if c.startswith("bbox")},
    **dict.fromkeys("detector_score missing_feature_ratio score_fake score_real".split(), "DOUBLE"),
    "is_trainable": "BOOLEAN",
    "top_signals": "ARRAY<STRING>",
}


@dataclass(frozen=True)
class Contract:
    name: str
    layer: str
    grain: str
    required: tuple[str, ...]
    accepted: dict[str, tuple[str, ...]] = field(default_factory=dict)
    optional: tuple[str, ...] = ()
    description: str = ""

    def ddl(self) -> str:
        """The schema of the required columns."""
        return ", ".join(f"{c} {TYPES.get(c, 'STRING')}" for c in self.required)

    def missing(self, columns) -> list[str]:
        have = set(columns)
        return [c for c in self.required if c not in have]


_ALL = [
    Contract("bronze_manifest", "bronze", "source video", tuple(MANIFEST), {"label": ("Real", "Fake", ""), "status": ("pending", "downloaded", "failed", "skipped"), "source_type": ("youtube", "manual_upload", "dataset_local")}, tuple(MANIFEST_EXTRA), "one row per attempt to ingest a video"),
    Contract("frame_metadata", "silver", "processed frame", tuple(FRAME_METADATA), {"source": SOURCES}),
    Contract("frame_features", "silver", "processed frame", tuple(FRAME_FEATURES)),
    Contract("video_features", "silver", "video", tuple(VIDEO_FEATURES)),
    Contract("gold_training_dataset", "gold", "trainable video", tuple(GOLD), {"dataset_split": SPLITS, "quality_flag": FLAGS}),
    Contract("prediction_payload", "serving", "analysed video", tuple(PREDICTION), {"prediction": ("Real", "Fake", "Unknown"), "processing_status": ("success", "failed", "partial")}),
]
CONTRACTS = {c.name: c for c in _ALL}

RESULT = "contract_name STRING, path STRING, exists BOOLEAN, row_count BIGINT, missing_columns ARRAY<STRING>, invalid_values MAP<STRING, ARRAY<STRING>>, status STRING"


def validate(df: DataFrame, name: str, path: str = "") -> DataFrame:
    """One row of RESULT's columns from one pass over the table.

    Values are compared stripped, null counts as an empty string. Only the columns with accepted values are read, and of
    them only what isn't accepted is gathered.
    """
    contract = CONTRACTS[name]
    missing = contract.missing(df.columns)
    checked = {c: v for c, v in contract.accepted.items() if c in df.columns}
    rejected = lambda c, v: F.when(~text_or_empty(c).isin(*v), text_or_empty(c))
    row = df.agg(F.count(F.lit(1)).alias("row_count"), *(F.array_sort(F.collect_set(rejected(c, v))).alias(f"bad_{c}") for c, v in checked.items()))
    entries = [F.struct(F.lit(c).alias("key"), F.col(f"bad_{c}").alias("value")) for c in checked]
    none = F.array().cast("array<struct<key:string,value:array<string>>>")
    row = row.withColumn("invalid_values", F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0) if entries else none))
    passed = F.lit(not missing) & (F.size("invalid_values") == 0)
    return row.select(
        F.lit(name).alias("contract_name"),
        F.lit(path).alias("path"),
        F.lit(True).alias("exists"),
        "row_count",
        F.array(*map(F.lit, missing)).cast("array<string>").alias("missing_columns"),
        "invalid_values",
        F.when(passed, "passed").otherwise("failed").alias("status"),
    )


def absent(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The result for a table that isn't there."""
    return spark.createDataFrame([(name, path, False, 0, list(CONTRACTS[name].required), {}, "missing")], RESULT)


def summarize(results: DataFrame) -> DataFrame:
    """One row: passed if every result is, and how many there are of either kind."""
    ok = F.col("status") == "passed"
    return results.agg(
        F.when(F.coalesce(F.bool_and(ok), F.lit(True)), "passed").otherwise("failed").alias("status"),
        F.count(F.lit(1)).alias("validated_assets"),
        F.count_if(~ok).alias("failed_assets"),
    )
