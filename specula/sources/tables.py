"""Tables, reports and file listings by path, on any file system that Hadoop knows."""

from __future__ import annotations

import json
import math

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType

from specula.contracts import MANIFEST, MANIFEST_EXTRA
from specula.functions.scalars import json_number, strip

LISTING = "path STRING, name STRING, length BIGINT"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def uri(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString()


def list_files(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """Names below a folder that end with suffix, sorted; none for a folder that isn't there."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(suffix))


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length) of the files below a folder, without reading them; empty if the folder isn't there."""
    if not exists(spark, path):
        return spark.createDataFrame([], LISTING)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files. A file is hashed by one task, in one piece."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_table(spark: SparkSession, path: str, schema: str | StructType | None = None, ignore_corrupt: bool = False) -> DataFrame:
    """A Parquet or CSV table by its suffix; where it isn't there, the same name with the other suffix."""
    kind = _suffix(path)
    if kind not in (".parquet", ".csv"):
        raise ValueError(f"unknown kind of table: {path}")
    if not exists(spark, path):
        other = path[: -len(kind)] + (".csv" if kind == ".parquet" else ".parquet")
        if not exists(spark, other):
            raise FileNotFoundError(path)
        path, kind = other, _suffix(other)
    reader = (spark.read.schema(schema) if schema else spark.read).option("ignoreCorruptFiles", str(ignore_corrupt).lower())
    return reader.parquet(path) if kind == ".parquet" else reader.csv(path, header=True, multiLine=True, escape='"')


def write_table(df: DataFrame, path: str) -> str:
    """Overwrite a table, Parquet or CSV by its suffix (CSV for any other); returns the path written."""
    kind = _suffix(path)
    if kind == ".parquet":
        df.write.mode("overwrite").parquet(path)
        return path
    path = path if kind == ".csv" else path + ".csv"
    df.write.mode("overwrite").csv(path, header=True, escape='"')
    return path


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one of this schema where there is none that can be read; corrupt files of it are passed over."""
    try:
        return read_table(spark, path, ignore_corrupt=True)
    except (FileNotFoundError, ValueError, PySparkException):
        return spark.createDataFrame([], schema)


def read_many(spark: SparkSession, folder: str, kind: str = "parquet") -> DataFrame | None:
    """All tables of one kind below a folder as one, columns that some lack are null; unreadable files are passed over."""
    names = list_files(spark, folder, "." + kind)
    if not names:
        return None
    reader = spark.read.option("ignoreCorruptFiles", "true")
    paths = [f"{folder}/{n}" for n in names]
    if kind == "parquet":
        return reader.option("mergeSchema", "true").parquet(*paths)
    parts = [reader.csv(p, header=True) for p in paths]  # headers may differ from file to file
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def first_rows(df: DataFrame, n: int | None) -> DataFrame:
    """The first n rows in the order in which the files are read; all for None."""
    if n is None:
        return df
    return df.withColumn("_order", F.monotonically_increasing_id()).orderBy("_order").limit(n).drop("_order")


def union_tables(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def _jsonable(column, kind):
    if isinstance(kind, (DoubleType, FloatType)):
        return json_number(column)
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: _jsonable(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(column, lambda k, v: _jsonable(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(column.isNotNull(), F.struct(*(_jsonable(column[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return column


def to_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON string per row; NaN and infinities are null in it."""
    clean = F.struct(*(_jsonable(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields))
    return df.select(F.to_json(clean, {"ignoreNullFields": "false"}).alias(name))


def plain(value):
    """A report's value as JSON takes it."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if hasattr(value, "item") and not isinstance(value, (str, bytes)):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def write_json(spark: SparkSession, data: dict, path: str) -> str:
    """A report, which is small, as one JSON file."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(plain(data), ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()
    return path


BOXES = "video_id STRING, frame_id INT, bbox ARRAY<INT>, bbox_expanded ARRAY<INT>, source STRING, detector_score DOUBLE, frame_width INT, frame_height INT, processed_at STRING, pipeline_version STRING"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Face boxes from JSON files that hold a list of objects each, with their place in the list."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"ARRAY<STRUCT<{_fields(BOXES)}>>").alias("rows"))
    return whole.select("file", F.posexplode("rows").alias("metadata_idx", "row")).select("file", "metadata_idx", "row.*")


def _fields(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ", 1) for x in ddl.split(", ")))


def write_metadata(rows: DataFrame, folder: str) -> str:
    """A JSON document per video, its frames in order, as one line of text in a partition of the video's name."""
    listed = F.sort_array(F.collect_list(F.struct("frame_id", *[c for c in rows.columns if c not in ("frame_id", "video_id")], "video_id")))
    rows.groupBy("video_id").agg(F.to_json(listed).alias("value")).write.mode("overwrite").partitionBy("video_id").text(folder)
    return folder


def read_sources(spark: SparkSession, path: str, url_column: str = "Media", label_column: str = "Video Ground Truth") -> DataFrame:
    return source_records(spark.read.csv(path, header=True), url_column, label_column)


def source_records(rows: DataFrame, url_column: str = "Media", label_column: str = "Video Ground Truth", source_type: str = "youtube") -> DataFrame:
    """(source_url, label, source_type) of the rows that have a URL."""
    url, label = F.coalesce(F.col(url_column), F.lit("")), F.coalesce(F.col(label_column), F.lit(""))
    return rows.select(strip(url).alias("source_url"), strip(label).alias("label"), F.lit(source_type).alias("source_type")).filter("source_url <> ''")


def read_catalog(spark: SparkSession, path: str, videos: str) -> DataFrame:
    return with_video_path(spark.read.csv(path, header=True), videos)


def with_video_path(catalog: DataFrame, videos: str) -> DataFrame:
    if "Filename" not in catalog.columns:
        raise ValueError("the catalog has no column Filename")
    return catalog.withColumn("video_path", F.concat_ws("/", F.lit(videos), F.col("Filename")))


def manifest_rows(rows: DataFrame) -> DataFrame:
    """The manifest's columns in their order; what rows lack is an empty string."""
    have = set(rows.columns)
    return rows.select(*((F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in [*MANIFEST, *MANIFEST_EXTRA]))


def append_manifest(rows: DataFrame, path: str) -> str:
    manifest_rows(rows).write.mode("append").parquet(path)
    return path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_optional(spark, path, ", ".join(f"{c} STRING" for c in [*MANIFEST, *MANIFEST_EXTRA]))


class Layout:
    """Where the tables of a run lie below one root."""

    def __init__(self, root: str):
        root = root.rstrip("/")
        self.catalog, self.videos, self.manifest = f"{root}/bronze/catalog.csv", f"{root}/bronze/videos", f"{root}/bronze/manifest.parquet"
        self.metadata_json = f"{root}/silver/face_metadata_json"
        self.metadata, self.frames = f"{root}/silver/face_metadata.parquet", f"{root}/silver/frames.parquet"
        self.frame_features, self.video_features = f"{root}/silver/frame_features.parquet", f"{root}/silver/video_features.parquet"
        self.gold, self.reports = f"{root}/gold/training_dataset.parquet", f"{root}/reports"

    def report(self, stamp: str) -> str:
        return f"{self.reports}/quality_{stamp}.json"
