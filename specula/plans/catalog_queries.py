"""Queries over documents and pages: they stand for the source catalog, the manifest, and the gold table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specula import contracts
from specula.functions import scalars as S
from specula.operators import boxes, gold, ingest, quality
from specula.plans import frame_queries
from specula.sources import tables


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def _sha(x) -> F.Column:
    return F.sha2(x.cast("binary"), 256)


def _url(key):
    return F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/watch?v="), F.substring(_sha(key), 1, 3), F.lit("&t="), (F.col("doc_id") % 3).cast("string"))


def catalog(spark, d) -> DataFrame:
    """documents with their label; the video's id is the document's, its hash that of the text."""
    docs, labels = _read(spark, d, "documents"), _read(spark, d, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("doc_id").cast("string").alias("video_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".mp4")).alias("Filename"),
        F.when(F.col("quality") == 1, " true ").when(F.col("quality") == 0, "IA").alias("label"),
        "source",
        "lang",
        "n_chars",
        _sha(F.coalesce("text", F.lit(""))).alias("sha256"),
        _url(F.coalesce("text", F.lit(""))).alias("source_url"),
        _url(F.concat("lang", F.col("doc_id").cast("string"))).alias("record_url"),
    )


CATALOG = """cat AS (
  SELECT d.doc_id, d.doc_id::VARCHAR AS video_id, d.doc_id || '.mp4' AS "Filename",
         CASE quality WHEN 1 THEN ' true ' WHEN 0 THEN 'IA' END AS label, source, lang, n_chars, sha256(coalesce(text, '')) AS sha256,
         'https://' || source || '.example.org/watch?v=' || substr(sha256(coalesce(text, '')), 1, 3) || '&t=' || d.doc_id % 3 AS source_url,
         'https://' || source || '.example.org/watch?v=' || substr(sha256(lang || d.doc_id), 1, 3) || '&t=' || d.doc_id % 3 AS record_url
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), norm AS (SELECT *, CASE label WHEN ' true ' THEN 'Real' WHEN 'IA' THEN 'Fake' ELSE '' END AS normal FROM cat)"""


def manifest(spark, d) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("downloaded", "skipped", "failed", "pending", " ok"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return catalog(spark, d).select(
        F.substring("sha256", 1, 3).alias("video_id"), "source_url", F.col("Filename").alias("filename"), F.concat(F.lit("/v/"), F.col("Filename")).alias("storage_path"), "sha256",
        F.lit("2024-01-01T00:00:00+00:00").alias("downloaded_at"), S.normalize_label("label").alias("label"), status.alias("status"), F.lit("").alias("error_message"), F.lit("youtube").alias("source_type"),
    )


MANIFEST = (
    CATALOG
    + """, man AS (
  SELECT substr(sha256, 1, 3) AS video_id, source_url, "Filename" AS filename, '/v/' || "Filename" AS storage_path, sha256,
         '2024-01-01T00:00:00+00:00' AS downloaded_at, normal AS label,
         CASE doc_id % 5 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'skipped' WHEN 2 THEN 'failed' WHEN 3 THEN 'pending' ELSE ' ok' END AS status,
         '' AS error_message, 'youtube' AS source_type FROM norm
)"""
)


def _files(spark, d, key: str) -> DataFrame:
    c = catalog(spark, d)
    return c.select(F.substring(_sha(F.concat(F.lit(key), "video_id")), 1, 3).alias("video_id"), F.concat(F.lit(f"/{key}/"), "Filename").alias("path"), "sha256")


def _files_sql(key: str) -> str:
    return f"""SELECT substr(sha256('{key}' || video_id), 1, 3) AS video_id, '/{key}/' || "Filename" AS path, sha256 FROM cat"""


def ingest_decision(spark, d):
    records = catalog(spark, d).select(F.col("record_url").alias("source_url"), "label", F.lit("youtube").alias("source_type")).distinct()
    fetch = ingest.local_fetch(_files(spark, d, "g"))
    return ingest.ingest(records, manifest(spark, d), _files(spark, d, "f"), fetch, "2024-02-02T00:00:00+00:00")


INGEST_SQL = f"""WITH {MANIFEST}, rec AS (
  SELECT DISTINCT record_url AS source_url, regexp_extract(record_url, 'v=([0-9a-f]+)', 1) AS video_id, normal AS label FROM norm
), ok AS (SELECT * FROM man WHERE status IN ('downloaded', 'skipped')),
f AS (SELECT video_id, min(path) AS path, arg_min(sha256, path) AS sha FROM ({_files_sql("f")}) GROUP BY 1),
g AS (SELECT video_id, min(path) AS path, arg_min(sha256, path) AS sha FROM ({_files_sql("g")}) GROUP BY 1),
j AS (
  SELECT rec.*, f.path AS fpath, f.sha AS fsha, g.path AS gpath, g.sha AS gsha,
    CASE WHEN rec.source_url IN (SELECT source_url FROM ok) THEN 'source_url already present in manifest'
         WHEN rec.video_id IN (SELECT video_id FROM ok) THEN 'video_id already present in manifest'
         WHEN f.path IS NOT NULL THEN 'video file already exists in Bronze' END AS why,
    coalesce(g.sha IN (SELECT sha256 FROM ok), false) AS seen
  FROM rec LEFT JOIN f USING (video_id) LEFT JOIN g USING (video_id)
)
SELECT video_id, source_url, coalesce(regexp_extract(CASE WHEN why IS NOT NULL THEN fpath ELSE gpath END, '[^/]*$'), '') AS filename,
  coalesce(CASE WHEN why IS NOT NULL THEN fpath ELSE gpath END, '') AS storage_path,
  coalesce(CASE WHEN why IS NOT NULL THEN fsha ELSE gsha END, '') AS sha256, '2024-02-02T00:00:00+00:00' AS downloaded_at, label,
  CASE WHEN why IS NOT NULL THEN 'skipped' WHEN gpath IS NULL THEN 'failed' WHEN seen THEN 'skipped' ELSE 'downloaded' END AS status,
  coalesce(why, CASE WHEN gpath IS NULL THEN 'not found' WHEN seen THEN 'sha256 already present in manifest' ELSE '' END) AS error_message,
  'youtube' AS source_type FROM j"""


def features(spark, d) -> DataFrame:
    """A video_features table: counts and ratio follow from the number of characters."""
    c, n = catalog(spark, d), F.col("n_chars")
    return c.select("video_id", S.normalize_label("label").alias("label"), F.col("Filename").alias("filename"), (n % 7).cast("int").alias("n_frames"), (n % 5).cast("int").alias("metadata_rows_used"), ((n % 21) / 20.0).alias("missing_feature_ratio"))


FEATURES = (
    CATALOG
    + """, feat AS (
  SELECT video_id, normal AS label, "Filename" AS filename, (n_chars % 7)::INT AS n_frames, (n_chars % 5)::INT AS metadata_rows_used,
         (n_chars % 21) / 20.0::DOUBLE AS missing_feature_ratio FROM norm
), flagged AS (
  SELECT *, label AS target_label, CASE WHEN label NOT IN ('Real', 'Fake') THEN 'missing_label' WHEN n_frames <= 0 OR metadata_rows_used <= 0 THEN 'insufficient_metadata'
    WHEN missing_feature_ratio >= 1 THEN 'feature_failure' WHEN missing_feature_ratio > 0.5 THEN 'review' ELSE 'ok' END AS quality_flag FROM feat
), trainable AS (SELECT *, quality_flag = 'ok' AS is_trainable FROM flagged),
hashed AS (SELECT *, ('0x' || substr(sha256('42:' || target_label || ':' || video_id), 1, 12))::BIGINT / 281474976710655.0::DOUBLE AS x FROM trainable),
gold AS (SELECT *, CASE WHEN NOT is_trainable THEN 'unassigned' WHEN x < 0.7::DOUBLE THEN 'train' WHEN x < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS dataset_split FROM hashed)"""
)


def links_dedup(spark, d):
    c = catalog(spark, d)
    return ingest.distinct_links(c.select(F.col("doc_id").alias("pos"), F.col("source_url").alias("link")), c.select(F.col("doc_id").alias("pos"), F.concat(F.lit(" "), F.col("record_url"), F.lit("\t")).alias("link")))


def contract_validate(spark, d):
    r = contracts.validate(manifest(spark, d), "bronze_manifest")
    return r.select("contract_name", "status", "row_count", F.array_join("missing_columns", ",").alias("missing_columns"), F.array_join(F.coalesce(F.try_element_at("invalid_values", F.lit("status")), F.array().cast("array<string>")), ",").alias("invalid_status"))


def contract_summary(spark, d):
    g = gold.gold(features(spark, d)).withColumn("pipeline_version", F.lit("1"))
    return contracts.summarize(contracts.validate(manifest(spark, d), "bronze_manifest").unionByName(contracts.validate(g, "gold_training_dataset")))


def union_mixed(spark, d):
    a = _read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = _read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"), F.col("p_name").alias("name"))
    return tables.union_tables([a, b])


def _folder(spark, tag: str) -> str:
    """A new folder in the shared folder, or below the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{path.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def sink_roundtrip(spark, d):
    """customer written as Parquet and read back."""
    return tables.read_table(spark, tables.write_table(_read(spark, d, "customer"), _folder(spark, "roundtrip") + ".parquet"))


def scan_many(spark, d):
    """Two tables and a file that is none, below one folder, as one table."""
    folder = _folder(spark, "many")
    for t in ("nation", "region"):
        tables.write_table(_read(spark, d, t), f"{folder}/{t}.parquet")
    return tables.read_many(spark, folder)


def metadata_json(spark, d):
    """Boxes of all frames written as JSON, a document a video, and read back."""
    box = lambda c: F.array(*(F.col(f"{c}.{k}") for k in S.BOX))
    rows = boxes.fill(frame_queries.frames(spark, d))
    rows = rows.select(F.col("video_id").cast("string").alias("video_id"), "frame_id", box("bbox").alias("bbox"), box("bbox_expanded").alias("bbox_expanded"), "source", "detector_score", "frame_width", "frame_height")
    folder = tables.write_metadata(rows, _folder(spark, "metadata"))
    back = tables.read_metadata(spark, f"{folder}/*/")
    return back.select("video_id", "metadata_idx", "frame_id", *(F.col("bbox")[k].alias(b) for k, b in enumerate(S.BOX)), "source", "detector_score", "frame_width")


def content_sha256(spark, d):
    """A file of every supplier's name, hashed."""
    folder = _folder(spark, "files")
    _read(spark, d, "supplier").select("s_suppkey", "s_name").write.partitionBy("s_suppkey").text(folder)
    files = tables.content_hashes(spark, f"{folder}/*/*.txt")
    return files.select(F.regexp_extract("path", "s_suppkey=([0-9]+)", 1).cast("long").alias("s_suppkey"), "sha256")


def json_sanitize(spark, d):
    e = _read(spark, d, "events")
    v = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 == 1, F.lit(float("inf"))).otherwise(F.round("value", 2))
    rows = e.select("event_id", v.alias("value"), F.array(F.col("user_id").cast("double"), v).alias("pair"))
    return tables.to_json_rows(rows).select(
        F.get_json_object("json", "$.event_id").cast("long").alias("event_id"), F.get_json_object("json", "$.value").try_cast("double").alias("value"), F.get_json_object("json", "$.pair[0]").try_cast("double").alias("first"),
        F.get_json_object("json", "$.pair[1]").try_cast("double").alias("second"),
    )


def _gold(spark, d):
    return gold.gold(features(spark, d))


QUERIES = {
    "scan_table": (lambda s, d: tables.read_table(s, f"{d}/orders.csv").filter("o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_orderpriority"), "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 100000"),
    "scan_many": (scan_many, "SELECT n_nationkey, n_name, n_regionkey, NULL::INT AS r_regionkey, NULL AS r_name FROM nation UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region"),
    "sink_roundtrip": (sink_roundtrip, "SELECT * FROM customer"),
    "json_sanitize": (json_sanitize, "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN round(value, 2) END AS value, user_id::DOUBLE AS first, CASE WHEN event_id % 3 = 2 THEN round(value, 2) END AS second FROM events"),
    "metadata_json": (
        metadata_json,
        f"WITH {frame_queries.FRAMES} SELECT video_id::VARCHAR AS video_id, frame_id AS metadata_idx, frame_id, f.x1, f.y1, f.x2, f.y2, source, score AS detector_score, w AS frame_width FROM exp",
    ),
    "catalog_scan": (lambda s, d: tables.with_video_path(catalog(s, d), "/v").select("video_id", "Filename", "video_path"), f'WITH {CATALOG} SELECT video_id, "Filename", \'/v/\' || "Filename" AS video_path FROM cat'),
    "source_records": (
        lambda s, d: tables.source_records(catalog(s, d).withColumn("Media", F.when(F.col("source") == "src0", F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("source_url"), F.lit(" ")))), label_column="label"),
        f"WITH {CATALOG} SELECT source_url, coalesce(trim(label), '') AS label, 'youtube' AS source_type FROM cat WHERE source <> 'src0'",
    ),
    "label_normalize": (lambda s, d: catalog(s, d).select("video_id", S.normalize_label("label").alias("label")), f"WITH {CATALOG} SELECT video_id, normal AS label FROM norm"),
    "label_counts": (lambda s, d: catalog(s, d).groupBy(S.normalize_label("label").alias("label")).count().withColumnRenamed("count", "n"), f"WITH {CATALOG} SELECT normal AS label, count(*) AS n FROM norm GROUP BY 1"),
    "url_video_id": (
        lambda s, d: _read(s, d, "pages").select("page_id", S.video_id_from_url("url", "ref").alias("by_ref"), S.video_id_from_url("url", "page").alias("by_page"), S.video_id_from_url(F.replace("url", F.lit(".com"), F.lit(".youtu.be"))).alias("short"), S.video_id_from_url(F.regexp_replace("url", "/(en|fr|de|es)/", "/shorts/")).alias("shorts")),
        r"""SELECT page_id, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS by_ref, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS by_page,
            CASE WHEN url LIKE '%.com/%' THEN regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) ELSE '' END AS short,
            regexp_extract(regexp_replace(url, '/(en|fr|de|es)/', '/shorts/'), '^https?://[^/]+/shorts/([^/?#]*)', 1) AS shorts FROM pages""",
    ),
    "links_dedup": (
        links_dedup,
        f"""WITH {CATALOG}, l AS (SELECT 0 AS part, doc_id AS pos, source_url AS link FROM cat UNION ALL SELECT 1, doc_id, record_url FROM cat)
            SELECT link, min(part) AS part, arg_min(pos, part * 1000000000000 + pos) AS pos FROM l GROUP BY link""",
    ),
    "content_sha256": (content_sha256, "SELECT s_suppkey::BIGINT AS s_suppkey, sha256(s_name || chr(10)) AS sha256 FROM supplier"),
    "manifest_index": (
        lambda s, d: tables.union_tables([ingest.success_index(manifest(s, d), c).select(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("video_id", "sha256", "source_url")]),
        f"WITH {MANIFEST}, ok AS (SELECT * FROM man WHERE status IN ('downloaded', 'skipped')) SELECT DISTINCT 'video_id' AS kind, video_id AS value FROM ok UNION SELECT 'sha256', sha256 FROM ok UNION SELECT 'source_url', source_url FROM ok",
    ),
    "manifest_project": (
        lambda s, d: tables.manifest_rows(manifest(s, d).drop("error_message").withColumn("extra", F.lit(1)).withColumn("title", F.when(F.col("status") == "failed", "x"))),
        f"WITH {MANIFEST} SELECT *, CASE WHEN status = 'failed' THEN 'x' ELSE '' END AS title, '' AS duration, '' AS uploader, '' AS webpage_url FROM man",
    ),
    "existing_file": (
        lambda s, d: ingest.decide(catalog(s, d).select(F.col("record_url").alias("source_url"), "label"), manifest(s, d), _files(s, d, "f")).select("source_url", F.col("existing_file.path").alias("path")).distinct(),
        f"""WITH {CATALOG}, f AS (SELECT video_id, min(path) AS path FROM ({_files_sql("f")}) GROUP BY 1)
            SELECT DISTINCT record_url AS source_url, f.path FROM cat LEFT JOIN f ON f.video_id = regexp_extract(record_url, 'v=([0-9a-f]+)', 1)""",
    ),
    "ingest_decision": (ingest_decision, INGEST_SQL),
    "catalog_semi": (
        lambda s, d: ingest.with_files(catalog(s, d).select("video_id", "lang"), _read(s, d, "labels").select(F.col("doc_id").cast("string").alias("path")), "video_id"),
        f"WITH {CATALOG} SELECT video_id, lang FROM cat WHERE doc_id IN (SELECT doc_id FROM labels)",
    ),
    "catalog_anti": (
        lambda s, d: ingest.without_output(catalog(s, d).select("video_id", "lang"), _read(s, d, "labels").select(F.col("doc_id").cast("string").alias("video_id"))),
        f"WITH {CATALOG} SELECT video_id, lang FROM cat WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "catalog_limit": (lambda s, d: catalog(s, d).orderBy("doc_id").limit(50).select("video_id"), f"WITH {CATALOG} SELECT video_id FROM cat ORDER BY doc_id LIMIT 50"),
    "bronze_quality": (
        lambda s, d: quality.bronze(manifest(s, d)),
        f"""WITH {MANIFEST} SELECT count(*) AS input_rows, count(*) FILTER (status = 'downloaded') AS downloaded, count(*) FILTER (status = 'failed') AS failed,
            count(*) FILTER (status = 'skipped') AS skipped, count(DISTINCT video_id) AS unique_videos FROM man""",
    ),
    "hash_fraction": (
        lambda s, d: catalog(s, d).select("video_id", S.hash_fraction(F.concat(F.col("lang"), F.lit(":"), F.col("video_id"))).alias("x")),
        f"WITH {CATALOG} SELECT video_id, ('0x' || substr(sha256('42:' || lang || ':' || video_id), 1, 12))::BIGINT / 281474976710655.0::DOUBLE AS x FROM cat",
    ),
    "gold_splits": (lambda s, d: _gold(s, d).select("video_id", "dataset_split"), f"WITH {FEATURES} SELECT video_id, dataset_split FROM gold"),
    "gold_quality_flag": (lambda s, d: _gold(s, d).select("video_id", "quality_flag"), f"WITH {FEATURES} SELECT video_id, quality_flag FROM gold"),
    "gold_trainable": (lambda s, d: _gold(s, d).select("video_id", "is_trainable"), f"WITH {FEATURES} SELECT video_id, is_trainable FROM gold"),
    "gold_quality": (
        lambda s, d: quality.gold(_gold(s, d)).select("rows", "trainable_rows", "real_count", "fake_count", *(F.coalesce(F.try_element_at("split_distribution", F.lit(k)), F.lit(0).cast("long")).alias(k) for k in contracts.SPLITS)),
        f"""WITH {FEATURES} SELECT count(*) AS rows, count(*) FILTER (is_trainable) AS trainable_rows, count(*) FILTER (target_label = 'Real') AS real_count,
            count(*) FILTER (target_label = 'Fake') AS fake_count, """
        + ", ".join(f"count(*) FILTER (dataset_split = '{k}') AS {k}" for k in contracts.SPLITS)
        + " FROM gold",
    ),
    "contract_validate": (
        contract_validate,
        f"""WITH {MANIFEST}, bad AS (SELECT coalesce(string_agg(DISTINCT trim(status), ',' ORDER BY trim(status)), '') AS b FROM man WHERE trim(status) NOT IN ('pending', 'downloaded', 'failed', 'skipped'))
            SELECT 'bronze_manifest' AS contract_name, CASE WHEN b = '' THEN 'passed' ELSE 'failed' END AS status, (SELECT count(*) FROM man) AS row_count, '' AS missing_columns, b AS invalid_status FROM bad""",
    ),
    "contract_summary": (
        contract_summary,
        f"WITH {MANIFEST}, b AS (SELECT count(*) AS k FROM man WHERE trim(status) = 'ok') SELECT CASE WHEN k = 0 THEN 'passed' ELSE 'failed' END AS status, 2::BIGINT AS validated_assets, (k > 0)::INT::BIGINT AS failed_assets FROM b",
    ),
    "union_mixed": (union_mixed, "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, NULL::INT AS size FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_size FROM part"),
}
