"""Exact dedup with a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A new batch is first reduced to one row per digest (map-side
combined, so a text that makes up a third of all rows costs one row a task), anti-joined against the index by sort-merge
on the bucketing, and what is new is appended. The index itself is never shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.llm.common import delete, lower_ascii, new_path, written


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 after lower-casing A-Z; null counts as empty."""
    return F.unhex(F.sha2(lower_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256))


class DigestIndex:
    """A table (digest BINARY, keep_id BIGINT, n_rows BIGINT) at ``path``, bucketed and sorted by digest.

    Opening the same path again, also in another session, continues the index. ``buckets`` must stay the same for one path.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, n_rows BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def fresh(self, groups: DataFrame) -> DataFrame:
        """The rows of groups whose digest the index doesn't hold, by a sort-merge anti-join on the bucketing."""
        return groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def held(self, groups: DataFrame) -> DataFrame:
        """The index's rows for the digests of groups, by a sort-merge semi-join on the bucketing."""
        return self.table().join(groups.select("digest").hint("merge"), "digest", "left_semi")

    def append(self, groups: DataFrame) -> None:
        groups.select("digest", "keep_id", "n_rows").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        """Forget the table and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def dedup(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add the texts of ``df`` to the index and tell for every row which row of its text stays.

    Returns (id, keep_id, group_size, kept, digest), one row for each row of df. Texts that the index held before keep the
    row it names, and group_size is what it counted when it first saw the text. Null and empty texts are one group. Rows
    that repeat an id are all kept or all dropped with it. A null id never stays unless its group has no other id. An
    empty table gives an empty result. Other columns are not read. The result doesn't read the index any more.

    The index is read along its buckets and never shuffled; what moves is one row for each text of the batch.
    """
    digests = written(df.select(F.col(id_col).cast("long").alias("id"), text_digest(F.col(text_col)).alias("digest")), "digests")
    groups = written(digests.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n_rows")), "groups")
    # First what the index knows, then what it doesn't: together a row for each text of the batch.
    row = ("digest", "keep_id", "n_rows")
    named = written(index.held(groups).select(*row, F.lit(False).alias("new")).unionByName(index.fresh(groups).select(*row, F.lit(True).alias("new"))), "named")
    index.append(named.filter("new"))
    return digests.join(named, "digest").select(
        "id", "keep_id", F.col("n_rows").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def op4_exact_dedup(docs: DataFrame) -> DataFrame:
    """Dedup against an index of its own, which is gone afterwards."""
    spark = docs.sparkSession
    index = DigestIndex(spark, new_path(spark, "digest-index"))
    out = dedup(docs, index)
    index.drop()
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
