"""A corpus pipeline of five stages: language ID, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Nulls, empty texts, repeated rows and extra columns are treated as by the operators. A stage selects its columns by name, so
columns of other names that docs may have are dropped by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.llm import byte_bpe, decontaminate, language_id, line_dedup, near_dup
from specula.llm.common import new_path, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates have 0.8 or more of their five-word shingles in common.
NEAR_WORDS, NEAR_PERCENT = 5, 80
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are in no one language: null texts, those without a letter, and those of which no language holds
    a quarter of the letters. lang becomes the language that the text shows, also where it was null or told another.

    The labels are learnt from the documents that no accuracy is measured on.
    """
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs.filter(~language_id.held_out()))
    # The operator hands its rows on with the text, so the decision needs no join.
    return language_id.keep_known(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines of three-line windows that stand earlier; n_chars follows the text. No document is dropped."""
    return line_dedup.line_dedup_rows(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays."""
    groups = near_dup.near_duplicates(docs, NEAR_WORDS, NEAR_PERCENT)
    gone = groups.filter("id <> component_id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids): the token ids of what stayed, in the order of the text.

    The round trip is checked on every document: one that doesn't decode to its text ends the job.
    """
    out = byte_bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, carry=("lang", "source", "text"))
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    ids = F.when(whole, F.col("ids")).otherwise(F.raise_error(F.concat(F.lit("no round trip: document "), F.col("id").cast("string"))))
    return out.select(F.col("id").alias("doc_id"), "lang", "source", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids"))


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: Language ID and tokens can't be expressed in SQL; the tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; between stages the rows are in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
