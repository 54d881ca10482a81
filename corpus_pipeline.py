"""The corpus pipeline: quality, near duplicates, benchmark overlap, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept; all but the
last return the columns of ``documents``. Between stages the rows are written to the shared folder
and read again, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import decontaminate, near_dup, piece_bpe, pii, quality
from quillmill.llm.common import sized, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go."""
    return quality.keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; of rows that repeat id and text, one.

    Rows of one id with unlike texts are decided each by its own text. Rows without an id stay, as nothing tells them apart.
    """
    docs = docs.select(*COLUMNS).withColumn("_text", F.xxhash64("text"))
    found = near_dup.near_duplicates(docs, carried=("_text",)).where("doc_id is not null")
    groups = written(found.groupBy("doc_id", "_text").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "groups")
    gone = written(groups.where("not kept").select(F.col("doc_id").alias("_gone"), F.col("_text").alias("_gone_text")), "gone")
    left = docs.join(sized(gone), (F.col("doc_id") == F.col("_gone")) & (F.col("_text") == F.col("_gone_text")), "left_anti")
    if not groups.where("rows > 1").isEmpty():
        left = left.where("doc_id is not null").dropDuplicates(["doc_id", "_text"]).unionByName(left.where("doc_id is null"))
    return left.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text."""
    return pii.mask(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Ids of each text and the text that they decode to."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_bpe.encode(docs.select("doc_id", "lang", "source", "text"), model_path, decoded="decoded").drop("text")


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("piece_ids", encode_pieces),
]

#: A trained classifier and a tokenizer can't be put in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
