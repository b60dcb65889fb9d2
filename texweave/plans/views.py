"""The driver's tables seen as formula records, pairs, rasters and logits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from texweave.functions import latex
from texweave.functions.vocabulary import Vocabulary
from texweave.operators import policy as P

VOCABULARY = Vocabulary.core()
MAX_LENGTH = 1027
KEEP_DROP = P.Policy(MAX_LENGTH, "keep", "drop")
DROP_DROP = P.Policy(MAX_LENGTH, "drop", "drop")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.col("text").alias("raw_latex"), F.col("lang").alias("subset"), "source")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.measured(records(spark, sf_dir), VOCABULARY)


def judged(spark: SparkSession, sf_dir: str, policy: P.Policy = KEEP_DROP) -> DataFrame:
    return P.judged(measured(spark, sf_dir), policy)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as prediction, the next as reference; ``pair_id, p, r``."""
    turns = table(spark, sf_dir, "conversations")
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns.withColumn("reference", following).filter("reference is not null")
    side = latex.split_white
    return rows.select(F.concat_ws(":", "conv_id", "turn").alias("pair_id"), side(F.col("text")).alias("p"), side(F.col("reference")).alias("r"))


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 rasters of the embeddings' 64 values as bytes."""
    byte = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v.cast("double") * 256 + 128))).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", byte).alias("px"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.col("embedding").alias("z"), F.when(F.col("vec_id") % 7 == 0, -100).otherwise(F.col("label")).alias("label"))


def state_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixed tensors of the documents; some rows are foreign."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.when(F.col("doc_id") % 11 == 0, "decoder.").otherwise("encoder."), F.lit("w"), F.col("doc_id").cast("string"))
    return docs.select(name.alias("name"), F.array((F.col("doc_id") % 5).cast("int"), F.lit(3)).alias("shape"))


def state_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return rows.select(F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("name"), F.array((F.col("doc_id") % 5).cast("int"), (F.lit(3) + F.col("toxic")).cast("int")).alias("shape"), F.col("doc_id").alias("pos"))
