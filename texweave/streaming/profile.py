"""The corpus profile as a stream that ends when its input does."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texweave.functions.vocabulary import Vocabulary
from texweave.operators.lineage import checkpoint_dir
from texweave.operators.policy import Policy, judged, measured, subset_name


def counters(records: DataFrame, vocabulary: Vocabulary, policy: Policy) -> DataFrame:
    """Counters by subset that a stream can keep: sums only, state bounded by the subsets."""
    told = judged(measured(records, vocabulary), policy)
    return told.groupBy(subset_name(F.col("subset")).alias("subset")).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if("accepted").alias("accepted_samples"),
        F.count_if(F.col("unknown") > 0).alias("unknown_samples"),
        F.sum("unknown").alias("unknown_token_count"),
        F.sum("n").alias("total_token_count"),
        F.max("n").alias("max"),
    )


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a streaming query on what is there and returns its last result."""
    spark = stream.sparkSession
    name = f"profile_{uuid.uuid4().hex}"
    folder = f"{checkpoint_dir(spark)}/{name}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
