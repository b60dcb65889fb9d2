"""From split manifests to guarded, padded batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texweave.functions import latex, vocabulary
from texweave.functions.vocabulary import BOS, EOS, PAD, Vocabulary
from texweave.operators import batching, policy
from texweave.plans.config import DataConfig
from texweave.sources import manifest

SPLITS = ("train", "val", "test")
#: The splits that each stage sets up.
STAGES = {None: SPLITS, "fit": ("train", "val"), "validate": ("val",), "test": ("test",)}


def normalized(rows: DataFrame) -> Column:
    """The stored normalized text of a row, or that of ``raw_latex`` where none is stored."""
    own = latex.normalize(F.col("raw_latex"))
    return F.coalesce(F.col("normalized_latex"), own) if "normalized_latex" in rows.columns else own


def _guard(holds: Column, message: Column, value: Column) -> Column:
    """``value``, or an error where a guard does not hold."""
    return F.when(holds, value).otherwise(F.raise_error(message).cast("array<int>"))


def guarded(rows: DataFrame, max_sequence_length: int, ids: str = "ids", key: str = "id") -> DataFrame:
    """``rows`` whose ids are no longer than allowed and stand between BOS and EOS; any other row is an error that names it."""
    if max_sequence_length < 2:
        raise ValueError("max_sequence_length must hold BOS and EOS")
    found = F.col(ids)
    short = F.size(found) <= max_sequence_length
    bounded = (F.size(found) >= 2) & (F.get(found, F.lit(0)) == BOS) & (F.element_at(found, -1) == EOS)
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    long = F.concat(F.lit("sample "), name, F.lit(" has "), F.size(found).cast("string"), F.lit(f" ids, more than {max_sequence_length}"))
    told = _guard(bounded, F.concat(F.lit("sample "), name, F.lit(" is not between BOS and EOS")), found)
    return rows.withColumn(ids, _guard(short, long, told))


def batches(rows: DataFrame, known: Vocabulary, size: int, max_sequence_length: int, order: str = "ordinal") -> DataFrame:
    """Padded rows of every batch with what the batch is made of: ``batch_id, position, id, subset, source, raw_latex, normalized_latex`` and the decoder's columns.

    ``rows`` are records with their ``order``; an empty table has no batch.
    """
    if (BOS, PAD, EOS) != (0, 1, 2):
        raise ValueError("the decoder takes 0, 1 and 2 for BOS, PAD and EOS")
    told = rows.withColumn("normalized_latex", normalized(rows)).withColumn("tokens", latex.split_white(F.col("normalized_latex")))
    coded = guarded(vocabulary.encode(told, known), max_sequence_length)
    numbered = coded.withColumns({"batch_id": batching.batch(F.col(order), size), "position": F.col(order) % size})
    padded = batching.collate(numbered)
    return padded.select("batch_id", "position", "id", "subset", "source", "raw_latex", "normalized_latex", "decoder_input_ids", "decoder_attention_mask", "labels")


def gathered(rows: DataFrame) -> DataFrame:
    """One row per batch: each column's values in the order of their positions. A batch is bounded by its size."""
    columns = [c for c in rows.columns if c not in ("batch_id", "position")]
    items = F.array_sort(F.collect_list(F.struct("position", *columns)))
    packed = rows.groupBy("batch_id").agg(items.alias("x"))
    return packed.select("batch_id", F.size("x").alias("size"), *(F.col(f"x.{c}").alias(c) for c in columns))


def nth(rows: DataFrame, index: int) -> DataFrame:
    """The accepted row of an ordinal; an empty result beyond the last."""
    return rows.filter(F.col("ordinal") == index)


class DataModule:
    """Splits of a configuration, set up by stage, as batches. Reader and vocabulary can be replaced."""

    def __init__(self, spark: SparkSession, config: DataConfig, known: Vocabulary, read: Callable[[SparkSession, str], DataFrame] = manifest.read):
        self.spark, self.config, self.known, self.read = spark, config, known, read
        self.splits: dict[str, DataFrame] = {}

    def setup(self, stage: str | None = None) -> None:
        """Accepted, numbered rows of the stage's splits; a split that is there already stays. Other stages set nothing up."""
        for split in STAGES.get(stage, ()):
            if split in self.splits:
                continue
            path = getattr(self.config, f"{split}_manifest")
            if path is None:
                raise ValueError(f"no manifest is configured for {split}")
            rows = policy.enforce(policy.measured(self.read(self.spark, path), self.known), self.config.policy())
            kept = rows.select("id", "image_path", "raw_latex", "subset", "source")
            self.splits[split] = batching.with_ordinal(self._ordered(kept, split), "_order", "id").drop("_order")

    def _ordered(self, rows: DataFrame, split: str) -> DataFrame:
        """Training rows in a seeded order: through a buffer as they come if streaming, permuted as a whole if not."""
        config = self.config
        if split != "train":
            return rows.withColumn("_order", F.monotonically_increasing_id())
        if config.streaming:
            return batching.bounded_shuffle(rows, config.shuffle_buffer_size, config.seed).withColumn("_order", F.monotonically_increasing_id())
        return rows.withColumn("_order", batching.permuted(F.col("id"), config.seed) if config.shuffle else F.monotonically_increasing_id())

    def loader(self, split: str, limit: int | None = None) -> DataFrame:
        """Padded rows of the split's batches, of the first ``limit`` of them if given."""
        if split not in self.splits:
            raise RuntimeError(f"set up a stage with {split} first")
        found = batches(self.splits[split], self.known, self.config.batch_size, self.config.max_sequence_length)
        return found if limit is None else found.filter(F.col("batch_id") < limit)

    def count(self, split: str) -> int:
        return self.splits[split].count()
