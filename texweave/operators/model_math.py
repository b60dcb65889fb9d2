"""Tensor, checkpoint and schedule arithmetic as relational queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IGNORE = -100
ENCODER_PREFIXES = ("module.encoder.", "model.encoder.", "encoder.")
MODEL_PREFIXES = ("module.model.", "module.", "model.")

# Fixed values of the baseline encoder: input, mid and output channels, blocks, layers, kernel, downsample, light.
STEM = (3, 32, 48)
STAGES = (
    ("stage1", 48, 48, 128, 1, 6, 3, False, False),
    ("stage2", 128, 96, 512, 1, 6, 3, True, False),
    ("stage3", 512, 192, 1024, 3, 6, 5, True, True),
    ("stage4", 1024, 384, 2048, 1, 6, 5, True, True),
)
STAGE_COLUMNS = "stage string, in_ch int, mid_ch int, out_ch int, blocks int, layers int, kernel int, down boolean, light boolean"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def cross_entropy(logits: Column, label: Column) -> Column:
    """Loss of one target; null for ignored ones."""
    values = F.transform(logits, lambda x: x.cast("double"))
    top = F.array_max(values)
    total = _sum(F.transform(values, lambda x: F.exp(x - top)))
    return F.when(label != IGNORE, F.log(total) + top - F.get(values, label))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def argmax(values: Column) -> Column:
    """First place of the largest value."""
    return F.array_position(values, F.array_max(values)) - 1


def differences(reference: Column, actual: Column) -> Column:
    """Largest and mean absolute difference, and the relative L2 difference."""
    gap = F.zip_with(reference, actual, lambda x, y: y.cast("double") - x.cast("double"))
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    away = F.transform(gap, lambda x: F.abs(x))
    return F.struct(F.array_max(away).alias("max_abs"), (_sum(away) / F.size(away)).alias("mean_abs"), (norm(gap) / F.greatest(norm(reference), F.lit(1e-12))).alias("l2_relative"))


class StateMappingError(ValueError):
    """A checkpoint does not fit the target."""


def vote_prefix(source: DataFrame, prefixes: tuple[str, ...], every: bool) -> DataFrame:
    """One row ``prefix``: the first that any (or every) name starts with, else the empty one."""
    test = F.bool_and if every else F.bool_or
    found = source.agg(*(F.coalesce(test(F.startswith("name", F.lit(p))), F.lit(False)).alias(f"p{k}") for k, p in enumerate(prefixes)))
    chosen = F.lit("")
    for k in reversed(range(len(prefixes))):
        chosen = F.when(F.col(f"p{k}"), prefixes[k]).otherwise(chosen)
    return found.select(chosen.alias("prefix"))


def selected(source: DataFrame, prefix: DataFrame) -> DataFrame:
    """Names with the prefix, without it."""
    return source.join(F.broadcast(prefix), F.startswith("name", "prefix")).select(F.expr("substring(name, length(prefix) + 1)").alias("name"), "shape")  # prefix is one row


def map_state(source: DataFrame, target: DataFrame, prefixes: tuple[str, ...] = ENCODER_PREFIXES, every: bool = False, prefix: str | None = None) -> DataFrame:
    """Source entries in target order; raises on duplicate, missing, unexpected or misshapen names."""
    spark = source.sparkSession
    chosen = spark.createDataFrame([(prefix,)], "prefix string") if prefix is not None else vote_prefix(source, prefixes, every)
    names = selected(source, chosen)
    twice = names.groupBy("name").count().filter("count > 1").agg(F.min("name")).first()[0]
    if twice is not None:
        raise StateMappingError(f"duplicate mapped key: {twice}")
    if names.isEmpty():
        raise StateMappingError("no tensors found with the source prefix")
    missing, unexpected = (x.agg(F.sort_array(F.collect_list("name"))).first()[0] for x in (target.join(names, "name", "left_anti"), names.join(target, "name", "left_anti")))
    if missing or unexpected:
        raise StateMappingError(f"state key mismatch: missing={missing}, unexpected={unexpected}")
    both = target.join(names.withColumnRenamed("shape", "source_shape"), "name")
    wrong = both.filter("shape <> source_shape").agg(F.sort_array(F.collect_list("name"))).first()[0]
    if wrong:
        raise StateMappingError(f"state shape mismatch: {wrong}")
    return both.orderBy("pos").select("name", F.col("source_shape").alias("shape"), "pos")


def stage_table(spark: SparkSession, stages=STAGES) -> DataFrame:
    return spark.createDataFrame(list(stages), STAGE_COLUMNS)


def _conv(ins: Column, outs: Column, kernel, groups=1) -> Column:
    return ins * outs * kernel * kernel / groups + 2 * outs


def parameter_counts(stages: DataFrame) -> DataFrame:
    """``stage, parameters``: convolutions and their normalization, summed over blocks."""
    c = F.col
    first = F.when(c("light"), _conv(c("in_ch"), c("mid_ch"), 1) + _conv(c("mid_ch"), c("mid_ch"), c("kernel"), c("mid_ch"))).otherwise(_conv(c("in_ch"), c("mid_ch"), c("kernel")))
    later_in = F.when(c("light"), _conv(c("out_ch"), c("mid_ch"), 1) + _conv(c("mid_ch"), c("mid_ch"), c("kernel"), c("mid_ch"))).otherwise(_conv(c("out_ch"), c("mid_ch"), c("kernel")))
    inner = F.when(c("light"), _conv(c("mid_ch"), c("mid_ch"), 1) + _conv(c("mid_ch"), c("mid_ch"), c("kernel"), c("mid_ch"))).otherwise(_conv(c("mid_ch"), c("mid_ch"), c("kernel")))
    squeeze = lambda ins: _conv(ins + c("layers") * c("mid_ch"), c("out_ch") / 2, 1) + _conv(c("out_ch") / 2, c("out_ch"), 1)
    down = F.when(c("down"), _conv(c("in_ch"), c("in_ch"), 3, c("in_ch"))).otherwise(0)
    total = down + first + (c("layers") - 1) * inner + squeeze(c("in_ch")) + (c("blocks") - 1) * (later_in + (c("layers") - 1) * inner + squeeze(c("out_ch")))
    return stages.select("stage", total.cast("long").alias("parameters"))


def stem_parameters(stem: tuple[int, int, int] = STEM) -> int:
    a, m, b = stem
    conv = lambda i, o, k: i * o * k * k + 2 * o
    return conv(a, m, 3) + conv(m, m // 2, 2) + conv(m // 2, m, 2) + conv(2 * m, m, 3) + conv(m, b, 1)


def output_shapes(stages: DataFrame, image_size: int = 384) -> DataFrame:
    """``stage, channels, side, tokens``: the stem quarters the side, each downsampling stage halves it."""
    halvings = F.sum(F.col("down").cast("int")).over(Window.orderBy("stage"))  # a row per stage
    side = (F.lit(image_size // 4) / F.pow(F.lit(2), halvings)).cast("int")
    return stages.select("stage", F.col("out_ch").alias("channels"), side.alias("side"), (side * side).alias("tokens"))


def channel_chain(stages: DataFrame, stem_out: int = STEM[-1]) -> DataFrame:
    """``stage, expected, ok``: each stage takes what the one before gives."""
    before = F.coalesce(F.lag("out_ch").over(Window.orderBy("stage")), F.lit(stem_out))
    return stages.select("stage", before.alias("expected"), (before == F.col("in_ch")).alias("ok"))


def check_schedule(lr: float, min_lr: float, warmup: int, total: int) -> None:
    if lr <= 0 or not 0 <= min_lr <= lr:
        raise ValueError("lr must be positive and min_lr within [0, lr]")
    if warmup < 0 or total <= warmup:
        raise ValueError("total must exceed warmup, which is not negative")


def lr_multiplier(step: Column, lr: float, min_lr: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then a cosine down to ``min_lr / lr``."""
    check_schedule(lr, min_lr, warmup, total)
    ratio = min_lr / lr
    progress = F.least((step - warmup) / (total - warmup), F.lit(1.0))
    return F.when(step < warmup, (step + 1) / max(warmup, 1)).otherwise(ratio + (1 - ratio) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress)))
