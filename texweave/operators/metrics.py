"""Corpus BLEU and token edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texweave.functions.binding import let
from texweave.functions.latex import split_white

MAX_ORDER = 4


def ngrams(tokens: Column, order: int) -> Column:
    """All runs of ``order`` tokens, joined by one space (tokens hold none)."""
    n = F.size(tokens) - order + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda j: F.array_join(F.slice(tokens, j, F.lit(order)), " "))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<string>"))


def ngram_counts(pairs: DataFrame, side: str, max_order: int = MAX_ORDER) -> DataFrame:
    """``pair_id, ord, gram, n``: the n-gram multiset of one side of each pair."""

    def of(order: int) -> Column:
        return F.transform(ngrams(F.col(side), order), lambda g: F.struct(F.lit(order).alias("ord"), g.alias("gram")))

    every = F.flatten(F.array(*map(of, range(1, max_order + 1))))
    exploded = pairs.select("pair_id", F.explode(every).alias("x"))
    return exploded.groupBy("pair_id", "x.ord", "x.gram").agg(F.count(F.lit(1)).alias("n"))


def tokenized(pairs: DataFrame) -> DataFrame:
    """``pair_id, p, r``: tokens of prediction and reference."""
    return pairs.select("pair_id", split_white(F.col("prediction")).alias("p"), split_white(F.col("reference")).alias("r"))


def clipped(pairs: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """``pair_id, ord, matches, total`` of tokenized pairs: prediction n-grams clipped by the reference's counts."""
    p, r = ngram_counts(pairs, "p", max_order), ngram_counts(pairs, "r", max_order).withColumnRenamed("n", "m")
    met = p.join(r, ["pair_id", "ord", "gram"], "left")
    return met.groupBy("pair_id", "ord").agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("matches"), F.sum("n").alias("total"))


def by_order(pairs: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """``ord, matches, total`` pooled over the corpus."""
    return clipped(pairs, max_order).groupBy("ord").agg(F.sum("matches").alias("matches"), F.sum("total").alias("total"))


def corpus_bleu(pairs: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """One row ``bleu``: no smoothing, orders without a prediction n-gram are left out, any nought gives 0."""
    lengths = pairs.agg(F.coalesce(F.sum(F.size("p")), F.lit(0)).alias("p"), F.coalesce(F.sum(F.size("r")), F.lit(0)).alias("r"))
    pooled = by_order(pairs, max_order).agg(F.min("matches").alias("least"), F.avg(F.when(F.col("matches") > 0, F.log(F.col("matches") / F.col("total")))).alias("mean_log"))
    brevity = F.when(F.col("p") > F.col("r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r") / F.col("p")))
    score = F.when((F.col("p") == 0) | F.col("least").isNull() | (F.col("least") == 0), F.lit(0.0)).otherwise(brevity * F.exp("mean_log"))
    return lengths.crossJoin(pooled).select(score.alias("bleu"))  # one row each


def letter(place: Column) -> Column:
    """A character of its own for each place from 1 on: U+4E00 and up, and from the surrogates on the planes above."""
    point = F.when(place < 0xD800 - 0x4E00, F.lit(0x4E00) + place).otherwise(F.lit(0x10000) + place)
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def edit_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance of token arrays: each distinct token of the pair becomes one character.

    Exact up to a million distinct tokens in a pair; more are an error.
    """

    def spelled(side: Column, letters: Column) -> Column:
        return F.array_join(F.transform(side, lambda t: letter(F.array_position(letters, t))), "")

    def told(x: Column) -> Column:
        found = F.levenshtein(spelled(x["p"], x["u"]), spelled(x["r"], x["u"]))
        return F.when(F.size(x["u"]) <= 1_000_000, found).otherwise(F.raise_error(F.lit("too many distinct tokens in a pair")).cast("int"))

    return let(told, p=left, r=right, u=F.array_distinct(F.concat(left, right)))


def normalized_distance(left: Column, right: Column) -> Column:
    return edit_distance(left, right) / F.greatest(F.size(left), F.size(right), F.lit(1))
