"""Order, shards, batches and padded decoder inputs."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texweave.functions.vocabulary import PAD
from texweave.operators.lineage import cut

IGNORE = -100


def with_ordinal(rows: DataFrame, *keys: str, name: str = "ordinal") -> DataFrame:
    """``rows`` with their 0-based place in the order of ``keys``; equal keys are in any order.

    Only the keys are range-partitioned and cut; ranges are numbered on their
    own and shifted by the sizes of those before, so no task sees more than a
    range and only the sizes reach the driver. Rows beside their keys join back
    on keys and the count of equal ones, which is one shuffle of their own.
    """
    slim = cut(rows.select(*keys).repartitionByRange(*map(F.col, keys)).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    sizes = slim.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, total = [0] * (sizes[-1]["part"] + 1 if sizes else 1), 0
    for r in sizes:
        before[r["part"]] = total
        total += r["n"]
    start = F.array(*(F.lit(x).cast("long") for x in before))
    numbered = slim.withColumn(name, F.get(start, part) + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")
    if sorted(rows.columns) == sorted(keys):
        return numbered.select(*rows.columns, name)
    same = Window.partitionBy(*keys).orderBy(F.lit(0))
    left = rows.withColumn("_nth", F.row_number().over(same))
    right = numbered.select(*(F.col(k).alias(f"_{k}") for k in keys), name, F.row_number().over(Window.partitionBy(*keys).orderBy(name)).alias("_nth_"))
    on = [left[k].eqNullSafe(right[f"_{k}"]) for k in keys] + [left["_nth"] == right["_nth_"]]
    return left.join(right, on).select(*(left[c] for c in rows.columns), name)


def shard(ordinal: Column, shards: int) -> Column:
    """Round robin: disjoint, complete, and before any policy."""
    return F.pmod(ordinal, F.lit(shards))


def batch(ordinal: Column, size: int) -> Column:
    """Batches of ``size``, the last one short."""
    return F.floor(ordinal / size)


def permuted(key: Column, seed: int, epoch: int = 0) -> Column:
    """A sort key that gives a permutation fixed by seed and epoch."""
    return F.xxhash64(key, F.lit(seed), F.lit(epoch))


def shuffle_seed(seed: int, epoch: int, worker: int) -> int:
    return seed + epoch * 1_000_003 + worker


def bounded_shuffle(rows: DataFrame, buffer: int, seed: int, epoch: int = 0) -> DataFrame:
    """Each partition's rows through a buffer: a full one emits a random row for each that comes in, then drains.

    ``buffer`` of 1 keeps the order. Memory is the buffer; nothing is shuffled
    between partitions.
    """
    if buffer < 1 or epoch < 0:
        raise ValueError("buffer must be positive and epoch not negative")
    if buffer == 1:
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rng = random.Random(shuffle_seed(seed, epoch, TaskContext.get().partitionId()))
        held: list = []
        columns = None
        for b in batches:
            columns, out = b.columns, []
            for row in b.itertuples(index=False, name=None):
                if len(held) < buffer:
                    held.append(row)
                    continue
                k = rng.randrange(buffer)
                out.append(held[k])
                held[k] = row
            yield pd.DataFrame(out, columns=columns)
        out = []
        while held:
            out.append(held.pop(rng.randrange(len(held))))
        if out:
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(run, rows.schema)


def collate(rows: DataFrame, batch_id: str = "batch_id", ids: str = "ids") -> DataFrame:
    """Rows of a batch with ``decoder_input_ids, decoder_attention_mask, labels``, padded to the batch's longest.

    Labels are the ids moved left by one; they and padding end in IGNORE.
    """
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch_id))
    sized = rows.withColumn("length", longest)
    n, gap = F.size(ids), F.col("length") - F.size(ids)
    return sized.withColumns(
        {
            "decoder_input_ids": F.concat(F.col(ids), F.array_repeat(F.lit(PAD), gap)),
            "decoder_attention_mask": F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), gap)),
            "labels": F.concat(F.slice(F.col(ids), F.lit(2), n - 1), F.array_repeat(F.lit(IGNORE), gap + 1)),
        }
    )
