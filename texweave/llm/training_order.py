"""Training-order materialisation: token sequences in a keyed global order, in fixed-stride shards.

Documents are cut into sequences of at most STRIDE ids. Sequences are numbered
densely, and a keyed Feistel network on the smallest even-bit domain, walked
until it lands inside the number of sequences (cycle-walking), permutes the
numbers into global slots: no sort by a random key, and any slot can be traced
back. Each shard is the range of slots of one partition; its records all have
the same size, so record k of a shard is at byte k * RECORD and a reader can
resume at any slot.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texweave.llm.common import checkpoint_dir, mix
from texweave.llm.word_tokens import word_tokens

STRIDE = 512
END = 1
KEY = 20240229
ROUNDS = 8
#: Slots of a shard at least, and shards at most before they grow.
SHARD_SLOTS, MOST_SHARDS = 16_384, 50_000
#: Records that are packed into one row of a shard.
BLOCK = 256
RECORD = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("length", "<i4"), ("ids", "<u2", STRIDE)])
#: Writers hold a row group in memory.
SMALL_GROUPS = {"parquet.block.size": 16 << 20}
BLOCKS = "shard long, shard_slots long, first_slot long, records int, payload binary"
U = np.uint64


def _keys(key: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(key % 2**64))


def _half_bits(n: int) -> int:
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of the numbers ``index`` below ``n``; a permutation of 0..n-1 for every key."""
    half = U(_half_bits(n))
    mask = U((1 << int(half)) - 1)
    out = index.astype(U)
    left_out = np.arange(len(out))
    while len(left_out):
        x = out[left_out]
        left, right = x >> half, x & mask
        for k in _keys(key):
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[left_out] = x = left << half | right
        left_out = left_out[x >= U(n)]
    return out.astype(np.int64)


def trace(slot: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The number that ``permute`` sends to each slot."""
    half = U(_half_bits(n))
    mask = U((1 << int(half)) - 1)
    out = slot.astype(U)
    left_out = np.arange(len(out))
    while len(left_out):
        x = out[left_out]
        left, right = x >> half, x & mask
        for k in _keys(key)[::-1]:
            left, right = right ^ (mix(left ^ k) & mask), left
        out[left_out] = x = left << half | right
        left_out = left_out[x >= U(n)]
    return out.astype(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "piece", "packed"])


def _cut(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pack = word_tokens(tokenizer_path), zstandard.ZstdCompressor(1)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.all_ids(x.as_py() or "" for x in batch.column(1))):
                ids = np.append(ids, np.uint32(END))
                if ids.max() > 0xFFFF:
                    raise ValueError("records hold 16-bit ids; the vocabulary is larger")
                ids = ids.astype("<u2")
                rows += [(doc_id, k, pack.compress(ids[at : at + STRIDE].tobytes())) for k, at in enumerate(range(0, len(ids), STRIDE))]
                if len(rows) >= 4000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return run


def _write_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and slot -> blocks of fixed-size records. A block never spans shards."""
    unpack = zstandard.ZstdDecompressor()
    held: list[tuple[int, int, int | None, int, bytes]] = []

    def block() -> pa.RecordBatch:
        records = np.zeros(len(held), RECORD)
        for k, (_, _, doc_id, piece, packed) in enumerate(held):
            ids = np.frombuffer(unpack.decompress(packed), "<u2")
            records[k]["doc_id"], records[k]["piece"], records[k]["length"] = (-1 if doc_id is None else doc_id), piece, (-len(ids) if doc_id is None else len(ids))
            records[k]["ids"][: len(ids)] = ids
        out = [held[0][0]], [held[0][1]], [len(held)], [records.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["shard", "first_slot", "records", "payload"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (row[0] != held[0][0] or len(held) >= BLOCK):
                yield block()
                held = []
            held.append(row)
    if held:
        yield block()


def materialise(docs: DataFrame, path: str, tokenizer_path: str, key: int = KEY, shard_slots: int | None = None) -> int:
    """Writes the sequences of ``docs`` in training order to shards at ``path``; returns how many there are.

    A document is its ids and an end id. Null texts count as empty (the end id
    alone); null ids and repeated rows are kept and get slots of their own; an
    empty table writes no shard. The tokenised sequences are written once beside
    ``path`` with their place in it, so that numbers do not change if a task
    runs again, and removed at the end.
    """
    spark = docs.sparkSession
    stage = f"{path}-sequences"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cut(tokenizer_path), "doc_id long, piece int, packed binary")
    rows.withColumn("at", F.monotonically_increasing_id()).write.options(compression="uncompressed", **SMALL_GROUPS).parquet(stage)
    try:
        staged = spark.read.schema("doc_id long, piece int, packed binary, at long").parquet(stage)
        sizes = staged.groupBy(F.shiftright("at", 33).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").toPandas()  # a row per partition
        n = int(sizes.n.sum())
        if not n:
            spark.createDataFrame([], BLOCKS).write.parquet(path)
            return 0
        slots = shard_slots or max(SHARD_SLOTS, -(-n // MOST_SHARDS))
        offsets = np.zeros(int(sizes.part.max()) + 1, np.int64)
        offsets[sizes.part] = np.cumsum(sizes.n) - sizes.n
        shared = spark.sparkContext.broadcast(offsets)

        @F.pandas_udf("long")
        def slot(at: pd.Series) -> pd.Series:
            at = at.to_numpy(np.int64)
            return pd.Series(permute(shared.value[at >> 33] + (at & ((1 << 33) - 1)), n, key))

        placed = staged.withColumn("slot", slot("at")).withColumn("shard", F.floor(F.col("slot") / slots))
        ranges = placed.repartitionById(-(-n // slots), F.col("shard").cast("int")).sortWithinPartitions("slot")
        blocks = ranges.select("shard", "slot", "doc_id", "piece", "packed").mapInArrow(_write_blocks, "shard long, first_slot long, records int, payload binary")
        blocks = blocks.select("shard", F.lit(slots).cast("long").alias("shard_slots"), "first_slot", "records", "payload")
        blocks.write.options(compression="zstd", **SMALL_GROUPS).parquet(path)
        return n
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(stage)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read(spark: SparkSession, path: str, first_slot: int = 0, digests: bool = False) -> DataFrame:
    """``slot, shard, offset, doc_id, piece, length, ids`` of the sequences from ``first_slot`` on.

    ``offset`` is the record's byte in its shard. Blocks before the slot are
    skipped by their statistics. ``digests`` gives ``ids_crc32`` (of the ids as
    little-endian 32-bit integers) in place of the ids.
    """
    last, kind = ("ids_crc32", "long") if digests else ("ids", "array<int>")

    def told(record: np.ndarray) -> int | np.ndarray:
        ids = record["ids"][: abs(int(record["length"]))]
        return zlib.crc32(ids.astype("<u4").tobytes()) if digests else ids.astype(np.int32)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, lowest, payload in zip(*batch.columns):
                found = np.frombuffer(payload.as_py(), RECORD)
                slot = first.as_py() + np.arange(len(found))
                doc_id = pa.array(found["doc_id"], mask=found["length"] < 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array(np.full(len(found), shard.as_py())), pa.array((slot - lowest.as_py()) * RECORD.itemsize), doc_id, pa.array(found["piece"]), pa.array(np.abs(found["length"])), pa.array(list(map(told, found)), pa.int64() if digests else pa.list_(pa.int32()))],
                    names=["slot", "shard", "offset", "doc_id", "piece", "length", last],
                )

    blocks = spark.read.schema(BLOCKS).parquet(path)
    wanted = blocks.filter(F.col("first_slot") > first_slot - BLOCK).select("shard", "first_slot", (F.col("shard") * F.col("shard_slots")).alias("lowest"), "payload")
    return wanted.mapInArrow(records, f"slot long, shard long, offset long, doc_id long, piece int, length int, {last} {kind}").filter(F.col("slot") >= first_slot)


def order(docs: DataFrame, tokenizer_path: str, key: int = KEY) -> DataFrame:
    """Every sequence of ``docs`` as the written shards hold it: ``slot, shard, offset, doc_id, piece, length, ids_crc32``."""
    path = f"{checkpoint_dir(docs.sparkSession)}/order-{uuid.uuid4().hex}"
    materialise(docs, path, tokenizer_path, key)
    return read(docs.sparkSession, path, digests=True)
