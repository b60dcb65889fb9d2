"""Packing of documents into fixed-size sequences.

The instance is a histogram: how many pieces have each length (at most
``capacity`` different lengths, whatever the corpus). The plan is made on that
histogram alone. Martello-Toth reduction first fixes sets that provably
dominate every other set with the same largest piece; best-fit decreasing packs
the rest. A plan is a short list of patterns with multiplicities; every piece
then finds its place from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from texweave.llm.common import cut, trimmed
from texweave.llm.word_tokens import forget, word_tokens

CAPACITY = 4096
#: Id that ends every document.
END = 1
#: Pieces of one length are ranked in so many buckets, or one more per ROWS_PER_BUCKET pieces.
BUCKETS = 64
ROWS_PER_BUCKET = 500_000


@dataclass
class Plan:
    """Bins of equal content: ``runs`` of (length, copies) and how many bins there are."""

    capacity: int
    patterns: list[tuple[list[tuple[int, int]], int]] = field(default_factory=list)

    @property
    def bins(self) -> int:
        return sum(n for _, n in self.patterns)

    def placements(self) -> pd.DataFrame:
        """For ranks ``low`` and up of pieces of a length: first sequence, copies in each, first offset."""
        used: dict[int, int] = defaultdict(int)
        rows, base = [], 0
        for runs, bins in self.patterns:
            offset = 0
            for size, copies in runs:
                rows.append((size, used[size], copies, base, offset))
                used[size] += copies * bins
                offset += size * copies
            base += bins
        return pd.DataFrame(rows, columns=["length", "low", "copies", "base", "offset"], dtype=np.int64).sort_values(["length", "low"], ignore_index=True)


def reduce_dominated(counts: dict[int, int], plan: Plan) -> dict[int, int]:
    """Fixes bins that dominate all others with the same largest piece; returns what is left.

    For the largest piece j, with k the largest piece that fits beside it:
    nothing fits -> {j}; j + k fills the bin -> {j, k}; no two others fit
    together -> {j, k}; no three others fit and no two that fit sum to more
    than k -> {j, k}. In each case any feasible set with j can be exchanged for
    the fixed one without a further bin.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)

    def take(size: int, n: int) -> None:
        left[size] -= n
        if not left[size]:
            del left[size]
            sizes.pop(bisect_left(sizes, size))

    for j in sorted(left, reverse=True):
        while left.get(j):
            room = plan.capacity - j
            others = left[j] - 1  # further pieces of this length
            at = bisect_left(sizes, room + 1) - 1
            if at >= 0 and sizes[at] == j and not others:
                at -= 1
            if at < 0:
                n = left[j]
                if room >= j:
                    n = 1
                plan.patterns.append(([(j, 1)], n))
                take(j, n)
                continue
            k = sizes[at]
            if j + k != plan.capacity and not _dominates(left, sizes, j, k, room):
                break
            # As long as j and k are left, k stays the largest that fits and fewer
            # others cannot fill the room better: all such bins are fixed at once.
            n = left[j] // 2 if k == j else min(left[j], left[k])
            plan.patterns.append(([(j, 2)] if k == j else [(j, 1), (k, 1)], n))
            take(j, 2 * n if k == j else n)
            if k != j:
                take(k, n)
    return left


def _dominates(left: dict[int, int], sizes: list[int], j: int, k: int, room: int) -> bool:
    """Whether {j, k} beats every set of j with two or more others."""
    small: list[int] = []  # the three smallest others
    for s in sizes[:4]:
        small += [s] * min(3, left[s] - (s == j))
    small = small[:3]
    if len(small) < 2 or small[0] + small[1] > room:
        return True
    if len(small) == 3 and sum(small) <= room:
        return False
    # Two pointers for the largest sum of two others that fits.
    low, high, best = 0, bisect_left(sizes, room + 1) - 1, 0
    while low <= high:
        total = sizes[low] + sizes[high]
        if total > room:
            high -= 1
            continue
        if low < high or left[sizes[low]] - (sizes[low] == j) >= 2:
            best = max(best, total)
        low += 1
    return best <= k


def best_fit(counts: dict[int, int], plan: Plan) -> None:
    """Best-fit decreasing on the histogram: equal pieces meeting equal bins are placed together."""
    open_bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, runs: list[tuple[int, int]], n: int) -> None:
        if not n:
            return
        if room == 0:
            plan.patterns.append((runs, n))
            return
        if not open_bins[room]:
            insort(rooms, room)
        open_bins[room].append((runs, n))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                copies = plan.capacity // size
                put(plan.capacity - copies * size, [(size, copies)], n // copies)
                put(plan.capacity - n % copies * size, [(size, n % copies)], 1 if n % copies else 0)
                break
            room = rooms[at]
            runs, bins = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(at)
            copies = min(room // size, n)
            filled = min(bins, n // copies)
            put(room - copies * size, [*runs, (size, copies)], filled)
            put(room, runs, bins - filled)
            n -= copies * filled
    for found in open_bins.values():
        plan.patterns += found


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan = Plan(capacity)
    best_fit(reduce_dominated(counts, plan), plan)
    return plan


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document.

    A document is its ids and one end id; only longer ones are cut, every
    ``capacity`` ids. Null texts count as empty: a piece of the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_path)
        for batch in batches:
            rows = []
            texts = (x.as_py() or "" for x in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.all_ids(texts)):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        del tokens
        forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (pieces with ``doc_id, piece, length, ids_crc32``) with ``sequence_id`` and ``offset``.

    Repeated rows are pieces of their own and each get a place; which of equal
    rows gets which does not matter. An empty table gives an empty result.
    """
    found = cut(found)
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # capacity rows at most
    plan = make_plan(counts, capacity)
    table = plan.placements()
    keys = (table.length.to_numpy() << 44) | table.low.to_numpy()
    shared = found.sparkSession.sparkContext.broadcast((keys, *(table[c].to_numpy() for c in ("low", "copies", "base", "offset"))))

    @F.pandas_udf("sequence_id long, offset long")
    def spot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, low, copies, base, offset = shared.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
        nth = rank - low[at]
        return pd.DataFrame({"sequence_id": base[at] + nth // copies[at], "offset": offset[at] + nth % copies[at] * length})

    # A rank among pieces of one length, whatever share of all pieces they are:
    # ranks within buckets plus the sizes of the buckets before.
    buckets = BUCKETS + sum(counts.values()) // ROWS_PER_BUCKET
    spread = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = spread.withColumn("_nth", F.row_number().over(inside) - 1).join(sizes, ["length", "_bucket"])
    spots = ranked.withColumn("_spot", spot("length", F.col("_before") + F.col("_nth")))
    return spots.select(*found.columns, "_spot.sequence_id", "_spot.offset")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document of ``docs`` with its place. Other columns are ignored."""
    return place(pieces(docs, tokenizer_path, capacity), capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, ids``: the token ids of each packed sequence (``capacity`` at most).

    Takes rows whose ``doc_id`` is unique.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.all_ids(x.as_py() or "" for x in batch.column(1))):
                ids = np.append(ids, np.uint32(END)).astype(np.int32)
                rows += [(doc_id, k, ids[at : at + capacity]) for k, at in enumerate(range(0, len(ids), capacity))]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.list_(pa.int32())))], names=["doc_id", "piece", "ids"])

    parts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, ids array<int>")
    joined = placed.select("doc_id", "piece", "sequence_id", "offset").join(parts, ["doc_id", "piece"])
    ordered = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return ordered.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
