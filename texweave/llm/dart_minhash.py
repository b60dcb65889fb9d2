"""Near-duplicate documents by DartMinHash signatures and banded joining.

DartMinHash throws darts into the plane of weight and rank over every element:
a Poisson process of unit intensity whose cells are seeded by the element, so
equal elements of different sets share their darts. A set owns the darts below
its weights; each dart also names one of the signature's coordinates, and every
coordinate keeps its earliest dart (smallest rank). Two sets agree on a
coordinate with the probability of their weighted Jaccard similarity. Ranks are
visited up to a bound that leaves about ``k ln k`` darts, so the work follows
the number of elements and coordinates and not their product.

Documents are compared as bags of five-word runs: a run's weight is how often
the text has it, and similarity is weighted Jaccard. Texts of fewer words are
one run. Equal texts are joined first and expanded last.

Members of a bucket first meet its hub and a few others. Where a large bucket
still holds several classes afterwards, everything outside its largest class is
compared with all members in blocks that hand on links alone, so no pair that
shares a bucket and could still join two classes is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from texweave.llm.common import WordHashes, cut, mix, shingles, trim, trimmed
from texweave.llm.graph import components

BANDS, ROWS = 25, 5
SIZE = 5
SIMILARITY = 0.8
#: Buckets of so many members and one meet in all pairs; in larger ones each
#: member first meets the hub and FIRST others; ``apart`` finds the rest.
SMALL, FIRST = 8, 1
#: A larger bucket is dealt into parts of about this size for the first meetings; its hub serves all of them.
BUCKET = 10_000
#: Texts held while others of their bucket pass by, and how many of these pass in one task.
BLOCK, PASSING = 128, 2_000
#: Cells of the table of held texts and their runs, in which passing texts are counted.
CELLS = 16_000_000
LOWEST = -4  # the first rank cell ends at 2**LOWEST
U = np.uint64


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


@lru_cache(maxsize=256)
def _poisson(area: float) -> np.ndarray:
    """Distribution function of Poisson(area)."""
    top = int(area + 12 * math.sqrt(area) + 14)
    logs = np.array([n * math.log(area) - area - math.lgamma(n + 1) for n in range(top)])
    return np.cumsum(np.exp(logs))


@lru_cache(maxsize=64)
def _cells(v: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rank cells of weight cell ``v`` up to number ``last``: seeds, lower ranks, widths, distribution of darts, most darts."""
    numbers = range(LOWEST, last + 1)  # [0, 2**LOWEST), then by doubling
    seeds = np.array([((v + 1) << 32) + e + 1000 for e in numbers], U) * U(0x9E3779B97F4A7C15)
    low = np.array([0.0 if e == LOWEST else 2.0 ** (e - 1) for e in numbers])
    wide = np.array([2.0**LOWEST if e == LOWEST else 2.0 ** (e - 1) for e in numbers])
    tables = [_poisson(float(x) * (1.0 if v == 0 else 2.0 ** (v - 1))) for x in wide]
    size = max(map(len, tables))
    return seeds, low, wide, np.array([np.pad(t, (0, size - len(t)), constant_values=2.0) for t in tables]), np.array(list(map(len, tables)))


def _darts(elements: np.ndarray, weights: np.ndarray | None, rank_bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Rank and identity of every dart below the weights (one each if None) and the rank bound."""
    ranks, names = [], []
    last = max(LOWEST, math.ceil(math.log2(rank_bound)))
    top = 0 if weights is None else int(max(0, math.ceil(math.log2(float(weights.max())))))
    for v in range(top + 1):  # weight cells [0, 1), [1, 2), [2, 4) ...
        low_w, wide_w = (0.0, 1.0) if v == 0 else (2.0 ** (v - 1), 2.0 ** (v - 1))
        here, w = elements, weights
        if v:
            here, w = elements[weights > low_w], weights[weights > low_w]
        seeds, low, wide, darts, _ = _cells(v, last)
        cell = mix(here[None, :] ^ seeds[:, None])
        chance = _uniform(cell)
        c, x = np.nonzero(chance >= darts[:, :1])
        cell, chance = cell[c, x], chance[c, x]
        n, more, j = np.ones(len(c), np.int64), np.arange(len(c)), 1
        while len(more) and j < darts.shape[1]:
            more = more[chance[more] >= darts[c[more], j]]
            n[more] += 1
            j += 1
        if len(n) and n.max() > 1:
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cell, c, x = np.repeat(cell, n), np.repeat(c, n), np.repeat(x, n)
            name = mix(cell + (nth.astype(U) + U(1)) * U(0xD6E8FEB86659FD93))
        else:
            name = mix(cell + U(0xD6E8FEB86659FD93))
        rank = low[c] + wide[c] * _uniform(mix(name ^ U(0xA5A5A5A5A5A5A5A5)))
        keep = rank <= rank_bound
        if w is not None:
            keep &= low_w + wide_w * _uniform(mix(name ^ U(0x5851F42D4C957F2D))) < w[x]
        ranks.append(rank[keep])
        names.append(name[keep])
    return np.concatenate(ranks), np.concatenate(names)


def signature(elements: np.ndarray, weights: np.ndarray | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    """``k`` 64-bit coordinates of a weighted set of distinct 64-bit elements; zeros for an empty set."""
    if weights is not None:
        elements, weights = elements[weights > 0], weights[weights > 0]
    if not len(elements):
        return np.zeros(k, U)
    bound = (k * math.log(k) + 2 * k) / float(len(elements) if weights is None else weights.sum())
    while True:
        rank, name = _darts(elements, weights, bound)
        at = (mix(name ^ U(0xC2B2AE3D27D4EB4F)) % U(k)).astype(np.int64)
        order = np.argsort(at + rank / (bound * 1.0000001), kind="stable")  # by coordinate, then rank
        at = at[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else at
        if len(first) == k:
            return name[order][first]
        bound *= 2


def runs(text: bytes, hashes: WordHashes, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word runs of a text, as sorted 64-bit hashes, and how often it has each; a shorter text is one run."""
    words = text.split()
    if not words:
        return np.empty(0, U), np.empty(0, np.int64)
    of = hashes.of(words)
    return np.unique(shingles(of, min(size, len(words))), return_counts=True)


def occurrences(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A sorted 64-bit hash for each occurrence of each run: plain Jaccard of these is weighted Jaccard of the bags."""
    if not len(counts) or counts.max() == 1:
        return elements
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(np.where(nth == 0, np.repeat(elements, counts), mix(np.repeat(elements, counts) + nth.astype(U) * U(0xD6E8FEB86659FD93))))


@trimmed
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket keys (one per band) and the sketch of each text; no key for a text without a word."""
    hashes = WordHashes()
    for batch in batches:
        keys, sketch = [], []
        for raw in batch.column(2):
            elements, counts = runs(raw.as_py(), hashes)
            found = signature(elements, counts.astype(np.float64) if len(counts) and counts.max() > 1 else None)
            sketch.append(found.astype("<u2").tobytes())
            bands = found.reshape(BANDS, ROWS)
            key = np.arange(BANDS, dtype=U)
            for r in range(ROWS):
                key = mix(key * U(0x9E3779B97F4A7C15) + bands[:, r])
            keys.append(key.view(np.int64) if len(elements) else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "node", "keys", "sketch"])


@trimmed
def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The occurrences of word runs of each text as sorted 32-bit hashes, of which two meet in one of 100,000 words."""
    hashes = WordHashes()
    for batch in batches:
        sets = [np.unique((occurrences(*runs(x.as_py(), hashes)) >> U(32)).astype("<u4")).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "elements"])


@F.pandas_udf(DoubleType())
def _agreement(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    k = BANDS * ROWS
    for a, b in batches:
        left, right = (np.frombuffer(b"".join(map(bytes, x)), "<u2").reshape(-1, k) for x in (a, b))
        yield pd.Series((left == right).mean(axis=1))
    trim()


@F.pandas_udf(DoubleType())
def _jaccard(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        found = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            both = len(np.intersect1d(x, y, assume_unique=True))
            found.append(both / (len(x) + len(y) - both))
        yield pd.Series(found, dtype=float)
    trim()


def shared(nodes: DataFrame) -> DataFrame:
    """``node, band, key, size``: the members of every bucket that has more than one."""
    members = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    crowded = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return cut(members.join(crowded, ["band", "key"]))


def candidates(members: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of ``members`` of one bucket, linear in their number.

    Within a bucket every member meets the bucket's hub - the member whose
    buckets are the most crowded over all bands, as an original's among its
    edited copies are - and the members before it, in an order that differs
    from band to band.
    """
    fame = members.groupBy("node").agg(F.sum("size").alias("fame"))
    hubs = members.join(fame, "node").groupBy("band", "key").agg(F.max(F.struct("fame", "node"))["node"].alias("hub"))
    parts = members.withColumn("part", F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("size") / BUCKET)))
    inside = Window.partitionBy("band", "key", "part").orderBy(F.xxhash64("band", "node"), "node")
    before = parts.select("node", "size", F.array(*(F.lag("node", k).over(inside) for k in range(1, SMALL + 1))).alias("before"))
    near = before.select("node", F.explode(F.when(F.col("size") <= SMALL + 1, F.col("before")).otherwise(F.slice("before", 1, FIRST))).alias("other"))
    starred = members.join(hubs, ["band", "key"]).select("node", F.col("hub").alias("other"))
    pairs = near.filter("other is not null").union(starred).filter("node <> other")
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def apart(members: DataFrame, nodes: DataFrame, named: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``a, b, jaccard`` of ``members`` that share a crowded bucket and are of different ``classes`` (``node, class``; others are their own).

    These are all that ``candidates`` may have left out and that a class can
    still gain. In each bucket the members outside its largest class meet every
    member: the former are held BLOCK at a time, the latter pass them PASSING at
    a time, and only links leave the task.
    """
    crowded = members.filter(F.col("size") > SMALL + 1)
    placed = cut(crowded.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")))
    sizes = placed.groupBy("band", "key", "class").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    main = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "class"))["class"].alias("main"), F.first("size").alias("all"), F.max("n").alias("n"))
    grid = F.ceil((F.col("all") - F.col("n")) / BLOCK).alias("blocks"), F.ceil(F.col("all") / PASSING).alias("parts")
    split = main.filter("n < all").select("band", "key", "main", *grid)
    met = placed.select("band", "key", "node", "class").join(split, ["band", "key"])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("node", "band"), F.col(n))
    held = met.filter("class <> main").select("band", "key", one("blocks").alias("block"), every("parts").alias("part"), F.lit(0).alias("passing"), "node", "class")
    passing = met.select("band", "key", every("blocks").alias("block"), one("parts").alias("part"), F.lit(1).alias("passing"), "node", "class")
    bags = _bags(met.select("node").distinct(), nodes, named)
    dealt = held.union(passing).join(bags, "node").select("band", "key", "block", "part", "passing", "node", "class", "elements")
    where = ["band", "key", "block", "part"]
    found = dealt.repartition(*where).sortWithinPartitions(*where, "passing").mapInArrow(_pass_by(similarity), "a string, b string, jaccard double")
    return found.distinct()


def _pass_by(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by place and ``passing``: first the texts to hold, then those that pass -> links between classes."""
        place, held = None, []
        for batch in batches:
            rows: list[tuple[str, str, float]] = []
            passing: list[tuple[str, str, np.ndarray]] = []
            columns = [c.to_pylist() for c in batch.columns[:7]]
            for *at, passes, node, name, raw in zip(*columns, batch.column(7)):
                if at != place:
                    rows += links_between(held, passing, similarity)
                    place, held, passing = at, [], []
                (passing if passes else held).append((node, name, np.frombuffer(raw.as_py(), "<u4")))
            rows += links_between(held, passing, similarity)
            ends = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(ends, (pa.string(), pa.string(), pa.float64()))], names=["a", "b", "jaccard"])

    return trimmed(run)


def links_between(held: list[tuple[str, str, np.ndarray]], passing: list[tuple[str, str, np.ndarray]], similarity: float) -> Iterator[tuple[str, str, float]]:
    """The links ``a, b, jaccard`` (a < b) between held and passing texts (node, class, elements) of different classes."""
    passing = [x for x in passing if len(x[2])]
    while held and passing:
        size = 1
        while size < len(held) and (size + 1) * sum(len(x[2]) for x in held[: size + 1]) <= CELLS:
            size += 1
        some, held = held[:size], held[size:]
        known = np.unique(np.concatenate([x[2] for x in some]))
        table = np.zeros((len(known), len(some)), np.uint8)
        for k, (_, _, elements) in enumerate(some):
            table[np.searchsorted(known, elements), k] = 1
        sizes = np.array([len(x[2]) for x in some])
        for node, name, elements in passing if len(known) else ():
            at = np.minimum(np.searchsorted(known, elements), len(known) - 1)
            both = table[at[known[at] == elements]].sum(axis=0, dtype=np.int64)
            jaccard = both / (sizes + len(elements) - both)
            for k in np.flatnonzero(jaccard >= similarity):
                if some[k][1] != name:
                    yield min(node, some[k][0]), max(node, some[k][0]), float(jaccard[k])


def _meet(pairs: DataFrame, facts: DataFrame, value: str) -> DataFrame:
    """``pairs`` with the value of both ends. A hub's value is copied for every 1,000 of its pairs, so it meets them in many tasks."""
    load = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 1000).alias("parts"))
    load_b = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / 1000).alias("parts"))
    for end, sizes in (("a", load), ("b", load_b)):
        other = "b" if end == "a" else "a"
        copies = facts.select(F.col("node").alias(end), F.col(value).alias(f"{value}_{end}")).join(sizes, end)
        copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        dealt = pairs.join(sizes, end).withColumn("part", F.pmod(F.xxhash64(other), F.col("parts")))
        pairs = dealt.join(copies.drop("parts"), [end, "part"]).drop("part", "parts")
    return pairs


def linked(nodes: DataFrame, named: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``node, class`` of every node with a link; nodes without one are their own class.

    The first candidates leave pairs of crowded buckets out; ``apart`` finds the
    links among these that still join two classes.
    """
    members = shared(nodes)
    found = cut(_verified(cut(candidates(members)), nodes, named, similarity))
    classes = components(found)
    more = cut(apart(members, nodes, named, classes, similarity))
    if more.isEmpty():
        return classes
    own = classes.union(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node", "left_anti").select("node", F.col("node").alias("class")))
    of = lambda end: own.select(F.col("node").alias(end), F.col("class").alias(f"class_{end}"))
    joined = components(more.join(of("a"), "a").join(of("b"), "b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct())
    renamed = joined.select(F.col("node").alias("class"), F.col("class").alias("now"))
    return own.join(renamed, "class", "left").select("node", F.coalesce("now", "class").alias("class"))


def _bags(wanted: DataFrame, nodes: DataFrame, named: DataFrame) -> DataFrame:
    """``node, elements`` of the nodes in ``wanted``, from their texts."""
    wanted = nodes.select("node", "copy_of").join(wanted, "node")
    rows = named.join(wanted, (named["node"] == wanted["node"]) & named["doc_id"].eqNullSafe(wanted["copy_of"]), "left_semi")
    bags = rows.select("node", F.col("text").cast("binary").alias("raw")).mapInArrow(_elements, "node string, elements binary")
    return cut(bags.groupBy("node").agg(F.first("elements").alias("elements")))  # rows that repeat both id and text count once


def _verified(pairs: DataFrame, nodes: DataFrame, named: DataFrame, similarity: float) -> DataFrame:
    """The links ``a, b, jaccard`` among ``pairs``.

    ``nodes`` has ``node, copy_of, keys, sketch`` per text, ``named`` has
    ``doc_id, node, text`` per row. Sketches (a few hundred bytes) drop pairs
    that are five standard deviations short, which a link is with odds under one
    in a million; only texts of the others are read again for the exact
    similarity of their bags.
    """
    slack = 5 * math.sqrt(similarity * (1 - similarity) / (BANDS * ROWS))
    likely = cut(_meet(pairs, nodes, "sketch").filter(_agreement("sketch_a", "sketch_b") >= similarity - slack).select("a", "b"))
    ends = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    return _meet(likely, _bags(ends, nodes, named), "elements").select("a", "b", _jaccard("elements_a", "elements_b").alias("jaccard")).filter(F.col("jaccard") >= similarity)


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, copy_of``: one row per row of ``docs``.

    ``class_id`` is the smallest ``doc_id`` of the documents connected by links
    of ``similarity`` or more; ``copy_of`` the smallest with the same text. Null
    texts count as empty; texts without a word link only to equal texts. Repeated rows
    share their class. Other columns are ignored; an empty table gives an empty
    result.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("node", F.md5(F.col("text").cast("binary")))
    described = cut(named.select("doc_id", "node", F.col("text").cast("binary").alias("raw")).mapInArrow(_describe, "doc_id long, node string, keys array<long>, sketch binary"))
    nodes = cut(described.groupBy("node").agg(F.min("doc_id").alias("copy_of"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    joined = cut(linked(nodes, named, similarity))
    facts = nodes.select("node", "copy_of").join(joined, "node", "left").withColumn("class", F.coalesce("class", "node"))
    lowest = facts.groupBy("class").agg(F.min("copy_of").alias("class_id"))
    facts = facts.join(lowest, "class").select("node", "class_id", "copy_of")
    return described.select("doc_id", "node").join(facts, "node").select("doc_id", "class_id", "copy_of")


def keep(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class: the one of the smallest ``doc_id``, columns unchanged.

    Rows without an id stay as they are; of rows that repeat an id within a
    class the first by text stays.
    """
    judged = classes(docs.filter("doc_id is not null"), similarity).filter("doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(judged, "doc_id", "left_semi")
    return kept.union(docs.filter("doc_id is null"))
