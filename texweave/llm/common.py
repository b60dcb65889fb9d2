"""What the operators of this folder share: reading, lineage cuts, hashing."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Where lineage is cut in a local session that names no ``spark.checkpoint.dir``.
LOCAL_CHECKPOINTS = "file:///tmp/texweave-checkpoints"
#: Spark's setting that deletes a query's shuffles when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where driver and executors are one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or LOCAL_CHECKPOINTS


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there.

    Survives lost executors; Spark deletes the files with the last reference
    if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on. The shuffles
    that made it are deleted as soon as it is written, not when the driver
    happens to collect its garbage.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_dir(spark))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(True)  # a frame takes the setting when it is made
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files that only lineage before a cut still held.

    Spark deletes them when the driver collects its garbage, which it may not
    do for long; between phases that each shuffle much, this asks for it. The
    first round lets go of what Python holds, which reaches the driver's JVM
    later, so that only a second one frees it there.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        spark._jvm.System.gc()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (murmur3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: A 64-bit number for each byte.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class WordHashes:
    """64-bit hashes of words (bytes without white space), all words of a text at once.

    A word's hash is a polynomial of its bytes, taken as the difference of two
    running sums over the text and moved to the word's start; powers and their
    inverses modulo 2**64 are kept up to the longest text seen, and let go
    beyond KEPT bytes.
    """

    KEPT = 1 << 20
    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.powers = self.inverses = np.empty(0, np.uint64)

    def powers_of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``n`` powers of BASE or more, and their inverses."""
        if len(self.powers) >= n:
            return self.powers, self.inverses
        made = []
        for base in (self.BASE, pow(self.BASE, -1, 2**64)):
            x = np.full(max(n, 1 << 14), base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x))
        if n <= self.KEPT:
            self.powers, self.inverses = made
        return made[0], made[1]

    def of(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0, np.uint64)
        flat = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        powers, inverses = self.powers_of(len(flat))
        end = np.flatnonzero(flat == 32)
        start = np.concatenate(([0], end[:-1] + 1))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[flat] * powers[: len(flat)], dtype=np.uint64)))
        return mix((sums[end] - sums[start]) * inverses[start] + (end - start).astype(np.uint64))

    def of_texts(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the words of some texts one after the other, and how many words each text has."""
        flat = np.frombuffer(b" %b " % b" ".join(raws), np.uint8)
        powers, inverses = self.powers_of(len(flat))
        space = (flat == 32) | (flat - np.uint8(9) < 5)  # as bytes.split() has it
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = edges[::2], edges[1::2]
        if not len(start):
            return np.empty(0, np.uint64), np.zeros(len(raws), np.int64)
        parts = _BYTES.take(flat)
        parts *= powers[: len(flat)]
        sums = np.cumsum(parts, out=parts)
        ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
        counts = np.diff(np.searchsorted(start, ends), prepend=0)
        return mix((sums[end - 1] - sums[start - 1]) * inverses[start] + (end - start).astype(np.uint64)), counts


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, by start; none for shorter texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    found = hashes[:n].copy()
    for k in range(1, size):
        found *= np.uint64(0x9E3779B97F4A7C15)
        found += hashes[k : k + n]
    return mix(found)


def texts(column) -> Iterable[str]:
    """Values of an Arrow string column; null counts as the empty text."""
    for value in column:
        yield value.as_py() or ""


@cache
def _libc() -> ctypes.CDLL | None:
    libc = ctypes.CDLL(None)
    return libc if hasattr(libc, "malloc_trim") else None


def trim() -> None:
    """Gives memory that this Python process holds without use back to the system.

    Executors keep their Python workers for the tasks to come, of any
    operator; without this each stays as large as its largest task.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with ``trim`` at the end of each task."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return task
