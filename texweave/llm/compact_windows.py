"""Repeated passages by compact windows over token min-hashes.

A token is the hash of a five-word run. For a hash function, the Cartesian tree
of a text's token values groups all its stretches by the position of their
smallest value: a compact window (l, c, r) stands for every stretch that starts
in l..c and ends in c..r and whose minimum is at c. Only windows that hold a
stretch of the least passage length are made, about 2n/length of them, each
with the interval of starts of its stretches of that length.

Texts whose windows share a minimum under a hash function are joined with the
first text that has it (a star, so a passage in thousands of texts costs
thousands of links), and the intervals of starts that a text shares with that
one are joined across the hash functions: where enough of them meet, the pair is
a candidate. Candidates are verified along their diagonal: a
stretch counts as repeated if its words match the earlier text's at a Jaccard
similarity of 0.8 or more.

The first text may hold only a part of what others share, so that a repeat of
a later one stays without a pair. What no passage covers is therefore joined
again exactly. A stretch that repeats an earlier one leaves five of its tokens
unmatched at most, and a word inside that differs takes four or five, so what
two texts share is a run of NEED tokens, or two runs of as many together around
one gap, the longer of RUN tokens or more. A key stands for each way to choose
these: texts that have the key all repeat each other there, so that the star
around its first text loses nothing and is linear however many texts have it.
Since a token has hundreds of such keys, they are only made where shorter runs
are shared (a compact window of RUN tokens, runs beside its minimum, a run of
RUN) and by the task that has all texts with such a run, so that no key leaves
it. Up to FEW texts with a run are all compared instead.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texweave.llm.common import WordHashes, cut, mix, release, shingles, trim, trimmed

SIZE = 5
MIN_WORDS = 50
SIMILARITY = 0.8
HASHES = 5
#: Hash functions whose intervals of starts must meet, and the starts that count as one place.
ENOUGH, CELL = 2, 46
#: Tokens of a least passage, of these the matched ones that make it a repeat, and those of the longer of two runs that hold them.
WIDTH = MIN_WORDS - SIZE + 1
NEED = math.ceil(2 * WIDTH * SIMILARITY / (1 + SIMILARITY))
RUN = NEED // 2 + 1
#: Tokens that two texts must share on a diagonal to be compared along it.
ON_DIAGONAL = 6
#: Texts that are compared with one copy of an earlier text.
PART = 100
#: Words by which aligned passages may drift (insertions, deletions).
DRIFT = 8
#: Gaps between two runs: in tokens, those of the text that repeats (one word less, or another), and of the one it repeats.
OWN_GAPS = (SIZE - 1, SIZE)
GAPS = np.arange(SIZE - 1, SIZE + DRIFT + 1)
#: Texts with a run of RUN that are all compared with each other.
FEW = 32
#: Tokens before and behind a run of RUN that the keys with it may hold.
BESIDE = NEED - RUN + int(GAPS[-1])
#: Beyond all tokens that the keys with a run may hold.
COVERED = 127
#: Rows that a task hands on at once.
ROWS = 1 << 14
#: Bytes of texts that are worked on at once: so many that short texts cost no calls of their own, so few that they stay near the processor.
AT_ONCE = 1 << 17
#: Rows of several runs of RUN that are joined at once.
TOGETHER = 1 << 10
U = np.uint64
SEEDS = [U(0x9E3779B97F4A7C15 * (k + 1) % 2**64) for k in range(HASHES)]


def tokens(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return shingles(hashes.of(words), SIZE)


def compact_windows(values: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """All (l, c, r) of the Cartesian tree whose stretch l..r has ``width`` tokens or more; ties go left."""
    found, todo = [], [(0, len(values) - 1)]
    while todo:
        low, high = todo.pop()
        if high - low + 1 < width:
            continue
        c = low + int(values[low : high + 1].argmin())
        found.append((low, c, high))
        todo.append((low, c - 1))
        todo.append((c + 1, high))
    return found


def _starts(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_starts_of`` for one text alone."""
    return _starts_of(values, width, np.zeros(1, np.int64), np.array([len(values)]))[1:]


def _starts_of(values: np.ndarray, width: int, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The compact windows of ``width`` or more of texts (their first value and number), by their stretches of ``width``: text, first start, center, last start.

    A window (l, c, r) holds those that start in max(l, c - width + 1) ..
    min(c, r - width + 1). Minima of twice as many values at each step give
    every stretch's minimum at once; runs of one minimum are the windows.
    """
    n = len(values)
    if n < width:
        return (np.empty(0, np.int64),) * 4
    # The low bits hold the position, so that ties go left and minima name their place.
    bits = max(1, (n - 1).bit_length())
    lowest, done = (values >> U(bits) << U(bits)) | np.arange(n, dtype=U), 1
    while done < width:
        step = min(done, width - done)
        lowest, done = np.minimum(lowest[:-step], lowest[step:]), done + step
    many = np.maximum(count - width + 1, 0)
    start = _ranges(first, many)
    at = (lowest[start] & U((1 << bits) - 1)).astype(np.int64)  # never falls from one stretch to the next
    new = np.flatnonzero(np.concatenate((np.ones(min(len(at), 1), bool), at[1:] != at[:-1])))
    text = np.searchsorted(np.cumsum(many), new, side="right")
    return text, start[new], at[new], start[np.append(new[1:], len(at))[: len(new)] - 1]


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``many`` numbers from each ``first``."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


def _some(raws: list[bytes]) -> Iterator[slice]:
    """Slices of texts of AT_ONCE bytes, or of one longer text."""
    low = held = 0
    for k, raw in enumerate(raws):
        if k > low and held + len(raw) > AT_ONCE:
            yield slice(low, k)
            low, held = k, 0
        held += len(raw)
    if low < len(raws):
        yield slice(low, len(raws))


def _tokens_of(raws: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of some texts one after the other (with others between), and each text's first and number."""
    found, words = hashes.of_texts(raws)
    return shingles(found, SIZE), np.cumsum(words) - words, np.maximum(words - SIZE + 1, 0)


def _binary(values: np.ndarray, many: np.ndarray) -> pa.Array:
    """``values`` as bytes, ``many`` of them in each row."""
    offsets = np.concatenate(([0], np.cumsum(many))) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a column as ``_binary`` makes it, and how many each row has."""
    rows = column.to_pylist()
    values = np.frombuffer(b"".join(rows), kind)
    return values, np.fromiter(map(len, rows), np.int64, len(rows)) // values.itemsize


@trimmed
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each text: minima as 64-bit integers (the token, its three low bits the hash function), and their places (center, first and last start before it).

    With the minima of the shorter windows of RUN tokens of the first function, and a digest of all tokens.
    """
    hashes = WordHashes()
    for batch in batches:
        docs, raws = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for some in _some(raws):
            values, first, count = _tokens_of(raws[some], hashes)
            held = np.flatnonzero(count >= WIDTH)
            if not len(held):
                continue
            first, count = first[held], count[held]
            texts, keys, places = [], [], []
            for fn, seed in enumerate(SEEDS):
                mixed = mix(values ^ seed)
                text, low, c, high = _starts_of(mixed, WIDTH, first, count)
                texts.append(text)
                keys.append(values[c] >> U(3) << U(3) | U(fn))
                places.append((c - first[text]) << 12 | c - low << 6 | c - high)
                if fn == 0:
                    text, _, c, _ = _starts_of(mixed, RUN, first, count)
                    short_of, short, _ = _distinct(text, values[c], np.zeros(len(c), bool))
            texts = np.concatenate(texts)
            order = np.argsort(texts, kind="stable")
            many = np.bincount(texts, minlength=len(held))
            columns = [_binary(np.concatenate(x)[order], many) for x in (keys, places)]
            columns.append(_binary(short, np.bincount(short_of, minlength=len(held))))
            columns.append(pa.array([hashlib.blake2b(values[a : a + n].tobytes(), digest_size=16).digest() for a, n in zip(first, count)], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(docs[some][held], pa.int64()), *columns], names=["id", "keys", "places", "short", "digest"])


def _distinct(text: np.ndarray, keys: np.ndarray, is_open: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of each text, and which are open anywhere in it; sorted by text, the open ones first."""
    order = np.lexsort((~is_open, keys, text))
    text, keys, is_open = text[order], keys[order], is_open[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    text, keys, is_open = text[new], keys[new], is_open[new]
    order = np.lexsort((~is_open, text))
    return text[order], keys[order], is_open[order]


@trimmed
def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text and window."""
    for batch in batches:
        if batch.num_rows:
            keys, many = _unpacked(batch.column(1), "<i8")
            places, _ = _unpacked(batch.column(2), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), many)), pa.array(keys), pa.array(places)], names=["id", "key", "place"])


def starred(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``id, key``) whose key more than one text has, with the ``first`` and ``last`` of these.

    Keys of one text alone are dropped by an aggregate that combines before its
    shuffle; the join that follows is an equality that Spark can split where a
    key is hot. It hashes the shared keys, which are few, instead of sorting
    all rows.
    """
    stars = rows.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    return rows.join(stars.hint("shuffle_hash"), "key")


def windows(rows: DataFrame) -> DataFrame:
    """``id, keys, places, short, digest``: each text's windows in one row. Texts are tokenised once, before a cut."""
    return cut(rows.select("id", F.col("text").cast("binary").alias("raw")).mapInArrow(_windows, "id long, keys binary, places binary, short binary, digest binary"))


def shared(packed: DataFrame) -> DataFrame:
    """``id, key, place, first, last``: the windows whose minima more than one text has."""
    return starred(packed.select("id", "keys", "places").mapInArrow(_spread, "id long, key long, place long"))


def _pairs(met: DataFrame) -> DataFrame:
    """``doc_id, src_id, hub`` of distinct pairs ``id, hub``; ``src_id`` is the smaller."""
    ends = met.select(F.greatest("id", "hub").alias("doc_id"), F.least("id", "hub").alias("src_id"), "hub")
    return ends.groupBy("doc_id", "src_id").agg(F.min("hub").alias("hub"))


def candidates(met: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """The pairs of a text and the first with its minima whose windows meet: ``enough`` hash functions have starts in one cell.

    An interval is in each cell that it touches, so stretches that share their
    signatures are always in a common one.
    """
    center = F.shiftright("place", 12)
    low, high = center - F.shiftright("place", 6).bitwiseAND(63), center - F.col("place").bitwiseAND(63)
    cell = lambda start: F.floor(start / CELL)
    touched = met.filter("id > first").select("id", F.col("first").alias("hub"), F.explode(F.sequence(cell(low), cell(high))).alias("cell"), F.col("key").bitwiseAND(7).cast("int").alias("fn"))
    bits = touched.groupBy("id", "hub", "cell").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("int"), F.col("fn"))).alias("bits"))
    return _pairs(bits.filter(F.bit_count("bits") >= enough).select("id", "hub"))


class Runs:
    """Hashes of all runs of some texts' tokens, from one running sum, and which stretches no passage covers.

    ``first`` and ``count`` are the texts' first tokens and numbers of tokens,
    ``text`` of a place is which text it is in; ``ranges`` are passages in
    words, by text, first and end. Each text has WIDTH tokens or more.
    """

    def __init__(self, values: np.ndarray, first: np.ndarray, count: np.ndarray, hashes: WordHashes, ranges: np.ndarray) -> None:
        self.values, self.first, self.end = values, first, first + count
        powers, self.inverses = hashes.powers_of(len(values) + 1)
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum(values * powers[: len(values)], dtype=U)))
        reach = np.full(len(values), -1)
        np.maximum.at(reach, first[ranges[:, 0]] + ranges[:, 1], first[ranges[:, 0]] + ranges[:, 2] - SIZE)
        #: For each token the furthest that one passage covers which starts there or before; what one of another text covers is never beyond the token.
        self.reach = np.maximum.accumulate(reach)
        self.stretches = np.concatenate(([0], np.cumsum(self.open(np.arange(len(values)), WIDTH))))

    def of(self, text: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        """A hash for each run; 0 for those that do not lie in the text."""
        inside = (start >= self.first[text]) & (start + length <= self.end[text])
        at = np.where(inside, start, 0)
        return np.where(inside, mix((self.sums[np.where(inside, at + length, 0)] - self.sums[at]) * self.inverses[at]), U(0))

    def open(self, start: np.ndarray, length: int) -> np.ndarray:
        """Whether no single passage covers the runs."""
        return self.reach[start] < start + length - 1

    def open_around(self, text: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        """Whether some stretch of WIDTH that holds the run (of WIDTH or less) is open."""
        low, high = np.maximum(start + length - WIDTH, self.first[text]), np.minimum(start, self.end[text] - WIDTH)
        return self.stretches[high + 1] > self.stretches[low]


def _keyed(kind: int, found: np.ndarray) -> np.ndarray:
    return np.where(found != 0, mix(found ^ SEEDS[kind]), U(0))


def _halves(runs: Runs, text: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Keys of the runs on both sides of minima: one of them is in any run of RUN tokens with the minimum."""
    half = RUN // 2 + 1
    return np.stack([_keyed(1, runs.of(text, c, half)), _keyed(2, runs.of(text, c - half + 1, half))], axis=1)


class Held:
    """Which keys each of some texts has."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.salts = mix(np.arange(1, len(rows) + 1, dtype=U))
        self.keys = np.unique(np.concatenate(rows) ^ np.repeat(self.salts, list(map(len, rows))))

    def has(self, text: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        keys = keys ^ self.salts[text]
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Runs, Held, Held]]:
    """Some texts at a time with their live keys, and those of them where they are open and have an earlier text."""
    unpack, hashes = zstandard.ZstdDecompressor(), WordHashes()
    for batch in batches:
        ids, raws = batch.column("id").to_numpy(), [unpack.decompress(x) for x in batch.column("packed").to_pylist()]
        live, later = ([x.values.to_numpy(zero_copy_only=False).view(U) for x in batch.column(c)] for c in ("live", "later"))
        ranges = batch.column("ranges").to_pylist()
        for some in _some(raws):
            covered = [(k, r["start"], r["end"]) for k, rows in enumerate(ranges[some]) for r in rows or ()]
            runs = Runs(*_tokens_of(raws[some], hashes), hashes, np.array(covered, np.int64).reshape(-1, 3))
            yield ids[some], runs, Held(live[some]), Held(later[some])


def _level(level: int):
    """Of texts with live minima the keys beside these (1); of those with live keys the runs of RUN with the minimum (2)."""

    @trimmed
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, runs, live, later in _runs_of(batches):
            text, low, c, high = _starts_of(mix(runs.values ^ SEEDS[0]), RUN, runs.first, runs.end - runs.first)
            before = runs.values[c][:, None] if level == 1 else _halves(runs, text, c)
            holds = np.any([live.has(text, x) for x in before.T], axis=0)
            text, low, c, high, before = text[holds], low[holds], c[holds], high[holds], before[holds]
            is_open = np.any([later.has(text, x) for x in before.T], axis=0)
            if level == 1:
                is_open &= runs.open_around(text, c, 1)
                keys, text, is_open = _halves(runs, text, c).ravel(), np.repeat(text, 2), np.repeat(is_open, 2)
            else:
                many = high - low + 1
                p, text, is_open = _ranges(low, many), np.repeat(text, many), np.repeat(is_open, many)
                keys, is_open = _keyed(3, runs.of(text, p, RUN)), is_open & runs.open_around(text, p, RUN)
            there = keys != 0
            text, keys, is_open = _distinct(text[there], keys[there], is_open[there])
            opened = np.bincount(text[is_open], minlength=len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids), _binary(keys, np.bincount(text, minlength=len(ids))), pa.array(opened)], names=["id", "keys", "open"])

    return made


@trimmed
def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The live runs of RUN with the tokens around them and, for each start up to the run, how far a passage covers them (from the run); empty where the text is not open."""
    for ids, runs, live, later in _runs_of(batches):
        many = runs.end - runs.first - RUN + 1
        text, p = np.repeat(np.arange(len(ids)), many), _ranges(runs.first, many)
        keys = _keyed(3, runs.of(text, p, RUN))
        there = live.has(text, keys)
        text, p, keys = text[there], p[there], keys[there]
        is_open = later.has(text, keys) & runs.open_around(text, p, RUN)
        # Places that are alike make the same keys: one row stands for a loop. Those that reach beyond the text are unlike all others.
        like = runs.of(text, p - BESIDE, RUN + 2 * BESIDE)
        like = np.where(like != 0, like, mix(p.astype(U))) ^ live.salts[text]
        for some in np.array_split(np.arange(len(p)), -(-len(p) // ROWS)) if len(p) else ():
            _, first, alike = np.unique(like[some], return_index=True, return_inverse=True)
            at = p[some][:, None] + np.arange(-BESIDE, 1)
            reach = np.clip(runs.reach[np.maximum(at, runs.first[text[some]][:, None])] - p[some][:, None], -BESIDE - 1, COVERED).astype(np.int8)
            reach[~is_open[some]] = COVERED
            least = np.full((len(first), BESIDE + 1), COVERED, np.int8)
            np.minimum.at(least, alike.ravel(), reach)
            own = some[first]
            at = p[own][:, None] + np.arange(-BESIDE, RUN + BESIDE)
            inside = (at >= runs.first[text[own]][:, None]) & (at < runs.end[text[own]][:, None])
            # Places outside the text are unlike any others.
            near = (np.where(inside, runs.values[np.clip(at, 0, len(runs.values) - 1)], mix(at.view(U) + mix(ids[text[own]].astype(np.int64).view(U))[:, None])) >> U(32)).astype("<u4")
            opened = np.where((least < COVERED).any(axis=1), BESIDE + 1, 0)
            columns = [pa.array(ids[text[own]]), pa.array(keys[own].view(np.int64)), _binary(near.ravel(), np.full(len(own), near.shape[1])), _binary(least[opened > 0].ravel(), opened)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "near", "reach"])


def _firsts(ids: np.ndarray, near: np.ndarray, reach: np.ndarray, is_open: np.ndarray, powers: np.ndarray, inverses: np.ndarray) -> np.ndarray:
    """Links (id, hub) between the texts with a run of RUN, by run and id: of each key of NEED tokens with that run as the longer one, open texts with the first.

    Rows of several runs can be given at once, since a key holds its run.
    """
    sums = np.zeros((near.shape[1] + 1, len(ids)), U)
    np.cumsum(mix(near.T.astype(U)) * powers[: near.shape[1], None], axis=0, dtype=U, out=sums[1:])
    links, own, reach = [np.empty(0, np.int64)], np.flatnonzero(is_open), np.ascontiguousarray(reach.T)

    def run(start: int, length: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        start += BESIDE
        return (sums[start + length, rows] - sums[start, rows]) * inverses[start]

    def join(made: Callable[[int, np.ndarray | slice], np.ndarray], gaps: list[int], ours: list[tuple[int, np.ndarray]]) -> None:
        """made: the keys of texts with a gap; ours: the gaps that are the text's own, and the open texts there."""
        if not any(len(mine) for _, mine in ours):
            return
        asked = [made(gap, mine) for gap, mine in ours]
        wanted = np.unique(np.concatenate(asked))
        hubs = np.full(len(wanted), len(ids))
        for gap in gaps:
            keys = made(gap, slice(None))
            at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
            there = np.flatnonzero(wanted[at] == keys)
            np.minimum.at(hubs, at[there], there)
        for (_, mine), keys in zip(ours, asked):
            hub = hubs[np.searchsorted(wanted, keys)]
            links.append(np.unique((mine * len(ids) + hub)[ids[hub] < ids[mine]]))

    def still(start: int, length: int) -> np.ndarray:
        return own[reach[start + BESIDE] < start + length - 1]

    for e in range(NEED - RUN + 1):
        join(lambda _, rows: run(-e, NEED, rows), [0], [(0, still(-e, NEED))])
    close = GAPS[:-1].tolist()  # within DRIFT of both OWN_GAPS, the last only of the longer
    far = [OWN_GAPS[1], int(GAPS[-1])]
    for e in range(NEED - RUN):
        more = NEED - RUN - e
        left, right = mix(run(-e, RUN + e)), mix(run(0, RUN + e))
        for gaps in (close, far):
            join(lambda g, rows: left[rows] + run(RUN + g, more, rows), gaps, [(g, still(-e, NEED + g)) for g in gaps if g in OWN_GAPS])
            join(lambda g, rows: right[rows] + run(-g - more, more, rows), gaps, [(g, still(-g - more, NEED + g)) for g in gaps if g in OWN_GAPS])
    found = np.unique(np.concatenate(links))
    return np.stack([ids[found // len(ids)], ids[found % len(ids)]], axis=1)


@trimmed
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_around`` sorted by key and id -> distinct links of each key."""
    powers, inverses = WordHashes().powers_of(RUN + 2 * BESIDE + 1)
    rest: list[pa.RecordBatch] = []

    def linked(some: pa.Table) -> np.ndarray:
        some = some.combine_chunks()
        ids, opened = some["id"].to_numpy(), some["reach"].to_pylist()
        near = np.frombuffer(b"".join(some["near"].to_pylist()), "<u4").reshape(len(ids), -1)
        is_open = np.array([len(x) > 0 for x in opened])
        reach = np.frombuffer(b"".join(opened), np.int8).reshape(-1, BESIDE + 1)
        return _firsts(ids, near, reach, is_open, powers, inverses)

    def whole(held: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = held["key"].to_numpy()
        edges = np.concatenate((np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        # About TOGETHER rows of whole keys at a time.
        edges = np.concatenate(([0], edges[np.concatenate((np.diff(edges // TOGETHER) > 0, [True]))]))
        links = np.concatenate([linked(held.slice(a, b - a)) for a, b in zip(edges[:-1], edges[1:])])
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["id", "hub"])

    for batch in batches:
        if not batch.num_rows:
            continue
        # All but the last key of a batch are complete.
        keys = batch.column("key").to_numpy()
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if rest and (last or rest[0].column("key")[0].as_py() != int(keys[0])):
            yield from whole(pa.Table.from_batches([*rest, batch.slice(0, last)]))
            rest = []
        elif last:
            yield from whole(pa.Table.from_batches([batch.slice(0, last)]))
        rest.append(batch.slice(last))
    if rest:
        yield from whole(pa.Table.from_batches(rest))


def _spread_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text and key."""
    for batch in batches:
        if batch.num_rows:
            keys, many = _unpacked(batch.column(1), "<i8")
            place = _ranges(np.zeros(len(many), np.int64), many)
            is_open = place < np.repeat(batch.column(2).to_numpy(), many)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), many)), pa.array(keys), pa.array(is_open)], names=["id", "key", "open"])


def others(packed: DataFrame, pairs: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that ``candidates`` left out: with the first text of every key of NEED tokens that no passage ``found`` covers in a later one.

    Of texts with equal tokens the first stands for all, and the others are
    paired with it. A key goes on to the next level if a text that is open
    there has an earlier one with the key.
    """
    firsts = packed.groupBy("digest").agg(F.min("id").alias("hub"))
    copies = packed.select("id", "digest").join(firsts, "digest").filter("id > hub").select("id", "hub")
    ranges = found.groupBy("doc_id").agg(F.collect_set(F.struct(F.col("start_word").alias("start"), F.col("end_word").alias("end"))).alias("ranges"))
    held = texts.join(ranges, texts["id"] == ranges["doc_id"], "left").select("id", "packed", "ranges")
    short = packed.join(firsts, packed["id"] == firsts["hub"], "left_semi").select("id", F.col("short").alias("keys"), F.expr("cast(octet_length(short) / 8 as bigint)").alias("open"))
    made = cut(short)
    for level in range(1, 4):
        rows = made.mapInArrow(_spread_level, "id long, key long, open boolean")
        last = F.max(F.when(F.col("open"), F.col("id"))).alias("last")
        stars = rows.groupBy("key").agg(F.min("id").alias("first"), last, F.count(F.lit(1)).alias("many")).filter("first < last")
        if level == 3:
            stars = cut(stars)
            few = rows.join(stars.filter(F.col("many") <= FEW).hint("shuffle_hash"), "key").groupBy("key").agg(F.collect_list(F.struct("id", "open")).alias("x"))  # FEW at most
            ends = few.select(F.explode("x").alias("a"), "x").select("a", F.explode("x").alias("b")).filter("a.open and a.id > b.id")
            met = copies.union(ends.select(F.col("a.id").alias("id"), F.col("b.id").alias("hub")))
            stars = stars.filter(F.col("many") > FEW)
        later = F.when(F.col("open") & (F.col("id") > F.col("first")), F.col("key"))
        live = rows.join(stars.hint("shuffle_hash"), "key").groupBy("id").agg(F.collect_list("key").alias("live"), F.collect_list(later).alias("later"))  # keys of one text
        if level < 3:
            made = cut(live.join(held, "id").mapInArrow(_level(level), "id long, keys binary, open long"))
    around = live.join(held, "id").mapInArrow(_around, "id long, key long, near binary, reach binary")
    tied = cut(around.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_links, "id long, hub long").distinct())
    return _pairs(met.union(tied)).join(pairs, ["doc_id", "src_id"], "left_anti")


class Ranked:
    """A text's tokens with their order by value, made once for all comparisons with the text."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.order = np.argsort(values, kind="stable")
        self.ranked = values[self.order]
        same = self.ranked[1:] == self.ranked[:-1]
        #: Which of the ranked tokens the text holds more than once.
        self.often = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(values) else np.zeros(0, bool)
        self.last: tuple[np.ndarray | None, np.ndarray, np.ndarray] = (None, *[np.empty(0, np.int64)] * 2)

    def met(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of another text's tokens that the text holds, and where these are first among the ranked; kept for the text last asked for."""
        if self.last[0] is not own:
            low = np.searchsorted(self.ranked, own)
            here = np.flatnonzero(self.ranked[np.minimum(low, len(self.ranked) - 1)] == own)
            self.last = own, here, low[here]
        return self.last[1:]


def diagonals(own: np.ndarray, earlier: Ranked) -> list[int]:
    """Differences of position (earlier - own) on which the texts share ON_DIAGONAL tokens or more.

    Equal tokens are paired with the first of their kind, and by their number
    from either end, which keeps a repetitive passage on its diagonal.
    """
    if not len(own) or not len(earlier.values):
        return []
    order, ranked = earlier.order, earlier.ranked
    here, low = earlier.met(own)
    if len(here) < ON_DIAGONAL:
        return []
    shifts = [order[low] - here]
    by_token = np.argsort(low, kind="stable")
    sorted_low = low[by_token]
    new = np.concatenate(([True], sorted_low[1:] != sorted_low[:-1]))
    if earlier.often[low].any() or not new.all():
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(low)))
        nth = np.empty(len(low), np.int64)
        nth[by_token] = np.arange(len(low)) - np.repeat(first, many)
        left = np.empty(len(low), np.int64)
        left[by_token] = np.repeat(many, many)
        left -= nth + 1
        high = np.searchsorted(ranked, own[here], side="right")
        for partner in (low + nth, high - 1 - left):
            both = np.flatnonzero((partner >= low) & (partner < high))
            shifts.append(order[partner[both]] - here[both])
    base = len(own) - 1  # of the lowest difference
    found = np.zeros(base + len(earlier.values), bool)
    for shift in shifts:
        found |= np.bincount(shift + base, minlength=len(found)) >= ON_DIAGONAL
    return (np.flatnonzero(found) - base).tolist()


def repeated(own: np.ndarray, prepared: Ranked, shifts: list[int], similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Word ranges (start, end) of a text that repeat an earlier one along the given diagonals.

    A stretch of ``min_words`` words repeats if m of its T tokens are found at
    the diagonal (within DRIFT) and m / (2T - m) reaches ``similarity``; ranges
    are unions of such stretches, without unmatched tokens at their ends.
    """
    width = min_words - SIZE + 1
    earlier = prepared.values
    if len(own) < width or len(earlier) < width:
        return []
    need = math.ceil(2 * width * similarity / (1 + similarity))
    here, low = prepared.met(own)
    if len(here) < need:
        return []
    edge = np.zeros(len(own) + 1, np.int64)
    # The place of a token that the earlier text has once tells its match; for the others all places within DRIFT are looked at.
    places, several = prepared.order[low] - here, here[prepared.often[low]]
    # Tokens that the earlier text repeats over a whole stretch have no diagonal of their own.
    often = prepared.often
    cyclic = np.isin(own, prepared.ranked[often]) if often.sum() >= width else np.zeros(len(own), bool)
    last, loops = None, cyclic.any()
    for shift in [None, *sorted(shifts)]:
        match = cyclic.copy()
        if shift is None:
            if not loops:
                continue
        elif last is not None and shift - last <= DRIFT // 2:
            continue
        else:
            last = shift
            near = np.abs(places - shift) <= DRIFT
            if not loops and np.count_nonzero(near) + len(several) < need:
                continue
            match[here[near]] = True
            if len(several):
                at = several[:, None] + np.arange(shift - DRIFT, shift + DRIFT + 1)
                same = (earlier[np.clip(at, 0, len(earlier) - 1)] == own[several][:, None]) & (at >= 0) & (at < len(earlier))
                match[several] |= same.any(axis=1)
        total = np.concatenate(([0], np.cumsum(match)))
        good = np.flatnonzero(total[width:] - total[:-width] >= need)
        if not len(good):
            continue
        hit = np.flatnonzero(match)
        starts = good[np.concatenate(([True], np.diff(good) > width))]
        ends = good[np.concatenate((np.diff(good) > width, [True]))] + width
        for a, b in zip(starts, ends):
            inside = hit[np.searchsorted(hit, a) : np.searchsorted(hit, b)]
            edge[inside[0]] += 1
            edge[inside[-1] + 1] -= 1
    covered = np.concatenate(([0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]))
    change = np.diff(covered)
    return [(int(a), int(b) + SIZE - 1) for a, b in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1))]


@trimmed
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts, compressed: smaller than their tokens."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress(x.as_py()) for x in batch.column(1)], pa.binary())], names=["id", "packed"])


@trimmed
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub, part and other, the hub's text (without other) first in its part -> passages."""
    unpack, hashes = zstandard.ZstdDecompressor(), WordHashes()

    def of(packed: list[bytes]) -> Iterator[np.ndarray]:
        raws = [unpack.decompress(x) for x in packed]
        for some in _some(raws):
            values, first, count = _tokens_of(raws[some], hashes)
            values = (values >> U(32)).astype("<u4")
            yield from (values[a : a + n] for a, n in zip(first.tolist(), count.tolist()))

    held, its_text, its_tokens = None, b"", Ranked(np.empty(0, "<u4"))
    for batch in batches:
        rows = []
        hubs, others, packed = (batch.column(c).to_pylist() for c in ("hub", "other", "packed"))
        for hub, other, text, values in zip(hubs, others, packed, of(packed)):
            if other is None:
                if hub != held:
                    held, its_text, its_tokens = hub, text, Ranked(values.copy())
                continue
            later, earlier = max(hub, other), min(hub, other)
            if text == its_text:
                words = len(its_tokens.values) + SIZE - 1
                if words >= MIN_WORDS:
                    rows.append((later, earlier, 0, words, words))
                continue
            own, base = (values, its_tokens) if other == later else (its_tokens.values, Ranked(values))
            if len(base.met(own)[0]) < NEED:
                continue
            rows += [(later, earlier, start, end, end - start) for start, end in repeated(own, base, diagonals(own, base))]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "src_id", "start_word", "end_word", "n_words"])


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``id, text`` of the rows with a doc_id, and ``doc_id, text_hash, id`` if ids are not the doc_ids.

    They are unless some doc_id has several texts; then each text gets an id of
    its own, in the order of doc_ids.
    """
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    several = hashed.groupBy("doc_id").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).filter("low <> high")
    if several.isEmpty():
        return rows.withColumnRenamed("doc_id", "id"), None
    keys = hashed.select("doc_id", "text_hash").distinct().repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    keys = cut(keys.withColumn("id", F.monotonically_increasing_id()))
    return hashed.join(keys, ["doc_id", "text_hash"]).select("id", "text"), keys


def _found(rows: DataFrame) -> DataFrame:
    """The passages of ``rows`` (``id, text``), with ids for doc_id and src_id."""
    texts = rows.select("id", F.col("text").cast("binary").alias("raw")).mapInArrow(_pack, "id long, packed binary").groupBy("id").agg(F.max("packed").alias("packed"))
    packed = windows(rows)
    pairs = cut(candidates(shared(packed)))
    texts = cut(texts)
    found = cut(_compared(pairs, texts))
    rest = cut(others(packed, pairs, found, texts))
    release(rows.sparkSession)
    return found.union(_compared(rest, texts))


def passages(docs: DataFrame) -> DataFrame:
    """``doc_id, src_id, start_word, end_word, n_words, text_hash``: passages that repeat one of a text with a smaller id.

    Words are counted from 0, the end is exclusive. Null texts count as empty;
    texts under MIN_WORDS words have no passage; rows without an id are left
    out. Texts of one id are compared as texts of their own, ``text_hash``
    (xxhash64) tells whose passage it is, and is null where every id has one
    text; src_id may then be the id itself. Copies inside one text are not
    passages across documents. Long texts cost in proportion to their words and
    matches. Other columns are ignored; an empty table gives an empty result.
    """
    rows, keys = _numbered(docs)
    found = _found(rows)
    if keys is None:
        return found.withColumn("text_hash", F.lit(None).cast("long"))
    later = keys.select(F.col("doc_id").alias("later"), "text_hash", F.col("id").alias("doc_id"))
    earlier = keys.select(F.col("doc_id").alias("earlier"), F.col("id").alias("src_id"))
    told = found.join(later, "doc_id").join(earlier, "src_id")
    return told.select(F.col("later").alias("doc_id"), F.col("earlier").alias("src_id"), "start_word", "end_word", "n_words", "text_hash")


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The verified passages of ``pairs`` (``doc_id, src_id, hub``, the hub one of both)."""
    # A hub meets its partners in many tasks, PART texts in each.
    load = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    ends = pairs.select("hub", F.when(F.col("hub") == F.col("src_id"), F.col("doc_id")).otherwise(F.col("src_id")).alias("other"))
    dealt = ends.join(load, "hub").select("hub", F.pmod(F.xxhash64("other"), F.col("parts")).alias("part"), "other")
    hubs = load.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("other"))
    wanted = dealt.union(hubs).withColumn("id", F.coalesce("other", "hub"))
    met = wanted.join(texts, "id").select("hub", "part", "other", "packed").repartition("hub", "part").sortWithinPartitions("hub", "part", "other")
    return met.mapInArrow(_verify, "doc_id long, src_id long, start_word long, end_word long, n_words long")


def spans(found: DataFrame) -> DataFrame:
    """``doc_id, text_hash, spans``: the merged word ranges of each text that has passages (``array<struct<start,end>>``)."""
    ranges = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct(F.col("start_word").alias("start"), F.col("end_word").alias("end")))).alias("r"))
    none = F.slice(F.col("r"), 1, 0)

    def add(done, x):
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (x["start"] <= F.get(done, F.size(done) - 1)["end"]), longer).otherwise(F.concat(done, F.array(x)))

    return ranges.select("doc_id", "text_hash", F.aggregate("r", none, add).alias("spans"))


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated passage cut from its text; the first text that has it keeps it.

    Lines and white space around a cut stay. Columns are unchanged, and so are
    rows without a passage; a text that is nothing but repeats becomes empty
    and its row is dropped. An ``n_chars`` column follows the new text.
    """
    found = spans(passages(docs))

    @F.pandas_udf("string")
    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, ranges in batches:
            yield pd.Series([cut_words(t, [(s["start"], s["end"]) for s in r]) if r is not None else t for t, r in zip(texts, ranges)], dtype=object)
        trim()

    named = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"))
    own = named["_hash"].isNull() | (named["_hash"] == F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    joined = docs.join(named, (docs["doc_id"] == named["_id"]) & own, "left")
    changed = F.col("_spans").isNotNull()
    text = F.when(changed, without(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    kept = joined.withColumn("text", text).filter(~changed | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the words of the ranges; white space between what stays is as it was before the cut."""
    raw = text.encode()
    ends: list[tuple[int, int]] = []
    at = 0
    for word in raw.split():
        at = raw.index(word, at)
        ends.append((at, at + len(word)))
        at += len(word)
    out, last = [], 0
    for start, end in ranges:
        if start < len(ends):
            out.append(raw[last : ends[start][0]])
            last = ends[min(end, len(ends)) - 1][1]
            while last < len(raw) and raw[last : last + 1].isspace():
                last += 1
    out.append(raw[last:])
    return b"".join(out).decode()
