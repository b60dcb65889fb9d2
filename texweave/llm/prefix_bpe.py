"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is one token that can end its encoding:
the token whose own prefix is already encoded and which forms a valid pair with
that prefix's last token. Storing that last token per prefix gives exact
encodings of all prefixes at once, exact appends (only new bytes are computed)
and cheap re-encoding near an edit (prefixes before it stay, and after it the
table is recomputed).

A pair of adjacent tokens is valid if merging by rank could have left them as
neighbours: undoing the later of the two merges on the facing sides must never
reveal a pair that an earlier merge would have joined.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cuts a text where no match of the token pattern can span: before a word with
#: its leading space, and around white space.
CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python's \s also takes these, which Unicode's White_Space (and so the pattern) does not.
NOT_WHITE = re.compile(r"[\x1c-\x1f]")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairRanks:
    """A rank table with the merge that makes each token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._known: dict[tuple[int, int], bool] = {}

    @cached_property
    def parts(self) -> dict[int, tuple[int, int]]:
        """Id -> ids of the two tokens that its merge joins (itself twice for single bytes)."""
        return {i: self._split(t, i) for t, i in self.ranks.items()}

    @cached_property
    def merged(self) -> dict[tuple[int, int], int]:
        """Pair of ids -> id of the token that joins them, by the merge that makes it."""
        return {p: i for i, p in self.parts.items() if p != (i, i)}

    @cached_property
    def endings(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            found.add_word(t.decode("latin-1"), (len(t), i))
        found.make_automaton()
        return found

    def _split(self, token: bytes, own: int) -> tuple[int, int]:
        pieces = [token[k : k + 1] for k in range(len(token))]
        while len(pieces) > 2:
            best = min(((self.ranks.get(a + b, own), k) for k, (a, b) in enumerate(zip(pieces, pieces[1:]))), default=(own, 0))
            if best[0] >= own:
                break
            pieces[best[1] : best[1] + 2] = [pieces[best[1]] + pieces[best[1] + 1]]
        if len(pieces) != 2:
            return own, own
        return self.ranks[pieces[0]], self.ranks[pieces[1]]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether an encoding can hold ``left`` directly before ``right``; remembered up to a bound."""
        known = self._known.get((left, right))
        if known is None:
            if len(self._known) >= 500_000:
                self._known.clear()
            known = self._known[left, right] = self._neighbours(left, right)
        return known

    def _neighbours(self, left: int, right: int) -> bool:
        bound = 1 << 60  # joins of this rank or later would come after the merges still undone
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < bound:
                return False
            if left > right:  # the left token's last merge happened later: look before it
                inner = self.parts[left][1]
                if inner != left:
                    bound, left = left, inner
                    continue
                bound, inner = right + 1, self.parts[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                inner = self.parts[right][0]
                if inner != right:
                    bound, right = right + 1, inner
                    continue
                bound, inner = left, self.parts[left][1]
                if inner == left:
                    return True
                left = inner


class PrefixEncoder:
    """The encoding of one piece, kept for all of its prefixes."""

    def __init__(self, table: PairRanks, piece: bytes = b""):
        self.table, self.text, self.last = table, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Adds bytes; prefixes that are there stay as they are."""
        start = len(self.text)
        self.text += more
        self.last += [-1] * len(more)
        table, last, known = self.table, self.last, self.table._known
        origin = max(0, start - table.longest)
        # Matches come by their end, so every prefix before is complete by then.
        for end, (size, token) in table.endings.iter(self.text[origin:].decode("latin-1")):
            at = origin + end + 1
            if at <= start or last[at] >= 0:
                continue
            if at == size:
                last[at] = token
                continue
            left = last[at - size]
            if left >= 0:
                fits = known.get((left, token))
                if table.neighbours(left, token) if fits is None else fits:
                    last[at] = token
        if -1 in last[start + 1 :]:
            raise ValueError("a prefix has no last token; a single byte is missing from the ranks")

    def replace(self, start: int, stop: int, by: bytes) -> None:
        """Edits bytes ``start:stop``; only prefixes beyond ``start`` are computed again."""
        tail = self.text[stop:]
        self.text, self.last = self.text[:start], self.last[: start + 1]
        self.append(by + tail)

    def ids(self, size: int | None = None) -> list[int]:
        """Ids of the prefix of ``size`` bytes (all)."""
        at, found = len(self.text) if size is None else size, []
        while at:
            found.append(self.last[at])
            at -= len(self.table.token[self.last[at]])
        return found[::-1]


class Codec:
    """Encodes and decodes whole texts; distinct chunks are encoded once while remembered.

    What is remembered is bounded: two generations of ``LIMIT`` chunks of at
    most ``LONG`` characters. Longer chunks are encoded each time.
    """

    LIMIT = 250_000
    LONG = 64

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.table, self.pattern = PairRanks(ranks), regex.compile(pattern)
        self.young, self.old = _Lookup(self), {}

    def lookup(self, chunk: str) -> tuple[str, bytes]:
        """Decimal ids of a chunk joined by spaces, and what they decode to."""
        value = self.old.get(chunk)
        if value is None:
            ids = self._chunk(chunk)
            value = " ".join(map(str, ids)), self.decode(ids)
        if len(chunk) <= self.LONG:
            if len(self.young) >= self.LIMIT:
                self.old, self.young = self.young, _Lookup(self)
            self.young[chunk] = value
        return value

    def _chunk(self, chunk: str) -> list[int]:
        found: list[int] = []
        for match in self.pattern.findall(chunk):
            raw = match.encode()
            whole = self.table.ranks.get(raw)
            found += (whole,) if whole is not None else PrefixEncoder(self.table, raw).ids()
        return found

    def both(self, text: str) -> tuple[str, bytes]:
        """Decimal ids joined by one space, and the bytes that they decode to."""
        if not text:
            return "", b""
        chunks = [text] if NOT_WHITE.search(text) else CHUNKS.findall(text)
        ids, raw = zip(*map(self.young.__getitem__, chunks))
        return " ".join(ids), b"".join(raw)

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.both(text)[0].split()]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.table.token[i] for i in ids])


class _Lookup(dict):
    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, chunk: str) -> tuple[str, bytes]:
        return self.codec.lookup(chunk)


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(key: int, ranks: dict[bytes, int], pattern: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    if (key, pattern) not in _codecs:
        _codecs[key, pattern] = Codec(ranks, pattern)
    return _codecs[key, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, after an exact round trip.

    Null texts count as empty (no tokens; the hashes are those of no bytes).
    Repeated rows are encoded each; other columns are ignored; an empty table
    gives an empty result. Very long texts cost in proportion to their length.
    One pass, no shuffle. The rank file (bounded by the vocabulary) is read on
    the driver and broadcast.
    """
    ranks = load_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = hash((ranks_path, len(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared.value, pattern)
        for batch in batches:
            n, enc, dec = [], [], []
            for value in batch.column(1):
                ids, raw = codec.both(value.as_py() or "")
                n.append(ids.count(" ") + 1 if ids else 0)
                enc.append(hashlib.sha256(ids.encode()).hexdigest())
                dec.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row; null texts give an empty array."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    key = hash((ranks_path, len(shared.value)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared.value, pattern)
        for batch in batches:
            ids = [codec.encode(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")
