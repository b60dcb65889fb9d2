"""Token ids of whole texts by a ``tokenizers`` BPE vocabulary, many texts at once.

The vocabulary's pre-tokenizer cuts a text into runs of letters, single digits,
runs of other characters and a few English endings, and drops white space. For
Latin-1 texts, where NFC and lower-casing act on single characters, these cuts
follow from the class of each character and of the one before, so they are made
for whole blocks of texts in columns of numbers; equal pieces are found by
dictionary encoding. Pieces seen before are remembered up to a bound; new ones
are merged together: every round joins, in every piece, its leftmost pair of
lowest rank. Any other text, and one that holds a special token's string, goes
to the library itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from texweave.llm.common import trim

#: Python takes these for white space, the library does not.
ODD = re.compile(r"[\x1c-\x1f]")
NONE = np.int32(2**31 - 1)
SPACE, LETTER, DIGIT, OTHER = range(4)
#: English endings that are pieces of their own after an apostrophe, fixed values of the vocabulary.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
PATTERN = "|".join(f"'{x}" for x in ENDINGS) + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _classes() -> np.ndarray:
    """The class of each Latin-1 character."""
    kinds = ((r"\s", SPACE), (r"\p{L}", LETTER), (r"\p{N}", DIGIT))
    return np.array([next((k for p, k in kinds if regex.match(p, chr(c))), OTHER) for c in range(256)], np.uint8)


class WordTokens:
    #: Pieces remembered (besides those of the texts in work), and the longest of them in bytes.
    LIMIT = 200_000
    LONG = 48
    #: Characters of the texts that are worked on together.
    VOLUME = 2_000_000

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN:
            raise ValueError("this vocabulary cuts texts in another way")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.classes = _classes()
        self.known: dict[bytes, bytes] = {}
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.final = np.array([vocab[x + end] for x in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def library_ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def plain(self, text: str) -> bytes | None:
        """``text`` in lower case as Latin-1, or None where cuts by character class are not exact."""
        if ODD.search(text) or self.special.search(text):
            return None
        try:
            return text.lower().encode("latin-1")
        except UnicodeEncodeError:
            return None

    def all_ids(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        held: list[str] = []
        volume = 0
        for text in texts:
            held.append(text)
            volume += len(text)
            if volume >= self.VOLUME:
                yield from self._together(held)
                held, volume = [], 0
        yield from self._together(held)

    def ids(self, text: str) -> np.ndarray:
        return next(self.all_ids([text]))

    def _together(self, texts: list[str]) -> Iterator[np.ndarray]:
        raws = [self.plain(x) for x in texts]
        found = self._block([x for x in raws if x is not None])
        for text, raw in zip(texts, raws):
            yield next(found) if raw is not None else self.library_ids(text)

    def _block(self, raws: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each of many lower-case Latin-1 texts."""
        flat = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        starts = self._starts(flat)
        solid = self.classes[flat] != SPACE
        at = np.flatnonzero(starts)  # where pieces start
        ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
        last_piece = np.searchsorted(at, ends)
        offsets = np.append(np.flatnonzero(starts[solid]), np.count_nonzero(solid)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat[solid])]).dictionary_encode()
        ids, first, size = self._ids(pieces.dictionary.to_pylist())
        piece = pieces.indices.to_numpy()
        many = size[piece]
        upto = np.cumsum(many)
        out = ids[np.repeat(first[piece] - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)]
        low = 0
        for high in np.concatenate(([0], upto))[last_piece].tolist():
            yield out[low:high]
            low = high

    def _starts(self, flat: np.ndarray) -> np.ndarray:
        """Whether a piece starts at each character."""
        kind = self.classes[flat]
        starts = (kind == DIGIT) | (np.append([SPACE], kind[:-1]) != kind)
        starts &= kind != SPACE
        quote = np.flatnonzero(flat == ord("'"))
        if len(quote):
            # An ending counts if its apostrophe starts a piece; a letter follows, so the apostrophe is alone.
            quote = quote[starts[quote]]
            for text in ENDINGS:
                here = quote[quote + len(text) < len(flat)]
                for k, letter in enumerate(text.encode(), 1):
                    here = here[flat[here + k] == letter]
                starts[here + 1] = False
                after = here + len(text) + 1
                after = after[after < len(flat)]
                starts[after] |= kind[after] == LETTER
        return starts

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all distinct pieces in a row, and where those of each start and how many they are."""
        if len(self.known) > self.LIMIT:
            self.known.clear()
        found = list(map(self.known.get, pieces))
        new = [k for k, x in enumerate(found) if x is None]
        for k, x in zip(new, self._merge([p if p.isascii() else p.decode("latin-1").encode() for p in map(pieces.__getitem__, new)])):
            found[k] = x
            if len(pieces[k]) <= self.LONG:
                self.known[pieces[k]] = x
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size, size

    def _merge(self, words: list[bytes]) -> list[bytes]:
        found: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 8), (8, 16), (16, 64)):
            at = np.flatnonzero((size > low) & (size <= high))
            for part in np.array_split(at, max(1, -(-len(at) * high // 1_000_000))):
                if len(part):
                    ids, counts = self._merge_block([words[k] for k in part], size[part])
                    raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
                    start = 0
                    for k, end in zip(part.tolist(), ends.tolist()):
                        found[k] = raw[start:end]
                        start = end
        for k in np.flatnonzero(size > 64):
            found[k] = self.library_ids(words[k].decode()).tobytes()
        return found

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], NONE)

    def _merge_block(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(size.max()) + 1  # one column of padding on the right
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[flat]
        last = np.cumsum(size) - 1
        ids[last] = self.final[flat[last]]
        table = np.full((len(words), width), -1, np.int32)
        table[np.arange(width) < size[:, None]] = ids
        rank = np.full((len(words), width), NONE, np.int32)
        rank[:, :-1] = self._rank(table[:, :-1], table[:, 1:])
        rows, column = np.arange(len(words)), np.arange(width)
        live_table, live_rank = table, rank
        while True:
            k = live_rank.argmin(axis=1)
            best = live_rank[np.arange(len(k)), k]
            go = best < NONE
            if not go.all():
                table[rows[~go]] = live_table[~go]
                rows, live_table, live_rank, k, best = rows[go], live_table[go], live_rank[go], k[go], best[go]
            if not len(rows):
                break
            here = np.arange(len(rows))
            live_table[here, k] = self.made[best]
            shift = np.minimum(column + (column > k[:, None]), width - 1)
            live_table = np.take_along_axis(live_table, shift, 1)
            live_rank = np.take_along_axis(live_rank, shift, 1)
            live_rank[here, k] = self._rank(live_table[here, k], live_table[here, np.minimum(k + 1, width - 1)])
            inner = k > 0
            live_rank[here[inner], k[inner] - 1] = self._rank(live_table[here[inner], k[inner] - 1], live_table[here[inner], k[inner]])
        return table[table >= 0], (table >= 0).sum(axis=1)


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letters)
    return [x for _, x in sorted((letters | {b: chr(256 + k) for k, b in enumerate(hidden)}).items())]


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One instance per Python process and vocabulary, until ``forget``."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
        trim()  # what reading the file took
    return _loaded[path]


def forget() -> None:
    """Lets the vocabularies go; a worker that stays for tasks of other operators need not hold them."""
    _loaded.clear()
    trim()
