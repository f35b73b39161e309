"""Encoding a corpus with a public byte-level BPE tokenizer.

Texts are cut into words by the tokenizer's pattern; each distinct word of a slice that is not in the worker's bounded cache
is encoded once.  Words of similar length form a padded numpy matrix of symbol ids; in every round each row merges its pair
of least rank from the left, with pairs looked up in a hash table, and the rows are compacted.  A merged symbol takes part in
later ranks only, so all occurrences of a row's least pair can merge in one round.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_arrow

#: Words kept with their ids per Python worker; the cache only saves time.
CACHE_WORDS = 300_000
NONE = np.int64(1 << 40)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Pair of symbol ids to (rank, merged id): open addressing in numpy arrays, probed for whole matrices at once."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.bits = max(4, (4 * len(merges) - 1).bit_length())
        size = 1 << self.bits
        self.keys, self.rank, self.merged = np.full(size, -1, np.int64), np.full(size, NONE, np.int64), np.zeros(size, np.int32)
        a, b, m = (np.array(x, dtype=np.int64) for x in zip(*merges))
        key, rank = (a << 32) | b, np.arange(len(merges), dtype=np.int64)
        _, first = np.unique(key, return_index=True)
        todo, at = np.sort(first), None
        at = self._slot(key[todo])
        while len(todo):  # each free slot takes the first of those that want it, the others go on to the next slot
            free = self.keys[at] == -1
            want, order = np.unique(at[free], return_index=True)
            who = todo[free][order]
            self.keys[want], self.rank[want], self.merged[want] = key[who], rank[who], m[who]
            rest = self.keys[at] != key[todo]
            todo, at = todo[rest], (at[rest] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (``NONE`` where there is no merge) and slots."""
        key = (left.astype(np.int64) << 32) | right
        at = self._slot(key)
        held = self.keys[at]
        open_ = np.nonzero((held != key) & (held != -1))[0] if key.ndim == 1 else None
        assert open_ is not None
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[at[open_]]
            open_ = open_[(held != key[open_]) & (held != -1)]
        return np.where(self.keys[at] == key, self.rank[at], NONE), at


class Bpe:
    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
        self.table = PairTable([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.byte_id = np.zeros(256, np.int32)
        for ch, b in _byte_of_char().items():
            self.byte_id[b] = vocab[ch]
        self.reach = max(map(len, vocab)) + 2  # no symbol has more bytes than its name has characters
        try:
            from public_tokenizers import PATTERN
        except ImportError:
            PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.split = regex.compile(PATTERN).findall
        self.clear()

    def clear(self) -> None:
        """The cache: a number for each word, and where its ids lie in one flat array."""
        self.cache: dict[str, int] = {}
        self.flat, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def words(self, words: list[str]) -> None:
        """Encode distinct words into the cache, by buckets of length."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
        ids: list = [None] * len(words)
        for k in np.unique(bucket):
            rows = np.nonzero(bucket == k)[0]
            step = max(1, (1 << 21) >> int(k))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                for j, x in zip(part, self.matrix([raw[x] for x in part], 1 << int(k))):
                    ids[j] = x
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self.cache.update(zip(words, range(len(self.cache), len(self.cache) + len(words))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, *ids])

    def matrix(self, raw: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of byte strings of at most ``width`` bytes each."""
        flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), np.uint8).reshape(len(raw), width)
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = np.where(np.arange(width) < length[:, None], self.byte_id[flat], -1)
        done: list[np.ndarray | None] = [None] * len(raw)
        live = np.arange(len(raw))
        while len(live):
            w = sym.shape[1]
            rank = np.full((len(live), max(1, w - 1)), NONE, np.int64)
            slot = np.zeros_like(rank)
            if w > 1:
                r, c = np.nonzero(sym[:, 1:] >= 0)
                rank[r, c], slot[r, c] = self.table.find(sym[r, c], sym[r, c + 1])
            least = rank.min(axis=1)
            still = least < NONE
            for i in np.nonzero(~still)[0]:
                row = sym[i]
                done[live[i]] = row[row >= 0].astype(np.int32)
            live, sym, rank, slot, least = live[still], sym[still], rank[still], slot[still], least[still]
            if not len(live):
                break
            hit = rank == least[:, None]
            if rank.shape[1] > 4 * self.reach:
                hit = self.apart(rank)
            # of overlapping hits (a a a) every other one from the left counts
            position = np.arange(hit.shape[1])
            starts = hit & ~np.pad(hit[:, :-1], ((0, 0), (1, 0)))
            run = np.maximum.accumulate(np.where(starts, position, -1), axis=1)
            hit &= (position - run) % 2 == 0
            r, c = np.nonzero(hit)
            sym[r, c] = self.table.merged[slot[r, c]]
            sym[r, c + 1] = -1
            # compaction: symbols to the left, width to the longest row
            order = np.argsort(sym < 0, axis=1, kind="stable")
            sym = np.take_along_axis(sym, order, axis=1)
            sym = sym[:, : int((sym >= 0).sum(axis=1).max())]
        return done  # type: ignore[return-value]

    def apart(self, rank: np.ndarray) -> np.ndarray:
        """The pairs of long rows that merge in this round wherever the row's least pair is: those of least rank within ``reach`` pairs on
        either side.  A merge further away could only matter to them through a symbol that grows until it meets them, and no symbol is
        that long.  Of a run of equal pairs only a part that begins with the run is taken, as the run merges from the left."""
        span, size = 1, 2 * self.reach + 1
        low = np.pad(rank, ((0, 0), (self.reach, self.reach)), constant_values=NONE)
        ahead = lambda x, n: np.pad(x[:, n:], ((0, 0), (0, n)), constant_values=NONE)
        while 2 * span <= size:
            low, span = np.minimum(low, ahead(low, span)), 2 * span
        low = np.minimum(low, ahead(low, size - span))[:, : rank.shape[1]]
        hit = (rank == low) & (rank < NONE)
        first = np.ones(rank.shape, bool)
        first[:, 1:] = rank[:, 1:] != rank[:, :-1]
        start = np.maximum.accumulate(np.where(first, np.arange(rank.shape[1]), 0), axis=1)
        missed = np.cumsum(~hit, axis=1)
        return hit & (missed == np.take_along_axis(missed, start, axis=1)) & np.take_along_axis(hit, start, axis=1)

    def encode(self, texts: list[str | None]) -> pa.Array:
        """Ids of each text as a list array; an empty list for null and empty texts."""
        if len(self.cache) > CACHE_WORDS:
            self.clear()
        parts = [self.split(t) if t else [] for t in texts]
        every = list(chain.from_iterable(parts))
        new = list(set(every).difference(self.cache))
        if new:
            self.words(new)
        word = np.fromiter(map(self.cache.__getitem__, every), np.int64, len(every))
        counts = self.count[word]
        ends = np.cumsum(counts)
        # position of each id in the flat array: its word's start + its place within the word
        values = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[word] - ends + counts, counts)]
        last = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        offsets = np.concatenate([[0], np.concatenate([[0], ends])[last]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


@lru_cache(maxsize=2)
def _bpe(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, ids`` of every row, without special tokens (their strings are ordinary text).

    Null and empty texts have an empty list.  Rows given twice come out twice; other columns are dropped.  ``path`` is the
    tokenizer's JSON file, which every worker reads from its own installation.
    """
    rows = docs.select(key, F.col(text).alias("_text"))
    kind = rows.schema[key].dataType.simpleString()

    def work(batch) -> dict:
        return {key: batch.column(key), "ids": _bpe(path or default_path()).encode(batch.column("_text").to_pylist())}

    return map_arrow(rows, f"`{key}` {kind}, ids array<int>", "_text", work)
