"""Evaluation texts leaking into training text, by q-gram lemma filtering.

A passage of ``w`` characters copied with at most ``e`` edits shares at least ``w + 1 - q (e + 1)`` q-grams with its source, on
diagonals at most ``e`` apart.  For each document the q-grams that occur in any item are found with one rolling hash over the
whole slice of texts; shared q-grams are counted per item in overlapping diagonal bands, regions that meet the bound are kept
and verified by banded alignment, all regions of a slice at once.

Items are a table of bounded size: they are read in blocks of ``BLOCK_CHARS`` characters, and each block's index is broadcast and
applied to all documents, so a larger benchmark costs more passes, not more memory.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_arrow

WORDS = 12  # consecutive words that make a leak
EDITS = 1  # edits allowed in a passage
PENALTY = 4  # of an edit, in matched characters
BLOCK_CHARS = 2 << 20

_WORD = re.compile(r"[^\W_]+")
_ASCII = {i: (chr(i).lower() if chr(i).isalnum() else " ") for i in range(128)}


def plain(text: str | None) -> str:
    """The words of a text in lower case, with single blanks: compatibility forms plain, format characters removed."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.translate(_ASCII).split())
    text = unicodedata.normalize("NFKC", text)
    if not text.isascii():
        odd = {ord(c) for c in set(text) if c > "\x7f" and unicodedata.category(c) == "Cf"}
        if odd:
            text = text.translate(dict.fromkeys(odd))
    return " ".join(_WORD.findall(text.lower()))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(code: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each position on."""
    n = len(code) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mult = 0x9E3779B97F4A7C15
    power, width, block = None, 1, (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    out, used = None, 0
    while True:  # binary method: blocks of doubling width
        if q & width:
            out = block[used : used + n].copy() if out is None else out * np.uint64(pow(mult, width, 1 << 64)) + block[used : used + n]
            used += width
        if 2 * width > q:
            break
        power = np.uint64(pow(mult, width, 1 << 64))
        block = block[: len(block) - width] * power + block[width:]
        width *= 2
    return (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """The q-grams of a block of items, and what makes a match of each."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]], edits: int = EDITS, words: int = WORDS):
        self.edits, self.ids, self.text, self.windows, self.bound, self.least = edits, [], [], [], [], []
        by_q: dict[int, list[tuple[np.ndarray, int]]] = {}
        for key, raw in items:
            text = plain(raw)
            if not text:
                continue
            w = text.split(" ")
            windows = sorted({" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
            size = min(map(len, windows))
            q, e = next(((q, e) for e in (edits, 0) for q in (12, 6, 3, 2, 1) if size + 1 - q * (e + 1) >= min(4, size)), (1, 0))
            n = len(self.ids)
            self.ids.append(key)
            self.text.append(codes(text))
            self.windows.append(windows)
            self.bound.append(size + 1 - q * (e + 1))
            self.least.append(size - e * (PENALTY + 1))
            by_q.setdefault(q, []).append((grams(self.text[-1], q), n))
        self.bound, self.least = np.array(self.bound, np.int64), np.array(self.least, np.int64)
        self.tables = {}
        for q, lists in by_q.items():
            h = np.concatenate([g for g, _ in lists])
            item = np.concatenate([np.full(len(g), n, np.int64) for g, n in lists])
            pos = np.concatenate([np.arange(len(g), dtype=np.int64) for g, _ in lists])
            order = np.argsort(h, kind="stable")
            h, item, pos = h[order], item[order], pos[order]
            keys, first, count = np.unique(h, return_index=True, return_counts=True)
            bloom = np.zeros(1 << self.BITS, bool)
            bloom[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
            self.tables[q] = (keys, first, count, item, pos, bloom)

    def hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in ``code``, item, position in the item) of all shared q-grams."""
        out = []
        for q, (keys, first, count, item, pos, bloom) in self.tables.items():
            g = grams(code, q)
            at = np.nonzero(bloom[(g >> np.uint64(64 - self.BITS)).astype(np.int64)])[0]
            k = np.searchsorted(keys, g[at])
            k[k == len(keys)] = 0
            good = keys[k] == g[at]
            at, k = at[good], k[good]
            n = count[k]
            total = np.cumsum(n)
            post = np.arange(total[-1] if len(total) else 0) + np.repeat(first[k] - total + n, n)
            out.append((np.repeat(at, n), item[post], pos[post]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3

    def search(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, matched characters) of the verified pairs of plain texts and items."""
        if not self.ids:
            return []
        gap = "\n" * 2
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + len(gap)
        start = np.concatenate([[0], np.cumsum(size)])
        code = codes(gap.join(texts) + gap)
        at, item, pos = self.hits(code)
        if not len(at):
            return []
        doc = np.searchsorted(start, at, "right") - 1
        half = max(1, self.edits)
        diagonal = at - pos + (1 << 40)  # of the whole slice: texts lie on diagonals of their own, up to an item's length
        found = []
        for shift in (0, half):
            band = (diagonal + shift) // (2 * half)
            order = np.lexsort((band, item, doc))
            d, i, b, x = doc[order], item[order], band[order], diagonal[order]
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])])
            first = np.nonzero(new)[0]
            n = np.diff(np.concatenate([first, [len(d)]]))
            keep = n >= self.bound[i[first]]
            found.append(np.stack([d[first], i[first], x[first] - (1 << 40)])[:, keep])
        regions = np.unique(np.concatenate(found, axis=1), axis=1)
        score = self.align(code, regions)
        good = score >= self.least[regions[1]]
        best: dict[tuple[int, int], int] = {}
        for d, i, s in zip(regions[0][good].tolist(), regions[1][good].tolist(), score[good].tolist()):
            best[d, i] = max(best.get((d, i), 0), s)
        return [(d, i, s) for (d, i), s in best.items()]

    def align(self, code: np.ndarray, regions: np.ndarray) -> np.ndarray:
        """Best local alignment of each region's item along its diagonal, in a band wide enough for the edits."""
        reach = 2 * max(1, self.edits)
        width, out = 2 * reach + 1, np.zeros(regions.shape[1], np.int64)
        step = 4096
        for lo in range(0, regions.shape[1], step):
            _, item, diagonal = regions[:, lo : lo + step]
            length = np.array([len(self.text[i]) for i in item])
            padded = np.full((len(item), length.max()), 0xFFFFFFFF, np.uint32)
            for r, i in enumerate(item):
                padded[r, : length[r]] = self.text[i]
            score = np.zeros((len(item), width + 2), np.int64)
            best = np.zeros(len(item), np.int64)
            offset = np.arange(-reach, reach + 1)
            for k in range(padded.shape[1]):
                where = diagonal[:, None] + k + offset
                inside = (where >= 0) & (where < len(code))
                same = (code[np.where(inside, where, 0)] == padded[:, k : k + 1]) & inside
                new = np.zeros_like(score)
                new[:, 1:-1] = np.maximum(0, np.maximum(score[:, 1:-1] + np.where(same, 1, -PENALTY), score[:, 2:] - PENALTY))
                for j in range(2, width + 1):
                    new[:, j] = np.maximum(new[:, j], new[:, j - 1] - PENALTY)
                new[:, 0] = new[:, -1] = 0
                score = new
                np.maximum(best, score.max(axis=1), out=best)
            out[lo : lo + step] = best
        return out


def _blocks(items: DataFrame, key: str, text: str):
    block, size = [], 0
    for k, t in items.select(key, text).where(f"`{key}` is not null").toLocalIterator():
        if block and size + len(t or "") > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((k, t))
        size += len(t or "")
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", edits: int = EDITS, words: int = WORDS) -> DataFrame:
    """``key, item_key, matched_chars, exact``: documents with a passage of ``words`` words of an item (all of a shorter item),
    with at most ``edits`` edits.  ``exact`` tells whether such words stand in the document in sequence, unchanged.

    Null, empty and wordless texts and items match nothing.  Rows given twice come out twice.
    """
    rows = docs.select(key, F.col(text).alias("_text"))
    kind, item_kind = rows.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, matched_chars bigint, exact boolean"
    parts = []
    for block in _blocks(items, item_key, text):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, edits, words))

        def work(batch, shared=shared) -> dict:
            index, keys = shared.value, batch.column(key).to_pylist()
            texts = [plain(t) for t in batch.column("_text").to_pylist()]
            out: dict[str, list] = {key: [], item_key: [], "matched_chars": [], "exact": []}
            for d, i, score in index.search(texts):
                padded = f" {texts[d]} "
                for name, value in ((key, keys[d]), (item_key, index.ids[i]), ("matched_chars", score), ("exact", any(f" {w} " in padded for w in index.windows[i]))):
                    out[name].append(value)
            return out

        parts.append(map_arrow(rows, schema, "_text", work, max_chars=2 << 20))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of exact leaks."""
    return leaks(docs, items).where("exact").select("doc_id", "item_id").distinct()
