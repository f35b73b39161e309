"""Splitting oversized items at natural boundaries, by content-defined chunking.

A rolling hash of the last ``WINDOW`` characters marks landmarks; the cut is the natural boundary (paragraph, line, sentence or
word end) nearest to a landmark within the minimum and maximum size.  As hash and boundaries depend on the text around a
cut only, an edit changes the pieces next to it and the later cuts fall into step again.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_arrow

LIMIT = 2000  # a piece with its overlap has at most so many code points
OVERLAP_MIN, OVERLAP_MAX = 100, 200
MINIMUM = 600  # new text of a piece, but the last
WINDOW = 48
MASK_BITS = 8  # a landmark every 256 characters on average

#: Strength of the natural boundaries, best first: end of paragraph, line, sentence, word.
_BOUNDARIES = (re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"\n\s*"), re.compile(r"(?<=[.!?;:…。！？])[\"”’»)\]]*\s+"), re.compile(r"\s+"))
_SPACE = re.compile(r"\s")
_RUN = re.compile(r"\S+")


def landmarks(text: str) -> np.ndarray:
    """Positions after which a cut is suggested: where the hash of the last ``WINDOW`` characters ends in zeros."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(code) < WINDOW:
        return np.empty(0, dtype=np.int64)
    mult, h, width = np.uint64(0x9E3779B97F4A7C15), (code + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), 1
    while width < WINDOW // 2 + 1:  # doubling the window: h(2w) at i = h(w) at i - w, times a power, + h(w) at i
        power = np.uint64(pow(int(mult), width, 1 << 64))
        h = h[:-width] * power + h[width:]
        width *= 2
    return np.nonzero((h ^ (h >> np.uint64(29))) >> np.uint64(64 - MASK_BITS) == 0)[0] + width


def split_text(text: str) -> list[tuple[int, int, int]]:
    """(start, new, end) of the pieces of ``text``: piece = text[start:end], of which text[new:end] was in no piece before.

    A text within the limit is one piece; an empty text none.  Where no white space allows a natural cut, the cut falls
    on a landmark or, without one, on the limit, so that every piece keeps the limit.
    """
    n = len(text)
    if n <= LIMIT:
        return [(0, 0, n)] if n else []
    marks = landmarks(text)
    levels = [np.fromiter((m.end() for m in b.finditer(text)), dtype=np.int64) for b in _BOUNDARIES]
    spaces = levels[-1]
    out: list[tuple[int, int, int]] = []
    new = start = 0
    while True:
        if n - start <= LIMIT:
            out.append((start, new, n))
            return out
        low, high = max(new + MINIMUM, start + OVERLAP_MAX + 1), start + LIMIT
        cut = 0
        m = marks[np.searchsorted(marks, low) : np.searchsorted(marks, high, "right")]
        for ends in levels:
            near = ends[np.searchsorted(ends, low) : np.searchsorted(ends, high, "right")]
            if len(near):
                # the boundary nearest to a landmark; without a landmark the last one
                if len(m):
                    gap = np.abs(near[:, None] - m[None, :]).min(axis=1)
                    cut = int(near[int(gap.argmin())])
                else:
                    cut = int(near[-1])
                break
        else:
            cut = int(m[-1]) if len(m) else high
        out.append((start, new, cut))
        new = cut
        lo, hi = cut - OVERLAP_MAX, cut - OVERLAP_MIN
        starts = spaces[np.searchsorted(spaces, lo) : np.searchsorted(spaces, hi, "right")]
        start = int(starts[len(starts) // 2]) if len(starts) else hi
        if not out[-1][0] < start:
            start = min(hi, cut - OVERLAP_MIN)


def longest_run(text: str) -> int:
    """Most consecutive characters without white space."""
    return max((len(m) for m in _RUN.findall(text)), default=0)


def items(docs: DataFrame) -> DataFrame:
    """``raw_path, chunk_no, text`` of parsed documents: the chunks from 1 by position; the markdown as 0 where chunks are
    null or empty.  Chunks without text are left out but keep their number."""
    texts = F.when(F.size("chunks") > 0, F.transform("chunks", lambda c, i: F.struct((i + 1).cast("bigint").alias("chunk_no"), c["markdown"].alias("text")))).otherwise(
        F.array(F.struct(F.lit(0).cast("bigint").alias("chunk_no"), F.col("markdown").alias("text")))
    )
    return docs.select("raw_path", F.explode(texts).alias("i")).select("raw_path", "i.chunk_no", "i.text")


def pieces(rows: DataFrame, keys: list[str], text: str = "text", oversized_only: bool = True) -> DataFrame:
    """Each row's ``text`` as pieces: the keys, ``piece_no`` from 1, ``start``, ``overlap``, ``piece``, ``item_chars``, ``longest_run``.

    Null and empty texts give no pieces.  With ``oversized_only`` texts within the limit are left out before they reach
    Python.  Rows given twice give their pieces twice.  Other columns are dropped.
    """
    rows = rows.select(*keys, F.col(text).alias("_text")).where(F.length("_text") > (LIMIT if oversized_only else 0))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def work(batch) -> dict:
        out: dict[str, list] = {k: [] for k in [*keys, "piece_no", "start", "overlap", "piece", "item_chars", "longest_run"]}
        columns = [batch.column(k).to_pylist() for k in keys]
        for i, value in enumerate(batch.column("_text").to_pylist()):
            run = longest_run(value)
            for no, (a, b, c) in enumerate(split_text(value), 1):
                for k, col in zip(keys, columns):
                    out[k].append(col[i])
                for k, v in (("piece_no", no), ("start", a), ("overlap", b - a), ("piece", value[a:c]), ("item_chars", len(value)), ("longest_run", run)):
                    out[k].append(v)
        return out

    return map_arrow(rows, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", piece_no int, start bigint, overlap int, piece string, item_chars bigint, longest_run bigint", "_text", work)


def found(docs: DataFrame) -> DataFrame:
    """``raw_path, chunk_no, kind`` of the items that had to be split, from the operator's pieces."""
    per_item = pieces(items(docs), ["raw_path", "chunk_no"]).where("piece_no = 1").select("raw_path", "chunk_no", "longest_run").distinct()
    kinds: Column = F.when(F.col("longest_run") > LIMIT, F.array(F.lit("oversized"), F.lit("unbreakable"))).otherwise(F.array(F.lit("oversized")))
    return per_item.select("raw_path", "chunk_no", F.explode(kinds).alias("kind")).distinct()
