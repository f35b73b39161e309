"""Noise in text from scanned pages: cut words, misread glyphs, running headers and page numbers.

1. Page furniture is found from the page structure of each document: lines at page edges that recur from page to page (numbers
   masked, glyphs reduced to strokes), repeat the title, or count pages.
   The text is parsed once, into a table of tokens that all later steps read.
2. Skip-gram vectors are learned over all pages: co-occurrence counts within ``REACH`` words between the ``VECTOR_WORDS`` most frequent
   words are summed in Spark, and their shifted positive mutual information is factorised, which is the optimum of skip-gram
   with negative sampling.  The matrix is bounded by that parameter; it spans the space, in which every other word, however rare,
   gets its vector from the words around all its places.
3. Each word is linked to far more frequent words whose glyphs reduce to the same strokes (m = rn = in, d = cl, u = ii, ...), and the
   links whose edits are plausible are kept.  In each place the target that fits best is compared with the word as it is read, whose
   vector leaves that place out; the correction is made only if the target is near and the context does not speak for the word
   as read.
4. A word cut at a line's end is joined if the corpus knows the joined word better than the hyphenated one.

Only words that are not among the ``KNOWN_WORDS`` most frequent clean words are looked up; they meet the links in a join.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import broadcast_if_small, cut, release, spread
from .arrow import map_arrow

REACH = 3
VECTOR_WORDS = 1000  # words with vectors; bounds the matrix on the driver
DIMENSIONS = 32
KNOWN_WORDS = 20_000  # clean frequent words that are not looked up; bounds the broadcast list
RATIO = 8  # a link leads to a word at least so many times as frequent
MAX_EDITS = 3
PRIOR = 10  # places at which a word's own contexts weigh as much as those of the word it may stand for
MARGIN = 0.15  # by how much the context may fit the word as read better before it is kept

MARKS = "-­¬‐‑"
_TOKEN = re.compile(r"\S+")
_OUTER = "“”\"„‚‘’'()[]{}.,;:?!…»«*_"
_LETTER = re.compile(r"[^\W\d_]")
_NUMBERISH = re.compile(r"^(?:fy|q)?[\d.,%$€£/-]+(?:m|bn|k|th|st|nd|rd|x)?$|^\$")

# The strokes that glyphs are made of as a scanner confuses them, in natural order.
STROKES = {
    "a": "a", "ä": "a", "á": "a", "à": "a", "â": "a", "b": "ıı", "6": "ıı", "c": "c", "ç": "c", "¢": "c", "d": "cı", "e": "c", "é": "c", "è": "c", "ê": "c", "€": "c", "f": "f", "g": "g", "9": "g", "q": "g",
    "h": "ıı", "i": "ı", "í": "ı", "ì": "ı", "î": "ı", "ï": "ı", "1": "ı", "|": "ı", "!": "ı", "j": "j", "k": "k", "l": "ı", "m": "ııı", "n": "ıı", "ñ": "ıı", "o": "o", "0": "o", "ó": "o", "ö": "o", "ø": "o", "p": "p", "þ": "p",
    "r": "ı", "s": "s", "5": "s", "$": "s", "š": "s", "t": "t", "†": "t", "7": "t", "u": "ıı", "ü": "ıı", "ú": "ıı", "v": "v", "y": "v", "ý": "v", "¥": "v", "w": "vv", "x": "x", "×": "x", "z": "z", "2": "z", "8": "b", "ß": "b",
    "ﬀ": "ff", "ﬁ": "fı", "ﬂ": "fı", "ﬃ": "ffı", "ﬄ": "ffı", "ﬅ": "st", "ﬆ": "st",
}
#: Glyphs that only a misreading puts into a word.
FOREIGN = set("†|¢!$€¥þ×0123456789ﬀﬁﬂﬃﬄﬅﬆ")


_STROKE_TABLE = str.maketrans(STROKES)


def strokes(word: str) -> str:
    return word.translate(_STROKE_TABLE)


def edits(read: str, meant: str) -> list[int] | None:
    """Positions in ``read`` of the glyph groups that differ from ``meant`` though their strokes agree; None if they cannot be
    aligned in groups of at most two glyphs for one or one for two, or equal words."""
    n, m = len(read), len(meant)
    if read == meant or abs(n - m) > MAX_EDITS:
        return None
    best: dict[tuple[int, int], list[int]] = {(0, 0): []}
    for i in range(n + 1):
        for j in range(m + 1):
            here = best.get((i, j))
            if here is None:
                continue
            for a, b in ((1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1)):
                if i + a > n or j + b > m:
                    continue
                x, y = read[i : i + a], meant[j : j + b]
                if x == y:
                    step = here if a == b == 1 else None
                elif strokes(x) == strokes(y):
                    step = [*here, i]
                else:
                    step = None
                if step is not None and ((i + a, j + b) not in best or len(step) < len(best[i + a, j + b])):
                    best[i + a, j + b] = step
    out = best.get((n, m))
    return out if out and len(out) <= MAX_EDITS else None


def word_of(token: str) -> str:
    """A token in lower case without outer punctuation; empty if it is a number or has no letters."""
    w = token.strip(_OUTER).lower()
    if not w or _NUMBERISH.match(w):
        return ""
    letters = len(_LETTER.findall(w))
    return w if letters and letters * 2 >= len(w) and len(w) <= 40 else ""


_PAGE = re.compile(
    r"^(?:[\[(<]?\s*[\dlIoOSivxXVL|]{1,5}\s*[\])>]?|[-–—]\s*[\dlIoOivx|]{1,5}\s*[-–—]|(?:page|seite|p[aá]gina|p\.|s\.)\s*[\dlIoO|]{1,5}(?:\s*(?:of|von|de|sur|/)\s*[\dlIoO|]{1,5})?|[\dlIoO|]{1,5}\s+[|·–-]\s+\S.{0,50}|\S.{0,50}?\s+(?:p\.|[|·])\s*[\dlIoO|]{1,5})$",
    re.I,
)
_OF = re.compile(r"\b(?:sheet|page|blatt|seite|feuille|hoja|p[aá]gina)\s+[\dlIoO|]{1,5}\s+(?:of|von|de|sur)\s+[\dlIoO|]{1,5}\s*$", re.I)
#: A number set apart at either end of a head in capitals.
_NUMBERED = re.compile(r"^(?:[\dlIoO|]{1,5}\s{2,}(?P<a>\D.*)|(?P<b>.*\D)\s{2,}[\dlIoO|]{1,5})$")
_SENTENCE_END = re.compile(r"[.;,:!?]\s*$")
_SEPARATOR = re.compile(r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$")


def _key(line: str) -> str:
    return strokes(re.sub(r"\d+|\b[ivxl]+\b", "#", line.strip().lower()))


def furniture(lines: list[str], chunk_lines: list[int] | None) -> list[str]:
    """For each line: ``blank`` (also page separators), ``furniture`` or ``text``."""
    n = len(lines)
    out = ["blank" if not x.strip() or _SEPARATOR.match(x) else "text" for x in lines]
    breaks = [i for i, x in enumerate(lines) if _SEPARATOR.match(x)]
    pages: list[list[int]] = []
    sure = True
    if breaks:
        edges = [-1, *breaks, n]
        pages = [[i for i in range(a + 1, b) if out[i] == "text"] for a, b in zip(edges, edges[1:])]
    elif chunk_lines and len(chunk_lines) > 1 and sum(chunk_lines) + len(chunk_lines) - 1 == n:
        at = 0
        for c in chunk_lines:
            pages.append([i for i in range(at, at + c) if out[i] == "text"])
            at += c + 1
    else:
        # pages are told from their numbers: a page ends with a counting line that stands apart
        sure = False
        start: list[int] = []
        for i in range(n):
            if out[i] != "text":
                continue
            start.append(i)
            apart = i + 1 >= n or out[i + 1] == "blank"
            if apart and len(lines[i].strip()) < 60 and _PAGE.match(lines[i].strip()):
                pages.append(start)
                start = []
        pages.append(start)
    pages = [p for p in pages if p]
    if not pages:
        return out
    for p in pages:  # feet
        if len(p) > 1 or not sure:
            foot = lines[p[-1]].strip()
            if len(foot) < 70 and _PAGE.match(foot) and (len(p) > 1 or len(pages) > 1):
                out[p[-1]] = "furniture"
    for p in pages:  # heads that count pages
        if _OF.search(lines[p[0]]) and len(lines[p[0]]) < 90:
            out[p[0]] = "furniture"
    for p in pages:
        m = _NUMBERED.match(lines[p[0]].strip())
        name = (m["a"] or m["b"] or "").strip() if m else ""
        if len(name) > 3 and len(lines[p[0]]) < 90 and sum(c.isupper() for c in name) > 4 * sum(c.islower() for c in name):
            out[p[0]] = "furniture"
    body = [[i for i in p if out[i] == "text"] for p in pages]
    first = next((p[0] for p in body if p), None)
    title = _key(lines[first]) if first is not None else ""
    lead = " ".join(title.split()[:2])
    heads = Counter(_key(lines[i]) for p in body[1:] for i in p[:2] if len(lines[i]) < 90)
    for no, p in enumerate(body):
        if no == 0 and pages and p and p[0] == first:
            continue
        for i in p[:1]:
            text, key = lines[i].strip(), _key(lines[i])
            if len(text) >= 90 or not re.search(r"[^\W\d_]{3}", text):
                continue
            recurs = heads[key] >= 2 and not re.search(r"[.;,]$", text)
            named = bool(lead) and key.startswith(lead) and not re.search(r"[.;,]$", text) and (len(key.split()) <= 4 or " | " in text or key == title)
            marked = (" | " in text or " · " in text) and len(text) < 70
            if key == title or recurs or named or marked:
                out[i] = "furniture"
                nxt = next((x for x in p[1:2] if x == i + 1), None)
                if nxt is not None and len(lines[nxt]) < 60 and (" · " in lines[nxt] or (heads[_key(lines[nxt])] >= 2 and not re.search(r"[.;,]$", lines[nxt].strip()))):
                    out[nxt] = "furniture"
    if not sure:
        for i in range(n):
            m = _NUMBERED.match(lines[i].strip()) if out[i] == "text" and len(lines[i]) < 90 and (i == 0 or out[i - 1] != "text") else None
            name = (m["a"] or m["b"] or "").strip() if m else ""
            if len(name) > 3 and sum(c.isupper() for c in name) > 4 * sum(c.islower() for c in name):
                out[i] = "furniture"
    if not sure:  # heads in documents whose pages could not be told apart: parts between bars or dots, in a line that opens a block
        parts = lambda i, mark: i < n and out[i] == "text" and mark in lines[i] and len(lines[i].strip()) < 70 and not _SENTENCE_END.search(lines[i]) and not lines[i].lstrip().startswith("|")
        for i in range(1, n):
            if out[i] != "text" or out[i - 1] == "text" or i == first or len(lines[i]) >= 90:
                continue
            dotted = parts(i + 1, " · ") and len(lines[i]) < 60 and not _SENTENCE_END.search(lines[i])
            if _key(lines[i]) == title or dotted or (parts(i, " | ") and not parts(i + 1, " | ")):
                out[i] = "furniture"
                if dotted:
                    out[i + 1] = "furniture"
    return out


def tokens(lines: list[str], kind: list[str]) -> list[tuple[int, str, int]]:
    """(line, word, cut) of the text lines in order: ``cut`` is 0, or where a joined word continues on a later line, the length of
    the first part.  Cut words come once, joined, under the line where they begin, with the mark kept as ``\\0``."""
    out: list[tuple[int, str, int]] = []
    text = [i for i in range(len(lines)) if kind[i] == "text"]
    skip = False
    for k, i in enumerate(text):
        parts = _TOKEN.findall(lines[i])
        for p, token in enumerate(parts):
            if skip and p == 0:
                skip = False
                continue
            if p == len(parts) - 1 and k + 1 < len(text) and len(token) > 1 and token[-1] in MARKS and token[-2] not in MARKS:
                following = _TOKEN.findall(lines[text[k + 1]])
                a, b = token[:-1].lstrip(_OUTER), following[0].rstrip(_OUTER) if following else ""
                if a and b and _LETTER.search(a) and _LETTER.match(b[0]):
                    out.append((i, (a + "\0" + b).lower() + ("\1" if b[0].isupper() else "") , len(a)))
                    skip = True
                    continue
            w = word_of(token)
            out.append((i, w, 0))
    return out


def pdf(docs: DataFrame) -> DataFrame:
    """Scanned and digital PDF documents, with the number of lines of each chunk."""
    return docs.where((F.col("metadata")["extension"] == ".pdf") & F.col("markdown").isNotNull()).select(
        "raw_path", "markdown", F.transform("chunks", lambda c: F.size(F.split(F.coalesce(c["markdown"], F.lit("")), "\n"))).alias("chunk_lines")
    )


PARSED = "raw_path string, furniture array<int>, line array<int>, next_line array<int>, size array<int>, w array<string>"


def parsed(pages: DataFrame) -> DataFrame:
    """``raw_path``, the numbers of its ``furniture`` lines and, token by token, ``line``, ``w`` and for words cut at a line's end
    ``size`` (of the first part, else 0) and ``next_line``.  All later steps read this table; the text is parsed once."""

    def work(batch) -> dict:
        out: dict[str, list] = {k: [] for k in ("raw_path", "furniture", "line", "next_line", "size", "w")}
        for path, text, sizes in zip(batch.column("raw_path").to_pylist(), batch.column("markdown").to_pylist(), batch.column("chunk_lines").to_pylist()):
            lines = text.split("\n")
            kind = furniture(lines, sizes)
            toks = tokens(lines, kind)
            text_lines = [i for i in range(len(lines)) if kind[i] == "text"]
            after = dict(zip(text_lines, text_lines[1:]))
            out["raw_path"].append(path)
            out["furniture"].append([i + 1 for i, x in enumerate(kind) if x == "furniture"])
            out["line"].append([i + 1 for i, _, _ in toks])
            out["next_line"].append([after.get(i, i) + 1 if c else 0 for i, _, c in toks])
            out["size"].append([c for _, _, c in toks])
            out["w"].append([w for _, w, _ in toks])
        return out

    return map_arrow(pages, PARSED, "markdown", work)


def vocabulary(parsed_: DataFrame) -> DataFrame:
    """``w, n``: how often each word stands whole in a line of text."""
    return parsed_.select(F.explode(F.arrays_zip("w", "size")).alias("t")).where("t.size = 0 and t.w <> ''").groupBy("t.w").agg(F.count("*").alias("n"))


def links(vocab: DataFrame) -> DataFrame:
    """``w, f, n, f_n, at``: each word with the far more frequent words it may be a misreading of, and where its glyphs differ."""

    @F.pandas_udf("string")
    def skeleton(w: pd.Series) -> pd.Series:
        return w.map(strokes)

    @F.pandas_udf("array<int>")
    def where(w: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([edits(a, b) for a, b in zip(w, f)])

    keyed = cut(vocab.where(F.length("w") >= 2).withColumn("k", skeleton("w")), "skeletons")
    clean = keyed.where((F.col("n") >= RATIO) & ~F.col("w").rlike("[" + "".join(sorted(FOREIGN - set("|$!"))) + r"|$!]")).select("k", F.col("w").alias("f"), F.col("n").alias("f_n"))
    both = keyed.join(clean, "k").where((F.col("f_n") >= RATIO * F.col("n")) & (F.col("w") != F.col("f")))
    return both.withColumn("at", where("w", "f")).where("at is not null").select("w", "f", "n", "f_n", "at")


def _codes(batch, code: dict[str, int], missing: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words of the batch's documents in a row, their codes with gaps of ``REACH`` missing ones between documents, the places of the
    words among the codes)."""
    words = batch.column("w").flatten().to_pylist()
    sizes = np.diff(batch.column("w").offsets.to_numpy())
    flat = np.fromiter((code.get(w, missing) for w in words), np.int64, len(words))
    at = np.arange(len(words)) + REACH * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    out = np.full(len(words) + REACH * (len(sizes) + 2), -1, np.int64)
    out[at] = flat
    return words, out, at


def vectors(parsed_: DataFrame, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Input and output skip-gram vectors of ``words``, from co-occurrence counts over all pages."""
    v = len(words)
    shared = parsed_.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def work(batch) -> dict:
        ids = _codes(batch, shared.value, -1)[1]
        pair = []
        for d in range(1, REACH + 1):
            a, b = ids[:-d], ids[d:]
            ok = (a >= 0) & (b >= 0)
            pair += [a[ok] * v + b[ok], b[ok] * v + a[ok]]
        keys, n = np.unique(np.concatenate(pair), return_counts=True)
        return {"pair": keys, "n": n}

    rows = map_arrow(parsed_.select("w"), "pair bigint, n bigint", "w", work, deal=False).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most VECTOR_WORDS squared
    count = np.zeros(v * v)
    count[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    count = count.reshape(v, v)
    total = max(1.0, count.sum())
    row = np.maximum(count.sum(axis=1), 1.0)
    smooth = row**0.75
    with np.errstate(divide="ignore"):
        pmi = np.log(count * smooth.sum() / (row[:, None] * smooth[None, :])) if total else count
    pmi = np.where(count > 0, np.maximum(pmi, 0), 0)
    left, size, right = np.linalg.svd(pmi.astype(np.float32), full_matrices=False) if v else (np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    k = min(DIMENSIONS, len(size))
    root = np.sqrt(size[:k])
    return left[:, :k] * root, right[:k].T * root


def places(around: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Vectors of places, from rows of the numbers of the context words around them (-1 where there is none): the mean output vector,
    of length 1; zeros without any."""
    padded = np.vstack([outer, np.zeros((1, outer.shape[1]))])
    x = np.zeros((len(around), outer.shape[1]))
    for column in around.T:
        x += padded[column]
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def favoured(place: np.ndarray, meant: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each place how much better it fits the word that may be meant than the word as read, in cosines from -2 to 2.  ``own`` is
    the sum over the places of the word as read, this one among them; it is left out, and few places weigh little."""
    rest = own - place + PRIOR * meant
    size = lambda x: np.maximum(np.linalg.norm(x, axis=1), 1e-12)
    return (place * meant).sum(axis=1) / size(meant) - (place * rest).sum(axis=1) / size(rest)


def _known(vocab: DataFrame, linked: DataFrame) -> list[str]:
    """The ``KNOWN_WORDS`` most frequent words that are no misreading of another."""
    clean = vocab.where("n >= 5").join(broadcast_if_small(linked.select("w").distinct()), "w", "left_anti")
    return [r.w for r in clean.orderBy(F.desc("n"), "w").limit(KNOWN_WORDS).collect()]


def asked(parsed_: DataFrame, known: list[str], outer: np.ndarray) -> DataFrame:
    """What is looked up, ``raw_path, line, next_line, p, role, w, size, around, x, n``:

    - ``word``: each place of a word that is not known, with the context words around it;
    - ``joined`` or ``upper`` (the second part begins in upper case) and ``hyphened``: both readings of a cut word;
    - ``furniture``: a line;
    - ``centre``: per batch, the sum of the vectors of the ``n`` places of a known word.
    """
    spark = parsed_.sparkSession
    v = len(outer)
    # context words have the numbers below v, other known words those from v on
    shared = spark.sparkContext.broadcast(({w: i for i, w in enumerate(known)}, known, outer))

    def work(batch) -> dict:
        code, names, out_vectors = shared.value
        words, ids, at = _codes(batch, code, -1)
        near = np.where(ids < v, ids, -1)
        offsets = batch.column("w").offsets.to_numpy()
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        column = lambda k: batch.column(k).flatten().to_numpy(zero_copy_only=False)
        line, following, size = column("line"), column("next_line"), column("size")
        shifts = np.array([d for d in range(-REACH, REACH + 1) if d])
        paths = batch.column("raw_path").to_pylist()
        out: dict[str, list] = {k: [] for k in ("raw_path", "line", "next_line", "p", "role", "w", "size", "around", "x", "n")}

        def put(*values) -> None:
            for k, x in zip(out, values):
                out[k].append(x)

        for path, rows in zip(paths, batch.column("furniture").to_pylist()):
            for i in rows:
                put(path, i, 0, 0, "furniture", "", 0, None, None, 0)
        own = ids[at]
        filled = np.fromiter((bool(w) for w in words), bool, len(words))
        for i in np.flatnonzero(filled & ((own < 0) | (size > 0))).tolist():
            around = near[at[i] + shifts]
            around = around[around >= 0].tolist()
            w, path, p = words[i], paths[doc[i]], i - int(offsets[doc[i]] - offsets[0])
            if not size[i]:
                put(path, line[i], 0, p, "word", w, 0, around, None, 0)
                continue
            upper = w.endswith("\1")
            a, _, b = w.rstrip("\1").partition("\0")
            put(path, line[i], following[i], p, "upper" if upper else "joined", a + b, size[i], around, None, 0)
            put(path, line[i], following[i], p, "hyphened", f"{a}-{b}", size[i], around, None, 0)
        # sums over the places of each known word, some at a time
        total = np.zeros((len(names), out_vectors.shape[1]))
        count = np.zeros(len(names), np.int64)
        spots = np.flatnonzero(filled & (own >= 0) & (size == 0))
        for some in np.array_split(spots, max(1, len(spots) // 50_000)):
            x = places(near[at[some][:, None] + shifts], out_vectors)
            some = some[x.any(axis=1)]
            np.add.at(total, own[some], x[x.any(axis=1)])
            count += np.bincount(own[some], minlength=len(names))
        for k in np.flatnonzero(count).tolist():
            put("", 0, 0, 0, "centre", names[k], 0, None, total[k].astype(np.float32), count[k])
        return out

    schema = "raw_path string, line bigint, next_line bigint, p bigint, role string, w string, size int, around array<int>, x array<float>, n bigint"
    return map_arrow(parsed_, schema, "w", work, deal=False)


def _sums(x: str, size: int) -> Column:
    """Sum of arrays, by element."""
    return F.array(*[F.sum(F.col(x)[i]) for i in range(size)])


def findings(docs: DataFrame) -> DataFrame:
    """``raw_path, line_no, kind, w, f, cut``: furniture lines, cut words and misread words with what they mean.

    Rows given twice give findings once.  Documents without markdown, not PDF or without lines have none.
    """
    spark = docs.sparkSession
    parsed_ = cut(parsed(pdf(docs)), "parsed")
    vocab = cut(vocabulary(parsed_), "vocabulary")
    linked = cut(links(vocab), "links")
    known = _known(vocab, linked)
    _, outer = vectors(parsed_, known[:VECTOR_WORDS])
    # without the mean, so that unlike words have cosines about 0
    outer = outer - outer.mean(axis=0) if len(outer) else outer
    rows = cut(asked(parsed_, known, outer), "asked")
    release(parsed_)
    words = rows.where("role not in ('furniture', 'centre')").select("raw_path", "line", "next_line", "p", "role", "w", "size", "around").dropDuplicates(["raw_path", "line", "p", "role", "w"])

    vector = spark.sparkContext.broadcast(outer)
    width = outer.shape[1]

    @F.pandas_udf("array<float>")
    def place(around: pd.Series) -> pd.Series:
        grid = np.full((len(around), 2 * REACH), -1)
        for i, x in enumerate(around):
            grid[i, : len(x)] = x
        return pd.Series(list(places(grid, vector.value).astype(np.float32)))

    @F.pandas_udf("fit double, gain double")
    def judged(x: pd.Series, meant: pd.Series, own: pd.Series) -> pd.DataFrame:
        zero = np.zeros(width)
        stack = lambda s: np.vstack([zero if v is None else v for v in s]).astype(np.float64) if len(s) else np.zeros((0, width))
        a, b = stack(x), stack(meant)
        told = b.any(axis=1) & a.any(axis=1)
        return pd.DataFrame({"fit": np.where(told, (a * b).sum(axis=1), 0.0), "gain": np.where(told, favoured(a, b, stack(own)), 0.0)})

    suspects = broadcast_if_small(linked.select("w").distinct())
    placed = cut(words.join(suspects, "w", "left_semi").withColumn("x", place("around")).drop("around"), "placed")
    # vectors of the words as read, and of those that may be meant: known ones are summed already, others from their own places
    meant = broadcast_if_small(linked.select(F.col("f").alias("w")).distinct())
    one = F.lit(1).cast("bigint").alias("n")
    rare = words.where("role = 'word'").join(meant, "w", "left_semi").select("w", F.lit("meant").alias("as"), place("around").alias("x"), one)
    known_ = rows.where("role = 'centre'").join(meant, "w", "left_semi").select("w", F.lit("meant").alias("as"), "x", "n")
    every = placed.select("w", F.lit("read").alias("as"), "x", one).unionByName(rare).unionByName(known_).where(F.exists("x", lambda v: v != 0))
    sums = cut(every.groupBy("w", "as").agg(_sums("x", width).alias("x"), F.sum("n").alias("n")), "sums")
    own = sums.where(F.col("as") == "read").select("w", F.col("x").alias("own"))
    centre = sums.where(F.col("as") == "meant").select(F.col("w").alias("f"), F.transform("x", lambda v: v / F.col("n")).alias("c"))

    # the link that fits best: closeness of glyphs, then the context, then frequency
    candidates = placed.join(broadcast_if_small(linked), "w").join(broadcast_if_small(centre), "f", "left").join(broadcast_if_small(own), "w", "left")
    scored = candidates.withColumn("j", judged("x", "c", "own")).drop("x", "c", "own").withColumn("score", F.col("j.fit") - 2.0 * F.size("at") + 0.3 * F.log("f_n"))
    best = scored.groupBy("raw_path", "line", "p", "role", "w").agg(F.max_by(F.struct("f", "f_n", "at", "size", "next_line", "j"), F.struct("score", "f")).alias("b")).select("raw_path", "line", "p", "role", "w", "b.*")
    # a word with a glyph that no word has is misread whatever stands around it; any other only if the word meant suits the place
    # and the word as read suits it no better
    foreign = F.col("w").rlike("[" + "".join(sorted(FOREIGN - set("|$!"))) + r"|$!]")
    best = cut(best.where(foreign | ((F.col("j.gain") >= -MARGIN) & (F.col("j.fit") >= 0))).drop("j"), "best")
    misread = (
        best.where("role in ('word', 'joined')")
        .withColumn("at", F.explode("at"))
        .select("raw_path", F.when((F.col("size") > 0) & (F.col("at") >= F.col("size")), F.col("next_line")).otherwise(F.col("line")).alias("line_no"), F.lit("misread").alias("kind"), "w", "f", "size")
    )
    # joined or hyphenated: what the corpus has more often, counting what a misreading stands for
    place_of = ["raw_path", "line", "p"]
    cuts = words.where("role <> 'word'").select(*place_of, "role", "w", "size").join(broadcast_if_small(vocab), "w", "left").join(best.where("role <> 'word'").select(*place_of, "role", "w", "f_n", "f"), [*place_of, "role", "w"], "left")
    seen = F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("f_n", F.lit(0)))
    decided = cuts.groupBy(*place_of).agg(
        F.max(F.when(F.col("role") != "hyphened", seen)).alias("joined"),
        F.max(F.when(F.col("role") == "hyphened", seen)).alias("hyphened"),
        F.max(F.when(F.col("role") != "hyphened", F.coalesce("f", "w"))).alias("f"),
        F.max(F.when(F.col("role") != "hyphened", F.col("w"))).alias("w"),
        F.max("size").alias("size"),
        F.bool_or(F.col("role") == "upper").alias("upper"),
    )
    hyphen = decided.where((F.col("joined") > F.col("hyphened")) | ((F.col("joined") == F.col("hyphened")) & ~F.col("upper"))).select("raw_path", F.col("line").alias("line_no"), F.lit("hyphen").alias("kind"), "w", "f", "size")
    plain = rows.where("role = 'furniture'").select("raw_path", F.col("line").alias("line_no"), F.lit("furniture").alias("kind"), F.lit(None).cast("string").alias("w"), F.lit(None).cast("string").alias("f"), "size").distinct()
    # a misreading in a word that keeps its hyphen is no joined word's
    return plain.unionByName(hyphen).unionByName(misread)


def found(docs: DataFrame) -> DataFrame:
    """``raw_path, line_no, kind`` of each finding, once."""
    return findings(docs).select("raw_path", "line_no", "kind").distinct()


def _match_case(old: str, new: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new


def reflow(lines: list[str], kind: list[str], joins: dict[int, str], fixes: dict[tuple[int, str], str]) -> str:
    """Text lines as paragraphs: furniture dropped, cut words joined, misread words replaced, lines of a paragraph joined by blanks.
    ``joins`` has the whole word by the line where it begins, ``fixes`` the word meant by line and word as read.

    A paragraph also goes on over a gap if its last line is a full one or a page ends there, it does not end a sentence, and the
    next line begins in lower case.
    """
    out: list[str] = []
    current = ""
    gap = glue = turned = False
    whole: str | None = None
    width = 0
    for i, line in enumerate(lines):
        if kind[i] != "text":
            gap = gap or kind[i] == "blank"
            turned = turned or kind[i] == "furniture" or bool(line.strip())
            continue

        def fixed(m: re.Match) -> str:
            token = m.group(0)
            core = token.strip(_OUTER)
            new = fixes.get((i + 1, core.lower()))
            return token.replace(core, _match_case(core, new), 1) if new else token

        text = _TOKEN.sub(fixed, line.strip())
        goes_on = glue or (current and (turned or width >= 40) and not re.search(r"[.!?:…”\"]$", current) and text[:1].islower())
        if current and gap and not goes_on:
            out.append(current)
            current = ""
        if glue:
            head, tail = _TOKEN.findall(current)[-1:], _TOKEN.findall(text)[:1]
            core = "".join(head + tail).strip(_OUTER)
            if head and tail and whole and whole != core.lower():  # the joined word's own misreadings
                text = "".join(head + tail).replace(core, _match_case(core, whole), 1) + text[len(tail[0]) :]
                current = current[: len(current) - len(head[0])]
            current = current + text
        else:
            current = f"{current} {text}" if current else text
        glue, gap, turned, width = (i + 1) in joins, False, False, len(line)
        whole = joins.get(i + 1)
        if glue:
            current = current.rstrip(MARKS)
        elif current and current[-1] in "-‐‑" and current[-2:-1].isalpha():
            glue = True
    if current:
        out.append(current)
    return "\n\n".join(out)


def repaired(docs: DataFrame) -> DataFrame:
    """``raw_path, text``: every PDF document as continuous paragraphs; a document without noise keeps its words."""
    found_ = findings(docs)
    per = cut(found_.groupBy("raw_path").agg(F.collect_set(F.struct("line_no", "kind", "w", "f")).alias("notes")), "notes")
    joined = spread(pdf(docs)).join(broadcast_if_small(per), "raw_path", "left")

    def work(batch) -> dict:
        out = []
        for text, notes in zip(batch.column("markdown").to_pylist(), batch.column("notes").to_pylist()):
            notes = notes or []
            lines = text.split("\n")
            dropped = {x["line_no"] for x in notes if x["kind"] == "furniture"}
            kind = ["furniture" if i in dropped else "blank" if not x.strip() or _SEPARATOR.match(x) else "text" for i, x in enumerate(lines, 1)]
            fixes = {(x["line_no"], x["w"]): x["f"] for x in notes if x["kind"] == "misread"}
            out.append(reflow(lines, kind, {x["line_no"]: x["f"] for x in notes if x["kind"] == "hyphen"}, fixes))
        return {"raw_path": batch.column("raw_path"), "text": out}

    return map_arrow(joined, "raw_path string, text string", "markdown", work, deal=False).groupBy("raw_path").agg(F.max("text").alias("text"))
