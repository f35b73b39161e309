"""Keyword-stuffed and link-list pages.

For each page the suffix automaton of its tokens (words, marks) gives the characters covered by repeated maximal substrings.  Each
line is cut into segments.  A segment's clause structure is the share of short words, which hold the words of a clause together in
any language, and whether it closes as a sentence does; the more of it is repetition, the more clause structure it needs to count
as a sentence (``needed``).  A page is stuffed when sentences hold less than half of its words and keywords and links most of the
rest.  No list of words takes part.
"""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_arrow

_LINK = re.compile(r"https?://\S+|www\.\S+|\[\[[^\]]*\]\]|\[([^\]]*)\]\([^)]*\)")
_WORD = re.compile(r"[^\W_]+(?:['’.,][^\W_]+)*")
_END = re.compile(r"(?<=[.!?…。！？؟।])[\"”’»)\]]*\s+")
_CLOSED = re.compile(r"[.!?…:;。！？؟।][\"”’»)\]]*\s*$")
_HEADING = re.compile(r"^\s*#{1,6}\s")
_MARK = re.compile(r"^\s*(?:[-*•·>]|\d+[.)])\s+")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]")
#: Scripts written without blanks between words.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")

LEAST = 8  # characters of a repeated substring
SHORT = 3  # letters of a short word
OPEN = 0.2  # share of short words that a segment needs in addition if it does not close as a sentence
REPEATED, WEIGHT = 0.4, 0.25  # from this share of repeated characters on, short words are needed, by this weight
UNSPACED_SHORT = 0.15  # clause structure of a segment in a script without blanks
TITLE_WORDS = 12  # a heading of up to so many words is neither sentence nor keywords
MIN_WORDS = 1
FRESH = 0.03  # a page of which less than this share is said for the first time is stuffed


def repeats(tokens: list[str]) -> tuple[list[int], list[int]]:
    """For each token how many tokens, it the last, form the longest substring that occurs again in the page, and the longest that
    occurs before.

    Blumer's automaton, in time linear in the number of tokens: a new state's suffix link is its longest suffix that was there
    before; the states that more than one end share are the maximal repeated substrings.
    """
    nxt: list[dict[str, int]] = [{}]
    link, length, at, before = [-1], [0], [], []
    last = 0
    for w in tokens:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
        at.append(cur)
        before.append(length[link[cur]])
    # a state that is another's link has more ends than that one, so it occurs twice; any other has one end, and its link is the
    # longest suffix with more
    again = set(link)
    return [length[s] if s in again else length[link[s]] for s in at], before


def covered(lengths: list[int], sizes: list[int], least: int = LEAST) -> list[bool]:
    """For each token whether one of the substrings that end with ``lengths`` tokens and have at least ``least`` characters holds it."""
    upto = [0, *accumulate(sizes)]
    out, reach = [False] * len(lengths), len(lengths)
    for i in range(len(lengths) - 1, -1, -1):
        n = lengths[i]
        if n and upto[i + 1] - upto[i + 1 - n] >= least:
            reach = min(reach, i - n + 1)
        if i >= reach:
            out[i] = True
    return out


def needed(repeated: float, closed: bool) -> float:
    """The share of short words from which a segment is a sentence, if ``repeated`` of its characters lie in repeated substrings."""
    return WEIGHT * max(0.0, repeated - REPEATED) + (0.0 if closed else OPEN)


def profile(text: str | None) -> tuple[int, int, int, float, float]:
    """(words, words in sentences, words in keyword segments, share of characters covered by repeated substrings, share of those not
    covered by what the page has said before)."""
    segments: list[tuple[int, int, int, int, float, bool, bool]] = []
    tokens: list[str] = []
    words = 0
    for line in (text or "").splitlines():
        if not line.strip():
            continue
        heading = bool(_HEADING.match(line))
        for part in _END.split(_MARK.sub("", line)):
            found = [x.lower() for x in _TOKEN.findall(part)]
            own = [x for x in found if x[0].isalnum()]
            if not own:
                continue
            linked = sum(len(_WORD.findall(m.group(0))) for m in _LINK.finditer(part))
            short = sum(len(x) <= SHORT and x.isalpha() for x in own) / len(own)
            if 2 * len(_UNSPACED.findall(part)) > len(part):
                short = UNSPACED_SHORT
            segments.append((len(tokens), len(found), len(own), linked, short, bool(_CLOSED.search(part)), heading))
            tokens += ["0" * len(x) if x.isdigit() else x for x in found]
            words += len(own)
    if not words:
        return 0, 0, 0, 0.0, 1.0
    sizes = [len(x) for x in tokens]
    total = [0, *accumulate(sizes)]
    anywhere, before = repeats(tokens)
    again = [0, *accumulate(n if r else 0 for n, r in zip(sizes, covered(anywhere, sizes)))]
    fresh = sum(n for n, r in zip(sizes, covered(before, sizes)) if not r)
    sentence = keyword = 0
    for start, size, own, linked, short, closed, heading in segments:
        if heading and own <= TITLE_WORDS:
            continue
        repeated = (again[start + size] - again[start]) / (total[start + size] - total[start])
        if 2 * linked <= own and short >= needed(repeated, closed):
            sentence += own
        else:
            keyword += own
    return words, sentence, keyword, again[-1] / total[-1], fresh / total[-1]


def stuffed(words: int, sentence: int, keyword: int, repeated: float, fresh: float) -> bool:
    """Keywords prevail, or the page says the same few things over and over, whatever their structure."""
    return (keyword > sentence and keyword >= MIN_WORDS and 2 * sentence < words) or fresh < FRESH


def pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, words, sentence_words, keyword_words, repeated, fresh, stuffed`` of every row.

    Null, empty and wordless texts have zeros, are fresh and not stuffed.  Rows given twice come out twice; other columns are dropped.
    """
    rows = docs.select(key, F.col(text).alias("_text"))
    kind = rows.schema[key].dataType.simpleString()

    def work(batch) -> dict:
        out = [profile(t) for t in batch.column("_text").to_pylist()]
        cols = list(zip(*out)) if out else [()] * 5
        return {key: batch.column(key), "words": cols[0], "sentence_words": cols[1], "keyword_words": cols[2], "repeated": cols[3], "fresh": cols[4], "stuffed": [stuffed(*x) for x in out]}

    return map_arrow(rows, f"`{key}` {kind}, words bigint, sentence_words bigint, keyword_words bigint, repeated double, fresh double, stuffed boolean", "_text", work)


def found(docs: DataFrame) -> DataFrame:
    """``doc_id`` of the stuffed pages."""
    return pages(docs).where("stuffed").select("doc_id")
