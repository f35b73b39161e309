"""Main content of web pages, by line-block distribution.

Markup is stripped from each line and the text that can be body is weighed.  Sums of the weights over sliding windows of lines surge
where the body begins and dive where it ends; the text between them, with headings, lists, tables and captions that touch it, is
the article.  Lines without weight between surge and dive are cut out of it.

What can be body is learned from the distribution itself, over all pages: for each phrase, how often it stands in a dense place, one
with much text in the long lines around it.  The phrases of notices, menus, teasers and company notes stand apart from the text,
wherever they recur, so a line whose phrases are rarely in dense places weighs nothing.  Short lines that recur on many pages and
are never a title are labels of the site, and lines that recur over the pages of a host are part of its menus.  There is no list
of words.

Counts have partial sums before the shuffle, so a host that holds a third of all pages is one counter per line.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import broadcast_if_small, cut, release, spread
from .arrow import map_arrow

WINDOW = 3  # lines of a block
SURGE = 100  # characters of body text in a block that open a body
MIN_PAGES, MIN_SHARE = 3, 0.05  # a line recurs on a host from so many pages and this share of its pages on
REACH, LONG, DENSE = 3, 60, 200  # a place is dense if so many lines on either side hold so many characters in lines that long
PHRASES = 50_000  # phrases in the model, the most frequent ones; bounds the list sent to workers
DIVE = 60  # characters in a block below which a body ends
PRIOR = 2.0  # occurrences by which a phrase's share of dense places is drawn to that of all phrases
FURNITURE = -0.1  # a line whose phrases have mean log-odds so far below those of all phrases is furniture
BARE = -1.4  # the same for a short line
WHOLE_WORDS = 8  # lines of up to so many words are phrases as a whole
LABEL_PAGES, LABEL_WORDS = 10, 5  # a line of up to so many words on so many pages, never a title, is a label of the site

_ADDRESS = re.compile(r"^[^,.:;!?]{2,50},\s+[^\W\d]+\.?\s+\d{1,6},\s+[^,.:;!?]{2,40}$")
#: One word, a colon and short parts without figures.
_TAGS = re.compile(r"^[^\W\d_]+(?:-[^\W\d_]+)?\s?:\s*[^,.:;!?\d]{2,40}(?:,\s*[^,.:;!?\d]{2,40})+$")
#: A reading time at the end of a line.
_READ = re.compile(r"\(\s*\d+\s*min\b[^()]{0,20}\)\s*$", re.I)
_LINK = re.compile(r"!?\[([^\]]*)\](?:\([^)]*\))?")
_HEADING = re.compile(r"^\s*#{1,6}\s+")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_PROSE_END = re.compile(r"[.!?…:][\"”’»)\]]*\s*$")
_WORD = re.compile(r"[^\W_]+")
_TERM = re.compile(r"[^\W\d_]+|\d+")
_PARTS = re.compile(r"\s*(?:\||·|›|»|\s>\s|\s/\s)\s*")


def strip(line: str) -> str:
    """A line without heading, list, quote and emphasis marks and with links as their texts."""
    out = _ITEM.sub("", _HEADING.sub("", line)).strip()
    out = re.sub(r"^>\s*", "", out)
    return _LINK.sub(r"\1", out).replace("**", "").replace("__", "").strip()


def _menu_row(text: str) -> bool:
    """Short items in one line between separators, as menus and breadcrumbs have them; rows of figures are tables."""
    parts = [p for p in _PARTS.split(text) if p]
    return len(parts) >= 2 and not text.startswith("|") and all(len(_WORD.findall(p)) <= 4 for p in parts[:-1]) and not any(c.isdigit() for p in parts[:-1] for c in p) and not _PROSE_END.search(text)


def phrases(line: str) -> set[str]:
    """The words, word pairs and, if it is short, the whole of a line, in lower case, numbers masked."""
    words = ["#" if w.isdigit() else w for w in _TERM.findall(strip(line).lower())]
    out = {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}
    if 0 < len(words) <= WHOLE_WORDS:
        out.add("\n" + " ".join(words))
    return out


def density(lines: list[str]) -> list[int]:
    """For each line how many characters the long lines around it hold, up to ``REACH`` lines before and after it."""
    upto = [0]
    sizes = [n if (n := len(strip(x))) >= LONG else 0 for x in lines]
    for n in sizes:
        upto.append(upto[-1] + n)
    return [upto[min(len(lines), i + REACH + 1)] - upto[max(0, i - REACH)] - sizes[i] for i in range(len(lines))]


def score(line: str, model: dict[str, float]) -> float:
    """Mean log-odds that the line's phrases stand in dense places, 0 for the mean of all phrases; phrases that the model does not
    hold take no part."""
    known = [model[x] for x in phrases(line) if x in model]
    return sum(known) / len(known) if known else 0.0


def whole(line: str) -> str:
    """The phrase that stands for a whole line."""
    return "\n" + " ".join("#" if w.isdigit() else w for w in _TERM.findall(strip(line).lower()))


def kinds(lines: list[str], recurring: set[int], title: str | None, model: dict[str, float], labels: dict[str, bool] = {}) -> tuple[list[str], list[float]]:
    """For each line its kind: blank, text, mark (heading, list item, table, caption), short, teaser, menu (a short line that recurs on
    the host) or noise; and its weight, the characters of body text that it holds."""
    out, weight = [], []
    for no, line in enumerate(lines, 1):
        raw = line.strip()
        text = strip(raw)
        words = len(_WORD.findall(text))
        linked = sum(len(m.group(1)) for m in _LINK.finditer(raw))
        marked = bool(_HEADING.match(line)) or raw.startswith("**") or raw.startswith(">")
        kind = "short"
        if not raw:
            kind = "blank"
        elif title and text == title.strip():
            kind = "title"
        elif _READ.search(text) or raw[0] in "←→" or raw[-1] in "←→" or (linked and linked >= 0.8 * max(1, len(text))):
            kind = "teaser"
        elif raw.startswith("|"):
            kind = "mark"
        elif not words or _ADDRESS.match(text) or _menu_row(text):
            kind = "noise"
        else:
            odds = score(raw, model)
            if odds < (FURNITURE if words > 8 or _PROSE_END.search(text) else BARE) and not (marked or raw.startswith(("- ", "+ ", "• "))):
                kind = "noise"
            elif words >= 12 or (words >= 6 and _PROSE_END.search(text)):
                kind = "noise" if no in recurring and words < 10 else "text"
            elif words <= LABEL_WORDS and not marked and ":" not in text and "|" not in text and whole(raw) in labels:
                kind = "label"
            elif _TAGS.match(text) and not marked:
                kind = "noise"
            elif marked:
                kind = "mark"
            elif no in recurring and words <= 8 and "|" not in raw:
                kind = "menu"
            elif raw.startswith(("- ", "+ ", "• ")) or any(c.isdigit() for c in text) or "," in text or ":" in text:
                kind = "mark"
        out.append(kind)
        weight.append(float(len(text)) if kind == "text" else 0.5 * len(text) if kind in ("mark", "short") and not raw.startswith("|") else 0.0)
    # the head of a list of teasers is part of it; a label above such a list, or alone, is furniture
    full = [i for i, k in enumerate(out) if k != "blank"]
    for a, b in zip(full, [*full[1:], None]):
        below = None if b is None else out[b]
        if below == "text" and b == a + 1 and out[b + 1 : b + 2] in (["teaser"], ["short"]):
            below = out[b + 1]  # a blurb stands above the first teaser
        label = out[a] == "label" or (out[a] == "mark" and bool(_HEADING.match(lines[a])) and whole(lines[a]) in labels)
        head = label or (out[a] in ("short", "menu", "noise", "mark") and len(_WORD.findall(lines[a])) <= LABEL_WORDS and not lines[a].lstrip().startswith(("- ", "|")))
        if (head and below == "teaser" and out[b] == "teaser") or (label and below in ("teaser", "short", "title")):
            out[a] = "related"
        elif out[a] == "label":
            out[a] = "menu" if labels[whole(lines[a])] else "noise"
    return out, weight


def article(markdown: str | None, recurring: set[int] = frozenset(), title: str | None = None, model: dict[str, float] | None = None, labels: dict[str, bool] | None = None) -> list[bool]:
    """For each line of ``markdown`` whether it belongs to the article; blank lines do not."""
    if not markdown:
        return []
    lines = markdown.split("\n")
    kind, mass = kinds(lines, recurring, title, model or {}, labels or {})
    n = len(lines)

    # a row of names above rows of figures heads a table
    for i in range(n - 1):
        if kind[i] == "noise" and " | " in lines[i] and " | " in lines[i + 1] and kind[i + 1] == "mark" and lines[i].count("|") == lines[i + 1].count("|"):
            kind[i] = "mark"

    # a recurring line alone between lines of the body heads a part of it
    full = [i for i in range(n) if kind[i] != "blank"]
    around = {full[k]: {kind[full[k - 1]], kind[full[k + 1]]} for k in range(1, len(full) - 1)}
    for i in full:
        if kind[i] == "menu":
            kind[i] = "short" if around.get(i, {""}) <= {"text", "mark", "title"} and not lines[i].lstrip().startswith("*") else "noise"

    # runs of three or more bare short lines are menus, wherever they stand; items with stars too
    i = 0
    while i < len(full):
        j = i
        while j < len(full) and kind[full[j]] in ("short", "noise") and (j == i or full[j] == full[j - 1] + 1):
            j += 1
        if sum(kind[full[k]] == "short" for k in range(i, j)) >= 3 or any(lines[full[k]].lstrip().startswith("* ") for k in range(i, j)):
            for k in range(i, j):
                kind[full[k]] = "noise"
        i = max(j, i + 1)

    # a list of teasers under its heading, with the blurbs between them
    for i in range(n):
        if kind[i] != "related" and not (kind[i] == "teaser" and (i == 0 or kind[i - 1] not in ("cut", "related", "teaser"))):
            continue
        last, j, titled = i, i + 1, kind[i] == "related"
        if titled and j < n and kind[j] == "blank":
            j += 1
        while j < n and kind[j] in ("teaser", "short", "text", "mark", "title"):
            if kind[j] == "teaser":
                last = j
            elif kind[j] == "short" and titled and j - last <= 2:
                last = j
            elif j - last > 2 or _HEADING.match(lines[j]):
                break
            j += 1
        # a blurb may close the list when the block ends with it
        if titled and last + 1 < n and kind[last + 1] == "text" and (last + 2 >= n or kind[last + 2] == "blank") and any(kind[k] == "text" for k in range(i, last)):
            last += 1
        for k in range(i, last + 1):
            kind[k] = "cut"

    # windows of lines: the text surges where a block of lines holds enough of it, and dives where a block holds none
    full = [i for i in range(n) if kind[i] != "blank"]
    weight = [mass[i] if kind[i] in ("text", "mark", "short") else 0.0 for i in full]
    block = [sum(weight[k : k + WINDOW]) for k in range(len(full))]
    keep = [False] * n
    k = 0
    while k < len(full):
        if not (weight[k] and block[k] >= SURGE):
            k += 1
            continue
        end = k
        while end < len(full) and block[end] >= DIVE:
            end += 1
        # what touches the body belongs to it: the lines up to furniture on either side
        a, b = k, end
        while a and kind[full[a - 1]] in ("mark", "short", "title", "text"):
            a -= 1
        while b < len(full) and kind[full[b]] in ("mark", "short", "title", "text"):
            b += 1
        for x in range(a, b):
            keep[full[x]] = kind[full[x]] in ("text", "mark", "short", "title")
        k = max(b, k + 1)

    # the title stands above the body, perhaps with a notice between them; marked structure between two bodies is body
    body = [i for i in full if keep[i]]
    if body:
        first = body[0]
        for i in range(first - 1, -1, -1):
            if kind[i] == "title" or (kind[i] == "mark" and _HEADING.match(lines[i])):
                keep[i] = True
        for i in range(first, body[-1]):
            if kind[i] in ("mark", "title", "short"):
                keep[i] = True
        # below the last body: headings and structure cut off from it by furniture
        for i in range(body[-1] + 1, n):
            if kind[i] == "mark":
                keep[i] = True
        # bare lines above the first body that are not its title are menus
        head = next((i for i in range(first, n) if kind[i] in ("title", "text") or (kind[i] == "mark" and _HEADING.match(lines[i]))), first)
        for i in range(first, head):
            if kind[i] == "short" and not any(kind[x] == "short" for x in range(i + 1, head)) and title is None:
                continue
            if kind[i] == "short":
                keep[i] = False
    return keep


def html(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("metadata")["extension"] == ".html").select(
        "raw_path", "markdown", F.col("metadata")["title"].alias("title"), F.coalesce(F.regexp_extract(F.lower(F.col("metadata")["url"]), r"^[a-z]+://([^/:?#]+)", 1), F.lit("")).alias("host")
    )


def recurring_lines(pages: DataFrame) -> DataFrame:
    """``raw_path, lines`` (numbers from 1) of the lines that recur over the pages of their host; a page given twice counts once."""
    mask = lambda x: F.xxhash64("host", F.regexp_replace(F.trim(x), "[0-9]+", "#"))
    hashed = cut(
        pages.where("markdown is not null").select("raw_path", "host", F.transform(F.split("markdown", "\n"), lambda x: F.when(F.trim(x) != "", mask(x))).alias("hashes")).dropDuplicates(["raw_path"]),
        "lines",
    )
    counts = hashed.select("host", F.explode(F.array_distinct(F.filter("hashes", lambda h: h.isNotNull()))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    hosts = hashed.groupBy("host").agg(F.count("*").alias("all"))
    common = cut(counts.join(broadcast_if_small(cut(hosts, "hosts")), "host").where(F.col("n") >= MIN_SHARE * F.col("all")).select("h"), "recurring")
    at = hashed.select("raw_path", F.posexplode("hashes").alias("no", "h")).where("h is not null")
    return at.join(broadcast_if_small(common), "h", "left_semi").groupBy("raw_path").agg(F.collect_set(F.col("no") + 1).alias("lines"))


def learn(pages: DataFrame) -> DataFrame:
    """``phrase, n, dense, pages, titles, heads``: over all pages, how many lines hold each phrase, how many of them stand in dense
    places, how many pages have the phrase as a whole line (of up to ``LABEL_WORDS`` words), and as a title or a heading."""

    def work(batch) -> dict:
        count: dict[str, list[int]] = {}
        for text, title in zip(batch.column("markdown").to_pylist(), batch.column("title").to_pylist()):
            lines = [x for x in (text or "").split("\n") if x.strip()]
            full: set[str] = set()
            heads: set[str] = set()
            for line, near in zip(lines, density(lines)):
                own = phrases(line)
                for x in own:
                    c = count.setdefault(x, [0, 0, 0, 0, 0])
                    c[0] += 1
                    c[1] += near >= DENSE
                own = {x for x in own if x[0] == "\n"}
                full |= own
                if _HEADING.match(line) or line.startswith("**"):
                    heads |= own
            for k, some in ((2, full), (3, phrases(title) if title else ()), (4, heads)):
                for x in some:
                    if x[0] == "\n":
                        count.setdefault(x, [0, 0, 0, 0, 0])[k] += 1
        cols = list(zip(*count.values())) if count else [()] * 5
        return dict(zip(("phrase", "n", "dense", "pages", "titles", "heads"), [list(count), *cols]))

    names = ("n", "dense", "pages", "titles", "heads")
    rows = map_arrow(pages.select("markdown", "title"), "phrase string, " + ", ".join(f"{x} bigint" for x in names), "markdown", work)
    return rows.groupBy("phrase").agg(*[F.sum(x).alias(x) for x in names])


def model(counts: DataFrame) -> tuple[dict[str, float], dict[str, bool]]:
    """(log-odds of standing in a dense place, of the ``PHRASES`` most frequent phrases; those that are labels of sites, with whether
    they are headings elsewhere)."""
    total = counts.agg(F.sum("n").alias("n"), F.sum("dense").alias("dense")).first()
    base = (total.dense or 0) / total.n if total.n else 0.0
    logit = lambda share: math.log(max(share, 1e-3) / max(1 - share, 1e-3))
    odds, labels = {}, {}
    for r in counts.orderBy(F.desc("n"), "phrase").limit(PHRASES).toArrow().to_pylist():  # bounded by PHRASES
        odds[r["phrase"]] = logit((r["dense"] + PRIOR * base) / (r["n"] + PRIOR)) - logit(base)
        if r["phrase"][0] == "\n" and r["pages"] >= LABEL_PAGES and not r["titles"]:
            labels[r["phrase"]] = r["heads"] > 0
    return odds, labels


def pages_lines(docs: DataFrame) -> DataFrame:
    """``raw_path, keep, lines``: the numbers of the article's lines and of the other non-blank lines of each HTML document.

    A null or empty markdown has neither.  Rows given twice come out twice; other columns are dropped.
    """
    pages = html(docs)
    counts = cut(learn(pages), "phrases")
    learned = docs.sparkSession.sparkContext.broadcast(model(counts))
    release(counts)
    marked = spread(pages).join(broadcast_if_small(cut(recurring_lines(pages), "marked")), "raw_path", "left").select("raw_path", "markdown", "title", "lines")

    def work(batch) -> dict:
        kept, rest = [], []
        for text, title, lines in zip(batch.column("markdown").to_pylist(), batch.column("title").to_pylist(), batch.column("lines").to_pylist()):
            flags = article(text, set(lines or ()), title, *learned.value)
            kept.append([i for i, f in enumerate(flags, 1) if f])
            rest.append([i for i, (f, line) in enumerate(zip(flags, (text or "").split("\n")), 1) if not f and line.strip()])
        return {"raw_path": batch.column("raw_path"), "markdown": batch.column("markdown"), "keep": kept, "cut": rest}

    return map_arrow(marked, "raw_path string, markdown string, keep array<int>, cut array<int>", "markdown", work, deal=False)


def main_text(docs: DataFrame) -> DataFrame:
    """``raw_path, text``: the article's lines of each HTML document, blank lines between paragraphs kept single; one row per
    document."""
    lines = F.split("markdown", "\n")
    return (
        pages_lines(docs)
        .select("raw_path", F.array_join(F.transform("keep", lambda i: F.element_at(lines, i)), "\n").alias("text"))
        .groupBy("raw_path")
        .agg(F.max("text").alias("text"))
    )


def found(docs: DataFrame) -> DataFrame:
    """``raw_path, line_no`` of the non-blank lines that are not article."""
    return pages_lines(docs).select("raw_path", F.explode("cut").alias("n")).select("raw_path", F.col("n").cast("bigint").alias("line_no")).distinct()
