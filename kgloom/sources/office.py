"""Word, PowerPoint, Excel and HTML files as parsed documents.

Files are read as binary rows and parsed in the partition that holds them, with the standard library only: Office files are zipped
XML, HTML is walked by a parser that knows nesting.  A file that cannot be read is a document without chunks and with a warning.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.web import CHROME_CLASSES, CHROME_TAGS

CHUNK = "struct<id:string,type:string,markdown:string,heading:string,level:int>"
SCHEMA = f"raw_path string, provider string, markdown string, chunks array<{CHUNK}>, metadata map<string,string>, warnings array<string>"


def _name(tag: str) -> str:
    """Tag or attribute without its namespace."""
    return tag.rpartition("}")[2]


def _all(node: ET.Element, tag: str) -> Iterator[ET.Element]:
    return (x for x in node.iter() if _name(x.tag) == tag)


def _attribute(node: ET.Element, tag: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _name(k) == tag), None)


def _text(node: ET.Element) -> str:
    return "".join(x.text or "" for x in _all(node, "t")).strip()


def table(rows: list[list[str]]) -> str:
    """Rows as a markdown table: the first row heads it, shorter rows are filled, longer ones cut."""
    if not rows:
        return ""
    width = len(rows[0])
    full = [rows[0], ["---"] * width, *[(r + [""] * width)[:width] for r in rows[1:]]]
    return "\n".join("| " + " | ".join(r) + " |" for r in full)


def _chunk(kind: str, number: int, markdown: str, heading: str = "", level: int = 0) -> dict:
    return {"id": f"{kind}-{number}", "type": kind.rpartition("-")[2], "markdown": markdown, "heading": heading, "level": level}


def word(data: bytes) -> tuple[str, list[dict]]:
    """A section per heading, then a section per table."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(_all(ET.fromstring(z.read("word/document.xml")), "body"))
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in _all(ET.fromstring(z.read("word/styles.xml")), "style"):
                label = next(_all(s, "name"), None)
                styles[_attribute(s, "styleId")] = (_attribute(label, "val") if label is not None else "") or ""
    sections: list[tuple[str, int, list[str]]] = [("", 0, [])]
    for p in body:
        if _name(p.tag) != "p" or not (text := _text(p)):
            continue
        style = next(_all(p, "pStyle"), None)
        key = _attribute(style, "val") if style is not None else ""
        label = (styles.get(key) or key or "").lower()
        if label.startswith("heading"):
            digits = re.search(r"\d+", label)
            sections.append((text, int(digits[0]) if digits else 1, []))
        else:
            sections[-1][2].append(text)
    made = [("\n\n".join(x for x in (f"{'#' * min(6, max(1, lv))} {h}" if h else "", "\n".join(lines)) if x), h, lv) for h, lv, lines in sections]
    for n, t in enumerate((x for x in body if _name(x.tag) == "tbl"), 1):
        rows = [[_text(c) for c in r if _name(c.tag) == "tc"] for r in t if _name(r.tag) == "tr"]
        if rows:
            made.append((f"## Table {n}\n\n{table(rows)}", f"Table {n}", 2))
    chunks = [_chunk("word-section", i, m, h, lv) for i, (m, h, lv) in enumerate((x for x in made if x[0]), 1)]
    return "\n\n".join(c["markdown"] for c in chunks), chunks


def slides(data: bytes) -> tuple[str, list[dict]]:
    """A chunk per slide: title, bullets by level, notes."""
    chunks = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        numbers = sorted(int(m[1]) for x in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", x)))
        for place, n in enumerate(numbers, 1):
            title, lines = "", []
            for shape in _all(ET.fromstring(z.read(f"ppt/slides/slide{n}.xml")), "sp"):
                holder = next(_all(shape, "ph"), None)
                heads = holder is not None and (_attribute(holder, "type") in ("title", "ctrTitle") or (_attribute(holder, "idx") or "0") == "0" and _attribute(holder, "type") is None)
                for p in _all(shape, "p"):
                    if not (text := _text(p)):
                        continue
                    if heads and not title:
                        title = text
                        continue
                    how = next(_all(p, "pPr"), None)
                    lines.append("  " * int((_attribute(how, "lvl") if how is not None else None) or 0) + "- " + text)
            parts = [f"# Slide {place}: {title}" if title else f"# Slide {place}", *(["\n".join(lines)] if lines else [])]
            if f"ppt/notesSlides/notesSlide{n}.xml" in z.namelist():
                notes = " ".join(t for p in _all(ET.fromstring(z.read(f"ppt/notesSlides/notesSlide{n}.xml")), "p") if (t := _text(p)))
                if notes:
                    parts.append(f"\n_Notes:_ {notes}")
            chunks.append(_chunk("pptx-slide", place, "\n\n".join(parts), title, 1))
    return "\n\n---\n\n".join(c["markdown"] for c in chunks), chunks


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes) -> list[dict[str, str]]:
    """Rows of the first sheet by the header in its first row; blank rows and cells beyond the header are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_text(x) for x in _all(ET.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in z.namelist() else []
        first = min((x for x in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=lambda x: int(re.search(r"\d+", x)[0]))
        root = ET.fromstring(z.read(first))
    out: list[list[str]] = []
    for row in _all(root, "row"):
        cells: dict[int, str] = {}
        for k, c in enumerate(x for x in row if _name(x.tag) == "c"):
            value = next(_all(c, "v"), None)
            text = _text(c) if _attribute(c, "t") == "inlineStr" else (value.text or "") if value is not None else ""
            if _attribute(c, "t") == "s" and text:
                text = shared[int(text)]
            cells[_column(_attribute(c, "r")) if _attribute(c, "r") else k] = text.strip()
        out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    if not out:
        return []
    header = out[0]
    return [{h: (r[i] if i < len(r) else "") for i, h in enumerate(header) if h} for r in out[1:] if any(r)]


class _Page(HTMLParser):
    """Content of a page as markdown; elements of a chrome tag or class are skipped with all they hold."""

    VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
    BLOCK = {"p", "div", "section", "article", "li", "ul", "ol", "table", "tr", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "main", "figure", "figcaption"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.lines, self.current, self.title, self.cells = [], [], "", []

    def _skip(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def _end(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.current)).strip()
        if text and text not in ("-", *("#" * k for k in range(1, 7))):
            self.lines.append(text)
        self.current = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.BLOCK or tag == "br":
            self._end()
        if tag in self.VOID:
            return
        classes = (dict(attrs).get("class") or "").lower()
        self.open.append((tag, self._skip() or tag in CHROME_TAGS or any(x in classes for x in CHROME_CLASSES)))
        if re.fullmatch("h[1-6]", tag):
            self.current.append("#" * int(tag[1]) + " ")
        elif tag == "li":
            self.current.append("- ")
        elif tag in ("td", "th") and self.current:
            self.current.append(" | ")

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            return
        if tag in self.BLOCK:
            self._end()
        while self.open and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data: str) -> None:
        if any(t == "title" for t, _ in self.open):
            self.title += data
        elif not self._skip():
            self.current.append(data)


def html(data: bytes) -> tuple[str, list[dict], str]:
    """Content as markdown, a section per heading with what precedes the first, and the title."""
    page = _Page()
    page.feed(data.decode("utf-8", "replace"))
    page.close()
    page._end()
    sections: list[list[str]] = [[]]
    for line in page.lines:
        if line.startswith("#"):
            sections.append([])
        sections[-1].append(line)
    chunks = []
    for s in (x for x in sections if x):
        m = re.match(r"(#+) (.*)", s[0])
        chunks.append(_chunk("web-section", len(chunks) + 1, "\n\n".join(s), m[2] if m else "", len(m[1]) if m else 0))
    return "\n\n".join(page.lines), chunks, page.title.strip()


#: Parsers by extension: provider and function of the bytes.
PARSERS = {".docx": ("word", word), ".pptx": ("pptx", slides), ".html": ("web", html), ".htm": ("web", html)}


def parse(files: DataFrame) -> DataFrame:
    """``path, content`` binary rows to parsed documents; files of other extensions are left out."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"]):
                ext = "." + path.rpartition(".")[2].lower()
                provider, how = PARSERS[ext]
                meta = {"filename": path.rpartition("/")[2], "extension": ext, "parser": provider}
                try:
                    markdown, chunks, *title = how(bytes(data))
                    if title:
                        meta["title"] = title[0]
                    out.append((path, provider, markdown, chunks, meta, []))
                except (zipfile.BadZipFile, ET.ParseError, KeyError, StopIteration, ValueError, IndexError) as e:
                    out.append((path, provider, None, [], meta, [f"{type(e).__name__}: {e}"]))
            yield pd.DataFrame(out, columns=["raw_path", "provider", "markdown", "chunks", "metadata", "warnings"])

    extension = F.concat(F.lit("."), F.lower(F.substring_index("path", ".", -1)))
    return files.where(extension.isin(*PARSERS)).select("path", "content").mapInPandas(work, SCHEMA)


def parse_new(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """Documents under ``root`` that are not in ``known`` (``raw_path``) yet; known files are listed, but not opened."""
    source = lambda *paths: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    files = source(root)
    if known is not None:
        # the scan that finds new paths reads no content; the driver holds the listing of all files anyway
        new = files.select("path").join(known.select(F.col("raw_path").alias("path")), "path", "left_anti")
        paths = [r.path for r in new.collect()]
        files = source(*paths) if paths else files.limit(0)
    return parse(files)


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of an Excel file as ``row_no`` (from 1) and ``fields``, a map of text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows = sheet_rows(bytes(data))
                yield pd.DataFrame({"row_no": range(1, len(rows) + 1), "fields": rows})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(work, "row_no bigint, fields map<string,string>")
