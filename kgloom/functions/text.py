"""Scalar and table-valued text functions, as column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-zA-Z][a-zA-Z0-9_]+"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lower_ascii(text: Column | str) -> Column:
    """A to Z in lower case; other letters stay, so that no other letter becomes an ASCII one."""
    return F.translate(_col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: Column | str) -> Column:
    """Words of at least two ASCII letters, digits or ``_`` that begin with a letter, in lower case; null text has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(_col(text), F.lit(""))), F.lit("([a-z][a-z0-9_]+)"), F.lit(1))


def spans(text: Column | str, pattern: str) -> Column:
    """Matches of ``pattern`` as an array of ``(start, match)``, ``start`` counted in characters from 0; the pattern must not
    match the empty string."""
    t = F.coalesce(_col(text), F.lit(""))
    parts = F.transform(F.split(t, pattern, -1), F.length)
    found = F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    return F.transform(found, lambda m, i: F.struct((total(F.slice(parts, F.lit(1), i + 1)) + total(F.transform(F.slice(found, F.lit(1), i), F.length))).alias("start"), m.alias("match")))


def slug_letters(text: Column | str) -> Column:
    """Lower case, every character but letters and digits as ``_``, outer ``_`` cut, 60 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", ""), 1, 60)


def slug_ascii(text: Column | str) -> Column:
    """Lower case, each run of characters but a-z and 0-9 as one ``_``, outer ``_`` cut."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug_blank(text: Column | str) -> Column:
    """Lower case, blanks as ``_``."""
    return F.replace(F.lower(_col(text)), F.lit(" "), F.lit("_"))


def url_slug(url: Column | str) -> Column:
    """Path of a url (``/index`` for none) and, where there is a query, the first eight digits of its SHA-1, as an ASCII slug of
    at most 120 characters."""
    u = _col(url)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(F.regexp_replace(path, "^/+|/+$", "") == "", "/index").otherwise(path)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return F.substring(slug_ascii(F.concat(path, F.when(query != "", F.concat(F.lit("_"), F.substring(F.sha1(query), 1, 8))).otherwise(""))), 1, 120)


def title(body: Column | str, key: Column | str) -> Column:
    """Text of the first line that begins with ``# ``; the key in title case without one."""
    found = F.trim(F.regexp_extract(F.coalesce(_col(body), F.lit("")), r"(?m)^# (.*)$", 1))
    return F.when(found != "", found).otherwise(F.initcap(F.regexp_replace(_col(key), "_", " ")))


def summary(body: Column | str) -> Column:
    """Lines that are neither blank, headings nor fences, joined by blanks, cut to 160 characters with ``...``."""
    lines = F.filter(F.transform(F.split(F.coalesce(_col(body), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("```"))
    text = F.array_join(lines, " ")
    return F.when(F.length(text) > 160, F.concat(F.rtrim(F.substring(text, 1, 157)), F.lit("..."))).otherwise(text)


def first_sentences(body: Column | str, n: int = 2) -> Column:
    """The first ``n`` sentences of the body without its markdown headings, at most 700 characters."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(_col(body), F.lit("")), r"(?m)^#+ .*$", " "), r"\s+", " "))
    return F.substring(F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, n), " "), 1, 700)


def paragraphs(text: Column | str, most: int | None = None, preview: int = 180) -> Column:
    """The paragraphs, or the first ``most`` where it is given, cut to ``preview`` characters."""
    parts = F.filter(F.transform(F.split(F.coalesce(_col(text), F.lit("")), r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts if most is None else F.slice(parts, 1, most), lambda x: F.substring(x, 1, preview))


def sections(markdown: Column | str) -> Column:
    """Sections of a markdown text as ``(level, heading, text)``: what precedes the first heading has level 0 and no heading."""
    t = F.coalesce(_col(markdown), F.lit(""))
    parts = F.split(t, r"(?m)^(?=#{1,6}[ \t]+\S)", -1)
    cut = F.transform(
        parts,
        lambda p: F.struct(
            F.length(F.regexp_extract(p, r"^(#{1,6})[ \t]+\S", 1)).alias("level"),
            F.trim(F.regexp_extract(p, r"^#{1,6}[ \t]+([^\n]*)", 1)).alias("heading"),
            F.regexp_replace(F.when(p.rlike(r"^#{1,6}[ \t]+\S"), F.regexp_replace(p, r"^#[^\n]*\n?", "")).otherwise(p), r"^\s+|\s+$", "").alias("text"),
        ),
    )
    return F.filter(cut, lambda s: (s["level"] > 0) | (s["text"] != ""))


def wikilinks(body: Column | str) -> Column:
    """Targets of ``[[target]]``, ``[[target|label]]`` and ``[[target#part]]``, in order, with repeats."""
    return F.transform(F.regexp_extract_all(F.coalesce(_col(body), F.lit("")), F.lit(r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"), F.lit(1)), lambda x: F.trim(x))


def json_list(text: Column | str) -> Column:
    """A JSON list of strings; an empty list for null, blank and malformed text."""
    return F.coalesce(F.from_json(_col(text), "array<string>"), F.array().cast("array<string>"))


def day(text: Column | str) -> Column:
    """The date in ``yyyy-MM-dd...``; null for any other form."""
    return F.when(_col(text).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(_col(text), 1, 10), "yyyy-MM-dd"))
