"""Web and document text: HTML to text and links, heading sections, paragraphs and index entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_sentences, paragraphs, sections, summary, title

# Tags whose contents are site chrome.
CHROME_TAGS = ("nav", "footer", "header", "aside", "form", "noscript", "script", "style")
# Parts of class names that tell site chrome.
CHROME_CLASSES = ("nav", "menu", "footer", "header", "sidebar", "aside", "related", "share", "social", "promo", "advert", "subscribe", "comment", "pagination", "breadcrumb", "cookie")


def without_chrome(html: Column) -> Column:
    """HTML without comments, chrome elements and ``div``-like elements of a chrome class that hold no element of their kind."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in CHROME_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    hint = "|".join(CHROME_CLASSES)
    return F.regexp_replace(out, rf"(?is)<(div|section|ul|p|span)\b[^>]*class\s*=\s*[\"'][^\"']*(?:{hint})[^\"']*[\"'][^>]*>(?:(?!<\1\b).)*?</\1\s*>", " ")


def text(html: Column) -> Column:
    """Visible text of the content: block ends as line ends, entities decoded, blank lines dropped."""
    out = F.regexp_replace(without_chrome(html), r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/section|/article|/blockquote)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != ""), "\n")


def _resolved(url: Column) -> Column:
    """A url without ``.`` and ``..`` steps in its path; steps above the root are dropped."""
    origin = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    path, query = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"(\?.*)$", 1)
    steps = F.filter(F.split(F.regexp_replace(path, "^/", ""), "/"), lambda x: x != ".")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.concat(origin, F.lit("/"), F.array_join(kept, "/"), query)).otherwise(url)


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``url, n, link``: links in the content, absolute, without fragments, http(s) only, each once in order of appearance."""
    base = F.col(url)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")

    def absolute(href: Column) -> Column:
        h = F.regexp_replace(F.trim(href), r"#.*$", "")
        return (
            F.when((h == "") | F.lower(h).rlike(r"^(?:mailto:|javascript:|tel:)"), F.lit(None).cast("string"))
            .when(F.lower(h).rlike(r"^https?://"), h)
            .when(h.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1), h))
            .when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), F.lit(None).cast("string"))
            .when(h.startswith("/"), F.concat(origin, h))
            .otherwise(_resolved(F.concat(folder, F.lit("/"), h)))
        )

    found = F.regexp_extract_all(without_chrome(F.col(html)), F.lit(r"(?i)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    own = F.array_distinct(F.filter(F.transform(found, absolute), lambda x: x.isNotNull()))
    return pages.where(F.col(html).isNotNull()).select(url, F.posexplode(own).alias("n", "link"))


def heading_sections(rows: DataFrame, key: str, markdown: str) -> DataFrame:
    """``key, section, level, heading, chars`` of each markdown text; keys given twice count once."""
    return rows.where(F.col(markdown).isNotNull()).dropDuplicates([key]).select(key, F.posexplode(sections(markdown)).alias("section", "s")).select(key, "section", "s.level", "s.heading", F.length("s.text").alias("chars"))


def paragraph_chunks(rows: DataFrame, key: str, body: str) -> DataFrame:
    """``key, chunk, preview`` of every paragraph."""
    return rows.where(F.col(body).isNotNull()).dropDuplicates([key]).select(key, F.posexplode(paragraphs(body)).alias("chunk", "preview"))


def index_entries(pages: DataFrame) -> DataFrame:
    """``id, title, summary, opening`` of each page."""
    return pages.dropDuplicates(["id"]).select("id", title("body", "id").alias("title"), summary("body").alias("summary"), first_sentences("body").alias("opening"))


def with_sidecars(parsed: DataFrame, crawl: DataFrame) -> DataFrame:
    """``raw_path, url, host, depth``: web documents with the crawl row of their url, if there is one; urls are compared in normal form,
    of several rows of a url the latest holds.  Documents given twice come once."""
    from .hierarchy import normal_url, resolve_nodes

    own = parsed.where(F.col("metadata")["url"].isNotNull()).select("raw_path", F.col("metadata")["url"].alias("url")).dropDuplicates(["raw_path"]).withColumn("k", normal_url(F.trim("url")))
    side = resolve_nodes(crawl).select(normal_url(F.trim("url")).alias("k"), "depth")
    return own.join(side, "k", "left").select("raw_path", "url", F.regexp_extract("k", r"^[^:]+://([^/?#]+)", 1).alias("host"), "depth")


def raw_relative(path: Column) -> Column:
    """A path from its ``raw/`` folder on; as it is if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(?:^|/)(raw/.*)$", 1), F.lit("")), path)
