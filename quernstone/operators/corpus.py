"""From pages to passages, and the incremental upkeep of a corpus keyed by URL.

Null or blank texts give no chunks and no passages; null html has no title and drops out; rows with a null URL match
nothing; of repeated URLs the last wins where a function says so; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.config import ChunkParams, UrlRules
from quernstone.functions.batches import by_portions
from quernstone.functions.text import clean_text
from quernstone.functions.urls import is_relevant, normalize_url

# --- chunks ------------------------------------------------------------------------------------------------------


def pack_paragraphs(text: Column, params: ChunkParams = ChunkParams()) -> Column:
    """Array of chunks: paragraphs are joined while they fit; the next chunk begins with the tail of the one before.

    A paragraph is never split, so a chunk may be longer. Null or blank texts have none.
    """
    pieces = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), params.separator), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    join = F.lit(params.joiner)

    def add(state: Column, p: Column) -> Column:
        fits = F.length(state["open"]) + len(params.joiner) + F.length(p) <= params.pack_length
        tail = F.substring(state["open"], F.greatest(F.length(state["open"]) - params.pack_overlap + 1, F.lit(1)), F.lit(params.pack_overlap))
        return (
            F.when(state["open"] == "", F.struct(state["done"].alias("done"), p.alias("open")))
            .when(fits, F.struct(state["done"].alias("done"), F.concat(state["open"], join, p).alias("open")))
            .otherwise(F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), F.concat(tail, join, p).alias("open")))
        )

    return F.aggregate(pieces, start, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def split_parts(text: str | None, params: ChunkParams) -> list[str]:
    """Overlapping parts of a long text, cut at the last sentence end, line end or blank if there is one late enough."""
    text = text or ""
    if len(text) <= params.split_length:
        return [text]
    parts, at = [], 0
    while at < len(text):
        end = min(at + params.split_length, len(text))
        if end < len(text):
            cut = max(text.rfind(p, at, end + len(p)) for p in (". ", "\n", " "))
            if cut > at + params.cut_after:
                end = cut + 1
        parts.append(text[at:end].strip())
        if end >= len(text):
            break
        at = max(end - params.split_overlap, at + 1)
    return parts


def split_oversized(text: Column, params: ChunkParams = ChunkParams()) -> Column:
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: split_parts(t, params))

    return run(text)


def to_passages(pages: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """Passages of ``pages`` (page_ord, url, title, description, chunks, text); numbers count before blanks are dropped."""
    chunks = F.when(F.size(F.coalesce("chunks", F.array().cast("array<string>"))) > 0, F.col("chunks")).otherwise(F.array("text"))
    one = pages.select("page_ord", "url", "title", "description", F.posexplode(chunks).alias("nth", "chunk"))
    parts = one.select("*", F.posexplode(split_oversized(F.col("chunk"), params)).alias("part", "text"))
    index = F.row_number().over(Window.partitionBy("page_ord").orderBy("nth", "part")) - 1
    return parts.withColumn("chunk_index", index).where(F.trim("text") != "").drop("nth", "part", "chunk")


# --- pages -------------------------------------------------------------------------------------------------------

#: Elements that aren't read, elements that end a paragraph, class words that aren't read.
SKIPPED = frozenset("footer form header iframe nav noscript script style svg".split())
BLOCKS = frozenset("dd div dt h1 h2 h3 h4 li p section table tr".split())
SKIPPED_CLASSES = frozenset("breadcrumb social-share usa-skipnav".split())

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start tag of the first ends an open element of the second.
IMPLIED = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class _Page(HTMLParser):
    """One pass over the page: keeps for each open element whether it is read, and gathers text by possible root."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, str]] = []  # name, skipped here or above, root begun here
        self.text: dict[str, list[str]] = {}  # of the first main, article, #main-content, body
        self.live: list[str] = []
        self.seen: dict[str, str] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.seen.setdefault(a.get("property") or a.get("name", ""), a.get("content", ""))
        if tag in VOID:
            return
        if self.open and self.open[-1][0] in IMPLIED.get(tag, ()):
            self.finish(len(self.open) - 1)
        skipped = bool(self.open and self.open[-1][1]) or tag in SKIPPED or a.get("aria-hidden") == "true" or bool(SKIPPED_CLASSES & set(a.get("class", "").split()))
        root = "#" if a.get("id") == "main-content" else tag
        begins = (tag in ("main", "article", "body") or root == "#") and root not in self.text
        if begins:
            self.text[root] = []
            self.live.append(root)
        if tag in ("h1", "title") and tag not in self.seen:
            self.seen[tag] = ""
            self.live.append(tag)
            begins, root = True, tag
        self.open.append((tag, skipped, begins and root or ""))

    def finish(self, at: int) -> None:
        for tag, skipped, root in reversed(self.open[at:]):
            if tag in BLOCKS and not skipped:
                self.put("\n\n")
            if root:
                self.live.remove(root)
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            self.finish(at)

    def put(self, data: str) -> None:
        for root in self.live:
            if root in self.text:
                self.text[root].append(data)

    def handle_data(self, data: str) -> None:
        for name in ("h1", "title"):
            if name in self.live:
                self.seen[name] += data
        if not (self.open and self.open[-1][1]):
            self.put(data)


def read_page(html: str | None) -> tuple[str, str, str]:
    """Title, description and readable text of a page, not yet cleaned."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page.finish(0)
    text = next(("".join(page.text[r]) for r in ("main", "article", "#", "body") if r in page.text), "")
    s = page.seen
    return s.get("h1") or s.get("og:title") or s.get("title") or "", s.get("description") or s.get("og:description") or "", text


def extract_pages(pages: DataFrame, params: ChunkParams = ChunkParams(), keep: tuple[str, ...] = ()) -> DataFrame:
    """url, title, description, text, chunks of ``pages`` (url, html); pages without a title or of short text are dropped."""

    names = ("title", "description", "text")
    kind = pa.struct([(c, pa.string()) for c in names])

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from by_portions(lambda htmls: [dict(zip(names, read_page(h), strict=True)) for h in htmls], kind)(batches)

    p = pages.select(*keep, "url", F.arrow_udf(read, "title string, description string, text string")("html").alias("r"))
    p = p.select(*keep, "url", *[clean_text(F.col(f"r.{c}")).alias(c) for c in ("title", "description", "text")])
    return p.where((F.col("title") != "") & (F.length("text") >= params.min_text)).withColumn("chunks", pack_paragraphs(F.col("text"), params))


# --- upkeep ------------------------------------------------------------------------------------------------------


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of a key the one with the greatest ``order``. One aggregate, so repeated keys combine before the shuffle."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(whole, F.col(order)).alias("_r")).select("_r.*")


def pending(found: DataFrame, cached: DataFrame, refresh: bool = False) -> DataFrame:
    """Rows of ``found`` (url, last_modified) to be fetched: not in ``cached``, or changed since; null dates never refresh."""
    if refresh:
        return found
    old = cached.select("url", F.col("last_modified").alias("_old"), F.lit(True).alias("_known"))
    changed = F.col("last_modified").isNotNull() & ~F.col("last_modified").eqNullSafe(F.col("_old"))
    return found.join(old, "url", "left").where(F.col("_known").isNull() | changed).drop("_old", "_known")


def merge(cached: DataFrame, fetched: DataFrame, approved: DataFrame) -> DataFrame:
    """The corpus after a crawl: new records replace old ones, failures keep the old, URLs no longer approved go."""
    kept = cached.join(approved.select("url"), "url", "left_semi").join(fetched.select("url"), "url", "left_anti")
    return kept.unionByName(fetched.join(approved.select("url"), "url", "left_semi"))


def discover(entries: DataFrame, rules: UrlRules, disallowed: tuple[str, ...] = ()) -> DataFrame:
    """url, last_modified of sitemap ``entries`` (place, url, last_modified): the relevant ones in normal form; of a repeated URL the last by ``place``."""
    kept = entries.where(is_relevant(F.col("url"), rules, disallowed)).withColumn("url", normalize_url(F.col("url"), rules.origin))
    return last_wins(kept.select("place", "url", "last_modified"), "url", "place").select("url", "last_modified")


def fetch_errors(fetched: DataFrame) -> DataFrame:
    """``fetched`` (url, status, content_type, ...) with error: null, or why the page can't be read."""
    status = F.coalesce(F.col("status"), F.lit(0))
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    return fetched.withColumn("error", F.when(~status.between(200, 299), F.concat(F.lit("status "), status.cast("string"))).when(~kind.contains("text/html"), F.concat(F.lit("content type "), kind)))


def crawl(found: DataFrame, cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """The corpus (url, last_modified, html) after a run over ``found`` (url, last_modified): what is pending and was
    ``fetched`` (url, status, content_type, html) without error is new, the rest of what is approved stays as ``cached``.

    A run that broke off is resumed by running it again: what it has stored is no longer pending.
    """
    good = fetch_errors(fetched).where("error is null").select("url", "html")
    new = pending(found, cached).select("url", "last_modified").join(good, "url")
    return merge(cached.select("url", "last_modified", "html"), new, found)


def crawl_counts(outcomes: DataFrame) -> DataFrame:
    """completed, failed, total of ``outcomes`` (error: null if all went well)."""
    return outcomes.agg(F.count_if(F.col("error").isNull()).alias("completed"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count("*").alias("total"))
