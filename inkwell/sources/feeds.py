"""Syndication documents: RSS, Atom and RDF as tables of entries, and JSON story lists.

Parsing XML with namespaces needs a parser, so documents go through Arrow batches to Python's own; the rest, URLs,
titles and dates included, is done on the columns that come back.
"""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import hn, texts, urls
from inkwell.functions.arrow import pieces

_FIELDS = ["url", "title", "author", "published", "summary"]
_ISO_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""


def _first(e: ET.Element, *names: str) -> str:
    """Text of the first child with one of the names that has any, in the order of the names."""
    for wanted in names:
        for child in e:
            if _name(child) == wanted and (said := "".join(child.itertext()).strip()):
                return said
    return ""


def _link(e: ET.Element) -> str:
    return next((x.get("href", "") for x in e if _name(x) == "link" and x.get("rel", "alternate") in ("alternate", "") and x.get("href")), "")


def parse_date(raw: str) -> int | None:
    """Epoch milliseconds of an RFC 822 or ISO date, else of the first day named in it."""
    for read in (datetime.fromisoformat, parsedate_to_datetime):
        try:
            at = read(raw.strip().replace("Z", "+00:00") if read is datetime.fromisoformat else raw)
        except (ValueError, TypeError, IndexError):
            continue
        return round((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)
    day = _ISO_DAY.search(raw)
    try:
        return round(datetime.fromisoformat(day[0]).replace(tzinfo=UTC).timestamp() * 1000) if day else None
    except ValueError:
        return None


def parse_document(raw: str | None, most: int | None = None) -> tuple[str, str, list[dict]] | None:
    """(title, site, entries) of a feed; None for what is none. RDF without entries is none.

    most: characters of a document that are read, 1.5 million in the product's own crawler; None: all.
    """
    try:
        root = ET.fromstring((raw or "")[:most].strip())
    except (ET.ParseError, ValueError):
        return None
    kind = _name(root)
    channel = next((x for x in root if _name(x) == "channel"), None)
    if kind == "feed":
        head, items = root, [x for x in root if _name(x) == "entry"]
        site = _link(root)
    elif kind in ("rss", "rdf"):
        if kind == "rss" and channel is None:
            return None
        head = channel if channel is not None else ET.Element("none")
        items = [x for x in (channel if kind == "rss" else root) if _name(x) == "item"]
        site = _first(head, "link") if kind == "rss" else ""
        if kind == "rdf" and not items:
            return None
    else:
        return None
    entries = []
    for x in items:
        if kind == "feed":
            author = next((_first(a, "name") for a in x if _name(a) == "author"), "")
            dates = [_first(x, "published"), _first(x, "updated"), _first(root, "updated")]
            entry = {"url": _link(x) or _first(x, "id"), "author": author, "summary": _first(x, "content", "summary")}
        else:
            dates = [_first(x, "pubdate") if kind == "rss" else "", _first(x, "date")]
            entry = {"url": _first(x, "link", "guid") if kind == "rss" else _first(x, "link"), "author": _first(x, "creator", "author") if kind == "rss" else _first(x, "creator"), "summary": _first(x, "encoded", "description")}
        entry["title"] = _first(x, "title")
        entry["published"] = next((at for d in dates if d and (at := parse_date(d)) is not None), None)
        entries.append(entry)
    return _first(head, "title"), site, entries


# The aggregator whose index is HTML, and the patterns of its items.
LIST_INDEX = re.compile(r"^https?://(?:www\.)?econacademics\.org/(?:en\.html)?(?:[?#].*)?$", re.I)
LIST_TITLE, LIST_SITE, LIST_MOST = "EconAcademics", "https://www.econacademics.org/", 60
_ITEM = re.compile(r"<li\b[^>]*>|</ul>", re.I)
_LINKED = re.compile(r"<b>\s*<a\b[^>]*href=[\"']([^\"']+)[\"'][^>]*>([\s\S]*?)</a>\s*</b>", re.I)
_BYLINE = re.compile(r"<br\s*/?>(?:\s|&nbsp;)*by\s+([\s\S]*?)\s+in\s+<i>", re.I)
_DATED = re.compile(r"</i>\s*,\s*([^<\r\n]+?)\s*(?=<|$)", re.I)
_QUOTED = re.compile(r"<blockquote\b[^>]*>([\s\S]*?)</blockquote>", re.I)


def parse_list(raw: str | None, url: str | None) -> tuple[str, str, list[dict]] | None:
    """(title, site, entries) of the aggregator's HTML index; None for any other address and for an index without items."""
    if not raw or not LIST_INDEX.match(url or ""):
        return None
    marks = list(_ITEM.finditer(raw))
    entries = []
    for a, b in zip(marks, marks[1:], strict=False):  # an item ends where the next or the list's end begins
        item = raw[a.end() : b.start()]
        if a[0].startswith("</") or not (link := _LINKED.search(item)):
            continue
        try:
            where = urljoin(url, html.unescape(link[1]))
        except ValueError:
            continue
        if LIST_INDEX.match(where):
            continue
        byline, date, said = _BYLINE.search(item), _DATED.search(item), _QUOTED.search(item)
        at = parse_date(html.unescape(date[1])) if date else None
        entries.append({"url": where, "title": html.unescape(link[2]), "author": html.unescape(byline[1]) if byline else "", "published": at, "summary": said[1].strip() if said else ""})
    return (LIST_TITLE, LIST_SITE, entries) if entries else None


def strip_html(text: Column) -> Column:
    return texts.compact(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), "(?i)&[a-z#0-9]+;", " "))


def entries(documents: DataFrame, id_col: str = "feed_id", xml_col: str = "xml", most: int | None = None, url_col: str | None = None) -> DataFrame:
    """(feed_id, feed_title, site_url, position, url, title, author, published, summary) of every entry with an http URL.

    Documents that are no feed give no rows; whole documents are read unless most says otherwise. Titles lose their tags, missing ones become "(untitled)"; URLs lose
    fragments and tracking parameters. With url_col, the documents' addresses, the known aggregator's HTML index counts as
    a feed: its entries once each, LIST_MOST at most, with the names behind mail addresses as bylines.
    """
    item = pa.struct([(f, pa.int64() if f == "published" else pa.string()) for f in _FIELDS])
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [parse_document(x.as_py(), most) for x in batch.column(1)]
            lists = [not f for f in found]
            if url_col:
                found = [f or parse_list(x.as_py(), u.as_py()) for f, x, u in zip(found, batch.column(1), batch.column(2), strict=True)]
            columns = [pa.array(lists, pa.bool_()), pa.array([f and f[0] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.string()), pa.array([f and f[2] for f in found], pa.list_(item))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["feed_id", "listed", "feed_title", "site_url", "entries"])

    rows = documents.select(F.col(id_col), F.col(xml_col), *([F.col(url_col)] if url_col else [])).mapInArrow(run, f"feed_id {kind}, listed boolean, feed_title string, site_url string, entries array<struct<url string, title string, author string, published bigint, summary string>>")
    each = rows.select("feed_id", "listed", "feed_title", "site_url", F.posexplode("entries").alias("position", "e"))
    url, title = urls.entry_url(F.col("e.url")), strip_html(F.col("e.title"))
    out = each.select("feed_id", texts.tidy_title(strip_html(F.col("feed_title"))).alias("feed_title"), "site_url", "position", url.alias("url"), F.when(title == "", "(untitled)").otherwise(title).alias("title"), F.when(F.col("listed"), texts.list_author(F.col("e.author"))).otherwise(strip_html(F.col("e.author"))).alias("author"), F.col("e.published").alias("published"), F.col("e.summary").alias("summary"), "listed")
    out = out.where("url <> ''")
    if url_col:
        again, place = Window.partitionBy("feed_id", "listed", "url").orderBy("position"), Window.partitionBy("feed_id", "listed").orderBy("position")
        out = out.withColumn("_again", F.row_number().over(again)).where("not listed or _again = 1").withColumn("_place", F.row_number().over(place)).where(~F.col("listed") | (F.col("_place") <= LIST_MOST)).drop("_again", "_place")
    return out.drop("listed")


def is_feed(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 3000))
    return head.contains("<rss") | head.contains("<feed") | head.contains("<rdf:rdf") | head.contains("<?xml")


_HITS = "hits array<struct<url string, title string, created_at_i double, created_at string, points double, num_comments double, _tags array<string>>>"


def stories(documents: DataFrame, json_col: str = "json", order: str = "batch") -> DataFrame:
    """(position, url, title, published_at, points, comments, is_front_page) of JSON story lists, the first of each URL."""
    hits = documents.select(order, F.posexplode(F.from_json(json_col, _HITS)["hits"]).alias("i", "h"))
    name = urls.host(F.col("h.url"))
    valid = hits.where(F.col("h.url").rlike("(?i)^https?://") & (F.trim("h.title") != "") & name.isNotNull() & ~hn.is_list_host(name))

    def whole(x: Column) -> Column:
        return F.greatest(F.lit(0), F.coalesce(x, F.lit(0.0))).cast("long")

    seconds = F.when(F.col("h.created_at_i") > 0, F.floor(F.col("h.created_at_i") * 1000))
    rows = valid.select(order, "i", F.substring_index("h.url", "#", 1).alias("url"), F.trim("h.title").alias("title"), F.coalesce(seconds, F.unix_millis(F.try_to_timestamp("h.created_at"))).alias("published_at"), whole(F.col("h.points")).alias("points"), whole(F.col("h.num_comments")).alias("comments"), F.coalesce(F.array_contains("h._tags", "front_page"), F.lit(False)).alias("is_front_page"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy(order, "i"))).where("_n = 1").drop("_n")
    return first.withColumn("position", F.col(order).cast("long") * 1_000_000 + F.col("i")).drop(order, "i")


def alternate_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, position, href) of a page's links to feeds of its own, as they stand in the page, each once."""
    links = pages.select(id_col, F.posexplode(F.regexp_extract_all(html_col, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))).alias("position", "tag"))
    kind = F.col("tag").rlike(r"(?i)\btype=[\"']application/(rss|atom)\+xml") | F.col("tag").rlike(r"(?i)\btype=[\"']text/xml")
    found = links.where(F.col("tag").rlike(r"(?i)\brel=[\"']?alternate") & kind)
    href = texts.decode_entities(F.regexp_extract("tag", r"(?i)\bhref=[\"']([^\"']+)[\"']", 1), ampersand_first=True)
    return found.select(id_col, "position", href.alias("href")).where("href <> ''").groupBy(id_col, "href").agg(F.min("position").alias("position"))


# Hosts of the forum whose links lead elsewhere.
FORUM_HOSTS, FORUM_ENDS = ["reddit.com", "redd.it"], ["redditmedia.com", "redditstatic.com"]


def is_forum(host: Column) -> Column:
    name = urls.without_www(F.lower(host))
    out = name.isin(FORUM_HOSTS)
    for h in FORUM_HOSTS:
        out = out | name.endswith(f".{h}")
    for h in FORUM_ENDS:
        out = out | name.endswith(h)
    return out


def forum_stories(entries_: DataFrame, limit: int = 24) -> DataFrame:
    """(feed_id, slot, url, domain, title): of each entry the first article link to a domain no entry before took.

    entries_: (feed_id, position, title, summary). Links are found and judged in columns; the choice, which depends on
    those before it, walks a feed's entries, and a feed is one document.
    """
    import pandas as pd

    links = entries_.where(F.trim("title") != "").select("feed_id", "position", F.trim("title").alias("title"), F.posexplode(F.regexp_extract_all("summary", F.lit(r"(?i)href=[\"']([^\"']+)[\"']"), F.lit(1))).alias("n", "href"))
    links = links.withColumn("url", F.substring_index(F.replace("href", F.lit("&amp;"), F.lit("&")), "#", 1))
    host = urls.host(F.col("url"))
    fit = links.where(urls.is_article_path(F.col("url")) & ~is_forum(host)).withColumn("domain", urls.root_domain(host)).select("feed_id", "position", "n", "title", "url", "domain")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        out = []
        for _, entry in rows.sort_values(["position", "n"]).groupby("position", sort=True):
            pick = next((r for r in entry.itertuples() if r.domain not in seen), None)
            if pick is not None and len(out) < limit:
                seen.add(pick.domain)
                out.append((pick.feed_id, len(out) + 1, pick.url, pick.domain, pick.title))
        return pd.DataFrame(out, columns=["feed_id", "slot", "url", "domain", "title"])

    return fit.groupBy("feed_id").applyInPandas(choose, "feed_id long, slot long, url string, domain string, title string")
