"""Text cleaning: white space, excerpts, titles, tags, entities, bylines and reading time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.basics import bind, matches

# Elements dropped before extraction, prefixes of boilerplate, separators, entities.
DROPPED = ["script", "style", "noscript", "template", "svg", "iframe", "form"]
BOILERPLATE = r"(?i)^(share|tweet|follow|subscribe|sign up|log in|login|menu|search|comments?|related posts?|leave a (reply|comment)|advertisement|cookie)"
LEGAL = r"(?i)^(copyright|all rights reserved|privacy policy|terms of service)"
TITLE_SEPARATORS = [" | ", " – ", " — ", " - ", " :: ", " » "]
SEPARATORS = [" — ", " – ", " - ", " :: ", " | "]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]
MARKDOWN = [r"(?m)^#{1,6}\s", r"\*\*[^*\n]+\*\*", r"(?m)^[-*]\s+\S", r"```", r"\[[^\]]+\]\([^)]+\)"]
NOT_AUTHORS = r"(?i)^(?:posted on|published by|written by|admin|administrator|editor|staff|unknown|anonymous|\?)$"
SUBMITTER = r"(?i)^[^\s]+\.[a-z]{2,}\s+(?:via|by)\s+\S+$"
NEWS_DATE = r"(?i)\s+(?:·\s*)?(?:posted|published|updated|last updated)\b.*$"
CALENDAR_DATE = r"(?i)\s+(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},\s+\d{4}.*$"
WEEKDAY = r"(?i)\s+(?:mon|tue|wed|thu|fri|sat|sun)(?:day)?[,]?$"
HOSTNAME = r"(?i)^[a-z0-9-]+(?:\.[a-z0-9-]+)+(?:/.*)?$"


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def pre_trim(html: Column) -> Column:
    """Without comments and without the elements that never hold an article, closed or not."""
    out = F.regexp_replace(html, r"<!--[\s\S]*?-->", " ")
    out = F.regexp_replace(out, rf"(?i)<({'|'.join(DROPPED)})\b[^>]*>[\s\S]*?</\1\s*>", " ")
    return F.regexp_replace(out, r"(?i)<(script|style|noscript|iframe)\b[^>]*/?>", " ")


def without_tags(html: Column) -> Column:
    return compact(F.regexp_replace(html, "<[^>]*>", " "))


def decode_entities(text: Column, ampersand_first: bool = False) -> Column:
    """The five common entities; with ampersand_first an escaped entity is decoded twice."""
    pairs = [("&amp;", "&"), *ENTITIES] if ampersand_first else [*ENTITIES, ("&amp;", "&")]
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def page_title(html: Column) -> Column:
    return compact(decode_entities(F.regexp_extract(html, r"(?i)<title[^>]*>([\s\S]*?)</title>", 1)))


def excerpt(text: Column, limit: int = 220, least: int = 100) -> Column:
    """The head of a text: to its last sentence end after `least` characters, else to a word, with an ellipsis."""
    head = F.substring(text, 1, limit)
    ends = [F.instr(F.reverse(head), e) for e in (" .", " !")]
    stop = F.greatest(*(F.when(e > 0, F.length(head) - e).otherwise(0) for e in ends))
    cut = F.concat(F.regexp_replace(head, r"\s\S*$", ""), F.lit("…"))
    return F.when(F.length(text) <= limit, text).when(stop > least + 1, F.substring(head, F.lit(1), stop)).otherwise(cut)


def tidy_title(title: Column) -> Column:
    """Feed titles over 48 characters lose their tagline at the first separator that leaves 12 characters, else are cut."""
    trimmed = F.trim(title)
    out = F.when(F.length(trimmed) <= 48, trimmed)
    for s in SEPARATORS:
        at = F.instr(trimmed, s)
        head = F.trim(F.substring(trimmed, F.lit(1), at - 1))
        out = out.when((at > 12) & (F.length(head) >= 12), head)
    return out.otherwise(F.concat(F.regexp_replace(F.substring(trimmed, 1, 60), r"\s\S*$", ""), F.lit("…")))


def is_boilerplate(text: Column) -> Column:
    trimmed = F.trim(text)
    return (F.length(trimmed) <= 120) & (trimmed.rlike(BOILERPLATE) | trimmed.rlike(LEGAL))


def title_for_enriched(source_id: Column, known: Column, found: Column) -> Column:
    """A card's title after extraction: what a curator gave a direct link stays, else the page's own title wins if it has one."""
    return F.when(source_id.isNull() & (F.trim(known) != ""), F.trim(known)).otherwise(F.coalesce(F.when(F.trim(found) != "", F.trim(found)), F.trim(known)))


def needs_verified_date(source_id: Column, stored: Column, found: Column) -> Column:
    """Whether a direct link has no date of its own and none on its page, so that it must not pass for new."""
    return source_id.isNull() & stored.isNull() & found.isNull()


def format_date(ms: Column) -> Column:
    """A date as on cards, such as "January 5, 2024", in UTC; empty without one."""
    at = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=ms / 1000)
    return F.when(ms.isNull() | (ms == 0), "").otherwise(F.date_format(at, "MMMM d, yyyy"))


def looks_like_markdown(text: Column) -> Column:
    """Markdown marks and no block element of HTML."""
    marks = F.lit(False)
    for p in MARKDOWN:
        marks = marks | text.rlike(p)
    return ~text.rlike(r"(?i)<(p|div|h[1-6]|ul|ol|blockquote|pre)\b") & marks


def clean_title(title: Column, site: Column) -> Column:
    """A title without the tail, behind its last separator, that holds the site's name."""
    out = F.when(site == "", F.trim(title))
    for s in TITLE_SEPARATORS:
        tail = F.trim(F.substring_index(title, s, -1))
        fits = (F.instr(title, s) > 1) & (tail != "") & F.contains(F.lower(tail), F.lower(site))
        out = out.when(fits, F.trim(F.substring(title, F.lit(1), F.length(title) - F.length(F.substring_index(title, s, -1)) - len(s))))
    return out.otherwise(F.trim(title))


def read_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(words / 220.0 + 0.5)).cast("int")


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def clean_author(author: Column) -> Column:
    """A byline as a person's name, or the empty string for labels, hosts, teams and blogs."""

    def taken(pattern: str, least: int = 0):
        return lambda x: F.when(x.rlike(pattern) & (F.length(x) > least), F.regexp_extract(x, pattern, 1)).otherwise(x)

    def removed(pattern: str):
        return lambda x: F.regexp_replace(x, pattern, "")

    def without_mail(x: Column) -> Column:
        mail = r"(?i)^\S+@\S+\s+\(([^)]+)\)$"
        return F.when(x.rlike(mail), F.regexp_extract(x, mail, 1)).otherwise(F.regexp_replace(x, r"^\S+@\S+\s+", ""))

    def before_news(x: Column) -> Column:
        parts = F.split(x, r"\s+·\s+", -1)
        news = F.exists(F.slice(parts, F.lit(2), F.size(parts)), lambda p: matches(p, r"\b(?:news|posted|updated)\b", True))
        return compact(F.when((F.size(parts) > 1) & news, parts[0]).otherwise(x))

    def person(x: Column) -> Column:
        short = F.regexp_replace(x, r"(?i)\s+on$", "")
        nobody = x.rlike(SUBMITTER) | x.rlike(NOT_AUTHORS)
        for p in (r"(?i)\b(?:staff|team)$", r"(?i)(?:'s|s)?\s*blog$", r"(?i)\s+\(on\b.*\)$", HOSTNAME):
            nobody = nobody | short.rlike(p)
        return F.when(nobody, "").otherwise(short)

    steps = [
        removed(r"(?i)^by\s+"),
        removed(r"(?i)^\d{4}-\d{2}-\d{2}\s*[-—]\s*(?:by\s+)?"),
        taken(r"(?i)^featuring\b.*?\.\s*by\s+(.+?)(?:\s+on)?$"),
        taken(r"(?i)^published by\s+(.+?)\s+view all posts by\b.*$"),
        taken(r"(?i)^(.+?)\1\s+is\s+(?:an?\s+)?[^.]+\.?$"),
        taken(r"(?i)^.*?\s+by\s+([\p{L}][\p{L} .'-]+)$", 55),
        without_mail,
        removed(r"(?i)\s+commented(?:\s+on.*)?$"),
        removed(NEWS_DATE),
        removed(CALENDAR_DATE),
        removed(WEEKDAY),
        before_news,
        person,
    ]
    name = compact(author)
    for step in steps:
        name = bind(name, step)
    return name


def author_key(author: Column) -> Column:
    return F.lower(clean_author(author))


def attribution(author: Column, site: Column) -> Column:
    """struct<primary, secondary, has_author>: the byline before the publication's name."""
    def told(name: Column) -> Column:
        place = compact(site)
        same = (place != "") & (author_key(name) == author_key(place))
        known = F.struct(name.alias("primary"), F.when(same, "").otherwise(place).alias("secondary"), F.lit(True).alias("has_author"))
        return F.when(name == "", F.struct(place.alias("primary"), F.lit("").alias("secondary"), F.lit(False).alias("has_author"))).otherwise(known)

    return bind(clean_author(author), told)


def summary_words(html: Column) -> Column:
    """Words of a feed summary's head."""
    return F.regexp_count(F.regexp_replace(F.substring(html, 1, 100000), "<[^>]*>", " "), F.lit(r"\S+"))


def first_paragraph(html: Column) -> Column:
    """Up to 300 characters of a feed summary's text."""

    def cut(x: Column) -> Column:
        return F.when(F.length(x) <= 300, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, 297), r"\s\S*$", ""), F.lit("…")))

    head = F.regexp_replace(F.regexp_replace(F.substring(html, 1, 4000), "<[^>]*>", " "), "(?i)&[a-z#0-9]+;", " ")
    return bind(compact(head), cut)


def list_author(raw: Column) -> Column:
    """A byline of an aggregator's list: the name behind an address, nothing for a question mark."""
    mail = r"(?i)^[^\s]+@[^\s]+\s*\(([^)]+)\)$"
    return bind(compact(F.regexp_replace(raw, "<[^>]*>", " ")), lambda a: F.when((a == "") | (a == "?"), "").when(a.rlike(mail), F.trim(F.regexp_extract(a, mail, 1))).otherwise(a))


def site_name(origin: Column, host: Column, feed_title: Column, name: Column) -> Column:
    """What a feed entry's publication is called: an aggregator's entries go by their host."""
    by_host = (origin == "aggregator") & host.isNotNull()
    return F.when(by_host, F.regexp_replace(host, r"^www\.", "")).otherwise(F.coalesce(F.when(feed_title != "", feed_title), name))
