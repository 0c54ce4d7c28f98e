"""Pages as articles: a small element tree, allow-list cleaning, metadata, text density and math placeholders.

Python's own HTML tokenizer feeds the tree, one page at a time in Arrow batches. Where the product leans on a reader
library whose rules aren't part of it, this uses the product's own density heuristic for every page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import texts, urls
from inkwell.functions.arrow import pieces
from inkwell.functions.basics import matches
from inkwell.sources.feeds import parse_date

# Elements, patterns, bounds.
ALLOWED = frozenset("p br hr h1 h2 h3 h4 h5 h6 ul ol li blockquote pre code em i strong b u s del mark kbd sup sub a img figure figcaption table thead tbody tr th td caption nc-math".split())
DROPPED = frozenset("script style iframe object embed form input button select textarea nav aside footer noscript svg canvas video audio dialog template link meta".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY = {"p": frozenset("p div ul ol table blockquote pre h1 h2 h3 h4 h5 h6 section article aside footer header figure form hr li nav main".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}
MATHJAX = re.compile(r"<script\s+type=[\"']math/tex(;\s*mode=display)?[\"'][^>]*>([\s\S]*?)</script\s*>", re.I)
LATEX_IMAGE = re.compile(r"<img\b[^>]*\bsrc\s*=\s*([\"'])((?:https?:)?//(?:[a-z0-9-]+\.)*(?:wp|wordpress)\.com/latex\.php\?.*?)\1[^>]*/?>", re.I)
#: An ampersand, with the name and semicolon behind it, that starts no number with a semicolon.
REFERENCE = re.compile(r"&(?!#(?:[0-9]+|[xX][0-9a-fA-F]+);)([A-Za-z][A-Za-z0-9]*;)?")
LATEX = re.compile(r"\\[a-zA-Z]+|[_^{}]|\d\s*[a-zA-Z]\s*\d|\\$")
MATH = re.compile(r"\$\$([\s\S]+?)\$\$|\\\[([\s\S]+?)\\\]|\\\(([\s\S]+?)\\\)")
BOILERPLATE = [re.compile(p) for p in (texts.BOILERPLATE, texts.LEGAL)]
LANGUAGE = re.compile(r"(?:^|\s)(?:lang|language)[-_]([\w+#-]+)", re.I)
MIN_WORDS = 80
LEAST_BLOCK, MOST_LINKS = 40, 0.55
#: (language, pattern, weight, any case) of code; the first with the most points from 2 on wins.
CODE = [
    ("rust", r"\b(fn\s+\w+|impl\s+\w|let\s+mut|vec!)", 2, False), ("rust", r"\b(unsafe|trait|crate)::?", 1, False), ("python", r"(?m)^\s*def\s+\w+\(", 2, False), ("python", r"(?m)^\s*from\s+\S+\s+import\s", 1, False),
    ("go", r"\bfunc\s+(\(\w+\s+\*?\w+\)\s+)?\w+\(", 2, False), ("go", r":=", 1, False), ("javascript", r"\bconsole\.log\b", 2, False), ("javascript", r"\b(const|let)\s+\w+\s*=", 1, False), ("javascript", r"=>", 1, False),
    ("c", r"#include\s*[<\"]", 2, False), ("sql", r"\b(SELECT|INSERT INTO|CREATE TABLE)\b", 2, True), ("bash", r"(?m)^\$\s", 2, False),
]
SEGMENT_TAGS = frozenset("p blockquote h1 h2 h3 h4 ul ol figure table".split())


@dataclass(frozen=True)
class Limits:
    """Characters of a page that are read, of content and text that are kept, and parts of an article; None: all.

    PRODUCT has the bounds of the product's own crawler and reader, which runs on telephones.
    """

    page: int | None = None
    content: int | None = None
    text: int | None = None
    segments: int | None = None


WHOLE, PRODUCT = Limits(), Limits(600_000, 300_000, 60_000, 250)


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        said, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                said.append(x)
            else:
                todo.extend(reversed(x.children))
        return "".join(said)

    def inner(self) -> str:
        out, todo = [], list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(html.escape(x, quote=False))
            elif isinstance(x, _End):
                out.append(f"</{x.tag}>")
            else:
                out.append("<" + x.tag + "".join(f' {k}="{html.escape(v)}"' for k, v in x.attributes.items()) + ">")
                if x.tag not in VOID:
                    todo.append(_End(x.tag))
                    todo.extend(reversed(x.children))
        return "".join(out)

    def outer(self) -> str:
        return Node("#", children=[self]).inner()


@dataclass
class _End:
    """An element's end on a stack of what is still to be written."""

    tag: str


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        top = self.open[-1].tag
        while tag in CLOSED_BY.get(top, ()):
            self.open.pop()
            top = self.open[-1].tag
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(page: str, loose: bool = True) -> Node:
    """A page's tree. Browsers also read references that lack their semicolon; without `loose` these stay as written."""
    builder = _Builder()
    builder.feed(page if loose else REFERENCE.sub(lambda m: m[0] if m[1] in html5 else "&amp;" + (m[1] or ""), page))
    builder.close()
    return builder.root


def safe_url(raw: str, base: str) -> str:
    try:
        found = urljoin(base, raw.strip())
        return found if raw and urlsplit(found).scheme in ("http", "https") else ""
    except ValueError:
        return ""


def _cleaned(c: Node, base: str) -> dict[str, str] | None:
    """An allowed element's attributes; None if it has a source that can't stay."""
    clean: dict[str, str] = {}
    hint = LANGUAGE.search(c.attributes.get("class", "")) if c.tag in ("pre", "code") else None
    if hint:
        clean["data-nc-lang"] = hint[1].lower()
    for k, v in c.attributes.items():
        own = (c.tag, k) in (("nc-math", "data-nc-display"), ("pre", "data-nc-lang"), ("code", "data-nc-lang"))
        if not own and (k.startswith(("on", "data-", "aria-")) or k in ("style", "class", "id", "srcset", "sizes", "loading")):
            continue
        if k in ("src", "href") and (c.tag == "a" or k == "src"):
            v = safe_url(v, base)
            if not v:
                continue
        clean[k] = v
    return None if "src" in c.attributes and not clean.get("src") else clean


def sanitize(node: Node, base: str) -> None:
    """Keep the allowed elements, put others' children in their place, drop what never holds text; clean attributes."""
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        kept: list = []
        inner = list(reversed(x.children))
        while inner:
            c = inner.pop()
            if isinstance(c, str):
                kept.append(c)
            elif c.tag in DROPPED:
                continue
            elif c.tag not in ALLOWED and c.tag not in ("html", "body", "head"):
                inner.extend(reversed(c.children))
            elif (clean := _cleaned(c, base)) is not None:
                c.attributes = clean
                kept.append(c)
                todo.append(c)
        x.children = kept
    # From the leaves up: paragraphs and items without text or image go.
    full: set[int] = set()
    for x in reversed(order):
        x.children = [c for c in x.children if isinstance(c, str) or c.tag not in ("p", "li") or id(c) in full]
        if x.tag == "img" or any(c.strip() if isinstance(c, str) else id(c) in full for c in x.children):
            full.add(id(x))


def sanitized_fragment(content: str | None, base: str) -> str:
    """A fragment of HTML, such as a feed's summary, with the allowed elements only."""
    root = parse(content or "")
    sanitize(root, base)
    return root.inner()


def space(text: str) -> str:
    return re.sub(r"[ \t\r\n]+", " ", text).strip()


def math_placeholders(page: str) -> str:
    """Formulas in scripts and in images that carry their source as elements of their own."""
    page = MATHJAX.sub(lambda m: f'<nc-math data-nc-display="{int(bool(m[1]))}">{m[2]}</nc-math>', page)

    def image(m: re.Match) -> str:
        pairs = (p.partition("=") for p in html.unescape(m[2]).partition("?")[2].split("&"))
        tex = next((v for k, eq, v in pairs if k == "latex" and eq), None)
        return f'<nc-math data-nc-display="0">{html.escape(unquote(tex.replace("+", " ")), quote=False)}</nc-math>' if tex else m[0]

    return LATEX_IMAGE.sub(image, page)


def math_segments(text: str) -> list[tuple[str, str]]:
    """("text" | "inline" | "display", value) parts of a text; single dollars only around what looks like TeX."""
    out: list[tuple[str, str]] = []
    at = plain = 0

    def add(kind: str, value: str, a: int, b: int) -> None:
        nonlocal at, plain
        if a > plain:
            out.append(("text", text[plain:a]))
        out.append((kind, value))
        at = plain = b

    while at < len(text):
        nxt = min((i for i in (text.find("$", at), text.find("\\", at)) if i >= 0), default=-1)
        if nxt < 0:
            break
        m = MATH.match(text, nxt)
        if m:
            add("inline" if m[3] is not None else "display", next(g for g in m.groups() if g is not None), nxt, m.end())
            continue
        close = text.find("$", nxt + 1) if text[nxt] == "$" and text[nxt + 1 : nxt + 2].strip() else -1
        if close > nxt + 1 and LATEX.search(text[nxt + 1 : close]):
            add("inline", text[nxt + 1 : close], nxt, close + 1)
        else:
            at = nxt + 1
    if plain < len(text):
        out.append(("text", text[plain:]))
    return out


def metadata(root: Node, url: str) -> dict:
    found: dict[tuple[str, str], str] = {}
    for x in root.walk():
        if x.tag == "meta" and x.attributes.get("content", "").strip():
            for k in ("property", "name", "itemprop"):
                if x.attributes.get(k):
                    found.setdefault((k, x.attributes[k]), x.attributes["content"].strip())

    def first(*keys: tuple[str, str]) -> str:
        return next((found[k] for k in keys if k in found), "")

    title = first(("property", "og:title"), ("name", "twitter:title")) or next((x.text().strip() for x in root.walk() if x.tag == "title"), "")
    author = first(("name", "author"), ("property", "article:author"), ("name", "twitter:creator"))
    date = first(("property", "article:published_time"), ("name", "date"), ("itemprop", "datePublished"))
    at = parse_date(date) if date else None
    if at is None:
        stamp = next((x.attributes["datetime"] for x in root.walk() if x.tag == "time" and "datetime" in x.attributes), "")
        at = parse_date(stamp) if stamp else None
    host = (urlsplit(url).hostname or "").removeprefix("www.") if url else ""
    return {"title": title, "author": "" if author.startswith(("@", "http://", "https://")) else author, "site": first(("property", "og:site_name")) or host, "published": at, "image": safe_url(first(("property", "og:image"), ("name", "twitter:image")), url)}


def densest(root: Node) -> tuple[str, str] | None:
    """(html, text) of the innermost element that holds all the long, link-poor blocks; None without any."""
    # In page order: text pieces and elements; an element's subtree is a range of both.
    nodes, parent, depth, said, first_text, last_text, last_node = [root], [0], [0], [], [0], [0], [0]
    todo: list = [(0, iter(root.children))]
    while todo:
        at, children = todo[-1]
        c = next(children, None)
        if c is None:
            last_text[at], last_node[at] = len(said), len(nodes)
            todo.pop()
        elif isinstance(c, str):
            said.append(c)
        else:
            nodes.append(c)
            parent.append(at)
            depth.append(depth[at] + 1)
            first_text.append(len(said))
            last_text.append(0)
            last_node.append(0)
            todo.append((len(nodes) - 1, iter(c.children)))
    ends = [0]
    for x in said:
        ends.append(ends[-1] + len(x))
    linked = [0]
    for i, x in enumerate(nodes):
        linked.append(linked[-1] + (ends[last_text[i]] - ends[first_text[i]] if x.tag == "a" else 0))
    found: list[tuple[int, str]] = []
    for i, c in enumerate(nodes):
        if c.tag in ("p", "pre", "blockquote", "nc-math"):
            text = "".join(said[first_text[i] : last_text[i]])
            text = re.sub(r"[ \t]+\n", "\n", text).strip() if c.tag == "pre" else space(text)
            links = linked[last_node[i]] - linked[i]
            if len(text) >= LEAST_BLOCK and links < MOST_LINKS * len(text) and not (len(text.strip()) <= 120 and any(p.match(text.strip()) for p in BOILERPLATE)):
                found.append((i, text))
    if not found:
        return None
    # All blocks lie between the first and the last, so what holds these two holds all.
    a, b = parent[found[0][0]], parent[found[-1][0]]
    while a != b:
        if depth[a] >= depth[b]:
            a = parent[a]
        else:
            b = parent[b]
    parts = [nodes[i].outer() if nodes[i].tag == "nc-math" else f"<pre>{html.escape(text, quote=False)}</pre>" if nodes[i].tag == "pre" else f"<{nodes[i].tag}>{nodes[i].inner()}</{nodes[i].tag}>" for i, text in found]
    heading = next((x.outer() for x in nodes[a : last_node[a]] if x.tag in ("h1", "h2")), "")
    return heading + "\n".join(parts), space("".join(said[first_text[a] : last_text[a]]))


def extract(page: str | None, url: str | None, limits: Limits = WHOLE, loose: bool = True) -> dict | None:
    """What is an article of a page: None under 80 words. Its title is as the page gives it; loose as in parse()."""
    try:
        root = parse(math_placeholders((page or "")[: limits.page]), loose)
        meta = metadata(root, url or "")
        sanitize(root, url or "")
        found = densest(root)
    except ValueError:
        return None
    if not found:
        return None
    content, text = found
    words = len(text.split())
    if words < MIN_WORDS:
        return None
    return {"title": space(meta["title"]), "author": space(meta["author"]), "site_name": space(meta["site"]), "published_date": meta["published"], "content_html": content[: limits.content], "text_content": text[: limits.text], "lead_image_url": meta["image"], "word_count": words}


_SCHEMA = [("title", pa.string()), ("author", pa.string()), ("site_name", pa.string()), ("published_date", pa.int64()), ("content_html", pa.string()), ("text_content", pa.string()), ("lead_image_url", pa.string()), ("word_count", pa.int64())]


def articles(pages: DataFrame, limits: Limits = WHOLE, loose: bool = True) -> DataFrame:
    """page_id, url and the article of every page that has one: a title and 80 words; page_id, url, html in; loose as in parse()."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [extract(h.as_py(), u.as_py(), limits, loose) for h, u in zip(batch.column(2), batch.column(1), strict=True)]
            rows = pa.array([i for i, x in enumerate(found) if x], pa.int64())
            made = [x for x in found if x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array([x[k] for x in made], t) for k, t in _SCHEMA)], ["page_id", "url", *(k for k, _ in _SCHEMA)])

    ddl = ", ".join(f"{k} {'long' if t == pa.int64() else 'string'}" for k, t in _SCHEMA)
    rows = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, {ddl}")
    rows = rows.withColumn("title", texts.clean_title(F.col("title"), F.col("site_name"))).where("title <> ''")
    return rows.withColumn("excerpt", texts.excerpt(F.col("text_content")))


_META = "title string, author string, site_name string, published_date long, lead_image_url string"


def page_metadata(pages: DataFrame, loose: bool = True) -> DataFrame:
    """page_id, title, author, site_name, published_date, lead_image_url as every page's head gives them; loose as in parse()."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [metadata(parse(h.as_py() or "", loose), u.as_py() or "") for h, u in zip(batch.column(2), batch.column(1), strict=True)]
            made = [pa.array([space(x[k]) for x in found], pa.string()) for k in ("title", "author", "site")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, pa.array([x["published"] for x in found], pa.int64()), pa.array([x["image"] for x in found], pa.string())], ["page_id", "title", "author", "site_name", "published_date", "lead_image_url"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, {_META}")


def html_column(rows: DataFrame, column: str, change: Callable[[str | None, str], str], base: str | None = None) -> DataFrame:
    """rows with a column of HTML put through change(html, base URL), in Arrow batches; base names the column of URLs."""
    at, where = rows.columns.index(column), rows.columns.index(base) if base else -1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            urls_ = batch.column(where).to_pylist() if base else [""] * batch.num_rows
            made = pa.array([change(x.as_py(), u or "") for x, u in zip(batch.column(at), urls_, strict=True)], pa.string())
            yield batch.set_column(at, batch.schema.names[at], made)

    return rows.mapInArrow(run, rows.schema)


def math_rendered(content: str | None, base: str = "") -> str:
    """HTML whose formulas in text, outside code, are nc-math elements with their TeX; layout is left to the reader."""
    root = parse(content or "")
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        x, in_code = todo.pop()
        joined: list = []
        for c in x.children:  # neighbouring texts are one, or an entity would part a delimiter
            if isinstance(c, str) and joined and isinstance(joined[-1], str):
                joined[-1] += c
            else:
                joined.append(c)
        out: list = []
        for c in joined:
            if isinstance(c, Node):
                todo.append((c, in_code or c.tag in ("code", "pre", "nc-math")))
                out.append(c)
            elif in_code or not any(mark in c for mark in ("$", "\\(", "\\[")):
                out.append(c)
            else:
                out += [value if kind == "text" else Node("nc-math", {"data-nc-display": str(int(kind == "display"))}, [value]) for kind, value in math_segments(c)]
        x.children = out
    return root.inner()


_INLINE = [(re.compile(p), to) for p, to in ((r"`([^`\n]+)`", r"<code>\1</code>"), (r"!\[([^\]]*)\]\(([^)\s]+)\)", r'<img src="\2" alt="\1">'), (r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>'), (r"\*\*([^*\n]+)\*\*", r"<strong>\1</strong>"), (r"(?<![*\w])[*_]([^*_\n]+)[*_](?![*\w])", r"<em>\1</em>"))]


def markdown_html(text: str | None, base: str = "") -> str:
    """The common part of Markdown as HTML: headings, lists, quotes, fenced code, rules, emphasis, links, images, code."""

    def inline(x: str) -> str:
        x = html.escape(x, quote=False)
        for pattern, to in _INLINE:
            x = pattern.sub(to, x)
        return x

    out: list[str] = []
    held: list[str] = []
    kind = ""

    def close() -> None:
        nonlocal kind
        if held:
            body = "\n".join(held)
            out.append({"ul": "<ul>\n{}\n</ul>", "ol": "<ol>\n{}\n</ol>", "quote": "<blockquote>\n<p>{}</p>\n</blockquote>", "code": "<pre><code>{}\n</code></pre>", "p": "<p>{}</p>"}[kind].format(body))
        held.clear()
        kind = ""

    fenced = False
    for line in (text or "").splitlines():
        if line.lstrip().startswith("```"):
            close()
            fenced = not fenced
            continue
        if fenced:
            kind = "code"
            held.append(html.escape(line, quote=False))
            continue
        for name, pattern, form in (("h", r"(#{1,6})\s+(.*?)\s*#*$", ""), ("hr", r"(?:-\s*){3,}$|(?:\*\s*){3,}$", ""), ("ul", r"[-*+]\s+(.*)$", "<li>{}</li>"), ("ol", r"\d+[.)]\s+(.*)$", "<li>{}</li>"), ("quote", r">\s?(.*)$", "{}"), ("p", r"(\S.*)$", "{}")):
            m = re.match(pattern, line.strip())
            if not m:
                continue
            if name in ("h", "hr") or name != kind:
                close()
            if name == "h":
                out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
            elif name == "hr":
                out.append("<hr>")
            else:
                kind = name
                held.append(form.format(inline(m[1])))
            break
        else:
            close()
    close()
    return "\n".join(out)


def segments(content: str | None, limits: Limits = WHOLE) -> list[dict]:
    """A reader's parts of an article: blocks of HTML, and code with its language."""
    out: list[dict] = []
    for x in parse(content or "").children:
        if len(out) == limits.segments:
            break
        if not isinstance(x, Node):
            continue
        if x.tag == "pre":
            out.append({"index": len(out), "html": "", "code": x.text(), "lang": x.attributes.get("data-nc-lang")})
        elif x.tag in SEGMENT_TAGS:
            out.append({"index": len(out), "html": x.outer(), "code": None, "lang": None})
    return out


def reader_segments(rows: DataFrame, id_col: str = "id", html_col: str = "content_html", limits: Limits = WHOLE) -> DataFrame:
    """(id, index, html, code, lang) of the parts of every article, as a reader shows them."""
    part = pa.struct([("index", pa.int64()), ("html", pa.string()), ("code", pa.string()), ("lang", pa.string())])
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([segments(x.as_py(), limits) for x in batch.column(1)], pa.list_(part))], ["id", "parts"])

    found = rows.select(id_col, html_col).mapInArrow(run, f"id {kind}, parts array<struct<`index`:bigint,html:string,code:string,lang:string>>")
    return found.select("id", F.inline("parts"))


def code_lines(code: Column) -> Column:
    """The lines of a piece of code, in order; colouring is left to the reader."""
    return F.split(code, "\n", -1)


def outbound_links(pages: DataFrame, allow_root_paths: bool = False, topic_hint: str = "technology", most: int = 40) -> DataFrame:
    """(page_id, position, url, topic_hint): links of pages to articles elsewhere, each address once, `most` of a page.

    pages: (page_id, url, html). Links are resolved against the page's address; queries and fragments go. With
    allow_root_paths sites' front pages count too. The bound on a page's links is the product's; it is a ranking within
    the page.
    """
    links = pages.select("page_id", F.col("url").alias("_base"), F.posexplode(F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*href=["']([^"']+)["'][^>]*>"""), F.lit(1))).alias("_i", "_href"))
    base, href = F.col("_base"), F.col("_href")
    scheme = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    # Other forms, such as paths, lead to the page's own host.
    whole = F.when(href.rlike(r"(?i)^https?://"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
    there, own = urls.host(whole), urls.host(base)
    bare = F.concat(F.lower(F.regexp_extract(whole, r"^([A-Za-z]+)://", 1)), F.lit("://"), there, urls.path(whole))
    found = links.where(whole.isNotNull() & own.isNotNull() & (there != own)).select("page_id", "_i", bare.alias("url"))
    fits = urls.is_article_path(F.col("url"))
    if allow_root_paths:
        fits = fits | urls.path(F.col("url")).isin("/", "")
    found = found.where(fits & urls.classify(F.col("url"))["allowed"]).groupBy("page_id", "url").agg(F.min("_i").alias("_i"))
    ranked = found.withColumn("position", F.row_number().over(Window.partitionBy("page_id").orderBy("_i"))).where(F.col("position") <= most)
    return ranked.select("page_id", F.col("position").cast("long").alias("position"), "url", F.lit(topic_hint).alias("topic_hint"))


def code_language(code: Column) -> Column:
    """The likely language of a piece of code, or the empty string."""
    points: dict[str, Column] = {}
    for name, pattern, weight, any_case in CODE:
        here = F.when(matches(code, pattern, any_case), weight).otherwise(0)
        points[name] = points[name] + here if name in points else here
    best = F.greatest(*points.values())
    out = F.when(best < 2, "")
    for name, p in points.items():
        out = out.when(p == best, name)
    return out
