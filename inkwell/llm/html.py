"""HTML extraction by tag-path ratios.

A page is read once, in time linear in its length: a stack of open elements gives each block of text its root-to-leaf path
of tags (with classes), numbered by (path of the parent, tag). Sums over subtrees take one pass over the elements.

What is set aside first: elements that never hold text to read (scripts, styles, controls, hidden ones), navigation,
asides, footers and page headers by tag or role, and what a heading such as "3 comments" or "Advertisement" opens. A word
of class or id is a prior only: it sets an element aside unless that holds the page's heading, its main element or, where
no article has the heading, most of its text; a word behind "with", "has" or the like says nothing. Elements named comments
stay only with the heading or main element in them.

For each path of the rest the text outside links and the punctuation per node are summed up, smoothed over neighbouring
paths in page order, fused with the path's own ratios, and thresholded. Blocks of paths above the threshold are prose and
decide where the article is: the article or main element with most prose, if that is most of the page's or the page's
heading is in it, else the least element with all prose. Inside,
a block stays if its path is prose; or if it is a part of an article by its tag (paragraph, heading, list, table, caption)
that isn't made of links and, for lists and tables, doesn't stand before the article's heading or first prose; or if it
is text right inside an element with prose. What else is inside, such as an unnamed menu or a line to click, goes.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head title script style noscript template iframe object embed svg math canvas audio video map button select option textarea input label datalist noembed noframes".split())
ASIDE = frozenset("nav menu aside footer dialog search".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTED = frozenset("li dt dd td th caption".split())
#: Elements that hold an article's text by their tag, and those around them that are still parts of it.
LEAVES = HEADINGS | LISTED | frozenset("p pre blockquote figcaption summary address".split())
PARTS = LEAVES | frozenset("ul ol dl dir table thead tbody tfoot tr details figure hgroup".split())
#: Start tag -> open elements that it ends, and the elements behind which it doesn't look.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"})}
#: Words of a class or id that name furniture, comments, an article, and a state of something else.
FURNITURE = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox banner banners sponsor sponsors sponsored sponsorship promo promos promotion sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager widget widgets toolbar skip disclaimer outbrain taboola".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
ARTICLE = frozenset("article content post story entry main body text layout page prose wrapper container".split())
STATES = frozenset("with without has have no not is hide show open closed on off enabled disabled".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())

_START = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_COMMENT = re.compile(r"--!?>")
_REST = re.compile(r"((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')|=(?!\s*[\"']))*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HREF = re.compile(r"\bhref\b", re.I)
#: Headings that open comments, wherever they stand and only as a section's own; and those that open other furniture.
_COMMENTS_OPEN = re.compile(r"(?:\d+ (?:reader )?(?:comments?|responses|replies|kommentare?|commentaires?|comentarios?)|(?:reader )?comments? ?\(\d+\)|(?:leave|post|add|write) a (?:comment|reply)|join the (?:discussion|conversation)|(?:reader|user) comments)\W*", re.I)
_COMMENTS_OWN = re.compile(r"(?:comments?|replies|responses|discussion|kommentare?|commentaires?|comentarios?)\W*", re.I)
_FURNITURE_OWN = re.compile(r"(?:advertise?ments?|advertising|sponsored(?: content| links?)?|anzeige|werbung|publicité|publicidad|related(?: (?:articles?|posts?|stories|links|content))?|recommended(?: for you)?|you (?:may|might) also like|more from .{1,40}|read (?:next|also)|share this(?: \w+)?|follow us|(?:subscribe|sign up)(?: (?:to|for) .{1,60})?|most (?:read|popular)|trending(?: now)?)\W*", re.I)
_LABEL = re.compile(r"(?:advertise?ments?|advertising|sponsored|anzeige|werbung|publicité|publicidad)\W*", re.I)
PUNCTUATION = frozenset(".,;:!?…。，、；：！？")

PLAIN, TAGGED, FORM, NAMED, COMMENTING, HEADER = range(6)


@lru_cache(1 << 12)
def _named(names: str) -> int:
    """What the class and id of an element say it is."""
    found = PLAIN
    whole = False
    for token in names.split():
        words = [x.lower() for x in _NAMES.findall(token)]
        if STATES.intersection(words):
            continue
        if COMMENTS.intersection(words):
            found = COMMENTING
        elif FURNITURE.intersection(words):
            found = found or NAMED
        elif words and words[-1] in ARTICLE:
            whole = True
    return NAMED if found == COMMENTING and whole else found


class Page:
    """A page's elements (name, parent, kind, path; 0 is the root) and blocks (text, characters in links, element)."""

    def __init__(self, page: str):
        self.names, self.parents, self.kinds, self.paths = ["#"], [0], [PLAIN], [0]
        self.texts: list[str] = []
        self.links: list[int] = []
        self.leaves: list[int] = []
        self._numbers: dict[tuple[int, str], int] = {}
        self._read(page)

    def _open(self, name: str, above: int, attributes: dict[str, str]) -> tuple[int, bool]:
        """(number of a new element, whether its text never counts)"""
        off = name in NEVER
        kind, step = PLAIN, name
        if attributes:
            off = off or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(attributes.get("style", "")))
            if name not in ("html", "body", "main"):
                if attributes.get("role", "").lower() in ROLES:
                    kind = TAGGED
                elif "class" in attributes or "id" in attributes:
                    kind = _named(f"{attributes.get('class', '')} {attributes.get('id', '')}")
            if attributes.get("class"):
                step = f"{name}.{'.'.join(attributes['class'].split())}"
        if name in ASIDE:
            kind = TAGGED
        elif kind == PLAIN and name in ("form", "fieldset"):
            kind = FORM
        elif kind == PLAIN and name == "header":
            kind = HEADER
        self.names.append(name)
        self.parents.append(above)
        self.kinds.append(kind)
        self.paths.append(self._numbers.setdefault((self.paths[above], step), len(self._numbers) + 1))
        return len(self.names) - 1, off

    def _read(self, page: str) -> None:
        stack, offs, off = [0], [False], 0
        where: dict[str, list[int]] = {}  # places in the stack of the open elements of a name
        text: list[tuple[str, bool]] = []
        link = 0  # depth of the stack where the open link began

        def flush() -> None:
            if text and not off:
                said = " ".join(html.unescape("".join(x for x, _ in text)).split())
                if said:
                    self.texts.append(said)
                    self.links.append(min(len(said), len(" ".join(html.unescape("".join(x for x, a in text if a)).split()))))
                    self.leaves.append(stack[-1])
            text.clear()

        def close(depth: int) -> None:
            nonlocal off, link
            flush()
            while len(stack) > depth:
                off -= offs.pop()
                where[self.names[stack.pop()]].pop()
            if link > depth:
                link = 0

        at, n, strict = 0, len(page), True
        while at < n:
            m = _START.search(page, at)
            if not m:
                text.append((page[at:], link > 0))
                break
            if m.start() > at:
                text.append((page[at : m.start()], link > 0))
            at = m.end()
            if m[1]:
                end = _COMMENT.search(page, at)
                at = end.end() if end else n
                continue
            name = (m[3] or "").lower()
            # Quoted values may hold a ">". Where quotes don't pair up to the end of the page, they no longer count.
            rest = _REST.match(page, at) if strict and name else None
            if rest:
                said, at = rest[1], rest.end()
            else:
                strict = strict and not name
                end = page.find(">", at)
                if end < 0 and not name:
                    text.append((m[0], link > 0))
                    continue
                said, at = page[at : end if end >= 0 else n], (end + 1 if end >= 0 else n)
            if not name:
                continue
            if m[2]:
                if name == "a":
                    link = 0
                elif where.get(name):
                    close(where[name][-1])
                continue
            if name == "br":
                text.append((" ", False))
                continue
            if name == "a":
                link = len(stack) if _HREF.search(said) else 0
                continue
            if name in RAW:
                end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
                if name not in NEVER and not off:
                    text.append((page[at : end.start() if end else n], False))
                at = end.start() if end else n
                continue
            if name == "hr":
                flush()
            if name in VOID or name not in BLOCK and name not in NEVER:
                continue
            if name in ENDS:
                ended, fence = ENDS[name]
                least = max((where[x][-1] for x in fence if where.get(x)), default=0)
                depths = [where[x][k] for x in ended if where.get(x) and (k := bisect_right(where[x], least)) < len(where[x])]
                if depths:
                    close(min(depths))
            elif name in BLOCK and self.names[stack[-1]] == "p":
                close(len(stack) - 1)
            flush()
            element, never = self._open(name, stack[-1], {x[1].lower(): x[2] or x[3] or x[4] or "" for x in _ATTRIBUTE.finditer(said)} if said else {})
            where.setdefault(name, []).append(len(stack))
            stack.append(element)
            offs.append(never)
            off += never
        flush()

    def sums(self, values: Iterable[float], leaves: Iterable[int]) -> list[float]:
        """For each element the sum of its subtree's values, given by leaf."""
        out = [0.0] * len(self.names)
        for x, leaf in zip(values, leaves, strict=True):
            out[leaf] += x
        for e in range(len(out) - 1, 0, -1):
            out[self.parents[e]] += out[e]
        return out


def path_scores(blocks: list[tuple[int, str, int]]) -> dict[int, tuple[float, float, float]]:
    """path -> (fused score, marks of punctuation, mean length) of blocks (path, text, characters in links), in page order.

    Ratios per node: text outside links, and punctuation. Each is smoothed over the two paths before and behind in the
    order of first appearance; a path's score is the geometric mean of its own fused ratios and the smoothed ones.
    """
    order: dict[int, int] = {p: i for i, p in enumerate(dict.fromkeys(b[0] for b in blocks))}
    nodes, length, marks = (np.zeros(len(order)) for _ in range(3))
    for path, text, linked in blocks:
        k = order[path]
        nodes[k] += 1
        length[k] += len(text) - linked
        marks[k] += sum(map(text.count, PUNCTUATION))
    kernel = np.exp(-(np.arange(-2, 3) ** 2) / 2.0)
    share = np.convolve(np.ones(len(order)), kernel, "full")[2:-2]

    def fused(smooth) -> np.ndarray:
        return np.sqrt(smooth(length / nodes) * smooth(length)) * (1 + smooth(marks / nodes))

    score = np.sqrt(fused(lambda x: x) * fused(lambda x: np.convolve(x, kernel, "full")[2:-2] / share))
    return {p: (float(score[k]), float(marks[k]), float(length[k] / nodes[k])) for p, k in order.items()}


def _set_aside(p: Page, majority: float) -> tuple[list[int], list[bool], list[float], float, int]:
    """(state, holds, weight, total, home): per element 0, 1 (gone) or 2 (only headings stay); whether it holds the page's
    heading or main element; its text outside links and furniture; the page's; and the page's main element or, without one,
    the article of its heading."""
    n = len(p.names)
    under, inside, outer = [False] * n, [False] * n, [0] * n
    for e in range(1, n):
        a = p.parents[e]
        under[e] = under[a] or p.kinds[e] == TAGGED
        inside[e] = inside[a] or p.names[a] in ("article", "main")
        outer[e] = a if p.names[a] == "article" else outer[a]
    own = [len(t) - x for t, x in zip(p.texts, p.links, strict=True)]
    weight = p.sums((0 if under[e] else x for x, e in zip(own, p.leaves, strict=True)), p.leaves)
    total = weight[0]
    first = next((e for e in range(1, n) if p.names[e] == "h1" and not under[e]), 0)
    main = [x == "main" for x in p.names]
    holds = [m or e == first > 0 for e, m in enumerate(main)]
    home = next((e for e in range(1, n) if p.names[e] == "main" and not under[e]), 0)
    e = first
    while e and not home:
        e = p.parents[e]
        home = e if p.names[e] == "article" else 0
    for e in range(n - 1, 0, -1):
        main[p.parents[e]] |= main[e]
        holds[p.parents[e]] |= holds[e]
    # What an article holds besides the articles in it; those that hold less are comments or teasers.
    alone = list(weight)
    for e in range(1, n):
        if p.names[e] == "article" and outer[e]:
            alone[outer[e]] -= weight[e]
    state, at_home = [0] * n, [not home or not weight[home]] * n
    for e in range(1, n):
        kind, a = p.kinds[e], p.parents[e]
        at_home[e] = at_home[a] or e == home
        most = weight[e] > 0 and weight[e] >= majority * total and at_home[e]
        if state[a] == 1 or kind == TAGGED and not main[e] or kind in (NAMED, FORM) and not (holds[e] or most) or kind == COMMENTING and not holds[e]:
            state[e] = 1
        elif p.names[e] == "article" and outer[e] and weight[e] < alone[outer[e]]:
            state[e] = 1
        elif kind == HEADER and not most and not main[e]:
            state[e] = 2 if inside[e] or p.names[a] not in ("#", "html", "body") else 1
        else:
            state[e] = state[a]
    return state, holds, weight, total, home


def _opened_by_headings(p: Page, kept: list[int], holds: list[bool], weight: list[float], most: float) -> set[int]:
    """Blocks of kept that a heading of comments or other furniture opens, the heading included."""
    cues = [i for i in kept if len(p.texts[i]) <= 80 and (_COMMENTS_OPEN.fullmatch(p.texts[i]) or _COMMENTS_OWN.fullmatch(p.texts[i]) or _FURNITURE_OWN.fullmatch(p.texts[i]))]
    if not cues:
        return set()
    n = len(p.names)
    begin, end = [len(p.texts)] * n, [-1] * n
    for i in kept:
        begin[p.leaves[i]], end[p.leaves[i]] = min(i, begin[p.leaves[i]]), max(i, end[p.leaves[i]])
    for e in range(n - 1, 0, -1):
        a = p.parents[e]
        begin[a], end[a] = min(begin[a], begin[e]), max(end[a], end[e])
    there, out = set(kept), set()
    for i in cues:
        if i in out:
            continue
        e = p.leaves[i]
        while (a := p.parents[e]) and begin[a] == i and not holds[a] and weight[a] < most and p.names[a] not in ("html", "body", "main"):
            e = a
        if end[e] > i and begin[e] == i:
            out.update(range(i, end[e] + 1))
        elif _COMMENTS_OPEN.fullmatch(p.texts[i]) and p.names[p.leaves[i]] in HEADINGS:
            for k in range(i, end[p.parents[p.leaves[i]]] + 1):
                if k > i and p.names[p.leaves[k]] in HEADINGS and p.names[p.leaves[k]] <= p.names[p.leaves[i]]:
                    break
                out.add(k)
        elif _LABEL.fullmatch(p.texts[i]):
            out.add(i)
    return out & there


def _article(p: Page, kept: list[int], prose: set[int], majority: float, home: int) -> tuple[int, bool, list[float]]:
    """(element, whether its tag names the article, prose of each subtree) of the article around the prose blocks."""
    mass = p.sums((len(p.texts[i]) - p.links[i] if i in prose else 0 for i in kept), [p.leaves[i] for i in kept])
    for name, least in (("article", 0.6), ("main", majority)):
        found = max((e for e in range(len(p.names)) if p.names[e] == name), key=lambda e: (mass[e], -e), default=0)
        if found and mass[found] > 0 and (mass[found] >= least * mass[0] or found == home):
            return found, True, mass
    e = 0
    children: dict[int, int] = {}
    for x in range(len(p.names) - 1, 0, -1):
        if mass[x] == mass[0]:
            children[p.parents[x]] = x
    while e in children and p.names[children[e]] not in PARTS:
        e = children[e]
    return e, False, mass


def main_text(page: str | None, majority: float = 0.5, level: float = 0.5) -> str:
    """The article's text, a line a block; empty if there is none."""
    p = Page(page or "")
    state, holds, weight, total, home = _set_aside(p, majority)
    kept = [i for i, e in enumerate(p.leaves) if not state[e] or state[e] == 2 and p.names[e] in HEADINGS]
    gone = _opened_by_headings(p, kept, holds, weight, max(1.0, majority * total))
    kept = [i for i in kept if i not in gone]
    if not kept:
        return ""
    path = [p.paths[e] for e in p.leaves]
    scores = path_scores([(path[i], p.texts[i], p.links[i]) for i in kept])
    own = np.array([x[0] for x in scores.values()])
    threshold = min(own.max(), level * own.std() if len(own) > 1 else 0.0)
    chosen = {k for k, x in scores.items() if x[0] >= threshold}
    said = {k for k in chosen if scores[k][1] > 0 or scores[k][2] >= 80} or chosen
    prose = {i for i in kept if path[i] in said and 10 * p.links[i] <= 9 * len(p.texts[i])} or {i for i in kept if path[i] in said}
    region, named, mass = _article(p, kept, prose, majority, home)
    inside = [e == region for e in range(len(p.names))]
    box = [0] * len(p.names)  # the nearest element above that is no part of an article
    for e in range(1, len(inside)):
        inside[e] = inside[e] or inside[p.parents[e]]
        box[e] = p.parents[e] if p.names[p.parents[e]] not in PARTS else box[p.parents[e]]
    letters = p.sums([len(p.texts[i]) for i in kept], [p.leaves[i] for i in kept])
    linked = p.sums([p.links[i] for i in kept], [p.leaves[i] for i in kept])
    here = [i for i in kept if inside[p.leaves[i]]]
    begin = next((i for i in here if p.names[p.leaves[i]] == "h1" or i in prose and p.names[p.leaves[i]] not in LISTED), 0)
    body = [i for i in here if i in prose and p.names[p.leaves[i]] not in HEADINGS]
    first, last = (body[0], body[-1]) if body else (-1, -1)

    def stays(i: int) -> bool:
        e = p.leaves[i]
        name, above = p.names[e], p.parents[e]
        if i in prose and (name not in LISTED or i >= begin):
            return True
        if name == "h1":
            return True
        if name in HEADINGS:
            return named or mass[above] > 0 or letters[above] == len(p.texts[i]) and mass[p.parents[above]] > 0
        links = 10 * p.links[i] > 9 * len(p.texts[i])
        if name in LISTED:
            links = links and 2 * linked[above] > letters[above]
            return i >= begin and (not links or first < i < last) and (named or mass[box[e]] > 0)
        if name in LEAVES:
            return not links and (named or mass[box[e]] > 0)
        return not links and mass[e] > 0

    body_of = [i for i in here if stays(i)]
    if not body_of:
        return ""
    title = next(([i] for i in kept if i < body_of[0] and p.names[p.leaves[i]] == "h1" and not inside[p.leaves[i]]), [])
    if any(p.names[p.leaves[i]] == "h1" for i in body_of):
        title = []
    return "\n".join(p.texts[i] for i in [*title, *body_of])


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the columns of keep, text and n_chars (code points) for every row of pages; whole pages are read.

    A null or empty page, and one without text, give the empty text and 0. Repeated rows are read each; ids and kept
    columns may be null and stay as they are. Further columns are not carried, so no name of theirs can clash. No rows
    give no rows. A page's cost grows with its length, whatever the depth of its elements.
    """
    rows = pages.select(pages[id_col], *(pages[c] for c in keep), pages[html_col])
    names = [id_col, *keep, "text", "n_chars"]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "text string", "n_chars long"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    return rows.mapInArrow(run, out)
