"""Queries of text scoring, classification, URL identity and page cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import quality, texts, topics, urls
from inkwell.functions.topics import TOPICS
from inkwell.plans.registry import query
from inkwell.sources import views

#: Headlines that the rules know; the documents' own words are invented and none of them would fire.
HEADLINES = [
    "Why the Rust borrow checker is dead",
    "I built a tiny compiler from scratch",
    "7 things you need to know about machine learning",
    "Monetary policy and the labor market after inflation",
    "A proof of the prime number theorem",
    "Weekly links: number theory and graph theory",
    "Show HN: an interactive game about supply and demand",
    "You won't believe what happened next!!!",
    "Getting started with Django and pytest",
    "How I reverse-engineered the kernel scheduler",
    "Central bank interest rate decisions in a recession",
    "This is how inflation changed everything...",
    "Postgres replication, WAL and MVCC under the hood",
    "Fragments: 12 notes on calculus",
    "THE TRUTH ABOUT CVE-2024 ransomware",
    "Linear algebra, matrix and tensor tricks in numpy python",
    "Haskell monads are functors",
    "Acme acquires Foo and announces Bar version 3",
    "A surprising paradox in game theory",
    "Weekend digest of open source software",
]
BODIES = [
    "economics is about trade and tax. ",
    "software and code for the internet server. ",
    "theorem proof lemma algebra geometry. ",
    "i wrote this in the kernel of the operating system ",
    "",
]
BYLINES = [
    "By Jane Doe", "jane@example.org (Jane Doe)", "Posted on", "2024-01-05 - by Ann Lee", "example.com via someone", "Max Muster Max Muster is a writer.",
    "Ian Roe · Example News · posted today", "The Example Team", "Kay's Blog", "Lou Poe on", "blog.example.org/about", "Sam Hill January 5, 2024", "bob@example.org Bob Ray", "Amy Fox commented on this", "  Eve   Day  Tue", "?",
]
URLS = [
    "https://www.blog.example.co.uk/2024/a-post?utm_source=x&b=1#top", "http://terrytao.wordpress.com/2024/01/01/x/", "https://wordpress.com/blog/post", "https://news.bbc.co.uk/story", "https://a.b.c.example.com/tag/x/y",
    "https://example.org/file.PDF", "https://medium.com/@x/post?source=feed&k=v", "https://sub.medium.com/p?source=rss", "https://example.com", "https://example.com/", "ftp://example.com/a", "not a url", "https://someone.github.io/writing/one",
    "https://example.edu/paper", "https://x.example.gov/page", "https://my.blogspot.com/essays/two/three?fbclid=1", "https://lobste.rs/s/abc", "HTTPS://WWW.Example.COM/Notes/One?UTM_campaign=z&gclid=2&q=3", "https://user@host.example.com:8080/a/b?si=1", "https://example.com/search/results", "mailto:a@example.com", "https://stackoverflow.com/q/1",
]


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def qs(values: list[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


_SUBJECTS = rf"""WITH subjects AS (
  SELECT doc_id AS id, {qs(HEADLINES)}[(doc_id % {len(HEADLINES)} + 1)::INT] || ' ' || array_to_string(regexp_split_to_array(substr(text, 1, 200), '[\x20\x09-\x0D]+')[1:4], ' ') AS title,
    substr(text, 1, 160) AS excerpt, repeat({qs(BODIES)}[(doc_id % {len(BODIES)} + 1)::INT], 6) || text AS body, ['technology', 'economics', 'math'][(doc_id // 3 % 3 + 1)::INT] AS hint,
    ['lwn.net', 'go.dev', 'publication-1.example', ''][(doc_id % 4 + 1)::INT] AS domain, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words
  FROM documents WHERE text IS NOT NULL)
"""


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles whose titles and bodies hold terms that the rules know."""
    i = F.col("doc_id")
    head = F.array_join(F.slice(F.split(F.substring("text", 1, 200), r"[\x20\x09-\x0D]+", -1), 1, 4), " ")
    return views.spread(views.table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")).select(
        i.alias("id"), F.concat(views.pick(HEADLINES, i), F.lit(" "), head).alias("title"), F.substring("text", 1, 160).alias("excerpt"), F.concat(F.repeat(views.pick(BODIES, i), F.lit(6)), F.col("text")).alias("body"),
        views.pick(TOPICS, F.floor(i / 3)).alias("hint"), views.pick(["lwn.net", "go.dev", "publication-1.example", ""], i).alias("domain"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def _sum(terms: list[tuple[str, float]]) -> str:
    return " + ".join(["0.0::DOUBLE", *(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for c, w in terms)])


def _has(column: str, pattern: str, any_case: bool = True) -> str:
    return f"regexp_matches({column}, {q(('(?i)' if any_case else '') + pattern)})"


def _clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


_QUALITY = rf"""{_SUBJECTS}, html AS (SELECT *, '<p>' || substr(body, 1, 300) || '</p><a class="x" href="/' || id || '">' || substr(body, 1, (id % 260)::INT) || '</a>' AS html FROM subjects),
a AS (SELECT *, regexp_extract_all(lower(substr(body, 1, 4000)), '[a-z'']+') AS ws, substr(body, 1, 4000) AS head, title || ' ' || substr(body, 1, 600) AS sample, lower(title) AS low FROM html),
b AS (SELECT *, len(list_filter(ws, lambda w: list_contains({qs(quality.STOPWORDS)}, w)))::DOUBLE / len(ws) AS share,
  len(list_filter(regexp_split_to_array(head, '[.!?]+(?:\s|$)'), lambda s: length(regexp_replace(s, '^\s+|\s+$', '', 'g')) > 2)) AS parts, len(regexp_split_to_array(head, '\s+'))::DOUBLE AS tokens,
  list_sum(list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*href[^>]*>[\s\S]*?</a>'), lambda x: length(regexp_replace(x, '<[^>]*>', '', 'g'))))::DOUBLE / length(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS density FROM a),
c AS (SELECT id,
  CASE WHEN words <= 0 THEN 0.0::DOUBLE ELSE {_clamp("log10(words / 150.0::DOUBLE) / log10(40.0::DOUBLE)")} END AS depth,
  CASE WHEN len(ws) < 50 THEN 0.5 WHEN share >= 0.32 AND share <= 0.58 THEN 1 WHEN share >= 0.22 AND share < 0.32 THEN 0.7 WHEN share > 0.58 AND share <= 0.68 THEN 0.7 ELSE 0.25 END::DOUBLE AS stopwords,
  CASE WHEN parts < 5 THEN 0.6 WHEN tokens / parts >= 8 AND tokens / parts <= 32 THEN 1 WHEN tokens / parts >= 5 AND tokens / parts <= 45 THEN 0.7 ELSE 0.3 END::DOUBLE AS sentences,
  {_clamp(r"len(regexp_extract_all(sample, '\b[A-Z]{3,}\b'))::DOUBLE / greatest(1, len(regexp_extract_all(sample, '[A-Za-z]+'))) * 12.0::DOUBLE")} AS caps,
  {_clamp(_sum([(r"regexp_matches(title, '!{2,}|\?{2,}')", 0.5), ("len(regexp_extract_all(title, '!')) > 2", 0.4), (f"regexp_matches(title, {q(quality.EMOJI)})", 0.3)]))} AS punctuation,
  {_clamp(_sum([(f"contains(low, {q(p)})", 0.45) for p in quality.CLICKBAIT_PHRASES] + [(_has("title", p), 0.35) for p in quality.CLICKBAIT_TITLES] + [(_has("low", r"\b(this|these)\b", False) + " AND len(string_split(low, ' ')) <= 12", 0.15), (r"regexp_matches(title, '\.\.\.|…')", 0.2)]))} AS clickbait,
  CASE WHEN density <= 0.15 THEN 0 WHEN density <= 0.3 THEN 0.3 ELSE {_clamp("(density - 0.3::DOUBLE) * 2.5::DOUBLE")} END::DOUBLE AS link_density,
  {_clamp(_sum([*((_has("title", p), w) for p, w in quality.INTERESTING), (_has("lower(substr(body, 1, 2000))", quality.FIRST_PERSON, False), 0.06)]))} AS interestingness
  FROM b)
SELECT id, round({_clamp("0.06::DOUBLE + 0.22::DOUBLE * depth + 0.10::DOUBLE * stopwords + 0.08::DOUBLE * sentences + 0.16::DOUBLE * (1 - caps) + 0.06::DOUBLE * (1 - punctuation) + 0.12::DOUBLE * (1 - clickbait) + 0.08::DOUBLE * (1 - link_density) + 0.12::DOUBLE * interestingness")}, 9) AS quality,
  round(depth, 9) AS depth, stopwords, sentences, round(caps, 9) AS caps, round(punctuation, 9) AS punctuation, round(clickbait, 9) AS clickbait, round(link_density, 9) AS link_density, round(interestingness, 9) AS interestingness FROM c"""


@query(_QUALITY)
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and its eight parts of every document as an article."""
    html = F.concat(F.lit("<p>"), F.substring("body", 1, 300), F.lit('</p><a class="x" href="/'), F.col("id").cast("string"), F.lit('">'), F.substring(F.col("body"), F.lit(1), (F.col("id") % 260).cast("int")), F.lit("</a>"))
    # Generators compute a struct once; fields taken from a projected struct would each compute it again.
    rows = subjects(spark, sf_dir).select("id", F.inline(F.array(quality.score(F.col("title"), F.col("body"), html, F.col("words")))))
    return rows.select("id", "quality", "components.*")


def _terms(column: str, topic: str) -> str:
    def part(terms: list[str], weight: float) -> str:
        needles = qs([f" {t} " for t in terms])
        return f"coalesce(list_sum(list_transform({needles}, lambda n: {weight}::DOUBLE * least(3, (length({column}) - length(replace({column}, n, ''))) // length(n)))), 0)"

    return f"({part(topics.STRONG[topic], 2.4)} + {part(topics.SUPPORTING[topic], 0.75)})"


def _normal(x: str) -> str:
    return f"' ' || trim(regexp_replace(lower({x}), '[^a-z0-9+#.]+', ' ', 'g')) || ' '"


_TOPICS = rf"""{_SUBJECTS}, n AS (SELECT id, hint, {_normal("title")} AS t, {_normal("excerpt")} AS e, {_normal("substr(body, 1, 12000)")} AS b FROM subjects),
h AS (SELECT *, {", ".join(f"{_terms('t', x)} * 3.5::DOUBLE + {_terms('e', x)} * 1.5::DOUBLE AS head_{x}" for x in TOPICS)} FROM n),
r AS (SELECT *, {", ".join(f"head_{x} + {_terms('b', x)} * 0.35::DOUBLE AS all_{x}" for x in TOPICS)} FROM h),
w AS (SELECT id, hint, {", ".join(f"CASE WHEN head_{x} = 0 AND all_{x} < 4 THEN all_{x} * 0.25::DOUBLE ELSE all_{x} END AS raw_{x}" for x in TOPICS)} FROM r),
c AS (SELECT *, CASE hint {" ".join(f"WHEN '{x}' THEN raw_{x}" for x in TOPICS)} END AS raw_hint, greatest({", ".join(f"raw_{x}" for x in TOPICS)}) AS top FROM w),
d AS (SELECT *, CASE WHEN top < raw_hint * 1.25::DOUBLE + 1.2::DOUBLE THEN hint WHEN raw_hint = top THEN hint {" ".join(f"WHEN raw_{x} = top THEN '{x}'" for x in TOPICS)} END AS topic FROM c)
SELECT id, topic, round(1 - exp(-(CASE topic {" ".join(f"WHEN '{x}' THEN raw_{x}" for x in TOPICS)} END) / 5.0::DOUBLE), 9) AS relevance, {", ".join(f"round(1 - exp(-raw_{x} / 5.0::DOUBLE), 9) AS {x}" for x in TOPICS)} FROM d"""


@query(_TOPICS)
def topic_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic and confidences of every document as an article."""
    return subjects(spark, sf_dir).select("id", F.inline(F.array(topics.assess(F.col("title"), F.col("excerpt"), F.col("body"), F.col("hint")))))


@query(_SUBJECTS + f"SELECT id, CASE WHEN hint <> 'technology' THEN '' {' '.join(f'WHEN domain IN ({chr(44).join(map(q, d))}) OR {_has(chr(116) + chr(105) + chr(116) + chr(108) + chr(101), p)} THEN {q(n)}' for n, d, p in topics.CLUSTERS)} ELSE '' END AS cluster FROM subjects")
def semantic_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ecosystem of every technology article."""
    return subjects(spark, sf_dir).select("id", topics.cluster(F.col("hint"), F.col("title"), F.col("domain"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("cluster"))


@query(_SUBJECTS + "SELECT id, title FROM subjects WHERE NOT (" + " OR ".join(_has("title", p) for p in topics.ROUNDUPS) + ")")
def roundup_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose titles aren't round-ups."""
    return subjects(spark, sf_dir).where(~topics.is_roundup(F.col("title"))).select("id", "title")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(-i - 1, u) for i, u in enumerate(URLS)], "id long, url string")
    return views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url").union(known)


_PLACES = f"""WITH places AS (SELECT page_id AS id, url FROM pages UNION ALL SELECT -i - 1, {qs(URLS)}[i + 1] FROM range({len(URLS)}) r(i)),
parts AS (SELECT id, url, regexp_extract(trim(url), {q(urls._URL)}, ['scheme', 'authority', 'path', 'query', 'fragment']) AS p FROM places),
named AS (SELECT id, url, lower(p.scheme) AS scheme, nullif(lower(regexp_replace(p.authority, '^.*@', '')), '') AS host, CASE WHEN p.scheme = '' THEN NULL WHEN p.path = '' THEN '/' ELSE p.path END AS path, p.query AS query, lower(p.authority) AS authority FROM parts),
bare AS (SELECT *, regexp_replace(coalesce(host, lower(trim(url))), '^www\\.', '') AS name FROM named),
labelled AS (SELECT *, string_split(name, '.') AS ls FROM bare),
rooted AS (SELECT *, CASE WHEN len(ls) <= 2 THEN name WHEN array_to_string(ls[-2:], '.') IN ({", ".join(map(q, urls.PLATFORM_ROOTS))}) THEN name
  WHEN array_to_string(ls[-2:], '.') IN ({", ".join(map(q, urls.TWO_PART_SUFFIXES))}) THEN array_to_string(ls[-3:], '.') ELSE array_to_string(ls[-2:], '.') END AS root FROM labelled)
"""
_BLOCKED = ", ".join(map(q, urls.BLOCKED_DOMAINS))
_ARTICLE = f"coalesce(scheme IN ('http', 'https') AND host IS NOT NULL AND lower(path) <> '/' AND NOT ({' OR '.join(f'ends_with(lower(path), {q(x)})' for x in urls.NON_ARTICLE_EXTENSIONS)}) AND NOT regexp_matches(lower(path), {q(urls.LIST_PATHS)}), false)"


@query(_PLACES + "SELECT id, name AS host, root FROM rooted")
def root_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and registrable domain of every URL."""
    name = urls.without_www(F.coalesce(urls.host(F.col("url")), F.lower(F.trim("url"))))
    return _places(spark, sf_dir).select("id", name.alias("host"), urls.root_domain(name).alias("root"))


@query(_PLACES + f"""SELECT id, reason = '' AS allowed, reason FROM (SELECT id, CASE WHEN name = '' OR NOT contains(name, '.') THEN 'not a domain' {" ".join(f"WHEN ends_with(name, {q(t)}) THEN {q('blocked tld ' + t)}" for t in urls.BLOCKED_TLDS)}
  WHEN (root IN ({_BLOCKED}) OR name IN ({_BLOCKED})) AND (root NOT IN ({", ".join(map(q, urls.PLATFORM_ROOTS))}) OR name = root OR name IN ({_BLOCKED})) THEN 'blocked domain' ELSE '' END AS reason FROM rooted)""")
def domain_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the site of every URL may be a source, and why not."""
    return _places(spark, sf_dir).select("id", F.inline(F.array(urls.classify(F.col("url")))))


@query(_PLACES + f"SELECT id, {_ARTICLE} AS is_article FROM rooted")
def article_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every URL looks like an article's."""
    return _places(spark, sf_dir).select("id", urls.is_article_path(F.col("url")).alias("is_article"))


@query(_PLACES + f"""--
, cut AS (SELECT id, url, scheme, authority, path, list_filter(string_split(query, '&'), lambda x: x <> '') AS pairs, authority = 'medium.com' OR ends_with(authority, '.medium.com') AS medium FROM named),
marked AS (SELECT *, list_filter(pairs, lambda x: NOT (regexp_matches(split_part(x, '=', 1), {q(urls.TRACKING)}) OR (medium AND split_part(x, '=', 1) = 'source'))) AS kept FROM cut)
SELECT id, CASE WHEN len(pairs) > len(kept) THEN scheme || '://' || authority || path || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END ELSE url END AS url FROM marked""")
def tracking_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs without tracking parameters."""
    return _places(spark, sf_dir).select("id", urls.strip_tracking(F.col("url")).alias("url"))


PAGE_TITLE = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?i)<title[^>]*>([\s\S]*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, {PAGE_TITLE} AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages, by pattern."""
    return views.table(spark, sf_dir, "pages").select("page_id", texts.page_title(F.col("html")).alias("title"))


_TRIM = r"regexp_replace(html, '<!--[\s\S]*?-->', ' ', 'g')"
for _name in texts.DROPPED:
    _TRIM = rf"regexp_replace({_TRIM}, '(?i)<{_name}\b[^>]*>[\s\S]*?</{_name}\s*>', ' ', 'g')"
_TRIM = rf"regexp_replace({_TRIM}, '(?i)<(script|style|noscript|iframe)\b[^>]*/?>', ' ', 'g')"


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace({_TRIM}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def pretrim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages without scripts, styles, forms and comments."""
    return views.table(spark, sf_dir, "pages").select("page_id", texts.without_tags(texts.pre_trim(F.col("html"))).alias("text"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ') AS x FROM documents), h AS (SELECT *, substr(x, 1, 220) AS head FROM t),
s AS (SELECT *, greatest(CASE WHEN contains(head, '. ') THEN 220 - strpos(reverse(head), ' .') ELSE 0 END, CASE WHEN contains(head, '! ') THEN 220 - strpos(reverse(head), ' !') ELSE 0 END) AS stop FROM h)
SELECT doc_id, CASE WHEN length(x) <= 220 THEN x WHEN stop > 101 THEN substr(head, 1, stop) ELSE regexp_replace(head, '\s\S*$', '') || '…' END AS excerpt FROM s""")
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpt of every document."""
    clean = F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " "))
    return views.table(spark, sf_dir, "documents").select("doc_id", texts.excerpt(clean).alias("excerpt"))


@query(_SUBJECTS + r""", t AS (SELECT id, trim(title || ' | ' || excerpt, ' ') AS x FROM subjects)
SELECT id, CASE WHEN length(x) <= 48 THEN x """ + " ".join(f"WHEN strpos(x, {q(s)}) > 12 AND length(trim(substr(x, 1, strpos(x, {q(s)}) - 1))) >= 12 THEN trim(substr(x, 1, strpos(x, {q(s)}) - 1))" for s in texts.SEPARATORS) + r" ELSE regexp_replace(substr(x, 1, 60), '\s\S*$', '') || '…' END AS title FROM t")
def tidy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed titles without their taglines."""
    return subjects(spark, sf_dir).select("id", texts.tidy_title(F.concat("title", F.lit(" | "), "excerpt")).alias("title"))


def _taken(pattern: str, least: int = 0) -> str:
    return f"CASE WHEN regexp_matches(x, {q(pattern)}) AND length(x) > {least} THEN regexp_extract(x, {q(pattern)}, 1) ELSE x END"


def _removed(pattern: str) -> str:
    return f"regexp_replace(x, {q(pattern)}, '')"


_MAIL = r"(?i)^\S+@\S+\s+\(([^)]+)\)$"
_DOUBLED = r"^\s+is\s+(?:an?\s+)?[^.]+\.?$"
_NOBODY = " OR ".join(f"regexp_matches(short, {q(p)})" for p in (r"(?i)\b(?:staff|team)$", r"(?i)(?:'s|s)?\s*blog$", r"(?i)\s+\(on\b.*\)$", texts.HOSTNAME))
#: The steps of a byline's cleaning; the doubled name, for which this engine's patterns have no back-reference, is looked
#: for at every length.
_BYLINE_STEPS = [
    r"trim(regexp_replace(x, '\s+', ' ', 'g'))", _removed(r"(?i)^by\s+"), _removed(r"(?i)^\d{4}-\d{2}-\d{2}\s*[-—]\s*(?:by\s+)?"), _taken(r"(?i)^featuring\b.*?\.\s*by\s+(.+?)(?:\s+on)?$"), _taken(r"(?i)^published by\s+(.+?)\s+view all posts by\b.*$"),
    f"coalesce(substr(x, 1, list_filter(range(1, length(x) // 2 + 1), lambda i: lower(substr(x, 1, i)) = lower(substr(x, i + 1, i)) AND regexp_matches(substr(x, 2 * i + 1), {q('(?i)' + _DOUBLED)}))[1]), x)",
    _taken(r"(?i)^.*?\s+by\s+([\p{L}][\p{L} .'-]+)$", 55), f"CASE WHEN regexp_matches(x, {q(_MAIL)}) THEN regexp_extract(x, {q(_MAIL)}, 1) ELSE regexp_replace(x, '^\\S+@\\S+\\s+', '') END",
    _removed(r"(?i)\s+commented(?:\s+on.*)?$"), _removed(texts.NEWS_DATE), _removed(texts.CALENDAR_DATE), _removed(texts.WEEKDAY),
    r"trim(regexp_replace(CASE WHEN len(list_filter(regexp_split_to_array(x, '\s+·\s+')[2:], lambda p: regexp_matches(p, '(?i)\b(?:news|posted|updated)\b'))) > 0 THEN regexp_split_to_array(x, '\s+·\s+')[1] ELSE x END, '\s+', ' ', 'g'))",
]


def _named(author: str) -> str:
    """CTEs cleaned(id, name) behind a table bylines(id, author)."""
    out = f"b0 AS (SELECT id, {author} AS x FROM bylines)"
    for k, step in enumerate(_BYLINE_STEPS):
        out += f", b{k + 1} AS (SELECT id, {step} AS x FROM b{k})"
    last = f"(SELECT id, x, regexp_replace(x, '(?i)\\s+on$', '') AS short FROM b{len(_BYLINE_STEPS)})"
    return out + f", cleaned AS (SELECT id, CASE WHEN regexp_matches(x, {q(texts.SUBMITTER)}) OR regexp_matches(x, {q(texts.NOT_AUTHORS)}) OR {_NOBODY} THEN '' ELSE short END AS name FROM {last})"


@query(f"""WITH bylines AS (SELECT doc_id AS id, {qs(BYLINES)}[(doc_id % {len(BYLINES)} + 1)::INT] AS author FROM documents), {_named("author")}
SELECT id, lower(name) AS author_key, CASE WHEN name = '' THEN 'Site ' || id % 5 ELSE name END AS "primary", CASE WHEN name = '' THEN '' ELSE 'Site ' || id % 5 END AS secondary, name <> '' AS has_author FROM cleaned""")
def author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bylines as names and keys, and what cards show of them."""
    rows = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), views.pick(BYLINES, F.col("doc_id")).alias("author"))
    a: Column = texts.attribution(F.col("author"), F.concat(F.lit("Site "), (F.col("id") % 5).cast("string")))
    return rows.select("id", texts.author_key(F.col("author")).alias("author_key"), F.inline(F.array(a)))


@query(_SUBJECTS + ", t AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'Share ' || title WHEN id % 4 = 1 THEN '# ' || title WHEN id % 4 = 2 THEN '<p>**' || title || '**</p>' ELSE title END AS x FROM subjects)\n"
  + f"SELECT id, length(trim(x)) <= 120 AND (regexp_matches(trim(x), {q(texts.BOILERPLATE)}) OR regexp_matches(trim(x), {q(texts.LEGAL)})) AS boilerplate, NOT regexp_matches(x, '(?i)<(p|div|h[1-6]|ul|ol|blockquote|pre)\\b') AND ({' OR '.join(f'regexp_matches(x, {q(p)})' for p in texts.MARKDOWN)}) AS markdown FROM t")
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts that are boilerplate, and texts that look like Markdown."""
    i, title = F.col("id"), F.col("title")
    x = F.when(i % 4 == 0, F.concat(F.lit("Share "), title)).when(i % 4 == 1, F.concat(F.lit("# "), title)).when(i % 4 == 2, F.concat(F.lit("<p>**"), title, F.lit("**</p>"))).otherwise(title)
    return subjects(spark, sf_dir).select("id", texts.is_boilerplate(x).alias("boilerplate"), texts.looks_like_markdown(x).alias("markdown"))


@query(_SUBJECTS + """SELECT id, CASE WHEN id % 7 = 3 AND trim(title) <> '' THEN trim(title) WHEN id % 3 = 0 THEN 'Page ' || id ELSE trim(title) END AS title, id % 7 = 3 AND id % 5 <> 0 AND id % 2 = 0 AS needs_date,
  strftime(make_timestamp((1706745600000 - id % 900 * 86400000) * 1000), '%B %-d, %Y') AS shown FROM subjects""")
def enriched_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of cards after extraction, whether a date must be verified first, and dates as shown."""
    i = F.col("id")
    source, found = F.when(i % 7 != 3, i), F.when(i % 3 == 0, F.concat(F.lit("Page "), i.cast("string"))).otherwise(" ")
    ms = F.lit(views.AS_OF) - i % 900 * views.DAY
    return subjects(spark, sf_dir).select("id", texts.title_for_enriched(source, F.col("title"), found).alias("title"), texts.needs_verified_date(source, F.when(i % 5 == 0, ms), F.when(i % 2 == 1, ms)).alias("needs_date"), texts.format_date(ms).alias("shown"))
