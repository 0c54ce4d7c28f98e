import pytest
from pyspark.sql import functions as F

from inkwell.functions import texts, topics, urls
from inkwell.operators import fairness, reports, state
from inkwell.sources import feeds, pages


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()
    return row["x"]


@pytest.mark.parametrize(
    ("author", "name"),
    [
        ("By  Jane   Doe", "Jane Doe"), ("Posted on", ""), ("Ann Lee commented on Some Blog", "Ann Lee"), ("host.example via someone", ""),
        ("Simon Roe · Example News · Posted: Aug 22", "Simon Roe"), ("me@example.dev Tia Poe", "Tia Poe"), ("x@y.z (Ann Poe)", "Ann Poe"), ("Published by Bo Bar View all posts by Bo Bar", "Bo Bar"),
        ("Featuring Mark L. Egan. By Rachel Layne on", "Rachel Layne"), ("Some Daily Staff", ""), ("blog.example.com", ""), ("Joe Za Wed,", "Joe Za"), ("Brad ReedBrad Reed is a staff writer for Things.", "Brad Reed"),
        ("A Very Long Institution Hosts Its Annual Meeting Again By Jane Beau", "Jane Beau"), ("2026-08-25 - By The Team", ""), ("?", ""),
    ],
)
def test_author_names(spark, author, name):
    assert one(spark, texts.clean_author(F.col("a")), a=author) == name


@pytest.mark.parametrize(("host", "root"), [("www.example.com", "example.com"), ("a.b.example.co.uk", "example.co.uk"), ("tao.wordpress.com", "tao.wordpress.com"), ("x.y.github.io", "x.y.github.io"), ("localhost", "localhost")])
def test_root_domains(spark, host, root):
    assert one(spark, urls.root_domain(F.col("h")), h=host) == root


@pytest.mark.parametrize(("title", "found"), [("Fragments: 3", True), ("Links", True), ("Weekly Roundup 4", True), ("Chain links of steel", False), ("Reading list 2024", True), ("A roundup of cattle", False)])
def test_roundups(spark, title, found):
    assert one(spark, topics.is_roundup(F.col("t")), t=title) is found


def test_topic_hint_keeps_a_near_tie(spark):
    a = topics.assess(F.col("t"), F.lit(""), F.lit(""), F.lit("economics"))
    assert one(spark, a["topic"], t="Nothing here") == "economics"
    assert one(spark, a["topic"], t="A compiler for the kernel of an operating system") == "technology"


def test_math_segments():
    assert pages.math_segments("a $x^2$ b $$y$$ c \\(z\\) it costs $5 and $10") == [("text", "a "), ("inline", "x^2"), ("text", " b "), ("display", "y"), ("text", " c "), ("inline", "z"), ("text", " it costs $5 and $10")]
    assert pages.math_segments("") == []


def test_page_extraction():
    body = "".join(f"<p>Sentence number {i} of a long enough article about something, indeed.</p>" for i in range(12))
    page = f'<html><head><title>A title | Site</title><meta property="og:site_name" content="Site"><meta name="author" content="Ann"></head><body><nav>menu</nav><div class="x">{body}<script>no()</script></div></body></html>'
    got = pages.extract(page, "https://example.com/a")
    assert got["title"] == "A title | Site" and got["author"] == "Ann" and got["word_count"] == 121
    assert "menu" not in got["text_content"] and "class" not in got["content_html"]
    assert pages.extract("<p>too short</p>", "https://example.com") is None and pages.extract(None, None) is None


def test_segments_hold_code():
    got = pages.segments('<p>a</p><pre data-nc-lang="go">x := 1</pre><span>no</span>')
    assert [(s["html"], s["code"], s["lang"]) for s in got] == [("<p>a</p>", None, None), ("", "x := 1", "go")]


ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><link rel="self" href="https://s"/><link href="https://site"/><entry><title>One</title><link href="https://site/1#x"/><author><name>Ann</name></author><updated>2024-01-02T03:04:05Z</updated><summary>s</summary></entry></feed>'
RDF = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>R</title></channel><item><title>I</title><link>https://r/1</link><dc:date>2024-01-02</dc:date></item></rdf:RDF>'


def test_feed_kinds(spark):
    rss = '<rss><channel><title>C</title><link>https://c</link><item><guid>https://c/2?utm_source=a</guid><author>Bo</author><pubDate>Tue, 02 Jan 2024 00:00:00 GMT</pubDate></item></channel></rss>'
    df = spark.createDataFrame([(1, ATOM), (2, RDF), (3, rss), (4, "<html></html>"), (5, None), (6, "broken <")], "feed_id long, xml string")
    got = {r.feed_id: r for r in feeds.entries(df).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].url, got[1].author, got[1].published, got[1].site_url) == ("https://site/1", "Ann", 1704164645000, "https://site")
    assert (got[2].title, got[2].published) == ("I", 1704153600000)
    assert (got[3].url, got[3].title, got[3].author, got[3].published) == ("https://c/2", "(untitled)", "Bo", 1704153600000)


def test_folds_in_blocks_are_folds_in_order(spark):
    import random

    rng = random.Random(5)
    log = [(k, i, rng.random()) for k in range(4) for i in range(rng.randrange(1, 60))]
    df = spark.createDataFrame(log, "source_id long, seq long, quality double")
    step = F.struct(F.lit(0.8).alias("a"), (F.col("quality") * 0.2).alias("b"), F.lit(0.3).alias("low"), F.lit(0.85).alias("high"))
    for block in (1, 7, 4096):
        got = {r.source_id: r.value for r in state.clamped_fold(df, "source_id", "seq", step, F.lit(0.55), block).collect()}
        for k in range(4):
            x = 0.55
            for key, _, q in log:
                if key == k:
                    x = max(0.3, min(0.85, 0.8 * x + 0.2 * q))
            assert got[k] == pytest.approx(x, abs=1e-12)


def test_round_robin_by_brute_force(spark):
    import random

    rng = random.Random(2)
    for _ in range(3):
        entries = [(i, f"d{rng.randrange(5)}") for i in range(30)]
        queues = {}
        for i, d in entries:
            queues.setdefault(d, []).append(i)
        want = [q[n] for n in range(3) for q in queues.values() if n < len(q)][:17]
        df = spark.createDataFrame(entries, "pos long, key string")
        got = fairness.round_robin_by(df, "key", "pos", 17, 3).orderBy("slot").collect()
        assert [r.pos for r in got] == want


def test_nearest_rank(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1, 1, 9, 7)], "v long")
    assert {r.share: r.value for r in reports.nearest_rank(df, "v", 0.5, 0.99, 0.0).collect()} == {0.5: 5, 0.99: 9, 0.0: 1}


def test_streamed_polling_follows_the_batch_rule(spark, tmp_path):
    import pandas as pd

    from inkwell.streaming import state as streaming

    hours = 3_600_000
    pd.DataFrame({"source_id": [1] * 5, "seq": range(5), "at": [0, 10 * hours, 12 * hours, 20 * hours, 21 * hours], "new_entries": [1, 0, 1, 1, 0], "ok": [True, True, True, False, False]}).to_parquet(tmp_path / "a.parquet")
    schema = spark.read.parquet(str(tmp_path / "a.parquet")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path) + "/*.parquet")
    out = streaming.run_to_end(streaming.polling(stream), "source_id").collect()
    assert [(r.source_id, round(r.interval_hours, 6), r.failures, r.status) for r in out] == [(1, 2.0, 2, "failing")]


SENTENCES = "".join(f"<p>Sentence number {i} of a long enough article about something, indeed.</p>" for i in range(12))


@pytest.mark.parametrize("tag", ["div", "blockquote", "section"])
def test_deep_pages_are_read(tag):
    page = "<title>T</title>" + f"<{tag}>" * 5000 + SENTENCES + f"</{tag}>" * 5000
    got = pages.extract(page, "https://example.com/a")
    assert got["word_count"] == 121 and got["content_html"].count("Sentence number 3 ") >= 1


def test_whole_pages_are_read_unless_limits_say_otherwise():
    page = f"<title>T</title><div>{SENTENCES * 900}</div>"
    assert len(page) > 700_000 and pages.extract(page, "")["word_count"] == 120 * 900 - 899 + 900
    short = pages.extract(page, "", pages.PRODUCT)
    assert short["word_count"] < 120 * 900 and len(short["content_html"]) == 300_000 and len(short["text_content"]) == 60_000


def test_long_feeds_are_read(spark):
    items = "".join(f"<item><link>https://c.example/p/{i}</link><title>{'word ' * 60}</title></item>" for i in range(6000))
    df = spark.createDataFrame([(1, f"<rss><channel><title>C</title>{items}</channel></rss>")], "feed_id long, xml string")
    assert len(items) > 2_000_000 and feeds.entries(df).count() == 6000
    assert feeds.entries(df, most=1_500_000).count() == 0


def test_lists_of_the_known_aggregator_only():
    item = '<li><b><a href="/p/1">A</a></b><br>by Bo in <i>B</i>, 2024-01-02<br><li>no link<li><b><a href="https://x.example/2">C</a></b></ul>'
    title, _, entries = feeds.parse_list(f"<ul>{item}", "https://www.econacademics.org/en.html")
    assert title == "EconAcademics" and [(e["url"], e["title"], e["author"], e["published"]) for e in entries] == [("https://www.econacademics.org/p/1", "A", "Bo", 1704153600000), ("https://x.example/2", "C", "", None)]
    assert feeds.parse_list(f"<ul>{item}", "https://other.example/en.html") is None and feeds.parse_list(None, None) is None


def test_polling_gaps_cross_blocks(spark):
    import random

    rng = random.Random(6)
    log, at = [], 0
    for i in range(60):
        at += rng.randrange(1, 40) * 900_000
        log.append((1, i, at, rng.choice([0, 1])))
    df = spark.createDataFrame(log, "source_id long, seq long, at long, new_entries int")
    hours, last = 24.0, None
    for _, _, at, new in log:
        gap = None if last is None else (at - last) / 3_600_000
        hours = max(0.5, min(168.0, (gap if 0.5 <= gap <= 720 else hours) if new and gap is not None else hours * 1.3))
        last = at
    for block in (1, 7, 4096):
        assert state.poll_interval(df, F.lit(24.0), block).first().value == pytest.approx(hours)


def test_voices_are_found_whatever_opening_they_share(spark):
    import random

    rng = random.Random(8)
    heads = ["commonopening", "commonopeningof", "another"]
    names = [rng.choice(heads) + "".join(rng.choice("ab") for _ in range(rng.randrange(0, 6))) for _ in range(120)]
    c = [(i, n, f"d{i % 9}") for i, n in enumerate(names[:60])]
    s = [(i, n, f"d{100 + i}" if i % 10 else f"d{i % 9}") for i, n in enumerate(names[60:])]

    def same(a, b):
        return len(b) >= 6 and (a == b or len(a) >= 8 and len(b) >= 8 and (a in b or b in a))

    want = {i: min(j for j, m, e in s if same(n, m) or d == e) for i, n, d in c if any(same(n, m) or d == e for _, m, e in s)}
    got = fairness.duplicate_voices(spark.createDataFrame(c, "candidate_id long, name string, domain string"), spark.createDataFrame(s, "source_id long, name string, domain string"))
    assert {r.candidate_id: r.source_id for r in got.collect()} == want


def test_topic_scores_by_brute_force():
    import random
    import re

    rng = random.Random(4)
    pool = [t for terms in (*topics.STRONG.values(), *topics.SUPPORTING.values()) for t in terms]
    for _ in range(60):
        text = " ".join(rng.choice([rng.choice(pool), "word", "Ünï", "x,y", "+"]) for _ in range(rng.randrange(0, 40)))
        plain = " " + " ".join(re.findall(r"[a-z0-9+#.]+", text.lower())) + " "
        for topic in topics.TOPICS:
            want = sum(w * min(3, plain.count(f" {t} ")) for terms, w in ((topics.STRONG[topic], 2.4), (topics.SUPPORTING[topic], 0.75)) for t in terms)
            assert topics.term_score(topics.lexicon_text(text), topic) == pytest.approx(want)


def test_streamed_reads_are_the_batch_ones(spark, small):
    from inkwell.streaming import state as streaming

    path = f"{small}/events.parquet"
    schema = spark.read.parquet(path).schema

    def stream():
        return streaming.reads_of(streaming.event_stream(spark, f"{path}*", schema))

    raw = spark.read.parquet(path).where("event_type in ('view', 'click')")
    got = streaming.run_to_end(streaming.windowed_reads(stream()), "start", "author_key")
    want = raw.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour")["start"].alias("start"), F.concat(F.lit("author-"), F.col("user_id").cast("string")).alias("author_key")).agg(F.count("*").alias("reads"))
    assert sorted(map(tuple, got.select("start", "author_key", "reads").collect())) == sorted(map(tuple, want.collect()))
    once = streaming.run_to_end(streaming.first_reads(stream(), "10000 days"), "reader", "article_id")
    assert once.count() == raw.select("user_id", F.col("event_id") % 500).distinct().count()


def test_catalogs_are_read(spark, tmp_path):
    import json

    from inkwell.operators import crawl

    (tmp_path / "c.json").write_text(json.dumps([{"name": "A", "siteUrl": "https://a.example", "feedUrl": "https://a.example/f", "topic": "math"}, {"name": "B", "siteUrl": "https://b.example", "feedUrl": "https://b.example/f", "topic": "technology", "origin": "aggregator"}], indent=1))
    assert sorted(map(tuple, crawl.read_catalog(spark, str(tmp_path / "c.json")).collect())) == [("A", "https://a.example", "https://a.example/f", "math", None), ("B", "https://b.example", "https://b.example/f", "technology", "aggregator")]


def _with_cut_references(small, folder):
    """The small tables, with references cut before their semicolons, an unknown name and a number in every page's title and heading."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    for name in os.listdir(small):
        if name != "pages.parquet":
            os.symlink(f"{small}/{name}", folder / name)
    table = pq.read_table(f"{small}/pages.parquet")
    odd = " &amp;&lt;&#39; R&ampS &notit; &nosuch; a&b=1 &lt &#39 &amp"
    html = [h.replace("</title>", odd + "</title>", 1).replace("</h1>", odd + "</h1>", 1) for h in table["html"].to_pylist()]
    pq.write_table(table.set_column(table.column_names.index("html"), "html", pa.array(html)), folder / "pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["page_articles", "page_metadata"])
def test_pages_with_cut_references_give_what_sql_gives(spark, small, tmp_path, name):
    from conftest import same_as_sql

    from inkwell.plans import catalog

    same_as_sql(spark, _with_cut_references(small, tmp_path), catalog.queries()[name], catalog.oracle_sql()[name])


def test_references_without_semicolon():
    page = '<p class="&lt;">a&ampb &lt; &lt c &#65; &#65 &#x41; &notit; <a href="?a=1&amp;b=2">d</a></p>'
    assert pages.parse(page).text() == "a&b < < c A A A ¬it; d"
    strict = pages.parse(page, loose=False)
    assert strict.text() == "a&ampb < &lt c A &#65 A &notit; d"
    assert [x.attributes for x in strict.walk() if x.attributes] == [{"class": "<"}, {"href": "?a=1&b=2"}]


def test_pieces_keep_every_row_in_order():
    import pyarrow as pa

    from inkwell.functions.arrow import pieces

    rows = [(i, "ü" * n if n is not None else None) for i, n in enumerate([0, 3, 50, None, 7, 4, 0, 100, None, 5, 5, 5])]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows], pa.string())], ["id", "t"])
    parts = list(pieces([batch, batch.slice(0, 0), batch.slice(5)], 20))
    assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == rows + rows[5:]
    sizes = [[len((t or "").encode()) for t in p.column(1).to_pylist()] for p in parts]
    assert all(len(x) == 1 or sum(x) <= 20 for x in sizes) and len(parts) < len(rows) + 7


def _steps(frame):
    """Each page step's function of Arrow batches, with a batch for it."""
    import pyarrow as pa

    n, page = 400, "<title>T {0}</title><p>" + "word “é” {0} " * 2000 + "</p>"
    ids, html, url = pa.array(range(n)), pa.array([page.format(i) for i in range(n)]), pa.array(["https://x.example/"] * n)
    three, two = pa.RecordBatch.from_arrays([ids, url, html], ["page_id", "url", "html"]), pa.RecordBatch.from_arrays([ids, html], ["id", "html"])
    return [("articles", lambda: pages.articles(frame), three), ("metadata", lambda: pages.page_metadata(frame), three), ("column", lambda: pages.html_column(frame.select("page_id", "html"), "html", pages.sanitized_fragment), two), ("segments", lambda: pages.reader_segments(frame, "page_id", "html"), two), ("feeds", lambda: feeds.entries(frame, "page_id", "html"), two)]


@pytest.mark.parametrize("i", range(5))
def test_page_steps_make_little_of_a_large_batch_at_once(spark, monkeypatch, i):
    taken = []
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    plain = type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema, *a: (taken.append(f), plain(self, f, schema, *a))[1])
    name, build, batch = _steps(frame)[i]
    build()
    made = list(taken[0]([batch]))
    assert batch.nbytes > 10 << 20 and sum(b.num_rows for b in made) == batch.num_rows, name
    assert max(b.num_rows for b in made) < 60 and max(b.nbytes for b in made) < 4 << 20, name
    ids = [x for b in made for x in b.column(0).to_pylist()]
    assert ids == list(range(batch.num_rows)), name


def test_topic_scores_hold_one_text_at_a_time(spark):
    import tracemalloc

    import pyarrow as pa
    from pyspark.util import PythonEvalType

    plan = spark.createDataFrame([], "t string").select(topics.assess(F.col("t"), F.col("t"), F.col("t"), F.lit("math")))._jdf.queryExecution().executedPlan().toString()
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_UDF}\n" in plan  # arrays as they come, never a batch of Python strings
    n, text = 1000, "a proof of “the” prime number theorem in algebra; " * 240
    titles, heads, bodies = pa.array([f"Kernel {i}" for i in range(n)]), pa.array(["tax"] * n), pa.array([text] * n)
    tracemalloc.start()
    got = topics._raw(titles, heads, bodies)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert bodies.nbytes > 10 << 20 and peak < 2 << 20
    assert [tuple(x.values()) for x in got.to_pylist()] == [tuple(topics.raw_scores(f"Kernel {i}", "tax", text)) for i in range(n)]
    assert topics._raw(*[pa.array([], pa.string())] * 3).to_pylist() == []
