import pytest

from inkwell.llm import html


def said(n, word):
    return (f"{word} text, with a few words more. " * (n // 20 + 1))[:n].strip()


INTRO, OUTRO, ITEMS = said(300, "Intro"), said(200, "Outro"), [said(100, f"Item {k}") for k in range(10)]
LIST = "".join(f"<li>{x}</li>" for x in ITEMS)
ROWS = "".join(f"<tr><td>{x}</td></tr>" for x in ITEMS)
TERMS = "".join(f"<dd>{x}</dd>" for x in ITEMS)
BODY = "".join(f"<p>{x}</p>" for x in ITEMS)


@pytest.mark.parametrize("outer", ["article", "main", "div", "section", "div class='post'"])
@pytest.mark.parametrize("parts", [f"<ul>{LIST}</ul>", f"<table>{ROWS}</table>", f"<dl>{TERMS}</dl>", f"<section class=body>{BODY}</section>"])
def test_text_beside_a_long_part_stays(outer, parts):
    page = f"<body><nav>Menu</nav><{outer}><h1>Title</h1><p>{INTRO}</p>{parts}<p>{OUTRO}</p></{outer.split()[0]}><footer>f</footer></body>"
    got = html.main_text(page).split("\n")
    assert got == ["Title", INTRO, *ITEMS, OUTRO]


def test_an_intro_section_beside_a_longer_one_stays():
    page = f"<article><h1>T</h1><section class=intro><p>{INTRO}</p></section><section class=body>{BODY}</section></article>"
    assert html.main_text(page).split("\n") == ["T", INTRO, *ITEMS]


BODY_TEXTS = [said(150, f"Para {k}") for k in range(6)]
PARAS = "".join(f"<p>{x}</p>" for x in BODY_TEXTS)
NAMES = ["content with-sidebar", "post share-on", "layout sidebar-right", "story-with-ad", "hentry comments-open", "x17", "widget", "a-b"]


@pytest.mark.parametrize("name", NAMES)
def test_a_body_beside_the_page_header_stays_whatever_its_class(name):
    page = f"<body><header><h1>Site</h1></header><div class='{name}'>{PARAS}</div><footer>f</footer></body>"
    assert html.main_text(page).split("\n") == BODY_TEXTS


@pytest.mark.parametrize("name", NAMES)
def test_unnamed_menus_adverts_and_comments_go(name):
    page = f"""<body><div class="q1"><div class='{name}'><ul><li>Home<li>About</ul><h1>Head</h1>{PARAS}<div>Buy now</div><ul><li><a href=a>More</a><li><a href=b>Stuff</a></ul></div>
    <div class=q2><h3>3 Comments</h3><div class=r><p>Nice one, thank you so much. I did like it a lot, really.</p></div></div>
    <div class=q3><b>Advertisement</b><p>Everything is cheap, today only.</p></div></div><footer>f</footer></body>"""
    assert html.main_text(page).split("\n") == ["Head", *BODY_TEXTS]


@pytest.mark.parametrize("kind", ["<aside>{}</aside>", "<nav>{}</nav>", "<div class='comment-list'>{}</div>", "<div role=complementary>{}</div>", "<div hidden>{}</div>", "<div style='display: none'>{}</div>", "<form>{}</form>", "<section id=related-posts>{}</section>", "<article>{}</article>"])
def test_longer_furniture_beside_an_article_goes(kind):
    other = "".join(f"<p>{said(90, f'Other {k}')}</p>" for k in range(4))
    page = f"<body>{kind.format(other)}<article><h1>Head</h1>{PARAS}{kind.format(other) if 'article' not in kind else ''}</article>{kind.format(other)}</body>"
    assert html.main_text(page).split("\n") == ["Head", *BODY_TEXTS]


@pytest.mark.parametrize("page", [f"<body><form id=aspnet><h1>Head</h1>{PARAS}<input></form></body>", f"<body><main><header><h1>Head</h1><p>By me</p></header>{PARAS}</main></body>", f"<body><h1>Head</h1><article>{PARAS}</article></body>", f"<body><div class=page><div class=t><h1>Head</h1></div><div>{PARAS}</div></div></body>"])
def test_wrapped_articles(page):
    assert html.main_text(page).split("\n") == ["Head", *BODY_TEXTS]


def test_links_in_prose_and_lists_in_an_article_stay():
    page = f"<article><h1>H</h1><p>See <a href=x>the long report of the whole matter</a>, please.</p>{PARAS}<h2>Items</h2><ul><li>eggs<li>flour</ul><p>{OUTRO}</p><ul><li><a href=1>a</a><li><a href=2>b</a></ul></article>"
    assert html.main_text(page).split("\n") == ["H", "See the long report of the whole matter, please.", *BODY_TEXTS, "Items", "eggs", "flour", OUTRO]


def test_scores_by_brute_force():
    import math
    import random

    rng = random.Random(1)
    blocks = [(rng.randrange(6), said(rng.randrange(1, 200), "word"), rng.choice([0, 0, 1])) for _ in range(40)]
    order = []
    for b in blocks:
        order += [b[0]] if b[0] not in order else []
    length = {k: sum(len(t) - x for j, t, x in blocks if j == k) for k in order}
    nodes = {k: sum(j == k for j, _, _ in blocks) for k in order}
    marks = {k: sum(c in html.PUNCTUATION for j, t, _ in blocks if j == k for c in t) for k in order}

    def smooth(of, k):
        near = [(math.exp(-(d * d) / 2), order[order.index(k) + d]) for d in range(-2, 3) if 0 <= order.index(k) + d < len(order)]
        return sum(w * of(x) for w, x in near) / sum(w for w, _ in near)

    got = html.path_scores(blocks)
    for k in order:
        own = math.sqrt(length[k] / nodes[k] * length[k]) * (1 + marks[k] / nodes[k])
        wide = math.sqrt(smooth(lambda x: length[x] / nodes[x], k) * smooth(lambda x: length[x], k)) * (1 + smooth(lambda x: marks[x] / nodes[x], k))
        assert got[k] == (pytest.approx(math.sqrt(own * wide)), marks[k], pytest.approx(length[k] / nodes[k]))


@pytest.mark.parametrize("part", ["<div>a ", "<a \"<b '", "<div class='x y'>a, <p>b ", "<li>a", "<ul><li>", "<main>x", "</p><div>", "<a href=x>"])
def test_time_grows_with_length_only(part):
    import time

    def took(n):
        start = time.process_time()
        html.main_text(part * n)
        return time.process_time() - start

    took(1000)
    assert took(16000) < 6 * took(4000) + 0.5


def test_a_page_of_five_thousand_levels():
    assert html.main_text("<div>" * 5000 + f"<p>{INTRO}</p>" + "</div>" * 5000) == INTRO


def test_tables_of_pages_with_odd_rows(spark):
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>One, two.", "t"), (2, "v", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(repr, html.extract_pages(df).collect())) == sorted(["Row(page_id=1, url='u', text='', n_chars=0)"] * 2 + ["Row(page_id=None, url=None, text='One, two.', n_chars=9)", "Row(page_id=2, url='v', text='', n_chars=0)"])
    assert html.extract_pages(df.where("page_id > 5")).count() == 0
