import json
import random
import struct

import brute
import pytest
from conftest import same_as_sql
from pyspark.sql import functions as F

from inkwell.llm import html, licenses, mixing, quality, queries, sentencepiece, sharding, simhash, tokencount
from inkwell.llm.common import connected_components, cut
from inkwell.llm.embeddings import near_vectors, tables_for
from inkwell.llm.license_texts import TEMPLATES
from inkwell.llm.linededup import dedup_lines

MODEL, RANKS = f"{queries.TOKENIZERS}/piece_bpe_32k.model", f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def pairs(spark, folder):
    return sorted((r.doc_id, r.text) for r in documents(spark, folder).collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_what_sql_gives(spark, small, name):
    same_as_sql(spark, small, queries.queries()[name], queries.oracle_sql()[name])


# 1 SentencePiece


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _message(fields):
    out = b""
    for k, v in fields:
        if isinstance(v, bytes):
            out += _varint(k << 3 | 2) + _varint(len(v)) + v
        elif isinstance(v, float):
            out += _varint(k << 3 | 5) + struct.pack("<f", v)
        else:
            out += _varint(k << 3) + _varint(v)
    return out


def unigram_library(pieces):
    """The library's own Unigram search over our pieces and scores."""
    import sentencepiece as library

    with open(MODEL, "rb") as f:
        raw = list(sentencepiece._fields(f.read()))
    out, at = [], 0
    for k, v in raw:
        if k == 1:
            piece = dict(sentencepiece._fields(v)) | {2: float(pieces[at][1])}
            v, at = _message(sorted(piece.items())), at + 1
        elif k == 2:
            v = _message([(a, 1 if a == 3 else b) for a, b in sentencepiece._fields(v)])
        out.append((k, v))
    return library.SentencePieceProcessor(model_proto=_message(out))


def test_encoding_scores_as_well_as_the_library(spark, small):
    pieces = sentencepiece.read_pieces(MODEL)
    model, lib = sentencepiece.Model(pieces), unigram_library(pieces)
    texts = [t for _, t in pairs(spark, small) if t] + ["héllo 世界 🙂 done", "a", "abc\n\ndef", "tab\there", "  two  spaces", "x" * 70]
    for t in texts:
        mine, other = list(model.encode(t)), lib.nbest_encode_as_ids(t, 1)[0]
        score = [sum(pieces[i][1] if pieces[i][2] == 1 else model.missing for i in ids) for ids in (mine, other)]
        assert mine == other or abs(score[0] - score[1]) < 1e-3 * len(t)
        assert model.decode(mine) == t
        assert model.decode(other) == lib.decode(other)


def test_many_words_at_once_are_the_same_search(spark, small):
    model = sentencepiece.Model(sentencepiece.read_pieces(MODEL))
    words = [w for _, t in pairs(spark, small)[:40] for w in model.split(" " + (t or ""))] + [" 🙂é", " 漢字", "a\0b", " " * 9]
    for w, ids in zip(words, model.best_of_many(words)):
        assert ids is None or ids == model.best(w.replace(" ", sentencepiece.MARK))


def test_trie_holds_its_keys_and_no_others():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choice(b"abc\xff") for _ in range(rng.randrange(1, 6))) for _ in range(300)})
    base, check, value = sentencepiece.double_array(keys)

    def find(key):
        state = 0
        for c in key:
            to = base[state] + c + 1
            if to >= len(check) or check[to] != state:
                return -1
            state = to
        return value[state]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert all(find(k + b"z") == -1 for k in keys)


def test_whole_text_search_where_words_can_not_be_cut():
    pieces = [("<unk>", 0.0, 2), ("a", -2.0, 1), ("▁", -3.0, 1), ("a▁b", -1.0, 1), ("b", -2.0, 1)]
    model = sentencepiece.Model(pieces)
    assert list(model.encode("a b")) == [2, 3]
    assert list(model.encode("zz a")) == [2, 0, 2, 1]


def test_encoded_documents(spark, small):
    df = sentencepiece.encode_documents(documents(spark, small), MODEL)
    rows, texts = df.collect(), dict(pairs(spark, small))
    model = sentencepiece.Model(sentencepiece.read_pieces(MODEL))
    assert len(rows) == len(texts)
    for r in rows:
        assert r.token_ids == list(model.encode(texts[r.doc_id])) and r.n_tokens == len(r.token_ids) and r.round_trip


# 2 SimHash


def test_simhash_by_brute_force(spark, small):
    docs = pairs(spark, small)
    want, prints = brute.near_copies(docs), {i: brute.simhash(t) for i, t in docs}
    rows = queries.op2_simhash_dedup(spark, small).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i, _ in docs}


@pytest.mark.parametrize("limit", [4096, 6])
def test_close_fingerprints_are_linked_in_any_group_size(spark, limit):
    rng = random.Random(3)
    prints = {0}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5])):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    edges = simhash.hamming_edges(df, limit=limit)
    roots = {r.node % 2**64: r.root for r in connected_components(edges).collect()}
    want = brute.classes(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    groups = {}
    for x in prints:
        groups.setdefault(want[x], set()).add(roots.get(x, ("alone", x)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (2001, 2000)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "src long, dst long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1300)) and got[2001] == got[2000] == 2000
    assert connected_components(df.where("src < 0")).count() == 0


# 3 quality rules


def test_quality_by_brute_force(spark, small):
    texts = dict(pairs(spark, small))
    for r in queries.op3_quality_bands(spark, small).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute.quality(texts[r.doc_id], quality.BANDS)


def test_bands_reject_both_ends():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    prose = " ".join(rng.choice(vocabulary) for _ in range(900))
    noise = " ".join("".join(chr(rng.randrange(0x21, 0x2FF)) for _ in range(12)) for _ in range(400))
    looped = " ".join(f"row {i} of the same table with the same words and value {i}" for i in range(500))
    rules = quality.Rules(max_repeat_percent=100)
    assert rules(prose)[-1] and not rules(noise)[-1] and not rules(looped)[-1]


def test_labelled_good_documents_stay(spark, small):
    good = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").collect()}
    assert all(r.kept or r.base_failed for r in queries.op3_quality_bands(spark, small).collect() if r.doc_id in good)


# 4 HTML

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h2>Site</h2><nav>menu</nav></header>
<div class="cookie-notice">We use cookies, lots of them, and this is long: very long, so long. Accept.</div>
<div id="wrap"><div class="post has-sidebar"><header><h1>Title &amp; more</h1><p class=byline>By me</p></header><p>First para, with <a href=x>link</a> and <b>bold</b>. Done.<p>Second<br>line.</p><ul><li>One<li>Two</ul><pre>code  x</pre>
<form>form</form><figure><img><figcaption>Caption</figcaption></figure><h2>Sub</h2>tail</div><aside>side</aside>
<section class="comments"><h3>Comments</h3><article class="comment"><p>Great post, thanks a lot. I really, really liked it.</p></article></section></div><footer>f</footer></body></html>"""


def test_article_without_furniture():
    assert html.main_text(PAGE) == "Title & more\nFirst para, with link and bold. Done.\nSecond line.\nOne\nTwo\ncode x\nCaption\nSub\ntail"


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<p>a</p><p>b", "a\nb"), ("<script>x</script>", ""), ("<div><div>Long para, one two three four five.</div><div>b</div></div>", "Long para, one two three four five.\nb"), ("<p title='a>b'>x &lt;y&gt;</p>", "x <y>"), ("<p>a<", "a<")])
def test_odd_pages(page, text):
    assert html.main_text(page) == text


def test_pages_of_the_table(spark, small):
    import re
    from html import unescape

    sources = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in queries.op4_html_extraction(spark, small).collect():
        article = re.sub(r"</?(p|h1)>", "\n", re.search(r"<article>(.*)</article>", sources[r.page_id], re.S)[1])
        lines = (" ".join(unescape(x).split()) for x in re.sub(r"<[^>]*>", " ", article).split("\n"))
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


# 5 token counts


def test_edits_count_like_the_whole_text():
    counter = tokencount.Counter(tokencount.read_ranks(RANKS))
    rng, letters = random.Random(3), list("ab  \n\t'sd1,. é")

    def some(n):
        return "".join(rng.choice(letters) for _ in range(n))

    for _ in range(400):
        tree = tokencount.TokenTree(some(rng.choice([0, 1, 5, 40, 200])), counter, leaf=rng.choice([1, 2, 3, 8]))
        for _ in range(5):
            at, drop, add = rng.randint(0, len(tree.text) + 2), rng.choice([0, 1, 3, 20, 500]), some(rng.choice([0, 1, 3, 30]))
            want = tree.text[:at] + add + tree.text[at + drop :]
            tree.edit(at, at + drop, add)
            assert tree.text == want and tree.tokens == len(counter.encode(want))


def test_an_edit_encodes_a_small_part():
    counter = tokencount.Counter(tokencount.read_ranks(RANKS))
    tree = tokencount.TokenTree("some words and more words, " * 4000, counter)
    tree.edit(50_000, 50_004, "others")
    assert tree.encoded < 2000 and tree.rebuilt == 0


def test_edited_documents(spark, small):
    texts, ranks = dict(pairs(spark, small)), tokencount.read_ranks(RANKS)
    counter = tokencount.Counter(ranks)
    for r in queries.op5_edit_token_counts(spark, small).collect():
        t = texts[r.doc_id]
        third, half = len(t) // 3, len(t) // 2
        assert r.n_tokens == len(counter.encode(t))
        first = t[:third] + t[half : half + 20] + t[third + 12 :]
        second = first[: third * 2] + " " + t[third : third + 30][::-1] + first[third * 2 :]
        assert r.n_tokens_after == len(counter.encode(second[5:])) and r.n_chars_after == len(second[5:])


# 6 sharding


def test_jump_shards_by_brute_force(spark):
    keys = [0, 1, -1, 5, 2**63 - 1, -(2**63), 123456789012345]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 100):
        one, more = sharding.jump_shards(F.col("k"), n, n + 1)
        for r in df.select("k", one.alias("a"), more.alias("b")).collect():
            assert (r.a, r.b) == (brute.jump(r.k % 2**64, n), brute.jump(r.k % 2**64, n + 1)) and (r.b == r.a or r.b == n)


def test_slots_have_no_gaps(spark, small):
    by = {}
    for r in queries.op6_jump_sharding(spark, small).collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and set(by) == set(range(16))


# 7 licences


def test_licences_of_documents(spark, small):
    want = {}
    for i, t in pairs(spark, small):
        for name, texts in TEMPLATES.items():
            for x in texts:
                if len(x) < 100 and t.count(x):
                    want[i, name] = want.get((i, name), 0) + t.count(x)
    got = {}
    texts = dict(pairs(spark, small))
    for r in queries.op7_license_scan(spark, small).collect():
        got[r.doc_id, r.license] = got.get((r.doc_id, r.license), 0) + 1
        assert licenses.words_of(texts[r.doc_id][r.start : r.end]) and r.coverage >= 0.8
    assert got == want


def test_changed_licences_are_found():
    index, rng = licenses.Index(TEMPLATES), random.Random(1)
    words = TEMPLATES["MIT"][2].split()
    for i in rng.sample(range(len(words)), 12):
        words[i] = "zzz"
    for i in sorted(rng.sample(range(len(words)), 4), reverse=True):
        del words[i]
    text = "Éa foo İ bar. " + " ".join(words) + " tail. Licensed under CC BY 4.0 ok"
    got = licenses.scan(text, index)
    assert [x[0] for x in got] == ["MIT", "CC-BY-4.0"] and text[got[0][4] : got[0][5]].startswith("Permission") and text[got[1][4] : got[1][5]] == "Licensed under CC BY 4.0"
    assert licenses.scan("Nothing of the kind is granted to any person", index) == [] == licenses.scan(None, index)


# 8 embeddings


@pytest.mark.parametrize(("chunk", "bucket"), [(16384, 16384), (1024, 16), (7, 100000)])
def test_vectors_by_brute_force(spark, chunk, bucket):
    import numpy as np

    rng = np.random.default_rng(0)
    x = [b + rng.standard_normal(32) * s for b in rng.standard_normal((30, 32)) for s in (0, 0, 0.1, 0.2, 0.3, 0.35)]
    x += [None, [0.0] * 32, [float("nan")] * 32, [float("inf")] * 32, [1.0, None] + [0.0] * 30, [], [1.0] * 5, [1.0] * 5, [1e300] * 5]
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "clash") for i, v in enumerate(x)]
    good = {i: np.array(v) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: v / np.abs(v).max() for i, v in good.items()}
    unit = {i: v / np.sqrt(v @ v) for i, v in unit.items()}

    def linked(a, b):
        return a in unit and b in unit and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9

    want, degree = brute.classes([i for i, _, _ in rows], linked), {a: sum(a != b and bool(linked(a, b)) for b in unit) for a in range(len(rows))}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, chunk=chunk, bucket=bucket).collect()}
    assert got == {i: (degree[i], want[i], want[i] == i) for i in want}


@pytest.mark.parametrize(("n", "dim"), [(3000, 16), (20000, 48)])
def test_recall_and_links_against_all_pairs(spark, n, dim):
    import numpy as np

    rng = np.random.default_rng(n)
    centres = rng.standard_normal((n // 10, dim))
    x = (centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, dim)) * rng.choice([0.05, 0.2, 0.3, 0.35], (n, 1))).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = 0
    want = np.zeros(n, np.int64)
    for i in range(0, n, 500):
        near = unit[i : i + 500] @ unit.T >= 0.9
        want[i : i + 500] = near.sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    got = np.zeros(n, np.int64)
    for r in near_vectors(df, bucket=512).collect():
        got[r.vec_id] = r.n_links
    assert (got <= want).all() and got.sum() >= 0.999 * want.sum() > 0


def test_tables_follow_the_recall():
    import math

    side = 1 - math.acos(0.9) / math.pi
    for n in (1, 100, 50_000, 10_000_000, 10**9):
        planes, tables = tables_for(n, 0.9, 0.9995, 16384)
        assert 1 - (1 - side**planes) ** tables >= 0.9995 and n / 2**planes <= 2 * 16384


def test_vectors_with_odd_rows(spark):
    rows = [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (5, [1.0, 0.01]), (5, [0.0, 1.0]), (9, [0.01, 1.0]), (None, [1.0, 0.0]), (3, [-0.0, 2.0]), (4, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, component_id string")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())
    assert got == [(0, 0, None, False), (3, 2, 3, True), (4, 0, 4, True), (5, 4, 3, False), (5, 4, 3, False), (7, 2, 3, False), (7, 2, 3, False), (9, 2, 3, False)]
    assert near_vectors(df.where("vec_id > 50")).count() == 0


# 9 line dedup


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(7)
    for least in (6, 50):
        pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 7, 30, 60]))) for _ in range(60)]
        docs = []
        for i in range(60):
            lines = [rng.choice(pool) if rng.random() < 0.3 else " ".join(str(rng.random()) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(12))]
            if docs and rng.random() < 0.7:
                old = rng.choice(docs)[1].split("\n")
                a = rng.randrange(len(old))
                lines[len(lines) // 2 : len(lines) // 2] = [*old[a : a + rng.randrange(1, 9)], *rng.choice([[], ["", " \t"]])]
            docs.append((i, "\n".join(lines)))
        docs.append((100, "same line of words here\n" * 30))
        df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, pos string")
        got = {r.doc_id: r.text for r in dedup_lines(df, min_words=least).collect()}
        assert got == brute.dedup_lines(docs, least)


# 10 mixing


def test_mix_meets_its_targets(spark, small):
    for folder_rows in (queries.op10_source_mix(spark, small).collect(),):
        sources = {r.doc_id: r.source for r in documents(spark, small).collect()}
        texts = dict(pairs(spark, small))
        sizes, taken, said = {}, {}, {}
        for r in folder_rows:
            s = sources[r.doc_id]
            assert r.size == len(brute.words(texts[r.doc_id])) and 0 <= r.taken <= 2 * r.size
            sizes[s] = sizes.get(s, 0) + r.size
            taken[s] = taken.get(s, 0) + r.taken
            said[s] = (r.source_size, r.target)
        want = brute.targets(sizes)
        for s in sizes:
            assert said[s] == (sizes[s], pytest.approx(want[s])) and abs(taken[s] - want[s]) <= 8 * 5


@pytest.mark.parametrize("house", [0, 1, 7, 50, 1000])
def test_seats_go_to_the_highest_quotients(spark, house):
    rng = random.Random(house)
    votes = {f"p{i}": rng.choice([0, 1, 5, 5, 90, 1000 * rng.random()]) for i in range(12)}
    df = spark.createDataFrame([(k, float(v)) for k, v in votes.items()], "party string, votes double")
    got = {r.party: r.seats for r in mixing.sainte_lague(df, "votes", F.lit(house), [], "party").collect()}
    assert got == brute.highest_quotients({k: v for k, v in votes.items()}, house)


def test_reruns_agree(spark, small):
    a, b = (sorted(map(tuple, queries.op10_source_mix(spark, small).collect())) for _ in range(2))
    assert a == b


# every operator: nulls, empty and long texts, repeated rows, clashing columns, no rows


@pytest.fixture(scope="module")
def odd(spark):
    long = "\n".join(f"line {i} of a very long text with number {i * i}" for i in range(6000))
    rows = [(1, None, None), (2, "", "a"), (None, "a text without an id " * 30, "a"), (None, None, None), (3, "same\ntext " * 40, "b"), (3, "same\ntext " * 40, "b"), (4, "same\ntext " * 40, None), (5, long, "b"), (6, " \n\t ", "c"), (3, "another text under the same id", "b")]
    return spark.createDataFrame([(i, t, s, "x", 1, 2, "y", "z", 5, "q") for i, t, s in rows], "doc_id long, text string, source string, doc string, fp int, pos int, size string, slot string, n_words int, taken string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(0).cast("long"))


def operators(docs):
    edited = docs.withColumn("edits", F.array(F.struct(F.lit(1).alias("at"), F.lit(None).cast("int").alias("drop"), F.lit("x").alias("add")), F.lit(None).cast("struct<at:int,drop:int,add:string>")))
    return {
        "encode": lambda: sentencepiece.encode_documents(docs, MODEL), "near": lambda: simhash.near_duplicates(docs), "quality": lambda: quality.quality_rules(docs), "count": lambda: tokencount.count_edited(edited, RANKS),
        "shard": lambda: sharding.shard_documents(docs), "lines": lambda: dedup_lines(docs), "mix": lambda: mixing.mix_sources(docs),
    }


@pytest.mark.parametrize("name", ["encode", "near", "quality", "count", "shard", "lines", "mix"])
def test_odd_rows_give_a_row_each(odd, name):
    df = operators(odd)[name]()
    assert df.count() == 10
    assert operators(odd.where("doc_id > 99"))[name]().count() == 0


def test_odd_rows_give_what_the_docstrings_say(odd):
    near = [(r.doc_id, r.fp, r.component_id) for r in operators(odd)["near"]().collect()]
    heads = simhash.one_of_each(odd)
    assert sorted((r.doc_id or 0) for r in heads.collect()) == [0, 1, 3, 3, 3, 5]
    assert {c for i, f, c in near if f == 0} == {1} and {c for i, f, c in near if i in (3, 4) and c == 3} == {3}
    lines = operators(odd)["lines"]().collect()
    keys = {(r.doc_id is None, r.doc_id or 0, r.h): r.text for r in odd.withColumn("h", F.xxhash64("text")).collect()}
    want = brute.dedup_lines(list(keys.items()))
    got = {(r.doc_id, keys[k], r.text) for r in lines for k in keys if (r.doc_id is None, r.doc_id or 0) == k[:2] and want[k] == r.text}
    assert {(k[1] or None, t, want[k]) for k, t in keys.items()} <= {(i or None, t, x) for i, t, x in got} and len(lines) == 10
    quality_rows = operators(odd)["quality"]().collect()
    assert all(r.base_failed and not r.kept for r in quality_rows if r.n_words == 0)
    mix = operators(odd)["mix"]().collect()
    assert all(r.taken <= 2 * r.size for r in mix)
    shards = operators(odd)["shard"]().collect()
    assert len({r.shard for r in shards if r.doc_id == 3}) == 1
    assert licenses.scan_licenses(odd).count() == 0
    assert sorted(r.n_chars for r in html.extract_pages(odd.withColumnRenamed("text", "html"), "doc_id", "html", ()).collect())[:3] == [0, 0, 0]


def test_cut_keeps_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    assert sorted(map(tuple, cut(df).collect())) == [(1, None), (2, "x")]
    assert json.loads("[]") == cut(df.where("a > 5")).collect()
