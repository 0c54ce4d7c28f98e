import math

import brute
import corpus_pipeline
from test_operators import MODEL

from inkwell.llm import mixing, quality, sentencepiece


def test_pipeline_by_brute_force(spark, small):
    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    docs = {i: x for i, x in docs.items() if brute.quality(x[0], quality.BANDS)[-1]}
    left = brute.dedup_lines(sorted((i, x[0]) for i, x in docs.items()))
    docs = {i: (left[i], x[1]) for i, x in docs.items() if left[i] == x[0] or brute.words(left[i])}
    heads = brute.near_texts([(i, x[0]) for i, x in docs.items()])
    docs = {i: x for i, x in docs.items() if heads[i] == i}
    taken = mixed(docs)
    copies = {i: math.floor(taken[i] / len(brute.words(x[0])) + 0.5) for i, x in docs.items()}
    model = sentencepiece.Model(sentencepiece.read_pieces(MODEL))
    want = sorted((i, x[1], list(model.encode(x[0]))) for i, x in docs.items() for _ in range(copies[i]))
    rows = corpus_pipeline.run(spark, small).collect()
    assert sorted((r.doc_id, r.source, r.token_ids) for r in rows) == want and want


def mixed(docs):
    """{id: words taken} of {id: (text, source)}."""
    import hashlib

    size = {i: len(brute.words(t)) for i, (t, _) in docs.items()}
    mark = {i: hashlib.md5(f"42:{i}".encode()).hexdigest() for i in docs}
    shard = {i: int(m[16:24], 16) % 4 for i, m in mark.items()}
    totals = {}
    for i, (_, s) in docs.items():
        totals[s] = totals.get(s, 0) + size[i]
    target = brute.targets(totals)
    house = math.floor(sum(totals.values()) * 1.5 / 8 + 0.5)
    blocks = brute.highest_quotients(target, house)
    out = {}
    for s in totals:
        parts = {h: sum(size[i] for i in docs if docs[i][1] == s and shard[i] == h) for h in sorted({shard[i] for i in docs if docs[i][1] == s})}
        for h, q in brute.highest_quotients(parts, blocks[s]).items():
            quota, at = min(q, parts[h] * 2 // 8) * 8, 0
            for i in sorted((i for i in docs if docs[i][1] == s and shard[i] == h), key=lambda i: (mark[i][:16], size[i])):
                out[i] = quota // parts[h] * size[i] + max(0, min(at + size[i], quota % parts[h]) - at)
                at += size[i]
    return out


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_stages_with_odd_rows(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and ids, clashing columns, and no rows."""
    from pyspark.sql import functions as F

    prose = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars > 400 and lang = 'en'").orderBy("doc_id").select("text").limit(4)
    a, b, c, d = (r.text for r in prose.collect())
    rows = [(1, None, "s"), (2, "", None), (None, a, "s"), (None, b, None), (3, c, "t"), (3, c, "t"), (3, d, "t"), (4, c, None), (5, " \n ", "s"), (None, None, None), (6, "\n".join([b] * 300), "t")]
    docs = spark.createDataFrame([(i, t, None, s, None, 7, "x", 8) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, fp int, _doc string, taken int")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(map(repr, out.collect()))
        after = stage(spark, out, "")
        if name == "quality rules":
            assert all(r.text and r.text.strip() for r in after.collect()) and after.columns == docs.columns
        elif name == "line dedup":
            assert after.count() <= len(before)
        elif name == "SimHash near-dedup":
            kept = [(r.doc_id, r.text) for r in after.collect()]
            assert (4, c) not in kept and len(set(kept)) == len({t for _, t in kept}) and after.columns == docs.columns
        elif name == "source mix":
            times = {(r.doc_id, r.text): 0 for r in out.collect()}
            for r in after.collect():
                times[r.doc_id, r.text] += 1
            assert after.columns == docs.columns and sum(times.values()) > 0
        else:
            assert after.count() == len(before) and all(r.token_ids for r in after.collect())
        empty = stage(spark, docs.where(F.col("doc_id") > 99), "")
        assert empty.count() == 0
        out = after


def test_mix_keeps_rows_that_share_an_id_apart(spark):
    rows = [(None, f"word{k} " * (k + 1), s) for k in range(40) for s in ("a", "b")] + [(7, "x y z", "a"), (7, "p q r s", "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {}
    for r in corpus_pipeline.mix(spark, docs, "").collect():
        got[r.text, r.source] = got.get((r.text, r.source), 0) + 1
    share = {(r.text_hash, r.source): r.taken / r.size for r in mixing.mix_sources(docs).collect()}
    marks = {(r.text, r.source): r.h for r in docs.selectExpr("text", "source", "xxhash64(text) AS h").collect()}
    assert got == {k: math.floor(share[h, k[1]] + 0.5) for k, h in marks.items() if math.floor(share[h, k[1]] + 0.5)}
