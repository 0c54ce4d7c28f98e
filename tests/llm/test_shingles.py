import random

import brute
import corpus_pipeline
import numpy as np
import pytest

from inkwell.llm import shingles


def test_texts_by_brute_force(spark):
    rng, docs = random.Random(5), []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 400))]
        for changes in (0, 1, 1, 2, 3, 4, 6):
            text = base[:]
            for _ in range(changes * len(base) // 100 + (changes > 0)):
                text[rng.randrange(len(text))] = "new"
            docs.append((len(docs), " ".join(text).title() if changes == 2 else " ".join(text)))
    docs += [(len(docs) + k, t) for k, t in enumerate(["", None, "a b", "A b", "x " * 40, "x " * 60])]
    want = brute.near_texts(docs)
    got = {r.doc_id: r.component_id for r in shingles.near_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and any(want[i] != x for i, x in brute.near_copies(docs).items())


def test_the_stage_takes_a_copy_of_eleven_bits(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id in (1, 177)")
    assert [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, small).collect()] == [1]


@pytest.mark.parametrize("chunk", [1 << 21, 900])
def test_a_dense_group_of_middling_copies(spark, monkeypatch, chunk):
    """Copies of one text with a mutual similarity on both sides of 0.8, in one block and in pairs of chunks."""
    rng, docs = random.Random(9), []
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    for k in range(90):
        text = base[:]
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            text[at] = f"x{k}"
        docs.append((k, " ".join(text)))
    plain = shingles.jaccard_edges
    monkeypatch.setattr(shingles, "jaccard_edges", lambda *a: plain(*a, chunk=chunk))
    got = {r.doc_id: r.component_id for r in shingles.near_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.near_texts(docs)


def test_linked_sets_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sets = [np.unique(rng.integers(0, 40, rng.integers(1, 60))) for _ in range(25)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        left, right = np.arange(12), np.arange(12, 25)
        for a, b in ((left, right), (np.arange(25), np.arange(25))):
            labels = shingles.linked_sets(np.concatenate(sets), ends, a, b, np.arange(25), cells=300)
            pairs = {(i, j) for i in a.tolist() for j in b.tolist()}
            want = brute.classes(list(range(25)), lambda i, j: ((i, j) in pairs or (j, i) in pairs) and 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j])))
            assert labels.tolist() == [want[i] for i in range(25)]
