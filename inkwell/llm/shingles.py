"""Near copies by word shingles: MinHash bands name pairs, and the shingle sets themselves decide.

A text is the set of its shingles of five words. Each distinct set gets `BANDS` keys of `ROWS` least hashes; sets that
share a key are compared exactly, so a link is never an estimate, and a pair of similarity 0.8 shares no key with
probability (1 - 0.8**ROWS)**BANDS = 7e-5, a nearer one less often. Only sets that share a key are made a second time, from
their texts; the others never leave their task. First each set is compared with the least set of its keys, which joins a
group of copies of any size at linear cost. Then the sets of a key that aren't in one component yet are compared within
tasks, in blocks by a matrix product, and only a spanning forest of their links leaves. A key with more than `chunk`
shingles is dealt to tasks as pairs of its chunks. No pair is left out. What is joined here grows with the documents on both
sides, so the joins are by sorted shuffle at every size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import connected_components, cut, local_roots, whole_groups
from inkwell.llm.simhash import by_fingerprint, fingerprint, hamming_edges, shingle_hashes

ROWS, BANDS = 5, 24
_BATCH = 1 << 12


def _laws(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, (ROWS * BANDS, 1), np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, (ROWS * BANDS, 1), np.uint64)


def band_keys(hashes: np.ndarray, laws: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """A signed key for each band of a set of hashes; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(ROWS * BANDS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), _BATCH):
        mixed = hashes[None, i : i + _BATCH] * laws[0] + laws[1]
        mixed ^= mixed >> np.uint64(31)
        least = np.minimum(least, (mixed * laws[0]).min(1))
    keys = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, text_hash, fp, node, n, bands) of every row: SimHash, digest and size of its set, and the set's keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        laws = _laws()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(2).to_pylist()
                sets = [np.unique(shingle_hashes(x, shingle)) for x in texts]
                prints = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
                nodes = np.fromiter(map(_digest, sets), np.int64, len(sets))
                bands = pa.array([band_keys(x, laws) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(prints), pa.array(nodes), pa.array(map(len, sets), pa.int64()), bands], ["doc_id", "text_hash", "fp", "node", "n", "bands"])

    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long, node long, n long, bands array<long>")


def _digest(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int = 5) -> DataFrame:
    """(node, hashes) of the documents of wanted (doc_id, text_hash, node)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [np.unique(shingle_hashes(x.as_py(), shingle)).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    named = wanted.select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), F.col("node").alias("_node"))
    same = docs[id_col].eqNullSafe(F.col("_i")) & (F.xxhash64(docs[text_col]) == F.col("_h"))
    return docs.select(id_col, text_col).join(named.hint("merge"), same).select("_node", text_col).mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of which four fifths of the union are shared."""
    x, y = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}s")) for c in "ab")
    shared = F.size(F.array_intersect("as", "bs"))
    return pairs.distinct().join(x.hint("merge"), "a").join(y.hint("merge"), "b").where(9 * shared >= 4 * (F.size("as") + F.size("bs"))).select("a", "b")


def linked_sets(flat: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray, labels: np.ndarray, cells: int = 1 << 23) -> np.ndarray:
    """labels after joining all pairs (of left, of right) of sets with a similarity of 0.8; set i is flat[ends[i]:ends[i + 1]]."""
    sizes = np.diff(ends)
    values, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.flatnonzero(counts > 1)  # what one set has alone is shared with none
    number = np.full(len(values), -1)
    number[common] = np.arange(len(common))
    column, row = number[place], np.repeat(np.arange(len(sizes)), sizes)
    row, column = row[column >= 0], column[column >= 0]
    starts = np.searchsorted(row, np.arange(len(sizes) + 1))
    step = max(8, min(512, cells // max(1, len(common))))

    def dense(sets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(common)), np.float32)
        for k, i in enumerate(sets.tolist()):
            out[k, column[starts[i] : starts[i + 1]]] = 1
        return out

    left, right = left[np.argsort(sizes[left], kind="stable")], right[np.argsort(sizes[right], kind="stable")]
    for a in range(0, len(left), step):
        some = left[a : a + step]
        high = np.searchsorted(sizes[right], sizes[some[-1]] * 5 // 4, side="right")
        low = np.searchsorted(sizes[right], -(-sizes[some[0]] * 4 // 5), side="left")
        mine = dense(some)
        for b in range(low, high, step):
            others = right[b : min(b + step, high)]
            if np.unique(labels[np.concatenate([some, others])]).size < 2:
                continue
            shared = mine @ dense(others).T
            p, q = np.nonzero(9 * shared >= 4 * (sizes[some][:, None] + sizes[others][None, :]))
            labels = local_roots(labels, some[p], others[q])
    return labels


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a spanning forest from (key, side, node, root, hashes), sorted by key."""
    for table in whole_groups(batches, "key"):
        keys = table.column("key").to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if b - a < 2:
                continue
            group = table.slice(a, b - a)
            side, node, root = (group.column(c).to_numpy() for c in ("side", "node", "root"))
            lists = group.column("hashes").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))])
            known = np.unique(root, return_index=True, return_inverse=True)
            before = known[1][known[2]]
            left, right = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
            labels = linked_sets(np.asarray(lists.flatten()), ends, left, right, before.copy())
            joined = np.flatnonzero(labels != before)
            if len(joined):
                yield pa.RecordBatch.from_arrays([pa.array(node[joined]), pa.array(node[labels[joined]])], ["a", "b"])


def jaccard_edges(docs: DataFrame, marked: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 21) -> DataFrame:
    """(src, dst): links whose components are those of all pairs of nodes with similarity 0.8. marked: sketches(docs)."""
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")).alias("rep")
    nodes = cut(marked.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), first_row))
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    heads = cut(keyed.groupBy("key").agg(F.count("*").alias("k"), F.min("node").alias("h")).where("k > 1").select("key", "h"))
    met = cut(keyed.join(heads.hint("merge"), "key"))
    wanted = cut(nodes.join(met.select("node").distinct().hint("merge"), "node", "left_semi").select("rep.doc_id", "rep.text_hash", "node"))
    held = cut(shingle_sets(docs, wanted, id_col, text_col))
    first = cut(_alike(met.where("node <> h").select(F.col("h").alias("a"), F.col("node").alias("b")), held))
    roots = connected_components(first.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "_node")
    left = cut(met.join(roots.hint("merge"), F.col("node") == F.col("_node"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")))
    mixed = left.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.sum("n").alias("all")).where("r0 <> r1")
    rest = left.join(mixed.select("key", F.ceil(F.col("all") / chunk).cast("int").alias("chunks")).hint("merge"), "key")
    rest = rest.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rest = rest.select("node", "root", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("with"))
    side = F.when(F.col("mine") == F.col("with"), 2).otherwise((F.col("mine") > F.col("with")).cast("int"))
    rest = rest.select("node", "root", side.alias("side"), F.xxhash64("key", F.least("mine", "with"), F.greatest("mine", "with")).alias("key"))
    dealt = rest.join(held.hint("merge"), "node").select("key", "side", "node", "root", "hashes").repartition("key").sortWithinPartitions("key")
    return first.union(dealt.mapInArrow(_blocks, "a long, b long")).toDF("src", "dst")


def near_texts(docs: DataFrame, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What near_duplicates gives, with links as well between texts whose 5-word sets have a similarity of 0.8.

    Nulls, empty texts, repeated rows and ids: as there. A text of fewer than five words is one shingle; texts without a
    word have the empty set, which is like no other.
    """
    marked = cut(sketches(docs, id_col, text_col))
    #: A set goes by the least fingerprint of its texts; equal sets may differ in their repeats and so in fingerprints.
    names = cut(marked.where("n > 0").groupBy("node").agg(F.min("fp").alias("name")))
    same = marked.join(names, "node").select(F.col("fp").alias("src"), F.col("name").alias("dst")).where("src <> dst").distinct()
    found = cut(jaccard_edges(docs, marked, id_col, text_col))
    for end in ("src", "dst"):
        found = found.join(names.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("name", f"_{end}")
    edges = hamming_edges(marked.select("fp").distinct(), bits).union(same).union(found.select("_src", "_dst"))
    return by_fingerprint(marked.select("doc_id", "text_hash", "fp"), cut(edges))
