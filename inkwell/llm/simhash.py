"""SimHash near-dedup: pivot distance tables prune the pairs of a shared-block join; survivors are verified.

Fingerprints within `bits` differing bits agree in all but `bits` of any blocks the 64 bits are cut into. So each
distinct fingerprint goes to one group for every choice of 5 - 3 = 2 blocks out of 5, and every pair that links meets in
a group. In a group a table of Hamming distances to many fixed reference fingerprints is looked up: by the triangle
inequality a pair whose distances to some reference differ by more than `bits` cannot link. Pairs are formed along the
order of the first reference's distance, only as far as that difference allows, thrown out by their greatest coordinate
difference, and those left are compared bit by bit. A group gives out a spanning forest of its links, not its pairs.

A group of more than `limit` distinct fingerprints is cut further instead: the bits it does not share fall into blocks
of 3 bits, and for each choice of all but `bits` of them its members meet in a group of at most 8**bits fingerprints.
So no group and no task grows with the number of documents, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import connected_components, cut, local_roots, unused, whole_groups

#: Bits of the blocks that the first groups share two of.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BATCH = 1 << 15


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle of a text, with repeats: lower-cased A-Z; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "replace").translate(_UPPER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text: lower-cased A-Z, words, word shingles with repeats, XXH64; a bit is set if over half have it."""
    hashes = shingle_hashes(text, shingle, seed)
    n, ones = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, _BATCH):
        part = hashes[i : i + _BATCH]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint of every row as a signed long; text_hash: XXH64 of the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def references(n: int = 16, seed: int = 7) -> np.ndarray:
    """Fixed reference fingerprints, the pivots."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64)


def linked_pairs(keys: np.ndarray, fps: np.ndarray, bits: int, pivots: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Indices (i, j) of a spanning forest of the pairs of one key within `bits` bits."""
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], keys))
    keys, fps, table = keys[order], fps[order], table[order]
    # Where the rows end that share the key and whose first coordinate is at most `bits` more.
    place = np.unique(keys, return_inverse=True)[1].astype(np.int64) * 128 + table[:, 0]
    ends = np.searchsorted(place, place + bits, side="right")
    counts = ends - np.arange(len(fps)) - 1
    labels = np.arange(len(fps))
    left = np.flatnonzero(counts > 0)
    sums = np.cumsum(counts[left])
    begin = 0
    while begin < len(left):
        base = sums[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(sums, base + step)))
        some = left[begin:stop]
        i = np.repeat(some, counts[some])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts[some]) - counts[some], counts[some])
        for k in range(1, table.shape[1]):
            near = np.abs(table[i, k] - table[j, k]) <= bits
            i, j = i[near], j[near]
        true = np.bitwise_count(fps[i] ^ fps[j]) <= bits
        labels = local_roots(labels, i[true], j[true])
        begin = stop
    joined = np.flatnonzero(labels != np.arange(len(fps)))
    return np.stack([order[joined], order[labels[joined]]], axis=1)


def _bits(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _first_keys(bits: int) -> Column:
    if bits != 3:
        raise ValueError("the blocks are cut for 3 bits")
    return F.array(*(F.struct(F.lit(c).alias("c"), F.xxhash64(F.lit(c), *(_bits(F.col("fp"), *BLOCKS[i]) for i in kept)).alias("key")) for c, kept in enumerate(combinations(range(5), 2))))


def _finer_keys(c: int, bits: int) -> Column:
    """Keys of the groups that a large group of choice c is cut into."""
    kept = list(combinations(range(5), 2))[c]
    free = [b for i, (at, n) in enumerate(BLOCKS) if i not in kept for b in range(at, at + n)]
    parts = [sum(1 << b for b in free[i : i + 3]) for i in range(0, len(free), 3)]
    masks = []
    for gone in combinations(range(len(parts)), bits):
        mask = (1 << 64) - 1 - sum(parts[i] for i in gone)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return F.transform(F.array(*map(F.lit, masks)), lambda m: F.xxhash64(m, F.col("fp").bitwiseAND(m)))


def hamming_edges(distinct: DataFrame, bits: int = 3, limit: int = 4096, n_pivots: int = 16) -> DataFrame:
    """(src, dst): links whose components are those of all pairs of fp within `bits` bits. distinct: (fp long), distinct."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = references(n_pivots)
        for table in whole_groups(batches, "key"):
            if table.num_rows < 2:
                continue
            keys, fps = (table.column(x).to_numpy() for x in ("key", "fp"))
            many = np.flatnonzero(keys[1:] == keys[:-1])
            if not len(many):
                continue
            inside = np.union1d(many, many + 1)
            pairs = linked_pairs(keys[inside], fps[inside].view(np.uint64), bits, pivots)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(fps[inside][pairs[:, k]]) for k in (0, 1)], ["src", "dst"])

    def paired(rows: DataFrame) -> DataFrame:
        return rows.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(compare, "src long, dst long")

    keyed = distinct.select("fp", F.inline(_first_keys(bits)))
    large = cut(keyed.groupBy("c", "key").count().where(F.col("count") > limit).select("c", "key"))
    choices = sorted(r["c"] for r in large.select("c").distinct().collect())  # at most ten numbers
    edges = paired(keyed.join(large, ["c", "key"], "left_anti") if choices else keyed)
    for c in choices:
        hot = keyed.join(large.where(F.col("c") == c).select("key"), "key", "left_semi").where(F.col("c") == c)
        edges = edges.union(paired(hot.select("fp", F.explode(_finer_keys(c, bits)).alias("key")).distinct()))
    return edges


def by_fingerprint(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """marked (doc_id, text_hash, fp, ...) with component_id and is_head, given links (src, dst) between fingerprints.

    The head of a component is its least document by id, those without an id last, then by text_hash.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    distinct = cut(marked.groupBy("fp").agg(F.min(order).alias("least")))
    roots = connected_components(edges)
    members = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = members.groupBy("root").agg(F.min("least").alias("head"))
    # Texts without words all have fingerprint 0: its rows are dealt to many tasks.
    salts = F.when(F.col("fp") == 0, F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))
    classes = members.join(heads, "root").select("fp", "head", F.explode(salts).alias("salt"))
    salted = marked.withColumn("salt", F.when(F.col("fp") == 0, F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(64)).cast("int")).otherwise(F.lit(0)))
    return salted.join(classes, ["fp", "salt"]).select("doc_id", "fp", F.col("head.doc_id").alias("component_id"), "text_hash", (order == F.col("head")).alias("is_head"))


def near_duplicates(docs: DataFrame, bits: int = 3, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (signed long), component_id, text_hash, is_head: the classes of documents that chains of links join.

    component_id is the least doc_id of the class, is_head marks the row that has it. Texts without words, null or empty,
    have fingerprint 0 and link like any others. Equal fingerprints are one node, whatever their number, so a group of
    copies costs one row. Rows without an id come last in their class: component_id is null only where all are. Of rows
    that share an id the first by text_hash (XXH64 of the text) may be head, and rows equal in both are head together.
    Repeated rows give repeated rows; further columns are not carried. An empty table gives no rows.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    edges = cut(hamming_edges(marked.select("fp").distinct(), bits, limit))
    return by_fingerprint(marked, edges)


def one_of_each(docs: DataFrame, find: Callable[..., DataFrame] = near_duplicates, **settings) -> DataFrame:
    """docs without near-duplicates: the head of every class that find gives stays; columns as before.

    Rows equal in id and text are one document given several times and stay together. Null ids and texts, repeated ids
    and empty tables: as find says. No column is added, so none can clash.
    """
    id_, print_ = unused(docs, "_head", "_print")
    heads = find(docs, **settings).where("is_head").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(print_)).distinct()
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(print_))
    return docs.join(heads.hint("merge"), same, "left_semi")
