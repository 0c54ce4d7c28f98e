"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, distributed components.

Two vectors at an angle a fall on the same side of a random hyperplane with probability 1 - a / pi. A table's code is
the signs for `planes` hyperplanes; a pair at the threshold's angle shares the code of a table with that probability to
the power of planes, and the number of tables is such that it shares at least one with probability `recall`. Nearer
pairs are found more surely.

What costs is to bring a vector to each of its tables, so buckets are as large as a task can compare by matrix products:
the number of planes follows the number of distinct vectors so that a code has about `bucket` of them, which keeps the
tables few (6 at 50,000 vectors, 33 at 1e8, 87 at 1e9). A vector travels as it is stored, without its codes, which
tasks compute anew. Products in single precision name the pairs near or above the threshold, and the cosine in double
precision decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import connected_components, cut, local_roots, whole_groups

#: Products of unit vectors in single precision are nearer than this to those in double precision, up to 10,000 components.
_SLACK = 2e-3


def tables_for(n: int, threshold: float, recall: float, bucket: int, least_planes: int = 2) -> tuple[int, int]:
    """(planes a table, tables) for n vectors."""
    planes = min(60, max(least_planes, round(math.log2(max(n, 1) / bucket))))
    side = 1 - math.acos(threshold) / math.pi
    return planes, math.ceil(math.log(1 - recall) / math.log(1 - side**planes))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    return np.asarray(lists.combine_chunks().flatten()).reshape(len(lists), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class _Codes:
    """The codes of unit vectors: for each table the signs for its hyperplanes, and the number of components."""

    def __init__(self, planes: int, tables: int, seed: int):
        self.planes, self.tables, self.seed = planes, tables, seed
        self.normals: dict[int, np.ndarray] = {}
        self.weights = 1 << np.arange(planes, dtype=np.int64)

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        dim = unit.shape[1]
        if dim not in self.normals:
            self.normals = {dim: np.random.default_rng([self.seed, dim]).standard_normal((dim, self.planes * self.tables))}
        out = np.empty((len(unit), self.tables), np.int64)
        for i in range(0, len(unit), 4096):
            part = unit[i : i + 4096]
            out[i : i + 4096] = ((part @ self.normals[dim] > 0).reshape(len(part), self.tables, self.planes) * self.weights).sum(2)
        return out


def _hashed(vectors: DataFrame, planes: int, tables: int, seed: int) -> DataFrame:
    """Adds codes, the code of each table, to vectors (..., embedding)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Codes(planes, tables, seed)
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.asarray(lists.value_lengths())
            found = np.zeros((batch.num_rows, tables), np.int64)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                found[rows] = coder(_unit(_matrix(pa.chunked_array([lists.take(pa.array(rows))]))))
            codes = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], [*batch.schema.names, "codes"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{columns}, codes array<long>")


def _linked(x: np.ndarray, single: np.ndarray, rows: np.ndarray, others: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (p of rows, q of others) with a cosine of threshold or more in double precision."""
    near = single[rows] @ single[others].T
    p, q = np.nonzero(near >= threshold - _SLACK)
    sure = near[p, q] >= threshold + _SLACK
    p, q = rows[p], others[q]
    for i in range(0, len(p), 1 << 16):
        doubt = i + np.flatnonzero(~sure[i : i + (1 << 16)])
        sure[doubt] = np.einsum("ij,ij->i", x[p[doubt]], x[q[doubt]]) >= threshold
    return p[sure], q[sure]


def _compared(rows: DataFrame, threshold: float, planes: int, tables: int, seed: int, step: int = 128) -> DataFrame:
    """(id, other, n) from the members of buckets: n vectors link to id, if n > 0; else id and other are linked.

    rows: (key, t, side, id, n, embedding); side 2: a bucket by itself, 0 and 1: the two chunks of a pair of chunks.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Codes(planes, tables, seed)
        for table in whole_groups(batches, "key"):
            keys = table.column("key").to_numpy()
            edges = np.flatnonzero(np.diff(keys)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
                if b - a < 2:
                    continue
                group = table.slice(a, b - a)
                one, side = group.column("t")[0].as_py(), group.column("side").to_numpy()
                ids, n = group.column("id").to_numpy(), group.column("n").to_numpy()
                x = _unit(_matrix(group.column("embedding")))
                single, codes = x.astype(np.float32), coder(x)
                alone = bool(side[0] == 2)
                left, right = (np.arange(len(side)),) * 2 if alone else (np.flatnonzero(side == k) for k in (0, 1))
                linked, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
                for i in range(0, len(left), step):
                    p, q = _linked(x, single, left[i : i + step], right[i + 1 :] if alone else right, threshold)
                    if alone:
                        p, q = p[p < q], q[p < q]
                    if one:  # a pair counts in the first table that both share
                        fresh = np.ones(len(p), bool)
                        for k in range(one):
                            fresh &= codes[p, k] != codes[q, k]
                        p, q = p[fresh], q[fresh]
                    np.add.at(linked, p, n[q])
                    np.add.at(linked, q, n[p])
                    labels = local_roots(labels, p, q)
                some, joined = np.flatnonzero(linked), np.flatnonzero(labels != np.arange(len(ids)))
                if len(some):
                    columns = [np.concatenate([ids[some], ids[joined]]), np.concatenate([ids[some], ids[labels[joined]]]), np.concatenate([linked[some], np.zeros(len(joined), np.int64)])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "other", "n"])

    return rows.mapInArrow(run, "id long, other long, n long")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.9995, bucket: int = 16384, chunk: int = 16384, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors.

    n_links: other vectors with cosine >= threshold found; component_id: the least vec_id that chains of links reach,
    itself included; kept: it is its own component_id. Vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing; vectors of different lengths never link. Equal vectors (by two 64-bit hashes) are one
    node with a weight, so a group of copies costs one row a table. A bucket over `chunk` members is dealt to tasks as
    pairs of its chunks, each pair of members once. Only counts of links and a spanning forest leave a bucket.

    Repeated rows count as vectors each. Rows that share an id but not the vector are one member with several vectors:
    they share a class, and each has the links of all of them besides its own copies. Null ids stand alone: no links,
    component null, kept false. No rows, no rows. Further columns are not carried.
    """
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    given = F.col(vector_col) if kind == "float" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), given.alias("embedding"))
    usable = rows.where(good & F.col("vec_id").isNotNull())
    # A zero of either sign is the same component.
    usable = usable.withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast("float" if kind == "float" else "double")))
    usable = usable.withColumns({"h": F.xxhash64("embedding"), "g": F.xxhash64(F.lit(1), "embedding")})
    planes, tables = tables_for(usable.agg(F.approx_count_distinct("h")).first()[0], threshold, recall, bucket)
    nodes = usable.groupBy("h", "g").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    nodes = cut(_hashed(nodes, planes, tables, seed))
    spot = nodes.select("id", "n", "embedding", F.size("embedding").alias("dim"), F.posexplode("codes").alias("t", "code"))
    sizes = nodes.select(F.size("embedding").alias("dim"), F.posexplode("codes").alias("t", "code")).groupBy("dim", "t", "code").agg(F.count("*").alias("k"))
    large = cut(sizes.where(F.col("k") > chunk).select("dim", "t", "code", F.ceil(F.col("k") / chunk).cast("int").alias("chunks")))
    spot = spot.join(large, ["dim", "t", "code"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    met = spot.select("id", "n", "embedding", "dim", "t", "code", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("with"))
    met = met.select("id", "n", "embedding", "t", F.when(F.col("mine") == F.col("with"), 2).otherwise((F.col("mine") > F.col("with")).cast("int")).alias("side"), F.xxhash64("dim", "t", "code", F.least("mine", "with"), F.greatest("mine", "with")).alias("key"))
    found = cut(_compared(met.repartition("key").sortWithinPartitions("key"), threshold, planes, tables, seed))
    links = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("found"))
    roots = connected_components(found.where("n = 0").select(F.col("id").alias("src"), F.col("other").alias("dst")))
    classes = nodes.select("h", "g", "id", (F.col("n") - 1).alias("copies")).join(links, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    classes = classes.select("h", "g", (F.col("copies") + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    joined = usable.select("vec_id", "h", "g").join(classes, ["h", "g"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    rest = rows.where(~F.coalesce(good & F.col("vec_id").isNotNull(), F.lit(False)))
    return joined.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")))
