"""Pieces that several operators share: cutting lineage, word patterns, grouped Arrow batches, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.shared import shared_dir

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor costs no recomputation of what is above.

    The files go when the JVM ends, or with release().
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(where)
    path, fs = _path(spark, where)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(where)
    out._cut = where
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of frames made by cut(); nothing may read them afterwards."""
    for df in frames:
        path, fs = _path(df.sparkSession, df._cut)
        fs.delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front as long as df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def text_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What stands for a row: (no_id, id, hash of the text), ordered by id with null last, and equal to itself throughout."""
    kind = docs.schema[id_col].dataType
    zero = F.lit("") if kind.simpleString() == "string" else F.lit(0).cast(kind)
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col), zero).alias("id"), F.xxhash64(F.col(text_col)).alias("print"))


def n_words(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup batches that are sorted by a long key so that no key is split over two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        start = int(np.searchsorted(keys, keys[-1]))
        if start == 0 and held and held[-1].column(key)[0].as_py() == keys[0]:
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, start)]) if held or start else pa.Table.from_batches([], batch.schema)
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def local_roots(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Join the classes of u[i] and v[i] for every i; labels[i] is the least index of i's class, before and after."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return labels
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (src long, dst long): root is the least node reachable.

    Alternates large-star and small-star steps until nothing changes, which takes a number of rounds near the
    logarithm of the longest path. Every step is an aggregation with a map-side part and an equi-join that
    adaptive execution can split; each round is written to the shared folder. Self-links and repeats are allowed.
    """
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        pairs = large.join(down, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        new = cut(pairs.select("p.u", "p.v").where("u <> v").distinct())
        release(e)
        e = new
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
