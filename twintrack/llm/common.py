"""Shared pieces of the training-data operators: scratch tables, hashing, union-find, connected components."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are split into words at once.
PIECE = 1 << 20
_WHITE = re.compile(rb"\s")
_KEPT: dict = {}
#: Rows of one Arrow batch. Texts may be long, so a batch is kept to a few MB.
ARROW_ROWS = 400


def scratch(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    The setting names a shared store on a cluster. Only on a single machine may it be unset; then a local folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/tt-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that go to Python workers small, as whole texts travel in them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives None."""
    return column.cast(pa.binary()).to_pylist()


def slices(lengths: list[int], most: int = 4_000_000):
    """Split rows into runs of about ``most`` bytes, a longer row alone in its run."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def pieces(text: bytes, most: int = PIECE):
    """A long text in pieces of about ``most`` bytes that end at white space, so that no word is cut."""
    at = 0
    while len(text) - at > most:
        m = _WHITE.search(text, at + most)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def kept(key, make):
    """What this worker process keeps under ``key`` from task to task. It keeps things of one operator at a time: others go."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def fold(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Union the pairs (u, v) into ``parent``, in place. parent maps each item to the smallest item of its class."""
    while u.size:
        ru, rv = parent[u], parent[v]
        apart = ru != rv
        if not apart.any():
            return
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Contraction rounds: each node that has a smaller neighbour hooks to its smallest one, the resulting forest is flattened by
    pointer jumping, and edges are renamed to roots. At least half of the nodes of a component leave in a round, so the
    rounds are logarithmic. All steps are joins and aggregates with map-side combine; nothing reaches the driver but counts.
    Nulls and self-loops are ignored. No edges give no rows.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    pairs = settle(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    label = None
    while not pairs.isEmpty():
        up = settle(pairs.groupBy("a").agg(F.min("b").alias("p")))
        while True:
            over = up.alias("x").join(up.alias("y"), F.col("x.p") == F.col("y.a"), "left")
            up = settle(over.select("x.a", F.coalesce("y.p", "x.p").alias("p"), F.col("y.p").isNotNull().alias("moved")))
            moved = not up.where("moved").isEmpty()
            up = up.drop("moved")
            if not moved:
                break
        small = pairs.select(F.col("b").alias("a")).distinct().join(up, "a", "left_anti").select("a", F.col("a").alias("p"))
        now = up.unionByName(small)
        if label is None:
            label = settle(now.select(F.col("a").alias("node"), F.col("p").alias("root")))
        else:
            label = settle(label.join(up, label.root == up.a, "left").select("node", F.coalesce("p", "root").alias("root")))
        first = pairs.join(up, "a").select(F.col("p").alias("x"), "b")
        both = first.join(up.withColumnsRenamed({"a": "b", "p": "q"}), "b", "left").select("x", F.coalesce("q", "b").alias("y"))
        both = both.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        pairs = settle(both.distinct())
    return label if label is not None else pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
