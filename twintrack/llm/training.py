"""Bounded, documented samples of labelled rows to fit a classifier on; the same rows at every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle


def remainder(doc_id: str, k: int):
    """crc32 of the id's text, mod k."""
    return F.crc32(F.col(doc_id).cast("string")) % k


def _smallest(known: DataFrame, count: dict, rows: int, order) -> DataFrame:
    """The ``rows`` rows of each class of ``known(doc_id, y)`` that come first in ``order``, a hash.

    Only rows below a hash are ranked, so no class is sorted whole; if they are too few, which is rare, those below twice that hash are.
    """
    spark, wide = known.sparkSession, rows + 6 * rows**0.5 + 50
    while True:
        cut = [(y, min(2**63 - 1, int(wide / n * 2**64) - 2**63)) for y, n in count.items()]
        below = spark.createDataFrame(cut, f"y {dict(known.dtypes)['y']}, _cut long")
        some = known.join(F.broadcast(below), "y").where(order <= F.col("_cut"))  # one row for each class
        ranked = some.withColumn("_at", F.row_number().over(Window.partitionBy("y").orderBy(order, "doc_id"))).where(F.col("_at") <= rows)
        picked = settle(ranked.select("doc_id", "y"))
        have = {r.y: r.n for r in picked.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if all(have.get(y, 0) >= min(rows, n) for y, n in count.items()):
            return picked
        wide *= 2


def sample(docs: DataFrame, labels: DataFrame, rows: int, most_bytes: int, most_classes: int = 1000) -> DataFrame:
    """(doc_id, y, text) of at most ``rows`` labelled documents of each class, and ``most_bytes`` of text of each.

    ``labels(doc_id, y)`` has the rows that may be learned from. The rows with the smallest hash of the id are taken; a row
    that would pass the byte bound is left out, the text of a taken one is whole. Null labels, ids and texts are not taken. More than ``most_classes`` classes are an error, as none is left out.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2"))
    known = settle(known.where("y = y2").select("doc_id", "y"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    count = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).orderBy("y").limit(most_classes + 1).collect()}
    if len(count) > most_classes:
        raise ValueError(f"more than {most_classes} classes to learn from")
    kind = dict(docs.dtypes)["doc_id"]
    if not count:
        return spark.createDataFrame([], f"doc_id {kind}, y int, text string")
    picked = _smallest(known, count, rows, order)  # rows x classes ids at most
    found = settle(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text"))
    left = dict.fromkeys(count, most_bytes)
    keep = []
    sizes = found.groupBy("doc_id", "y").agg(F.max(F.octet_length("text")).alias("n"))
    for r in sizes.orderBy(order, "doc_id").collect():
        if r.n <= left[r.y]:
            left[r.y] -= r.n
            keep.append((r.doc_id, r.y))
    chosen = spark.createDataFrame(keep, f"doc_id {kind}, _y {dict(known.dtypes)['y']}")
    return found.join(F.broadcast(chosen.select("doc_id")), "doc_id").select("doc_id", "y", "text")
