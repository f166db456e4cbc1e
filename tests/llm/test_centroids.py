"""Centroid clustering against a plain program with Python's whole numbers, the searched balls against a full scan, and edge cases."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twintrack.llm import centroids

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, count=16, rounds=3):
    points = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(points, key=lambda p: (p[0] is None, hashlib.sha256(f"1:{p[0]}".encode()).hexdigest(), p[1]))[:count]
    c = [q for _, q in first]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, m)), k) for k, m in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, q in points:
            groups.setdefault(nearest(q)[1], []).append(q)
        c = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else m for k, m in enumerate(c)]
    found = [(i, *nearest(q)[::-1]) for i, q in points]
    inertia = {}
    for _, k, d in found:
        inertia[k] = inertia.get(k, 0) + d
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, k, d in found), key=str)


def vectors(seed, n, spread):
    r = random.Random(seed)
    heads = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [x + r.uniform(-spread, spread) for x in r.choice(heads)]) for i in range(n)]


def answers(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("x")).withColumn("q", F.lit(1)).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = sorted((tuple(r[n] for n in names) for r in centroids.query(spark, str(folder)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    return got, sorted(con.execute(f"select {', '.join(names)} from ({centroids.ORACLE})").fetchall(), key=str)


@pytest.mark.parametrize("rows", [vectors(1, 150, 0.4), vectors(2, 90, 0.0), vectors(3, 9, 0.2), [(i, [0.25] * 64) for i in range(40)]], ids=["spread", "copies", "few", "one"])
def test_clusters_are_those_of_a_plain_program(spark, tmp_path, rows):
    got, sql = answers(spark, tmp_path, rows)
    want = plain(rows)
    assert got == want
    assert sql == want


def test_odd_vectors_are_left_out(spark, tmp_path):
    rows = vectors(4, 40, 0.3)
    odd = [(100, None), (101, [1.0] * 63), (102, [float("nan")] * 64), (103, [float("inf")] + [0.0] * 63), (104, [None] + [0.0] * 63), (105, [0.0] * 64), (3, rows[3][1]), (3, rows[3][1]), (7, rows[5][1])]
    got, _ = answers(spark, tmp_path, rows + odd)
    assert got == plain(rows + odd)
    assert {100, 101, 102, 103, 104}.isdisjoint(r[0] for r in got)


def test_null_ids_come_last_and_no_rows_give_none(spark):
    rows = [(None, [0.5] * 64), *vectors(5, 3, 0.3)]
    found, c = centroids.cluster(spark.createDataFrame(rows, SCHEMA), count=3)
    assert found.count() == 4 and len(c) == 3
    assert [32] * 64 not in centroids.first_centroids(centroids.points(spark.createDataFrame(rows, SCHEMA)), 3).tolist()
    found, c = centroids.cluster(spark.createDataFrame([], SCHEMA))
    assert found.collect() == [] and not len(c)


def test_components_that_are_too_large_are_refused(spark):
    with pytest.raises(ValueError, match="exactly"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], SCHEMA))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 6), st.sampled_from([3, 40, 1 << 24]))
def test_balls_find_what_a_scan_finds(seed, count, size, span):
    """Small grids have many ties and equal centroids."""
    r = np.random.default_rng(seed)
    c, x = r.integers(-span, span + 1, (count, size)), r.integers(-span, span + 1, (200, size))
    ball = centroids.Ball(c)
    cluster, d2, second = ball.all(x)
    upper = np.sqrt(d2.astype(float))
    for _ in range(4):
        c2 = ball.c + r.integers(-max(1, span // 3), max(1, span // 3) + 1, ball.c.shape)
        moved = np.sqrt(((c2 - ball.c) ** 2).sum(1).astype(float)) * (1 + 1e-9)
        others = np.array([np.delete(moved, k).max(initial=0.0) for k in range(count)])
        ball = centroids.Ball(c2)
        cluster, upper, second, *_ = ball.search(x, cluster, (upper + moved[cluster]) * (1 + 1e-9), second - others[cluster] * (1 + 1e-9))
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c2] for p in x], object)
        assert cluster.tolist() == [min(range(count), key=lambda k: (row[k], k)) for row in exact]


def test_balls_leave_vectors_and_centroids_out():
    r = np.random.default_rng(1)
    c, x = r.integers(-3000, 3000, (64, 2)), r.integers(-3000, 3000, (3000, 2))
    ball = centroids.Ball(c)
    cluster, d2, second = ball.all(x)
    upper = np.sqrt(d2.astype(float))
    got, *_, scanned, work = ball.search(x, cluster, upper + 30, second - 6000)
    assert np.array_equal(got, cluster) and 0 < scanned < 3000 and work < scanned * 64 / 2
    *_, scanned, work = ball.search(x, cluster, upper, second)
    assert work <= 16  # ties and close calls only
