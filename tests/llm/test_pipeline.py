"""The pipeline on a small corpus: every stage against what its operator decides on the rows it gets."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from twintrack.llm import queries

WORDS = "the and with house river stone garden window letter morning quiet evening market bridge winter".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ly", "ed", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = [], []
    for k in range(120):
        text = "\n".join(prose(100 * k + i, 30) for i in range(4))
        if k % 5 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, int(k % 5 != 0), 0))
    rows.append((500, rows[1][1], "en", "s", 1))  # a copy
    rows.append((501, rows[2][1] + "\n" + prose(9999, 12), "en", "s", 1))  # a copy with a new line
    item = prose(77, 20)
    rows.append((502, prose(5, 40) + " " + item + " " + prose(6, 40), "en", "s", 1))
    rows.append((503, None, None, None, 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_in_order_keep_columns_and_decide(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
        seen.append((name, {r.doc_id for r in docs.select("doc_id").collect()}))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    steps = dict(seen)
    good = {k for k in range(120) if k % 5}
    assert steps["quality classifier"] >= good | {500, 501, 502} and 0 not in steps["quality classifier"] and 503 not in steps["quality classifier"]
    assert steps["line dedup"] == steps["quality classifier"]
    assert good <= steps["SimHash near-dedup"]
    last = seen[-1][1]
    assert 502 not in last and good <= last
    rows = corpus_pipeline.run(spark, corpus)
    assert {r.doc_id for r in rows.collect()} == last
    assert rows.where("not round_trip").count() == 0


def test_queries_are_named_by_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_on_an_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0
