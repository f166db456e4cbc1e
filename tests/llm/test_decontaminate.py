"""Decontamination: repeated item ids, long texts, copies, and the SQL."""

import hashlib

import duckdb
from test_operators import brute_hits, sentence

from twintrack.llm import decontaminate
from twintrack.llm.common import PIECE


def test_rows_with_one_id_are_one_item(spark):
    rows = [("a", sentence(1, 12)), ("a", sentence(2, 12)), ("b", sentence(2, 12)), ("a", sentence(1, 12))]
    docs = spark.createDataFrame([(1, sentence(1, 12) + " and " + sentence(2, 12)), (2, sentence(2, 12))], "doc_id long, text string")
    bench = spark.createDataFrame(rows, "item_id string, text string")
    for bits in (6, 26):
        got = {r.doc_id: (r.n_items, r.items_sha256, r.n_hit) for r in decontaminate.report(docs, bench, bits=bits).collect()}
        assert got == {k: (2, hashlib.sha256(b"a,b").hexdigest(), n) for k, n in ((1, 24), (2, 12))}


def test_a_text_in_pieces_and_its_copies(spark):
    items = [(1, sentence(3, 25)), (2, "one"), (3, sentence(4, 10))]
    # a passage across each cut between pieces, and short hits
    text = ""
    while len(text) < 3 * PIECE:
        text += sentence(3, 25) + " qq " + "xyz " * 3 + "w" * 997 + " "
    docs = spark.createDataFrame([(1, text), (2, text), (3, sentence(4, 9)), (4, "one, ONE two")], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    n = text.count(" qq ")
    assert got[1] == got[2] and got[1][:3] == (30 * n, 25 * n, 1)
    assert got[3] == brute_hits(sentence(4, 9), items) and got[4] == brute_hits("one, ONE two", items)


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cols = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    want = sorted(con.execute(f"select {cols} from ({decontaminate.ORACLE})").fetchall())
    assert sorted(tuple(r) for r in decontaminate.query(spark, sf).select(*cols.split(", ")).collect()) == want
