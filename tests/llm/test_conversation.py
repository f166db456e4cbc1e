"""Conversation repair against a plain program that keeps the best edits of each state as text, for blocks of any size, and on edge cases."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from twintrack.llm import conversation

WHITE = " \t\n\x0b\x0c\r"
ZERO = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}


def one_more(state):
    return (3, "assistant") if state == 2 else (2, "user")


def plain(rows):
    """Audit record of the rows (turn, role, text) of one conversation, in order."""
    seen, best = set(), {0: (0, "", ())}
    count = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        blank, again = not text.strip(WHITE), (role, text) in seen
        seen.add((role, text))
        torn = not blank and not again and text.strip(WHITE)[-1] not in ".!?"
        count["blank"] += blank
        count["duplicate"] += again and not blank
        count["truncated"] += torn
        new = {}

        def put(state, way):
            if state not in new or way[:2] < new[state][:2]:
                new[state] = way

        for s, (c, a, out) in best.items():
            for _ in range(3):
                put(s, (c + 3, a + "D", out))
                to, given = one_more(s)
                if not blank and not again:
                    put(to, (c + 2 + torn, a + "R", (*out, (given, text))))
                    for initial, here, there in (("s", (0,), 1), ("u", (0, 1, 3), 2), ("a", (2,), 3)):
                        if role[:1] == initial and s in here:
                            put(there, (c + torn, a + "K", (*out, (role, text))))
                s, c, a, out = to, c + 2, a + "I", (*out, (given, ""))
        best = new
    ends = []
    for s, (c, a, out) in best.items():
        for _ in range(3):
            if s in (0, 3):
                ends.append((c, a, out))
            to, given = one_more(s)
            s, c, a, out = to, c + 2, a + "I", (*out, (given, ""))
    cost, audit, out = min(ends)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [p[1][:1] + q[1][:1] for p, q in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return count | {"gaps": gaps, "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": digest}


def expected(rows):
    space = lambda x: " " if x is None else x
    by = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        role, text = space(role), space(text)
        d = zlib.crc32(f"{space(c)}:{space(turn)}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        by[c] += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return {c: plain(sorted(v, key=lambda r: (r[0] is not None, r[0] or 0))) if v else ZERO for c, v in by.items()}


def answers(spark, folder, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit(0)).withColumn("cost", F.lit("x")).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    got = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in conversation.query(spark, str(folder)).collect()}
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    columns = ["conv_id", *ZERO]
    return got, {r[0]: dict(zip(columns[1:], r[1:])) for r in con.execute(f"select {', '.join(columns)} from ({conversation.ORACLE})").fetchall()}


@pytest.mark.parametrize("block", [4, 16, 8192])
def test_repair_is_the_plain_program(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(conversation, "BLOCK", block)
    r = random.Random(block)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "Användare", "unicorn"]
    rows = []
    for c in range(25):
        for t in range(r.choice([1, 2, 5, 60])):
            words = ["", "x", "ok.", "hi!", " \n", f"t{t}.", f"u{t}", f"v{t}? \t", None]
            rows.append((c, t + (r.random() < 0.05) * 1000, r.choice(roles), r.choice(words)))
    rows = list({r[:2]: r for r in rows}.values())
    got, sql = answers(spark, tmp_path, rows)
    want = expected(rows)
    assert got == want
    assert sql == want


def test_edges_of_conversations(spark, tmp_path):
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [
        (None, 0, "user", "hello."), (None, None, "assistant", "well."), (1, None, None, None), (2, 5, "system", "only."), (3, 1, "user", "same."), (3, 1, "user", "same."),
        (3, 2, "assistant", "same."), (4, 7, "user", "long " * 300_000), (4, 8, "assistant", "fine."), (gone, 0, "user", "dropped."),
    ]
    got, sql = answers(spark, tmp_path, rows)
    want = expected(rows)
    assert got == want and want[gone] == ZERO
    assert sql == want


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    audits, turns = conversation.repair(none)
    assert audits.collect() == [] and turns.collect() == []


def test_repaired_turns(spark):
    rows = [("c", 1, "system", "be kind."), ("c", 2, "assistant", "yes."), ("c", 3, "tool", "ping."), ("c", 4, "user", "no")]
    audits, turns = conversation.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    want = plain([r[1:] for r in rows])
    assert [(r.cost, r.audit, r.illegal, r.truncated) for r in audits.collect()] == [(want["cost"], want["audit"], want["illegal"], 1)]
    left = [f"{r.role}:{r.text}" for r in turns.orderBy("at", "k").collect()]
    assert hashlib.sha256("\n".join(left).encode()).hexdigest() == want["repaired_sha256"]


def test_one_conversation_over_many_blocks_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversation, "BLOCK", 64)
    rows = spark.range(2000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(".")).alias("text"))
    ordered = conversation.ordered(rows)
    assert ordered.groupBy("block").count().agg(F.max("count")).first()[0] <= 64
    audits, _ = conversation.repair(rows)
    assert audits.first().audit == "K" * 2000
