"""Conversation structure repair: the cheapest edits that make roles alternate, found by a dynamic program in time-major tensors.

Rows are put in order by a range partitioning over (conversation, turn), and cut into blocks. In a block, conversations are bucketed by
length, and all of a bucket advance together, a turn at a time: costs of the four states (nothing yet, after the system turn, after a
user turn, after an assistant turn) are updated backwards and stored, then edits are traced forwards. A conversation that reaches
over blocks is first summarised block by block, as costs from every state to every state with the order of the edits behind them;
from these its blocks learn the state that they start in and what follows costs, and are then solved like any other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, settle, small_batches

#: Costs of edits; a kept truncated turn costs TORN more.
REROLE, DELETE, INSERT, TORN = 2, 3, 2, 1
#: Rows of a block: a power of two.
BLOCK = 8192
#: White space.
SPACE = " \t\n\x0b\x0c\r"
_FAR = 1 << 40
# states: 0 nothing yet, 1 system, 2 user, 3 assistant; the state that a user or assistant turn leads to, and its initial
_NEXT = np.array([2, 2, 3, 2])
_ADDS = np.array(["u", "u", "a", "u"])
#: Costs of an end in each state, with the turns that are still to be inserted.
_END = np.array([0, 2 * INSERT, INSERT, 0])
#: Initials by code: 0 others, 1 system, 2 user, 3 assistant.
_INITIALS = {"s": 1, "u": 2, "a": 3}
# what one row adds to the edits, in ASCII order
_TEXTS = sorted("I" * k + a for k in range(3) for a in "DKR")
_RANK = np.array([[_TEXTS.index("I" * k + a) for a in "DKR"] for k in range(3)])


def _with_inserts(v: np.ndarray) -> np.ndarray:
    """Costs of the states on the last axis but one, when up to two turns may be inserted first."""
    for _ in range(2):
        v = np.minimum(v, INSERT + v[..., _NEXT, :])
    return v


def backward(code: np.ndarray, must: np.ndarray, torn: np.ndarray, there: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs (T + 1, N, 4, E) from before each turn and each state, given ``end`` (N, 4, E) after the last.

    code, must (deletion required), torn and there are (T, N); turns that aren't there come last and change nothing.
    """
    t_max, n = code.shape
    v = np.empty((t_max + 1, n, 4, end.shape[2]), np.int64)
    v[t_max] = end
    for t in range(t_max - 1, -1, -1):
        v[t] = np.where(there[t][:, None, None], _with_inserts(_step(v[t + 1], code[t], must[t], torn[t]).min(0)), v[t + 1])
    return v


def _step(after: np.ndarray, code: np.ndarray, must: np.ndarray, torn: np.ndarray) -> np.ndarray:
    """Costs (3, N, 4, E) of deleting, keeping and re-roling a turn in each state."""
    far = np.full_like(after, _FAR)
    spend = np.where(torn, TORN, 0)[:, None, None]
    free = ~must[:, None, None]
    again = np.where(free, REROLE + spend + after[:, _NEXT], far)
    keep = far.copy()
    for state in range(4):
        for initial, to in ((1, 1), (2, 2), (3, 3)):
            if to == _NEXT[state] or (initial == 1 and state == 0):
                fits = (code == initial)[:, None] & free[:, 0]
                keep[:, state] = np.where(fits, spend[:, 0] + after[:, to], keep[:, state])
    return np.stack([DELETE + after, keep, again])


def trace(v: np.ndarray, code, must, torn, there, state: np.ndarray):
    """The ASCII-least of the cheapest edits along ``v`` (T + 1, N, 4) from ``state`` (N,): (act, inserts, states before the act) by turn, each (T, N), and the last state.

    act: 0 delete, 1 keep, 2 re-role, -1 no turn.
    """
    t_max, n = code.shape
    act, inserts, froms = np.full((t_max, n), -1, np.int8), np.zeros((t_max, n), np.int8), np.zeros((t_max, n), np.int8)
    state, rows = state.copy(), np.arange(n)
    for t in range(t_max):
        ways = _step(v[t + 1][:, :, None], code[t], must[t], torn[t])[..., 0]
        waits = there[t].copy()
        for _ in range(3):
            best = v[t][rows, state]
            delete, keep = (ways[k][rows, state] == best for k in (0, 1))
            # a deletion goes before an insertion, that before the others
            insert = ~delete & (INSERT + v[t][rows, _NEXT[state]] == best) & waits
            act[t] = np.where(waits & ~insert, np.where(delete, 0, np.where(keep, 1, 2)), act[t])
            froms[t] = np.where(waits & ~insert, state, froms[t])
            to = np.where(delete, state, np.where(keep, code[t], _NEXT[state]))
            inserts[t] += insert
            state = np.where(insert, _NEXT[state], np.where(waits, to, state))
            waits = insert
            if not waits.any():
                break
    return act, inserts, froms, state


def _runs(table: pa.Table):
    """(columns of the rows in order, starts of the conversations) of a block."""
    table = table.sort_by("at").combine_chunks()
    names = pc.dictionary_encode(table.column("conv_id").combine_chunks() if table.num_rows else table.column("conv_id"), null_encoding="encode")
    names = np.asarray((names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names).indices)
    starts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
    return table, starts


def _buckets(table: pa.Table, starts: np.ndarray):
    """Yield (positions (T, N), there, code, must, torn, conversations) for each bucket of conversations of like length."""
    code, must, torn = (table.column(c).to_numpy(zero_copy_only=False) for c in ("code", "must", "torn"))
    length = np.diff(np.append(starts, table.num_rows))
    order = np.ceil(np.log2(length)).astype(int)
    for k in np.unique(order).tolist():
        some = np.flatnonzero(order == k)
        t = np.arange(length[some].max())[:, None]
        there = t < length[some][None, :]
        at = starts[some][None, :] + np.minimum(t, length[some][None, :] - 1)
        yield at, there, code[at].astype(np.int64), must[at].astype(bool), torn[at].astype(bool), some


def _summaries(table: pa.Table) -> pa.Table:
    """(conv_id, block, cost, rank) of each conversation of a block: 16 costs from state to state, and the order of their edits' texts."""
    table, starts = _runs(table)
    cost, rank = np.zeros((len(starts), 16), np.int64), np.zeros((len(starts), 16), np.int64)
    for _, there, code, must, torn, some in _buckets(table, starts):
        n = len(some)
        end = np.where(np.eye(4, dtype=bool), 0, _FAR)[None].repeat(n, 0)
        v = backward(code, must, torn, there, end)
        cost[some] = np.minimum(v[0].reshape(n, 16), _FAR)
        for s in range(4):
            texts = []
            for e in range(4):
                act, inserts, *_ = trace(v[..., e], code, must, torn, there, np.full(n, s))
                texts.append(np.where(act >= 0, _RANK[np.clip(inserts, 0, 2), np.maximum(act, 0)], -1))
            texts = np.stack(texts)  # (4, T, N)
            less = np.zeros((4, n), np.int64)
            for a in range(4):
                for b in range(4):
                    differs = texts[a] != texts[b]
                    first = differs.argmax(0)
                    less[a] += differs.any(0) & (texts[b][first, np.arange(n)] < texts[a][first, np.arange(n)])
            rank[some, 4 * s : 4 * s + 4] = less.T
    as_lists = lambda x: pa.array(x.tolist(), pa.list_(pa.int64()))
    take = table.take(pa.array(starts))
    return pa.table({"conv_id": take.column("conv_id"), "block": take.column("block"), "cost": as_lists(cost), "rank": as_lists(rank)})


def _linked(table: pa.Table) -> pa.Table:
    """(conv_id, block, first, ends): the state in which each block of one conversation starts, and the costs of what follows it."""
    table = table.sort_by("block").combine_chunks()
    m = np.array(table.column("cost").to_pylist(), np.int64).reshape(-1, 4, 4)
    rank = np.array(table.column("rank").to_pylist(), np.int64).reshape(-1, 4, 4)
    ends = np.empty((len(m), 4), np.int64)
    after = _END
    for k in range(len(m) - 1, -1, -1):
        ends[k] = after
        after = np.minimum((m[k] + after[None, :]).min(1), _FAR)
    first, state = np.zeros(len(m), np.int64), 0
    for k in range(len(m)):
        first[k] = state
        total = m[k][state] + ends[k]
        state = int(np.lexsort((rank[k][state], total))[0])
    return pa.table({"conv_id": table.column("conv_id"), "block": table.column("block"), "first": pa.array(first), "ends": pa.array(ends.tolist(), pa.list_(pa.int64()))})


def _solved(table: pa.Table) -> pa.Table:
    """(at, conv_id, block, initial, piece, role_to, before, after) of the rows of a block: what their edits are."""
    table, starts = _runs(table)
    n = table.num_rows
    piece, role, before, after = (np.full(n, "", object) for _ in range(4))
    first = table.column("first").to_pylist()
    ends = table.column("ends").to_pylist()
    for at, there, code, must, torn, some in _buckets(table, starts):
        begin = starts[some]
        state = np.array([first[i] or 0 for i in begin.tolist()], np.int64)
        wide = np.array([ends[i] is not None for i in begin.tolist()])
        end = np.array([ends[i] if ends[i] is not None else _END for i in begin.tolist()], np.int64)
        v = backward(code, must, torn, there, end[..., None])[..., 0]
        act, inserts, froms, state = trace(v, code, must, torn, there, state)
        t, k = np.nonzero(there)
        rows, a, i, s = at[t, k], act[t, k], inserts[t, k], froms[t, k]
        piece[rows] = np.array(_TEXTS, object)[_RANK[i, a]]
        role[rows] = np.where(a == 2, np.where(_ADDS[s] == "u", "user", "assistant"), "").astype(object)
        # the turns inserted before it end in the one that leads to the state it found
        before[rows] = np.where(i == 0, "", np.where(s == 2, np.where(i == 1, "u", "au"), np.where(i == 1, "a", "ua"))).astype(object)
        # at the end of the conversation; where it goes on, insertions are left to the next block
        last = begin + there.sum(0) - 1
        left = np.array(["", "ua", "a", ""], object)[state]
        closing = ~wide | (end == _END).all(1) & np.array([bool(x) for x in np.asarray(table.column("last").to_pylist(), object)[begin]])
        after[last[closing]] = left[closing]
    keep = [table.column(c) for c in ("at", "conv_id", "block", "initial")]
    return pa.table([*keep, *[pa.array(x, pa.string()) for x in (piece, role, before, after)]], ["at", "conv_id", "block", "initial", "piece", "role_to", "before", "after"])


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, at, block, turn, role, text, initial, blank, same, torn) of every row of ``turns(conv_id, turn, role, text)``; written in the shared folder.

    ``at`` numbers rows by conversation and turn, nulls first; equal turns go by role, the text's first 32 characters and its hash. Null
    roles and texts are one space. Faults: blank; same (role and text seen earlier in the conversation, both as 64-bit hashes with
    two seeds); torn (the last character that is no white space is none of . ! ?), each only if none before it holds.
    """
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    # repeated rows are dealt out too; they are alike, so their order is of no matter
    rows = rows.withColumns({"_head": F.left("text", F.lit(32)), "_hash": F.xxhash64("text"), "_salt": F.monotonically_increasing_id()})
    by = ["conv_id", "turn", "role", "_head", "_hash", "_salt"]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    bare = F.rtrim("text", F.lit(SPACE))
    rows = rows.withColumns({"block": F.expr(f"at div {BLOCK}"), "initial": F.left("role", F.lit(1)), "_k1": F.xxhash64("role", "text"), "_k2": F.xxhash64(F.lit(1), "text", "role"), "blank": F.length(bare) == 0, "torn": ~F.right(bare, F.lit(1)).isin(".", "!", "?")})
    rows = settle(rows.drop("_head", "_hash", "_salt"))
    first = rows.groupBy("conv_id", "_k1", "_k2").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_first"))
    rows = rows.drop("_k1", "_k2").join(first, "at", "left").withColumn("same", F.col("_first").isNull() & ~F.col("blank"))
    return rows.withColumn("torn", F.col("torn") & ~F.col("blank") & ~F.col("same")).drop("_first")


def edits(rows: DataFrame) -> DataFrame:
    """(at, conv_id, block, initial, piece, role_to, before, after) of every row of ``ordered``: its cheapest edits, as ASCII-least as can be.

    piece: insertions (I) before the row and D, K or R for itself; role_to: the role it gets by R, else empty; before, after:
    initials of the turns inserted around it.
    """
    code = F.coalesce(*[F.when(F.col("initial") == k, F.lit(v)) for k, v in _INITIALS.items()], F.lit(0))
    light = rows.select("at", "conv_id", "block", "initial", code.alias("code"), (F.col("blank") | F.col("same")).alias("must"), "torn")
    kind = dict(rows.dtypes)["conv_id"]
    spans = light.groupBy("conv_id").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi").select(F.col("conv_id").alias("_c"), "hi")
    wide = light.join(spans, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    parts = wide.groupBy("block").applyInArrow(_summaries, f"conv_id {kind}, block long, cost array<long>, rank array<long>")
    # a row for every block of a conversation
    links = parts.groupBy("conv_id").applyInArrow(_linked, f"conv_id {kind}, block long, first long, ends array<long>")
    links = links.join(spans, F.col("conv_id").eqNullSafe(F.col("_c"))).select("_c", F.col("block").alias("_b"), "first", "ends", (F.col("block") == F.col("hi")).alias("last"))
    told = light.join(settle(links), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")), "left").drop("_c", "_b")
    return told.groupBy("block").applyInArrow(_solved, f"at long, conv_id {kind}, block long, initial string, piece string, role_to string, before string, after string")


def repaired(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """(conv_id, at, k, role, text): the turns that are left and those inserted, in order of (at, k) within a conversation."""
    named = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    both = rows.select("at", "role", "text").join(changes.select("at", "conv_id", "piece", "role_to", "before", "after"), "at")
    role = F.when(F.col("role_to") != "", F.col("role_to")).otherwise(F.col("role"))
    own = F.when(F.endswith("piece", F.lit("D")), F.expr("array()")).otherwise(F.array(F.struct(role.alias("role"), "text")))
    turns = both.select("conv_id", "at", F.posexplode(F.concat(named("before"), own, named("after"))).alias("k", "t"))
    return turns.select("conv_id", "at", "k", "t.role", "t.text")


def audits(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation that has rows."""
    flag = lambda c: F.sum(F.col(c).cast("long"))
    seen = rows.groupBy(F.col("conv_id").alias("_c")).agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).cast("long").alias("gaps"), flag("blank").alias("blank"), flag("same").alias("duplicate"), flag("torn").alias("truncated"), F.max(F.lit(1)))
    # a block at a time: no list has more than BLOCK items, or an item for each block
    piece = F.concat("piece", F.repeat(F.lit("I"), F.length("after")))
    torn = rows.select("at", F.col("torn").cast("int").alias("torn"))
    price = F.when(F.endswith("piece", F.lit("D")), DELETE).otherwise(F.when(F.endswith("piece", F.lit("R")), REROLE).otherwise(0) + TORN * F.col("torn")) + INSERT * (F.length("before") + F.length("after"))
    listed = changes.join(torn, "at").groupBy("conv_id", "block").agg(F.sum(price).alias("cost"), F.sort_array(F.collect_list(F.struct("at", "initial", piece.alias("piece")))).alias("x"))
    fine = lambda a, b: F.concat(a, b).isin("su", "ua", "au")
    broken = F.expr("transform(sequence(1, size(x)), i -> i)")
    bad = F.size(F.filter(broken, lambda i: (i < F.size("x")) & ~fine(F.get("x", i - 1)["initial"], F.get("x", i)["initial"])))
    listed = listed.select("conv_id", "block", "cost", bad.alias("bad"), F.get("x", F.lit(0))["initial"].alias("head"), F.element_at("x", -1)["initial"].alias("foot"), F.array_join(F.transform("x", lambda s: s["piece"]), "").alias("text"))
    whole = listed.groupBy("conv_id").agg(F.sum("cost").cast("long").alias("cost"), F.sum("bad").alias("bad"), F.sort_array(F.collect_list(F.struct("block", "head", "foot", "text"))).alias("x"))
    border = F.size(F.filter(broken, lambda i: (i < F.size("x")) & ~fine(F.get("x", i - 1)["foot"], F.get("x", i)["head"])))
    whole = whole.select("conv_id", "cost", (F.col("bad") + border).cast("long").alias("illegal"), F.array_join(F.transform("x", lambda s: s["text"]), "").alias("audit"))
    both = whole.join(seen, F.col("conv_id").eqNullSafe(F.col("_c")))
    return both.select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repaired``: SHA-256 of role:text, joined by line feeds; a conversation streams through one task, as the hash needs."""
    small_batches(turns.sparkSession)

    def run(batches):
        name, h, ids, out = None, None, [], []
        for b in batches:
            names = b.column(0)
            roles, bodies = b.column(1).cast(pa.binary()).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()
            for i, n in enumerate(names.to_pylist()):
                if h is None or n != name:
                    if h is not None:
                        ids.append(name)
                        out.append(h.hexdigest())
                    name, h = n, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(roles[i] + b":")
                h.update(bodies[i])
            if len(ids) > 1000:
                yield pa.record_batch([pa.array(ids, names.type), pa.array(out)], ["conv_id", "repaired_sha256"])
                ids, out = [], []
        if h is not None:
            yield pa.record_batch([pa.array([*ids, name], names.type), pa.array([*out, h.hexdigest()])], ["conv_id", "repaired_sha256"])

    kind = dict(turns.dtypes)["conv_id"]
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "at", "k").select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired turns) of ``turns(conv_id, turn, role, text)``; see ``ordered``, ``edits``, ``audits``, ``repaired``.

    Every row counts, repeated ones too; a null conv_id is a conversation of its own; other columns are not read. Roles count by their
    first letter: s, u, a; all others must be re-roled or deleted. A conversation that deletes every turn has no repaired turns.
    No rows give no rows.
    """
    rows = ordered(turns)
    changes = settle(edits(rows))
    return audits(rows, changes), repaired(rows, changes)


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` after the damage that the query is about."""
    t = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = t.withColumn("d", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).where("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("d") == 3, F.expr("array(0, 1)")).otherwise(F.expr("array(0)"))
    return t.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("n")).drop("n")


def query(spark, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    audit, left = repair(damaged(turns))
    all_ = turns.select("conv_id").distinct()
    same = lambda n: F.col("conv_id").eqNullSafe(F.col(n))
    got = all_.join(audit.withColumnRenamed("conv_id", "_a"), same("_a"), "left").join(digests(left).withColumnRenamed("conv_id", "_h"), same("_h"), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return got.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: CRC-32 is computed bit by bit; the edits forwards, with the cheapest and ASCII-least text of each state.
ORACLE = r"""
with recursive crc as (
  select conv_id, turn, coalesce(role, ' ') "role", coalesce(text, ' ') "text", xor(4294967295, list_reduce(list_prepend(cast(4294967295 as ubigint), list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as ubigint))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::ubigint[]), lambda s, i: xor(s >> 1, 3988292384 * (s & 1))))) % 20 d
  from conversations),
turns as materialized (
  select conv_id, turn, case when d = 4 then 'user' else "role" end "role", case when d = 1 then '' when d = 2 then regexp_replace("text", '[.!?]', '', 'g') else "text" end "text", unnest(range(case when d = 3 then 2 else 1 end)) n
  from crc where d <> 0),
o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, "role", "text", n) i, count(*) over (partition by conv_id) size,
    rtrim("text", chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) bare from turns),
f as materialized (
  select *, bare = '' blank, bare <> '' and row_number() over (partition by conv_id, "role", "text" order by i) > 1 same, substr("role", 1, 1) ini, lag(substr("role", 1, 1)) over (partition by conv_id order by i) prev from o),
g as materialized (
  select *, not blank and not same and right(bare, 1) not in ('.', '!', '?') torn, blank or same must from f),
-- cheapest edits (cost, audit) that end in each state after row i: 1 nothing yet, 2 system, 3 user, 4 assistant
dp as (
  select conv_id, cast(0 as bigint) i, [struct_pack(c := cast(0 as bigint), a := ''), null, null, null] b from (select distinct conv_id from g)
  union all
  select dp.conv_id, g.i, list_transform([
    list_filter([struct_pack(c := w[1].c + 3, a := w[1].a || 'D')], lambda x: x.c is not null),
    list_filter([struct_pack(c := w[2].c + 3, a := w[2].a || 'D'), case when not must and ini = 's' then struct_pack(c := w[1].c + torn::int, a := w[1].a || 'K') end], lambda x: x.c is not null),
    list_filter([struct_pack(c := w[3].c + 3, a := w[3].a || 'D')] || flatten(list_transform([1, 2, 4], lambda s: [case when not must then struct_pack(c := w[s].c + 2 + torn::int, a := w[s].a || 'R') end, case when not must and ini = 'u' then struct_pack(c := w[s].c + torn::int, a := w[s].a || 'K') end])), lambda x: x.c is not null),
    list_filter([struct_pack(c := w[4].c + 3, a := w[4].a || 'D'), case when not must then struct_pack(c := w[3].c + 2 + torn::int, a := w[3].a || 'R') end, case when not must and ini = 'a' then struct_pack(c := w[3].c + torn::int, a := w[3].a || 'K') end], lambda x: x.c is not null)],
    lambda l: list_sort(l)[1])
  from (
    -- up to two insertions first
    select conv_id, i, [b[1], b[2],
      list_sort(list_filter([b[3], struct_pack(c := b[1].c + 2, a := b[1].a || 'I'), struct_pack(c := b[2].c + 2, a := b[2].a || 'I'), struct_pack(c := b[4].c + 2, a := b[4].a || 'I')], lambda x: x.c is not null))[1],
      list_sort(list_filter([b[4], struct_pack(c := b[3].c + 2, a := b[3].a || 'I'), struct_pack(c := b[1].c + 4, a := b[1].a || 'II'), struct_pack(c := b[2].c + 4, a := b[2].a || 'II')], lambda x: x.c is not null))[1]] w from dp) dp
  join g on g.conv_id is not distinct from dp.conv_id and g.i = dp.i + 1),
best as materialized (
  select dp.conv_id, list_sort(list_filter([b[1], b[4], struct_pack(c := b[3].c + 2, a := b[3].a || 'I'), struct_pack(c := b[2].c + 4, a := b[2].a || 'II')], lambda x: x.c is not null))[1] z
  from dp join (select conv_id, max(i) m from g group by 1) t on t.conv_id is not distinct from dp.conv_id and dp.i = t.m),
steps as (
  select conv_id, k, substr(z.a, k, 1) e from (select conv_id, z, unnest(range(1, length(z.a) + 1)) k from best)),
placed as (
  select conv_id, k, e, count(*) filter (where e <> 'I') over w i, count(*) filter (where e <> 'D') over w p from steps window w as (partition by conv_id order by k)),
named as (
  select p.conv_id, p.k, p.e, p.p, g."role", g."text", coalesce(max(case when p.p = 1 and p.e = 'K' and g.ini = 's' then 1 else 0 end) over (partition by p.conv_id), 0) s
  from placed p left join g on g.conv_id is not distinct from p.conv_id and g.i = p.i and p.e <> 'I'),
lines as (
  select conv_id, string_agg(case when e = 'K' then "role" when (p - s) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce("text", ''), chr(10) order by k) body from named where e <> 'D' group by 1),
seen as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (where blank) blank, count(*) filter (where same) "duplicate", count(*) filter (where torn) truncated,
    count(*) filter (where i > 1 and prev || ini not in ('su', 'ua', 'au')) illegal from g group by 1)
select c.conv_id, cast(coalesce(gaps, 0) as bigint) gaps, coalesce(blank, 0) blank, coalesce("duplicate", 0) "duplicate", coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(z.c, 0) "cost", coalesce(z.a, '') audit, sha256(coalesce(body, '')) repaired_sha256
from (select distinct conv_id from conversations) c left join seen s on s.conv_id is not distinct from c.conv_id left join best b on b.conv_id is not distinct from c.conv_id left join lines l on l.conv_id is not distinct from c.conv_id
"""
