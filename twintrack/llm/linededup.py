"""Line dedup: exact set-similarity join of the lines of a corpus, in DataFrame operations only.

A line is the set of its words (separated by space, tab, vertical tab, form feed, carriage return). A line goes if an earlier
line, in order of (doc_id, line number), has a Jaccard similarity of 0.8 or more. Lines without words stay.

Words are ordered by rarity (occurrences of their hash bucket in the whole corpus, in logarithmic steps, then hash), after them a
few common words, which are taken out before the work on each word; any choice of them is right. Two similar
lines share a word of their prefixes, so prefix words are the join key. Candidates must pass the length filter, the positional
filter, and a bound on the symmetric difference from 96 parity bits of the words that are not common: 64 of the rarer ones, 32 of the
others. A left-semi self-join first finds the prefix rows that have any candidate; it stops at a row's first one, so groups of copies don't multiply. Only their lines are verified: first
against the earliest line of each prefix word, and what is left against all. Two lines' words are compared by their 64-bit hashes;
only a collision within the pair could mislead that. Exact copies are found by their 128-bit hash beforehand, and that pair of
hashes is a line's identity from there on.

A prefix word of more than HOT rows would be a large group. Lines with it are joined on it and a second word instead: similar
lines with the same first common word have the next one in common too, within one word more of their prefixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, settle

THRESHOLD = 0.8
#: Hash buckets whose occurrences give the rarity of words.
BUCKETS = 1 << 17
#: Words that come last in the order of rarity: their rarity is not looked up unless a line has few others.
COMMON = 128
#: Share of the other words (occurrences) whose parity goes into the 64 bits of s1; that of the rest goes into the 32 bits of s2.
RARER = 0.6
#: Most bytes of a table that is sent to all executors; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Rows of a prefix word from which lines are joined on two words, and the most such words.
HOT, HOT_WORDS = 20_000, 1000
_ID = ["h1", "h2"]


def _sent(df: DataFrame) -> DataFrame:
    """``df``, a table read back, with a broadcast hint if its counted bytes are within the bound."""
    wide = [F.size(c) * 24 for c, kind in df.dtypes if kind.startswith("array")]
    got = df.agg(F.count("*").alias("n"), *[F.sum(x).alias(f"w{k}") for k, x in enumerate(wide)]).first()
    return F.broadcast(df) if got.n * 16 * len(df.columns) + sum(x or 0 for x in got[1:]) <= BROADCAST_BYTES else df


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))


def _split(text: str, more: str = "") -> str:
    """SQL of the words of a text and empty strings; ``more``: other characters between words. A split at one character is the fastest."""
    rare = "\t\x0b\f\r"
    odd = " or ".join(f"contains({text}, '{c}')" for c in rare)
    plain = f"if({odd}, translate({text}, '{rare}', '{' ' * len(rare)}'), {text})"
    for c in more:
        plain = f"replace({plain}, '{c}', ' ')"
    return f"split({plain}, ' ')"


def _hashes(line: str) -> str:
    """SQL of the 64-bit hashes of a line's distinct words."""
    return f"array_remove(array_distinct(transform({_split(line)}, t -> xxhash64(t))), xxhash64(''))"


def _level(count: int) -> int:
    """Occurrences in steps of an eighth of an octave, -128 to 127: the top byte of a word."""
    return min(255, 8 * count.bit_length() + (count >> max(0, count.bit_length() - 4) & 7)) - 128


def census(docs: DataFrame) -> DataFrame:
    """(k, c, h), a table: per hash bucket of words the occurrences in the corpus and the hash of one of its words."""
    w = docs.select(F.explode(F.expr(_split("text", "\n"))).alias("w")).select(F.xxhash64("w").alias("h"))
    counts = w.groupBy(F.col("h").bitwiseAND(BUCKETS - 1).alias("k")).agg(F.count("*").alias("c"), F.first("h").alias("h"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("c"), F.lit(None).cast("long").alias("h"))
    return settle(counts.unionAll(every).groupBy("k").agg(F.sum("c").alias("c"), F.first("h", ignorenulls=True).alias("h")))


#: _level(c) in SQL.
_LEVEL = "cast(least(255, 8 * length(bin(c)) * int(c > 0) + (shiftright(c, greatest(0, length(bin(c)) - 4)) & 7)) - 128 as int)"


def levels(counts: DataFrame) -> str:
    """SQL of an array: per hash bucket the level of its occurrences."""
    # one text of BUCKETS numbers comes to the driver
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.expr(_LEVEL).alias("l")))), lambda x: x["l"]), ",")
    return f"cast(split('{counts.agg(text.alias('t')).first().t}', ',') as array<bigint>)"


def _often(counts: DataFrame) -> list[int]:
    """A word's hash from each of the COMMON fullest buckets, most often that of a word that fills it."""
    return [r.h for r in counts.where("h is not null").orderBy(F.desc("c"), "k").limit(COMMON).collect()]


def _array(hashes: list[int]) -> str:
    return f"cast(array({', '.join(repr(str(h)) for h in hashes)}) as array<bigint>)"


def common(counts: DataFrame) -> str:
    """SQL of an array: the hashes of the common words."""
    return _array(_often(counts))


def _cut(counts: DataFrame, often: list[int]) -> int:
    """The level from which a word's parity goes into s2; any level is right."""
    others = counts.where(~F.col("k").isin([h & (BUCKETS - 1) for h in often]) if often else F.lit(True))
    return int(others.agg(F.expr(f"percentile({_LEVEL}, {RARER!r}D, c)").alias("l")).first().l or 0)


def rarity(docs: DataFrame) -> str:
    """SQL of an array: per hash bucket the level of its occurrences in the corpus."""
    return levels(census(docs))


def signatures(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each line with words: doc_id, no, line hashes h1 and h2, words n, parity bits s1 and s2, prefix words and the one after them.

    A prefix word is its rarity and 56 bits of its hash. Common words come after all others, so only a line that has too few others
    takes any into its prefix. The parity bits are those of the other words; a word flips one bit of 64 in s1 if it is rarer than the
    cut, else one of 32 in s2.
    """
    counts = census(docs)
    level, often = levels(counts), _often(counts)
    mark = _cut(counts, often) << 56
    lines = lines_of(docs).where(r"ltrim(' \t\u000B\f\r', line) <> ''")
    h = lines.select("doc_id", "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), F.expr(_hashes("line")).alias("w"))
    # literals are looked up in a set that is made once, where array_except makes one for each line
    h = h.select("*", F.expr(f"filter(w, v -> v not in ({', '.join(f'{x}L' for x in often)}))" if often else "w").alias("r"))

    def packed(words: str) -> str:
        # never null, so that the array is sorted as plain numbers
        return f"sort_array(transform({words}, v -> shiftleft(coalesce(get({level}, cast(v & {BUCKETS - 1} as int)), 0L), 56) | shiftrightunsigned(v, 8)))"

    def parity(words: str, bits: int) -> str:
        return f"aggregate({words}, 0L, (a, v) -> a ^ shiftleft(1L, cast(v & {bits - 1}L as int)))"

    h = h.select("doc_id", "no", "h1", "h2", F.size("w").alias("n"), F.expr(packed("r")).alias("p"), "w", "r")
    # the place of the first word from the cut on
    h = h.withColumn("q", F.expr(f"cast(array_position(sort_array(concat(p, array({mark}L))), {mark}L) as int)"))
    s1, s2 = parity("slice(p, 1, q - 1)", 64), parity("slice(p, q, size(p))", 32)
    most = _prefix(threshold) + 1
    few = packed(f"array_intersect(w, {_array(often)})")
    prefix = F.when(F.size("r") >= most, F.col("p")).otherwise(F.concat("p", F.expr(few)))
    return h.select("doc_id", "no", "h1", "h2", "n", F.expr(s1).alias("s1"), F.expr(s2).alias("s2"), F.slice(prefix, 1, most).alias("prefix"))


def _prefix(threshold: float):
    """Words of the prefix of a line of n words."""
    return (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")


def hot_words(table: DataFrame, threshold: float) -> list[int]:
    """Prefix words of more than HOT rows of ``signatures``, by a sketch of bounded size; HOT_WORDS at most, the most frequent ones."""
    prefix, least = F.slice("prefix", 1, _prefix(threshold)), _level(HOT) << 56
    # what occurs more often than HOT in the corpus at all; the last word of a prefix is the most frequent one
    w = table.where(F.get("prefix", _prefix(threshold) - 1) >= least).select(F.explode(prefix).alias("w")).where(F.col("w") >= least)
    got = w.agg(F.expr(f"approx_top_k(w, {HOT_WORDS}, {16 * HOT_WORDS})").alias("top")).first().top
    return sorted(r["item"] for r in got or [] if r["count"] > HOT)


def _keyed(table: DataFrame, hot: list[int], threshold: float) -> DataFrame:
    """(h1, n, s1, s2, tok) with a row for each join key of a line; s2 has the place of its prefix word in the lower half."""
    some = F.posexplode(F.slice("prefix", 1, _prefix(threshold))).alias("pos", "tok")
    rows = table.select("h1", "n", "s1", "s2", *(["prefix"] if hot else []), some).withColumn("s2", F.expr("shiftleft(s2, 32) | pos"))
    if hot:
        two = F.transform(F.filter("prefix", lambda v: v != F.col("tok")), lambda v: F.xxhash64("tok", v))
        # lines that may have a single word in common
        two = F.when(F.ceil(F.col("n") * threshold - 1e-9) <= 1, F.array_append(two, F.col("tok"))).otherwise(two)
        rows = rows.withColumn("tok", F.explode(F.when(F.col("tok").isin(hot), two).otherwise(F.array("tok"))))
    return rows.select("h1", "n", "s1", "s2", "tok")


def _near(threshold: float) -> str:
    """SQL of the filters on two prefix rows x and y with the same word, the cheapest and most selective first."""
    least = f"(x.n + y.n) * {threshold / (1 + threshold)!r}D - 1e-9"
    ratio = repr((1 + threshold) / (1 - threshold)) if threshold < 1 else "1e18"
    differ, left = "bit_count(x.s1 ^ y.s1)", "({0}.n - ({0}.s2 & 4294967295L))".format
    return (
        f"{differ} * {ratio}D <= x.n + y.n + 1e-6"
        f" and ({differ} + bit_count(shiftrightunsigned(x.s2 ^ y.s2, 32))) * {ratio}D <= x.n + y.n + 1e-6 and x.h1 <> y.h1"
        f" and x.n >= y.n * {threshold}D - 1e-9 and y.n >= x.n * {threshold}D - 1e-9 and least({left('x')}, {left('y')}) >= {least}"
    )


def _verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """The first lines (ids) of distinct pairs (xh1, xh2, yh1, yh2), a table, whose sets of words are similar; ``words(h1, h2, w)``."""
    side = lambda p: words.select(*[F.col(c).alias(p + c) for c in (*_ID, "w")])
    xs, ys = ["x" + c for c in _ID], ["y" + c for c in _ID]
    # the lines that are asked for, before they move
    left = side("x").join(_sent(pairs), xs)
    right = side("y").join(_sent(settle(pairs.select(*ys).distinct())), ys)
    enough = F.size(F.array_intersect("xw", "yw")) * (1 + threshold) + 1e-9 >= (F.size("xw") + F.size("yw")) * threshold
    return left.join(right, ys).where(enough).select(*[F.col("x" + c).alias(c) for c in _ID]).distinct()


def _pairs(x: DataFrame, y: DataFrame, threshold: float) -> DataFrame:
    """Distinct id pairs of prefix rows of x and earlier ones of y that pass the filters."""
    met = x.alias("x").join(y.alias("y"), (F.col("x.tok") == F.col("y.tok")) & (F.col("x.at") > F.col("y.at")) & F.expr(_near(threshold)))
    return met.select(*[F.col(f"{p}.{c}").alias(p + c) for p in "xy" for c in _ID]).distinct()


def removed(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, no, h1) of the lines of ``docs(doc_id, text)`` that go. Lines are numbered from 0.

    A null doc_id comes before all others; null texts have no lines; lines with the same doc_id and number (repeated rows)
    don't remove each other. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    table = settle(signatures(docs, threshold))
    at = F.struct("doc_id", "no")
    copies = table.groupBy(*_ID).agg(F.min(at).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = _sent(settle(copies))
    copied = table.select("doc_id", "no", *_ID).join(copies, _ID).where(at > F.col("first")).select("doc_id", "no", "h1")

    # copies of a line aside, few rows have a prefix word in common, and a row's search ends at its first candidate
    table = table.join(copies, _ID, "left").where(F.col("first").isNull() | (at <= F.col("first")))
    hot = hot_words(table, threshold)
    # columns in the table's order, so that both sides of the join read one exchange
    rows = _keyed(table, hot, threshold)
    met = rows.alias("x").join(rows.alias("y"), (F.col("x.tok") == F.col("y.tok")) & F.expr(_near(threshold)), "left_semi")
    met = settle(met.select("x.*"))
    ids = _sent(settle(met.select("h1").distinct()))
    first = settle(table.join(ids, "h1", "left_semi").groupBy(*_ID).agg(F.min(at).alias("at")))

    wanted = first.groupBy(F.col("at.doc_id").alias("_id")).agg(F.collect_set("at.no").alias("nos"))
    wanted = _sent(settle(wanted))  # lines of one document together, as in its text
    words = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")))
    words = words.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"), "nos").where("array_contains(nos, no)")
    words = words.select(at.alias("at"), *[F.xxhash64(*x).alias(c) for c, x in zip(_ID, (["line"], [F.lit(7), "line"]))], F.expr(_hashes("line")).alias("w"))
    words = settle(words.join(first.select("at", *_ID), ["at", *_ID]).select(*_ID, "w").dropDuplicates(_ID))

    met = settle(met.join(_sent(first), "h1"))
    # the earliest line of each word, then all
    lead = met.groupBy("tok").agg(F.min(F.struct("at", *_ID, "n", "s1", "s2")).alias("l")).select("tok", "l.*")
    gone = settle(_verified(settle(_pairs(met, lead, threshold)), words, threshold))
    left = met.join(_sent(gone), _ID, "left_anti")
    more = _verified(settle(_pairs(left, met, threshold)), words, threshold)
    similar = first.join(gone.unionByName(more), _ID, "left_semi").select("at.*", "h1")
    return settle(copied.unionByName(similar).distinct())


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the lines that ``removed`` lists. Row count and order of lines stay; null text stays null.

    A row's line goes if its number and its hash are listed for its doc_id, so rows with one doc_id and different texts don't mix.
    """
    name = "__tt_lines"
    gone = removed(docs, threshold).groupBy(F.col("doc_id").alias("__tt_id")).agg(F.collect_set(F.struct("no", "h1")).alias(name))
    both = docs.join(_sent(settle(gone)), F.col("doc_id").eqNullSafe(F.col("__tt_id")), "left")
    # let(x, f) is f(x) with x worked out once
    let = lambda x, f: F.get(F.transform(F.array(x), f), 0)

    def without(lines):
        own = F.array_sort(F.transform(F.filter(name, lambda g: F.xxhash64(F.get(lines, g["no"])) == g["h1"]), lambda g: g["no"]))
        # true up to each line that goes, then false
        run = lambda nos: F.transform(nos, lambda v, i: F.array_append(F.array_repeat(F.lit(True), v - F.coalesce(F.get(nos, i - 1), F.lit(-1)) - 1), F.lit(False)))
        return let(let(own, lambda nos: F.flatten(run(nos))), lambda stays: F.array_join(F.filter(lines, lambda _, i: F.coalesce(F.get(stays, i), F.lit(True))), "\n"))

    text = F.when(F.col(name).isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), without)).alias("text")
    return both.select(*[text if c == "text" else docs[c] for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("before"))
    n = lambda c: F.coalesce(F.size(F.split(c, "\n")), F.lit(0)).cast("long")
    got = dedup(docs)
    return got.select("doc_id", n("before").alias("n_lines"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``dedup`` of the documents with the columns of ``docs``; a document that loses all lines stays with an empty text."""
    return dedup(docs)


ORACLE = r"""
with l as (select doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) no from documents where text is not null),
lines as (
  select doc_id, no, string_split(text, chr(10))[no] line from l),
t as (select doc_id, no, list_distinct(list_filter(regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda w: w <> '')) w from lines),
t1 as (select doc_id, no, list_sort(w) w, len(w) n from t where len(w) > 0),
firsts as (select w, any_value(n) n, min((doc_id, no)) f from t1 group by w),
tok as (select w, n, f, unnest(w) tok from firsts),
df as (select tok, count(*) c from tok group by 1),
ranked as (select w, n, f, tok, row_number() over (partition by w order by c, tok) p from tok join df using (tok)),
pre as (select * from ranked where p <= n - ceil(0.8 * n - 1e-9) + 1),
cand as (select distinct a.f fa, b.f fb from pre a join pre b on a.tok = b.tok and a.f > b.f and a.n >= 0.8 * b.n - 1e-9 and b.n >= 0.8 * a.n - 1e-9),
near as (
  select distinct fa f from cand join firsts a on a.f = fa join firsts b on b.f = fb
  where len(list_intersect(a.w, b.w)) * 1.8 + 1e-9 >= 0.8 * (a.n + b.n)),
kept as (
  select doc_id, no from t1 join firsts using (w) where (doc_id, no) = f and f not in (select f from near)
  union all select doc_id, no from t where len(w) = 0),
clean as (select doc_id, string_agg(line, chr(10) order by no) text from lines join kept using (doc_id, no) group by 1)
select d.doc_id, cast(coalesce(len(string_split(d.text, chr(10))), 0) as bigint) n_lines, cast(strlen(coalesce(c.text, '')) as bigint) n_bytes,
       sha256(coalesce(c.text, '')) text_sha256
from documents d left join clean c using (doc_id)
"""
