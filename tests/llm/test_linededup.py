"""Line dedup: identity of lines, hot words, many removed lines in one text, rows that share an id."""

import duckdb
import pytest

from twintrack.llm import linededup


def gone(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id, r.no) for r in linededup.removed(docs).collect())


def test_lines_whose_hashes_agree_in_32_bits(spark):
    # the xxhash64 of these two agree in the lower half
    a, b = ("zqx" + " " * x + "vwy" + " " * y + "klj" for x, y in ((50, 624), (54, 397)))
    assert gone(spark, [(1, a), (2, b)]) == [(2, 0)]
    assert gone(spark, [(1, b + "\n" + a + "\nother words here"), (2, "klj vwy zqx")]) == [(1, 1), (2, 0)]


@pytest.mark.parametrize("hot", [20_000, 5])
def test_one_word_in_many_short_lines(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT", hot)
    n = 20_000 if hot > 5 else 2_000
    # 'the of and' are in every line twice over, so 'rare' is a prefix word of all
    lines = [f"rare u{k} the of and" for k in range(n)] + ["the of and"] * 3 + [f"the of and x{k} x{k} the" for k in range(n)]
    lines[700] = "rare u3 of the and"
    lines[900] = "rare u3 of the and more"
    rows = [(k, "\n".join(lines[k * 500 : k * 500 + 500])) for k in range(-(-len(lines) // 500))]
    want = {(1, 200), (1, 400), (n // 500, 1), (n // 500, 2)}
    got = set(gone(spark, rows))
    assert got == want


def test_hot_words_change_nothing(spark, monkeypatch):
    words = [f"w{k % 23} v{k % 7} hot a{k % 3} b c d{k % 11}" for k in range(600)]
    rows = [(k, "\n".join(words[k * 6 : k * 6 + 6])) for k in range(100)]
    want = gone(spark, rows)
    monkeypatch.setattr(linededup, "HOT", 2)
    monkeypatch.setattr(linededup, "_level", lambda count: -128)
    assert gone(spark, rows) == want


def test_levels_in_sql(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(300) for _ in range(k)))], "doc_id long, text string")
    level = spark.range(1).selectExpr(linededup.rarity(docs) + " l").first().l
    hashes = dict(spark.range(300).selectExpr("id", f"xxhash64('w' || id) & {linededup.BUCKETS - 1}").collect())
    count = {}
    for k, b in hashes.items():
        count[b] = count.get(b, 0) + k
    assert len(level) == linededup.BUCKETS and all(level[b] == linededup._level(c) for b, c in count.items())
    assert level[next(b for b in range(1000) if b not in count)] == linededup._level(0)


def test_common_words_come_last(spark, monkeypatch):
    monkeypatch.setattr(linededup, "COMMON", 2)
    # 'the' and 'of' are most frequent; a line of 10 words has a prefix of 3, and the one after it
    words = [f"w{k}" for k in range(8)]
    docs = spark.createDataFrame([(1, "\n".join(["the of " + " ".join(words), "the of", "of the x y"] + [f"the of u{k}" for k in range(20)]))], "doc_id long, text string")
    often = set(spark.range(1).selectExpr(linededup.common(linededup.census(docs)) + " h").first().h)
    h = dict(spark.createDataFrame([(w,) for w in ["the", "of", "x", "y", *words]], "w string").selectExpr("w", "xxhash64(w)").collect())
    assert often == {h["the"], h["of"]}
    got = {r.no: [v & (1 << 56) - 1 for v in r.prefix] for r in linededup.signatures(docs).where("no < 3").collect()}
    low = {w: (v % (1 << 64)) >> 8 for w, v in h.items()}
    assert len(got[0]) == 4 and set(got[0]) < {low[w] for w in words}
    assert len(got[1]) == 2 and set(got[1]) == {low["the"], low["of"]}
    assert got[2] == sorted([low["x"], low["y"]])


@pytest.mark.parametrize("common", [0, 3, 40])
def test_any_common_words_give_the_same_lines(spark, monkeypatch, common):
    # 'a0' to 'a9' are in most lines: some lines hold nothing else, others differ in them alone
    lines = [" ".join(f"a{(k * j) % 10}" for j in range(1 + k % 9)) + (f" r{k % 17} s{k % 5}" if k % 3 else "") for k in range(300)]
    rows = [(k, "\n".join(lines[k * 10 : k * 10 + 10])) for k in range(30)]
    sets = [((d, i), set(x.split())) for d, t in rows for i, x in enumerate(t.split("\n"))]
    want = [p for k, (p, w) in enumerate(sets) if any(len(w & v) * 1.8 + 1e-9 >= 0.8 * (len(w) + len(v)) for _, v in sets[:k])]
    monkeypatch.setattr(linededup, "COMMON", common)
    assert gone(spark, rows) == want


def test_texts_that_lose_many_lines(spark):
    lines = [f"line number {k} of a long text" if k % 2 else "always the same" for k in range(4000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[1::2][:1000])), (2, "always the same\nnew words in it")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in linededup.dedup(docs).collect())
    keep = [x for k, x in enumerate(lines) if k % 2 or k == 0]
    similar = {x for x in keep[1:]}  # numbers differ: 6 of 8 words
    assert got[0] == (1, "\n".join(keep)) and len(similar) == 2000
    assert got[1] == (2, "") and got[2] == (2, "new words in it")


def test_query_is_its_sql(spark, tmp_path):
    docs = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{docs}'")
    want = sorted(con.execute(f"select doc_id, n_lines, n_bytes, text_sha256 from ({linededup.ORACLE})").fetchall())
    got = sorted(tuple(r) for r in linededup.query(spark, "/root/testdata/sf0.001").select("doc_id", "n_lines", "n_bytes", "text_sha256").collect())
    assert got == want


@pytest.mark.parametrize("cut", [-128, None, 127])
def test_any_cut_gives_the_same_lines(spark, monkeypatch, cut):
    # lines of 40 words, of which 'a0' to 'a11' are frequent; copies differ in 1 to 9 words, rare or frequent ones
    def line(k):
        words = [f"a{(k * j) % 12}" for j in range(12)] + [f"u{k // 3}_{j}" for j in range(40)]
        return " ".join([f"x{k}_{j}" for j in range(k % 9)] + words[k % 9 if k % 2 else 0 :])

    rows = [(d, "\n".join(line(k) for k in range(d * 12, d * 12 + 12))) for d in range(20)]
    sets = [((d, i), set(x.split())) for d, t in rows for i, x in enumerate(t.split("\n"))]
    want = [p for k, (p, w) in enumerate(sets) if any(len(w & v) * 1.8 + 1e-9 >= 0.8 * (len(w) + len(v)) for _, v in sets[:k])]
    monkeypatch.setattr(linededup, "COMMON", 3)
    if cut is not None:
        monkeypatch.setattr(linededup, "_cut", lambda counts, often: cut)
    assert 20 < len(want) < 220 and gone(spark, rows) == want


def test_parity_is_one_bit_a_word(spark, monkeypatch):
    # a word used to be in s1 or s2 by a bit of its hash; now rare words go to s1 and frequent ones to s2, each word once
    monkeypatch.setattr(linededup, "COMMON", 1)
    text = "\n".join(["the r1 r2 r3 f1", "the r1 r2 r3", "the f1 f2"] + ["the f1 f2 the the"] * 20 + ["the f2"])
    got = {r.no: r for r in linededup.signatures(spark.createDataFrame([(1, text)], "doc_id long, text string")).where("no < 3").collect()}
    ones = lambda v: bin(v & (1 << 64) - 1).count("1")
    assert ones(got[0].s1 ^ got[1].s1) == 0 and ones(got[0].s2 ^ got[1].s2) == 1
    assert got[2].s1 == 0 and got[1].s2 == 0 and ones(got[1].s1) in (1, 3) and 0 <= got[2].s2 < 1 << 32
