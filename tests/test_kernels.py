import random

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import kernels as k


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, None), (2, 9, "z")], "k int, o int, v string")
    assert rows(k.first_wins(df, ["k"], ["o"]), "k", "v") == [(1, "a"), (2, None)]
    assert rows(k.last_wins(df, ["k"], ["o"]), "k", "v") == [(1, "b"), (2, "z")]


def test_argmin_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([("m", "beds", 3), ("m", "music", 7), ("m", "music", 5)], "k string, cat string, seq int")
    assert rows(k.argmin_pick(df, ["k"], tx.priority(F.col("cat")), ["seq"]), "k", "cat", "seq") == [("m", "music", 5)]


def test_global_offsets_match_a_running_sum(spark):
    sizes = [random.Random(1).randrange(9) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i int, n int").repartition(5)
    got = dict(rows(k.global_offsets(df, "n", "i", slices=7), "i", "offset"))
    assert got == {i: sum(sizes[:i]) for i in range(200)}


def test_overlapping_cuts_like_a_slice(spark):
    parts = ["abc", "", "defg", "h", "ij"]
    whole = "".join(parts)
    df = k.prefix_offsets(spark.createDataFrame([(i, p, len(p)) for i, p in enumerate(parts)], "i int, p string, n int"), "n", ["i"])
    for start, size in ((0, 3), (2, 4), (5, 100), (9, 0), (4, 1)):
        got = k.overlapping(df, "offset", "n", F.lit(start), F.lit(size)).orderBy("i").collect()
        assert "".join(r.p[r.cut_from : r.cut_from + r.cut_size] for r in got) == whole[start : start + size]


def test_islands_and_fallback(spark):
    df = spark.createDataFrame([(1, x) for x in (0, 41, 82, 200, 241, 282)] + [(2, 7), (2, 500)], "k int, p int")
    assert rows(k.longest_island(df, ["k"], "p", 41), "k", "run_first", "run_size") == [(1, 0, 3), (2, 7, 1)]
    wanted = df.withColumn("e", F.when(F.col("k") == 2, 2).otherwise(3))
    assert rows(k.longest_or_all(wanted, ["k"], "p", 41, "e"), "k", "p") == [(1, 0), (1, 41), (1, 82), (2, 7), (2, 500)]


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 4), (1, 4, 6), (1, 8, 9), (1, 8, 12)], "k int, b int, e int")
    assert rows(k.merge_intervals(df, ["k"], "b", "e"), "b", "e", "n_merged") == [(0, 6, 2), (8, 12, 2)]
    assert rows(k.gaps(df, ["k"], "b", "e"), "gap_begin", "gap_end") == [(6, 8)]
    assert rows(k.partition_violations(df, ["k"], "b", "e", F.lit(0), F.lit(13)), "b", "violation") == [(8, "gap"), (8, "overlap")]
    whole = spark.createDataFrame([(1, 0, 4), (1, 4, 6)], "k int, b int, e int")
    assert k.partition_violations(whole, ["k"], "b", "e", F.lit(0), F.lit(6)).count() == 0
    assert rows(k.partition_violations(whole, ["k"], "b", "e", F.lit(0), F.lit(7)), "violation") == [("end",)]
    assert rows(k.neighbour_violations(df, ["k"], "b", "e"), "b", "e") == [(8, 9)]


def test_majority_and_ordered_distinct(spark):
    df = spark.createDataFrame([("c", "x", 1), ("c", "y", 0), ("c", "y", 2), ("c", "x", 3)], "k string, v string, o int")
    assert rows(k.majority(df, ["k"], "v", ["o"]), "k", "v", "votes") == [("c", "y", 2)]
    assert k.ordered_distinct(df, ["k"], "v", ["o"]).first()["values"] == ["y", "x"]
    assert rows(k.first_seen_index(df, "v", ["o"]), "v", "index") == [("x", 1), ("y", 0)]


def test_positional_join_runs_short_and_over(spark):
    sets = spark.createDataFrame([(0, 2), (1, 0), (2, 3)], "s int, n int")
    items = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos long, item string")
    got = k.positional_join(sets, items, "n", ["s"], "pos").orderBy("pos").collect()
    assert [(r.s, r.slot, r.item) for r in got] == [(0, 0, "a"), (0, 1, "b"), (2, 0, "c"), (2, 1, None), (2, 2, None)]


def test_closure_path_with_cycle_and_skip(spark):
    df = spark.createDataFrame([(0, None, ""), (1, 0, "a"), (2, 1, "x.rmdblob"), (3, 2, "c"), (4, 5, "p"), (5, 4, "q"), (6, 6, "self")], "i int, up int, n string")
    got = {r.i: (r.path, r.is_cycle) for r in k.closure_path(df, "i", "up", "n", skip=F.endswith("n", F.lit(".rmdblob")) | (F.col("n") == "")).collect()}
    assert got[3] == ("a/c", False) and got[6] == ("self", False) and got[4][1] and got[5][1]


def test_closure_path_of_any_depth(spark):
    chain = [(i, i - 1 if i else None, f"n{i}") for i in range(150)] + [(1000, 1001, "a"), (1001, 1002, "b"), (1002, 1000, "c"), (1003, 1000, "below"), (2000, 9999, "dangling")]
    df = spark.createDataFrame(chain, "i int, up int, n string")
    got = {r.i: (r.path, r.is_cycle) for r in k.closure_path(df, "i", "up", "n").collect()}
    assert len(got) == len(chain) and got[149] == ("/".join(f"n{i}" for i in range(150)), False) and got[2000] == ("dangling", False)
    assert all(got[i] == (None, True) for i in (1000, 1001, 1002, 1003))


def test_variants_and_patches(spark):
    df = spark.createDataFrame([("a",), ("a-development",), ("b-development",)], "p string")
    assert rows(k.without_variant(df, "p", "-development"), "p") == [("a",), ("b-development",)]
    base = spark.createDataFrame([("k", "1"), ("l", "2")], "k string, v string")
    patched, missing = k.apply_patches(base, spark.createDataFrame([("k", "9"), ("z", "0")], "k string, v string"), "k", "v")
    assert rows(patched, "k", "v") == [("k", "9"), ("l", "2")] and rows(missing, "k") == [("z",)]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(tx.extension(F.lit("a/B.TXT"))) == ".txt" and one(tx.extension(F.lit("a"))) == "<no extension>"
    assert one(tx.safe_name(F.lit("__a b/é"))) == "a_b" and one(tx.safe_name(F.lit("é"))) == "x"
    assert one(tx.categories(F.lit("MUS_Boss-sting_hit"))) == ["music", "stingers"]
    assert one(tx.categories(F.lit("amb_drone_env"))) == ["ambience", "beds", "environment"]
    assert one(tx.categories(F.lit("ui_env"))) == [] and one(tx.categories(F.lit("ui"), F.array(F.lit(11)))) == ["music"]
    assert one(tx.grammar_quest(F.lit("cine_mq01_intro_s0010_g001a_talk"))) == "mq01_intro"
    assert one(tx.path_is_safe(F.lit("a/b"))) and not one(tx.path_is_safe(F.lit("a/../b"))) and not one(tx.path_is_safe(F.lit("/a")))
    assert one(tx.srt_time(F.lit(3_723_004))) == "01:02:03,004" and one(tx.srt_time(F.lit(-5))) == "00:00:00,000"
    assert one(tx.fnv1a32(F.lit("a").cast("binary"))) == 0xE40C292C and one(tx.fnv1a32(F.lit("").cast("binary"))) == 0x811C9DC5
    cues = one(tx.cues(F.lit("[0-1.5] hi [2-3][4-5]yo"), F.lit(10.0), F.lit(1.0)))
    assert [(c.begin, c.end, c.text) for c in cues] == [(10.0, 11.5, "hi"), (14.0, 15.0, "yo")]
    assert [(c.begin, c.end) for c in one(tx.cues(F.lit("plain"), F.lit(1.0), F.lit(0.1)))] == [(1.0, 1.5)]
