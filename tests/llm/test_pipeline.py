import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import RANKS, brute_links, check_bins, greedy, plain_best_fit, plain_stats

import corpus_pipeline
from tessera.llm import byte_bpe, classifier_chain, decision_list, packing, queries, wordpiece

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test")
        out.append(docs)
    return out


def test_stages_only_take_away(spark, stages):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for df in stages[:-1]:
        now = {r.doc_id: r.text for r in df.collect()}
        assert df.columns == list(corpus_pipeline.COLUMNS)
        assert set(now) <= set(before) and all(before[i] == t for i, t in now.items())
        before = now
    assert {r.doc_id for r in stages[-1].collect()} == set(before)


def test_stages_match_plain_versions(spark, stages):
    """Each stage against a loop over all its rows in Python."""
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = [{r.doc_id: r for r in df.collect()} for df in stages]
    before = {r.doc_id: r.text for r in whole.collect()}
    chain = classifier_chain.train(whole, labels)
    p = chain.probabilities([classifier_chain.features_of(t, chain.known) for t in before.values()])[:, -1]
    assert set(kept[0]) == {i for i, x in zip(before, p, strict=True) if not (chain.weights and x >= chain.threshold)}
    rules = decision_list.learn(decision_list.labelled_sample(whole, labels))
    want = set()
    for r in decision_list.text_stats(stages[0]).collect():
        n, _, _, _, again = plain_stats(r.text)
        fires = any(all((r[t.feature] <= t.bound) == t.below for t in rule) for rule in rules)
        if n >= 10 and 100 * again <= 20 * n and not fires:
            want.add(r.doc_id)
    assert set(kept[1]) == want
    assert set(kept[2]) == {i for i, (_, c) in brute_links([(i, r.text) for i, r in kept[1].items()]).items() if i == c}
    first, later = wordpiece.word_vocabulary(byte_bpe.read_ranks(RANKS))
    lengths = [1 + sum(greedy(w.encode(), first, later) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in kept[2].values()]
    pieces = [r.asDict() for r in stages[3].collect()]
    assert check_bins(pieces) == plain_best_fit([min(4096, n - k) for n in lengths for k in range(0, n, 4096)], packing.LENGTHS)


ODD_ROWS = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 300_000, "en", "s", 1), (4, "a b c d e f g h i j k l", None, None, None), (4, "a b c d e f g h i j k l", None, None, None), (None, "one two three four five six seven eight nine ten eleven", "en", "s", 5), (5, "a b c d e f g h i j k l", "x", "y", 3)]


@pytest.mark.parametrize("k", range(4))
def test_stages_take_odd_rows(spark, k):
    """Nulls, empty and very long texts, repeated rows, clashing columns and an empty table."""
    docs = spark.createDataFrame([(*r, "clash", 1.0, True) for r in ODD_ROWS], "doc_id long, text string, lang string, source string, n_chars long, kept string, p_toxic double, bin_id boolean")
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs, SF).collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got)
    if k == 0:
        assert len(got) == len(ODD_ROWS)
    elif k == 1:
        assert ids == [(False, 4), (False, 4), (False, 5), (True, 0)]
    elif k == 2:
        assert ids == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 4), (True, 0)]
    else:
        assert len({r.bin_id for r in got}) >= 1 and {(r.doc_id is None, r.doc_id or 0) for r in got} == {(i is None, i or 0) for i, *_ in ODD_ROWS}
    assert stage(spark, docs.where("false"), SF).count() == 0


def test_clean_documents_stay(spark):
    """On a table with some hundred toxic labels."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    left = corpus_pipeline.toxicity(spark, docs, sf).select("doc_id", F.lit(True).alias("kept"))
    counts = labels.join(docs.select("doc_id"), "doc_id", "left_semi").join(left, "doc_id", "left").groupBy("toxic").agg(F.count("*").alias("n"), F.count("kept").alias("kept")).collect()
    toxic, clean = (next(r for r in counts if r.toxic == on) for on in (1, 0))
    assert clean.kept >= 0.97 * clean.n and toxic.kept <= 0.2 * toxic.n


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))
