"""N-gram Jaccard join: which documents share most of their word shingles.

A document's set holds the 64-bit hashes of its 5-word shingles. Two documents
link when intersection and union are in the proportion 4 to 5 at least. The
result labels connected components, so a pair within a component that is known
already need not be looked at; between components no pair is left out.

Grouped prefix join. Sets are collapsed to classes of equal sets, classes of
equal size and equal prefix to groups; only a group's leader is indexed. Tokens
are ordered by how common they are (lossy counts in a table of hash buckets,
by powers of two), the rarest first, so a passage that many documents share comes
last and seldom enters a prefix. Two sets that link share a prefix token.

What bounds a pair: prefix tokens that no other group has (a near copy's own
changes) are in no common part. A posting carries ``left``, the set's size less
such tokens before it; neither side's ``left`` can be exceeded by the overlap.
As own changes are rare tokens, they come first, and a set that changed too much
to link with the middle of its family is dropped from the family's lists by
``left`` alone, before any pair is made.

Stars: in every list the set with the largest ``left`` for its size, the
family's middle, is the hub; it is paired with all others of the list, and every
group's leader with its classes. Pairs are verified on whole sets and components
formed: linear in the postings. As long as the lists that still hold several
components would give more than ``PAIRS_A_POSTING`` pairs a posting, and the last
stars linked something, the sets outside the hub's component get a star of their
own. The rest is exact: in lists of several components, sets outside the hub's
component are paired with the others; pairs of groups are filtered by size,
``left`` and the number of shared prefix tokens (a bound on the overlap that
holds for all members), expanded to members of different components, and
verified.

Id filters that tasks share have a fixed most size. One only tells which rows
surely need no join; the others are joined exactly.

Defined results: null text, or text without words, has an empty set and links
with nothing; a text of fewer than five words is one shingle; rows of equal
``doc_id`` are one document, linked by what any of them says; a null ``doc_id``
keeps its row with a null component; other columns are ignored. Sets hold
hashes: among N different shingles some two collide with a probability of about
N^2 / 2^65, which could alter a size or a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, materialise, small_batches
from tessera.llm.shingles import first_tokens, set_hashes, shingle_sets

MOST_BITS = 24
PAIRS_A_POSTING, MOST_STARS = 64, 8


def slots_for(n: int) -> int:
    """Slots for ``n`` documents: a power of two within fixed bounds."""
    return 1 << min(MOST_BITS, max(10, (16 * max(1, n)).bit_length()))


def marked(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Adds ``_maybe``: false only if the row's ``doc_id`` surely isn't among ``ids``.

    The filter is a bit for each of at most ``2**MOST_BITS`` slots, 64 a row, so
    what is broadcast has a fixed most size.
    """
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(slots_for(n)))
    bits = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 AS int)))").alias("_bits"))
    held = rows.withColumn("_slot", slot).join(F.broadcast(bits), F.shiftright("_slot", 6) == F.col("_word"), "left")
    maybe = F.coalesce(F.expr("(shiftright(_bits, cast(_slot & 63 AS int)) & 1) = 1"), F.lit(False))
    return held.withColumn("_maybe", maybe).select(*rows.columns, "_maybe")


def prefix_size(n: Column) -> Column:
    """How many first tokens of a set of ``n`` must meet any set that it links with."""
    return n - F.floor((4 * n + 4) / 5).cast("int") + 1


def _prefix_sizes(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)


def enough(overlap: Column, n: Column, m: Column) -> Column:
    """Whether sets of ``n`` and ``m`` with that overlap link: 100 o >= 80 (n + m - o)."""
    return 9 * overlap >= 4 * (n + m)


def _sizes_fit(n: Column, m: Column) -> Column:
    return (5 * n >= 4 * m) & (5 * m >= 4 * n)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(values[ends[0] : ends[-1]], pa.int64()))


class Corpus:
    """The documents, and what all steps need to know of them."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        self.scratch = Scratch(docs.sparkSession, "jaccard")
        self.n = self.docs.count()
        self.levels = docs.sparkSession.sparkContext.broadcast(self._levels(slots_for(self.n)))

    def _levels(self, size: int) -> np.ndarray:
        """For each bucket of tokens how common it is, as a power of two.

        Lossy counting: a task reports only buckets that it met far more often
        than the mean bucket, so what comes together are the common ones; the
        others are level 0.
        """

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(size, np.int32)
            for batch in batches:
                for sets in shingle_sets(batch.column("text")):
                    slots = sets.values & (size - 1)
                    for a, b in zip(sets.ends[:-1], sets.ends[1:], strict=True):
                        seen[slots[a:b]] += 1
            often = np.flatnonzero(seen > 3 + 4 * seen.mean())
            yield pa.RecordBatch.from_arrays([pa.array(often, pa.int32()), pa.array(seen[often], pa.int32())], ["slot", "n"])

        counts = self.docs.select("text").mapInArrow(count, "slot int, n int").groupBy("slot").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("level"))
        found, levels = counts.toPandas(), np.zeros(size, np.uint8)
        levels[found["slot"].to_numpy(np.int64)] = np.minimum(found["level"].to_numpy(np.int64), 31)
        return levels

    def signatures(self) -> DataFrame:
        """Per row: n, h1 and h2 (128-bit hash of the set), ph (of the prefix), p (the prefix)."""
        levels = self.levels

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for sets in shingle_sets(batch.column("text")):
                    ids = batch.column("doc_id").slice(sets.first_row, len(sets.ends) - 1)
                    h1, h2 = set_hashes(sets.values, sets.ends)
                    tokens, ends = first_tokens(sets, levels.value, _prefix_sizes)
                    columns = [ids, pa.array(sets.sizes, pa.int32()), *(pa.array(x, pa.int64()) for x in (h1, h2, set_hashes(tokens, ends)[0])), _lists(tokens, ends)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "h1", "h2", "ph", "p"])

        return self.docs.mapInArrow(sign, "doc_id long, n int, h1 long, h2 long, ph long, p array<long>")

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """The whole sets of some documents: only texts that may be theirs are joined."""

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for sets in shingle_sets(batch.column("text")):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(sets.first_row, len(sets.ends) - 1), _lists(sets.values, sets.ends)], ["doc_id", "s"])

        near = marked(self.docs, ids, self.n).where("_maybe").select("doc_id", "text")
        return near.mapInArrow(whole, "doc_id long, s array<long>").join(ids, "doc_id", "left_semi")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those whose sets link."""
        ids = self.scratch.table(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
        sets = self.sets_of(ids)
        both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
        return both.where(enough(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"))).select("a", "b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the least node in reach.

    Each step takes the least label among neighbours, then follows labels once;
    steps are written to the shared folder, which ends their lineage.
    """
    ways = scratch.table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = scratch.table(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = ways.join(labels, ways["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        step = step.join(jump, "mid", "left").select("node", "old", F.least("mid", "far").alias("label"))
        done = scratch.table(step, "labels")
        labels = done.select("node", "label")
        if not done.where(F.col("old") != F.col("label")).take(1):
            return labels


def _postings(corpus: Corpus, signed: DataFrame) -> DataFrame:
    """(token, doc, n, left) of the groups' leaders, for tokens that several groups have."""
    groups = signed.groupBy("n", "ph").agg(F.min_by("p", "doc_id").alias("p"), F.min("doc_id").alias("doc"))
    groups = corpus.scratch.table(groups.select("doc", "n", "p"), "prefixes")
    each = groups.select("doc", "n", F.posexplode("p").alias("pos", "token")).repartition("token")
    shared = each.join(each.groupBy("token").agg(F.count("*").alias("lists")).where("lists > 1").select("token"), "token")
    # Of the prefix tokens before the k-th shared one (from 0), pos - k are no one else's.
    k = F.row_number().over(W.partitionBy("doc").orderBy("pos")) - 1
    return corpus.scratch.table(shared.select("token", "doc", "n", (F.col("n") - F.col("pos") + k).alias("left")), "postings")


def _hub_order(rank: str = "doc") -> Column:
    return F.struct((F.col("left") / F.col("n")).alias("l"), (-F.col(rank)).alias("d"))


def _stars(postings: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's hub with the others that can link with it."""
    dealt = postings.repartition("token")
    hubs = dealt.groupBy("token").agg(F.max_by(F.struct(F.col("doc").alias("hub"), F.col("n").alias("m"), F.col("left").alias("hub_left")), _hub_order()).alias("h")).select("token", "h.*")
    near = _sizes_fit(F.col("n"), F.col("m")) & enough(F.least("left", "hub_left"), F.col("n"), F.col("m"))
    pairs = dealt.join(hubs, "token").where((F.col("doc") != F.col("hub")) & near).groupBy("hub", "doc", "n").agg(F.count("*").alias("c"))
    # Any choice is right here, as the last round is exact: pairs that share little are left to it.
    return pairs.where(20 * F.col("c") >= prefix_size(F.col("n"))).select(F.col("hub").alias("a"), F.col("doc").alias("b"))


def _open_lists(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """The postings of lists that hold several components, and whether each is apart from its hub's.

    A posting is dropped whose ``left`` is too small for the list's smallest set.
    What is dealt by token stays so for all that follows, so this isn't written.
    """
    posted = postings.join(groups.withColumnRenamed("leader", "doc"), "doc").repartition("token")
    lists = posted.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.max_by("main", _hub_order()).alias("hub_comp"), F.min("n").alias("least"))
    alive = enough(F.col("left"), F.col("n"), F.greatest(F.col("least"), F.ceil(4 * F.col("n") / 5)))
    apart = (F.col("low") != F.col("hub_comp")) | (F.col("high") != F.col("hub_comp"))
    found = posted.join(lists.where("l < h").drop("l", "h"), "token").where(alive)
    return found.select("token", "doc", "n", "left", "low", "high", apart.alias("apart"))


def link(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id."""
    with small_batches(docs.sparkSession):
        return _link(Corpus(docs))


def _link(corpus: Corpus) -> DataFrame:
    table = corpus.scratch.table
    signed = table(corpus.signatures(), "signatures")
    worded = signed.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = worded.groupBy("n", "h1", "h2", "ph").agg(F.min("doc_id").alias("node"))
    leaders = classes.groupBy("n", "ph").agg(F.min("node").alias("leader"))
    classes = table(classes.join(leaders, ["n", "ph"]), "classes")
    # Ids whose rows have different sets: the document, a node by its id, meets all classes of its rows.
    sign = F.struct("n", "h1", "h2")
    several = signed.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(sign).alias("x"), F.max(sign).alias("y")).where(F.col("x") != F.col("y"))
    several = table(several.select("doc_id", (F.col("x.n") == 0).alias("blank")), "several")
    mixed = table(signed.where(F.col("n") > 0).join(several, "doc_id").select("doc_id", "blank", "n", "h1", "h2"), "mixed")
    same = mixed.join(classes, ["n", "h1", "h2"]).where(F.col("doc_id") != F.col("node")).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    postings = _postings(corpus, worded)
    within = classes.where(F.col("node") != F.col("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    pairs = _stars(postings).union(within).distinct()
    edges = table(corpus.verified(table(pairs, "pairs")).union(same), "links")
    first = components(edges, corpus.scratch)
    for star in range(MOST_STARS + 1):
        named = classes.select("node", "leader", "n").join(first, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
        named = table(named, "named")
        groups = named.groupBy("leader").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min_by("comp", "node").alias("main"))
        open_lists = _open_lists(postings, groups)
        sizes = open_lists.groupBy("token").agg(F.count("*").alias("all"), F.count_if("apart").alias("apart"))
        load = sizes.agg(F.sum(F.col("all") * F.col("apart")).alias("pairs"), F.sum("all").alias("rows")).first()
        if star == MOST_STARS or (load["pairs"] or 0) <= PAIRS_A_POSTING * (load["rows"] or 0):
            break
        more = table(corpus.verified(table(_stars(open_lists.where("apart")).distinct(), "pairs")), "links")
        if not more.take(1):
            break
        edges = table(edges.union(more).distinct(), "links")
        first = components(edges, corpus.scratch)
    last = _last_round(corpus, open_lists, named, groups)
    known = classes.join(first.withColumnRenamed("label", "mid"), "node", "left").withColumn("mid", F.coalesce("mid", "node"))
    known = known.join(components(last, corpus.scratch).select(F.col("node").alias("mid"), F.col("label").alias("end")), "mid", "left")
    known = known.select("n", "h1", "h2", F.coalesce("end", "mid").alias("component"))
    # Rows without words are in no class; those of an id that has words elsewhere go with it.
    other = mixed.where("blank").join(known, ["n", "h1", "h2"]).groupBy("doc_id").agg(F.min("component").alias("other"))
    out = signed.select("doc_id", "n", "h1", "h2").join(known, ["n", "h1", "h2"], "left").join(table(other, "blank"), "doc_id", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "other", "doc_id"))
    found = materialise(out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.cast("long").alias("component_id")), "jaccard-found")
    corpus.scratch.clear()
    return found


def _last_round(corpus: Corpus, open_lists: DataFrame, named: DataFrame, groups: DataFrame) -> DataFrame:
    """Links between components, as edges between their labels: exact."""
    x = open_lists.where("apart").select("token", F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("left").alias("ex"), F.col("low").alias("xl"), F.col("high").alias("xh"))
    y = open_lists.select("token", F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("left").alias("ey"), F.col("low").alias("yl"), F.col("high").alias("yh"), (~F.col("apart")).alias("inside"))
    differ = (F.least("xl", "yl") != F.greatest("xh", "yh")) & (F.col("x") != F.col("y"))
    fits = _sizes_fit(F.col("nx"), F.col("ny")) & enough(F.least("ex", "ey"), F.col("nx"), F.col("ny"))
    pairs = x.join(y, "token").where(differ & (F.col("inside") | (F.col("x") < F.col("y"))) & fits)
    lesser = F.col("x") < F.col("y")
    pick = lambda a, b: F.when(lesser, F.col(a)).otherwise(F.col(b))
    shared = pairs.groupBy(pick("x", "y").alias("g"), pick("y", "x").alias("k"), pick("nx", "ny").alias("ng"), pick("ny", "nx").alias("nk")).agg(F.count("*").alias("c"))
    rest = F.greatest(F.col("ng") - prefix_size(F.col("ng")), F.col("nk") - prefix_size(F.col("nk")))
    likely = corpus.scratch.table(shared.where(enough(F.col("c") + rest, F.col("ng"), F.col("nk"))).select("g", "k"), "groups")
    member = lambda side, leader: named.select(F.col("leader").alias(leader), F.col("node").alias(side), F.col("comp").alias(f"{side}c"))
    crossed = likely.join(member("a", "g"), "g").join(member("b", "k"), "k").where(F.col("ac") != F.col("bc")).select("a", "b", "ac", "bc")
    mixed_groups = groups.where(F.col("low") != F.col("high")).select(F.col("leader").alias("g"), "main")
    odd = mixed_groups.join(member("a", "g"), "g").where(F.col("ac") != F.col("main"))
    inner = odd.join(member("b", "g"), "g").where((F.col("ac") != F.col("bc")) & ((F.col("bc") == F.col("main")) | (F.col("a") < F.col("b")))).select("a", "b", "ac", "bc")
    found = corpus.scratch.table(crossed.union(inner).distinct(), "pairs")
    true = corpus.verified(found.select("a", "b").distinct())
    return true.join(found, ["a", "b"]).select(F.col("ac").alias("a"), F.col("bc").alias("b")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents whose id is the least of their component.

    Ids that go make a filter; rows that it surely doesn't hold stay without a
    join, and rows of a null id stay.
    """
    found = link(docs)
    gone = materialise(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "jaccard-gone")
    held = marked(docs, gone, found.count())
    unsure = held.where("_maybe").join(gone.withColumnRenamed("doc_id", "_gone"), F.col("doc_id") == F.col("_gone"), "left_anti")
    return held.where("NOT _maybe").unionByName(unsure).drop("_maybe")
