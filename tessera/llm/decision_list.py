"""Quality rules: a learned, ordered list of threshold rules over text statistics.

``text_stats`` computes the statistics with SQL functions within each row.
``learn`` runs sequential covering on labelled statistics: a rule is grown one
threshold at a time by information gain, pruned from its end on held-out rows,
kept if it is precise there, and the rows that it covers are taken out before
the next. Covering ends when no bad row is left, a rule isn't precise, or after
``most_rules`` rules of ``most_tests`` tests each: what it doesn't cover is kept.
``verdict`` turns the list into one ordered conditional expression, so
scoring stays in the JVM and shuffles nothing.

Statistics are learned from at most ``max_labelled`` labelled documents (a
bound of the classifier alone; chosen by hash of ``doc_id``) and applied to
every whole text. Arrays over all words of a text take some hundred bytes a word
in one row; texts of more than ``LONG`` characters are therefore cut between
words into rows, whose counts are added up by ``_long_stats`` to the same values.

Defined results: a null text has no words and fails the base
rules; labels that are null are left out; of repeated labels the greatest
counts; without labels of both kinds the list is empty and keeps all; other
columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, materialise, window_hash, words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test, each a ratio of statistics that doesn't depend on length.
FEATURES = ("word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "bang_rate", "distinct_rate", "line_words", "digit_rate")
SYMBOLS = r"[^#*$%&|<>]+"
GRAM = 5
#: Characters of a text from which on it is counted in rows of parts, and of a part, unless a word or line is longer.
LONG, PART = 1 << 20, 1 << 16
_MARKS = ("_lines", "_kinds", "_upper", "_bangs", "_digits")
_INNER = ("_t", "_w", "_g", "_s", "_p", "_l", *_MARKS, "_key", "base_failed", "rule", "kept")


def _left(text: str, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, ""))


def _has_word(line: Column) -> Column:
    return F.length(F.replace(F.translate(line, "\t\x0b\x0c\r", "    "), F.lit(" "), F.lit(""))) > 0


def _marks(text: str) -> list[Column]:
    return [_left(text, SYMBOLS).cast("long").alias("n_symbols"), _left(text, r"[^\p{Lu}]+").alias("_upper"), _left(text, "[^!]+").alias("_bangs"), _left(text, "[^0-9]+").alias("_digits")]


def _cut(text: str, ends: str) -> Column:
    """A text in parts, each up to the last of the characters ``ends`` within ``PART`` characters, or else the next."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{0,{PART}}}(?:[{ends}]|\z)|[^{ends}]+"), F.lit(0))


def _long_parts(docs: DataFrame) -> DataFrame:
    """Texts ``_t`` as rows: of ``_kind`` 0 the parts cut between words, of 1 those cut between lines."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.xxhash64("_t").alias("_key"), "_t")
    rows = rows.select("_row", "_key", F.posexplode(F.array(_cut("_t", r" \t\n\x0b\f\r"), _cut("_t", r"\n"))).alias("_kind", "_parts"))
    return rows.select("_row", "_key", "_kind", F.posexplode("_parts").alias("_k", "_part"))


def _long_stats(parts: DataFrame) -> DataFrame:
    """The statistics by ``_key``, the 64-bit hash of a text.

    Words are 64-bit hashes here. Each part's words are followed by the next four
    of the text, so every window lies in one part; windows are dealt by hash.
    Arrays that lambdas or filters read are exploded from an array around them,
    or the optimizer would put their expressions in those places.
    """
    held = lambda x: F.explode(F.array(x)).alias("_h")
    split = parts.where("_kind = 0").select("_row", "_key", "_k", "_part", words(F.col("_part")).alias("_w"))
    each = split.select("_row", "_key", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), *_marks("_part"))
    sums = each.groupBy("_row", "_key").agg(*(F.sum(c).alias(c) for c in each.columns[2:]))
    hashed = split.select("_row", "_k", held(F.transform("_w", lambda w: F.xxhash64(w)))).where(F.size("_h") > 0)
    kinds = hashed.select("_row", F.explode("_h").alias("_h")).distinct().groupBy("_row").agg(F.count("*").alias("_kinds"))
    order = W.partitionBy("_row").orderBy("_k")
    after = F.flatten(F.collect_list(F.slice("_h", 1, GRAM - 1)).over(order.rowsBetween(1, GRAM - 1)))
    before = F.coalesce(F.sum(F.size("_h")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = hashed.select("_row", "_h", before.alias("_first"), F.slice(after, 1, GRAM - 1).alias("_after")).select("_row", "_first", held(F.concat("_h", "_after"))).where(F.size("_h") >= GRAM)
    windows = F.transform(F.sequence(F.lit(0), F.size("_h") - GRAM), lambda i: window_hash(F.col("_h"), i, GRAM))
    windows = joined.select("_row", "_first", F.posexplode(windows).alias("_i", "_g"))
    windows = windows.select("_row", (F.col("_first") + F.col("_i")).alias("_i"), "_g")
    twice = windows.withColumn("_n", F.count("*").over(W.partitionBy("_row", "_g"))).where("_n > 1")
    step = F.col("_i") - F.lag("_i").over(W.partitionBy("_row").orderBy("_i"))
    covered = twice.select("_row", F.least(F.lit(GRAM), step).alias("n")).groupBy("_row").agg(F.sum("n").alias("n_repeat_words"))
    lines = parts.where("_kind = 1").select("_row", F.explode(F.split("_part", "\n")).alias("_l")).where(_has_word(F.col("_l")))
    lines = lines.groupBy("_row", F.md5("_l").alias("_l")).agg(F.count("*").alias("n")).groupBy("_row").agg(F.sum("n").alias("_lines"), F.sum(F.col("n") - 1).alias("n_dup_lines"))
    for other in (kinds, covered, lines):
        sums = sums.join(other, "_row", "left")
    return sums.dropDuplicates(["_key"]).select("_key", *(F.coalesce(c, F.lit(0)).alias(c) for c in (*BASE, *_MARKS)))


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base statistics and the features of each whole text.

    Repeated windows: the hashes of all windows of a text are sorted with their
    positions; equal neighbours mark the positions whose window occurs twice or
    more, and the words that those windows cover are counted once.
    """
    own = [c for c in docs.columns if c not in (*BASE, *FEATURES, *_INNER)]
    whole = docs.select(*own, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    long = whole.where(F.length("_t") > LONG)
    doc = whole.where(F.length("_t") <= LONG).withColumn("_w", words(F.col("_t")))
    doc = doc.withColumn("n_words", F.size("_w").cast("long"))
    windows = F.transform(F.sequence(F.lit(0), (F.col("n_words") - GRAM).cast("int")), lambda i: window_hash(F.col("_w"), i, GRAM))
    doc = doc.withColumn("_g", F.when(F.col("n_words") >= GRAM, windows))
    ordered = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    doc = doc.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), ordered))
    near = lambda k: F.get(F.col("_s"), k)["h"]
    twice = F.transform("_s", lambda x, k: F.when((near(k - 1) == x["h"]) | (near(k + 1) == x["h"]), x["i"]))
    doc = doc.withColumn("_p", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    start = F.struct(F.lit(-GRAM).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(GRAM), i - acc["last"])).alias("n"))
    covered = F.aggregate("_p", start, step, lambda acc: acc["n"])
    doc = doc.withColumn("_l", F.filter(F.split("_t", "\n"), _has_word))
    stats = F.struct(
        "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").alias("_lines"), F.size(F.array_distinct("_w")).alias("_kinds"), *_marks("_t"),
    )
    # Filters on the statistics must not be pushed below them: they would compute all of them again for each use.
    doc = doc.select(*own, F.inline(F.array(stats)))
    scratch = Scratch(docs.sparkSession, "long")
    parts = scratch.table(_long_parts(long), "parts")
    if not parts.isEmpty():
        counted = materialise(_long_stats(parts), "long-stats")
        doc = doc.unionByName(long.withColumn("_key", F.xxhash64("_t")).join(F.broadcast(counted), "_key").select(*own, *BASE, *_MARKS))
    scratch.clear()
    n, chars, lines = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("_lines", F.lit(1))
    rate = {
        "word_length": F.col("word_chars") / n, "symbol_rate": F.col("n_symbols") / n, "dup_line_rate": F.col("n_dup_lines") / lines,
        "repeat_rate": F.col("n_repeat_words") / n, "upper_rate": F.col("_upper") / chars, "bang_rate": F.col("_bangs") / n,
        "distinct_rate": F.col("_kinds") / n, "line_words": F.col("n_words") / lines, "digit_rate": F.col("_digits") / chars,
    }
    return doc.select(*own, *BASE, *(rate[k].alias(k) for k in FEATURES))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """One threshold: ``feature`` is at most (or above) ``bound``."""

    feature: str
    below: bool
    bound: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] <= self.bound if self.below else x[self.feature] > self.bound

    def column(self) -> Column:
        return F.col(self.feature) <= self.bound if self.below else F.col(self.feature) > self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'<=' if self.below else '>'} {self.bound:.6g}"


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for test in rule:
        out &= test.mask(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> Rule:
    """Adds the test of the greatest information gain until only bad rows are left."""
    rule, inside = (), np.ones(len(bad), bool)
    while len(rule) < most and bad[inside].any() and not bad[inside].all():
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        before, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for feature, bounds in cuts.items():
            at = np.searchsorted(bounds, x[feature][inside], side="left")
            p = np.cumsum(np.bincount(at[bad[inside]], minlength=len(bounds) + 1))[:-1]
            n = np.cumsum(np.bincount(at[~bad[inside]], minlength=len(bounds) + 1))[:-1]
            for below, pp, nn in ((True, p, n), (False, p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - before), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), Test(feature, below, float(bounds[k])))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].mask(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float]:
    """Drops tests from the end while held-out rows like the shorter rule as well."""
    best, worth = rule, -1.0
    for size in range(len(rule), 0, -1):
        inside = _covers(rule[:size], x, len(bad))
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        now = (p - n) / (p + n) if p + n else -1.0
        if now >= worth:
            best, worth = rule[:size], now
    inside = _covers(best, x, len(bad))
    return best, float(bad[inside].mean()) if inside.any() else 0.0


def learn(rows: list[tuple], features: tuple[str, ...] = FEATURES, bins: int = 64, most_rules: int = 12, most_tests: int = 4, precision: float = 0.95) -> list[Rule]:
    """The decision list for ``(bad, *features)`` rows, in order.

    A third of the rows (every third, in the order given) is held out for
    pruning; a rule must reach ``precision`` on those that it covers there.
    """
    bad = np.array([bool(r[0]) for r in rows], bool)
    x = {f: np.array([r[k + 1] for r in rows], float) for k, f in enumerate(features)}
    held, live, rules = np.arange(len(rows)) % 3 == 2, np.ones(len(rows), bool), []
    cuts = {f: np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) if len(v) else np.zeros(0) for f, v in x.items()}
    cuts = {f: c for f, c in cuts.items() if len(c)}
    while len(rules) < most_rules:
        grown, kept = live & ~held, live & held
        if not bad[grown].any() or not bad[kept].any() or bad[grown].all():
            break
        rule = _grow({f: v[grown] for f, v in x.items()}, bad[grown], cuts, most_tests)
        if not rule:
            break
        rule, exact = _prune(rule, {f: v[kept] for f, v in x.items()}, bad[kept])
        if exact < precision:
            break
        rules.append(rule)
        live &= ~_covers(rule, x, len(rows))
    return rules


def labelled_sample(stats_of: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> list[tuple]:
    """At most ``max_labelled`` rows of (bad, features), chosen by hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    plain = stats_of.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    found = text_stats(plain).where(~base_failed()).select(F.xxhash64("doc_id").alias("_h"), F.col("_quality") == 0, *FEATURES)
    return [tuple(r)[1:] for r in sorted(found.collect(), key=lambda r: tuple(r))]


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the number of the first rule that fires, or 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        fires = rule[0].column()
        for test in rule[1:]:
            fires = fires & test.column()
        out = F.when(fires, k) if out is None else out.when(fires, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """Adds the statistics, ``base_failed``, the ``rule`` that fired and ``kept``."""
    rules = learn(labelled_sample(labelled_docs, labels, max_labelled))
    scored = text_stats(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
