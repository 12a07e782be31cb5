"""URL filters: allow and block rules first, then naive Bayes over segmented hosts.

A host such as ``cheappills.example.com`` is split at its marks, and each label
into the most probable words by a unigram Viterbi search. Word probabilities
come from counts over all pages; the classes' token counts come from all pages,
too. What a page is labelled as in training is said by its content, not by its
url: any condition on the page can be given, and by default a page counts towards
``block`` if its text has a seed word (a fixed parameter). Naive Bayes then learns
which words of urls go with such content, and judges urls alone.

All words and all tokens count, however long or rare. Tables are looked up by the
keys that occur: the keys met most often, at most ``most``, are broadcast with
their values, all others are joined (``look_up``). Names are segmented once for each distinct run of letters,
urls are judged once for each distinct host and path.
Defined results: a null url, or one without ``://``, has an empty host and path
and no tokens, so the class sizes decide; a null html has no words; other
columns pass through ``filter_urls``, but those that it adds replace input columns
of their names. Rules of equal length go alphabetically.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialise

#: (verdict, host, path) as the contract has them.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SEEDS = ("adult", "bet", "bets", "betting", "casino", "cheap", "escort", "loan", "loans", "lottery", "pharma", "pharmacy", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "torrent", "viagra", "warez", "xxx")
CLASSES = ("allow", "block")
#: So many of the keys met most often are broadcast, if they are no longer than this; the join finds the others.
MOST_SHARED, LONGEST_SHARED = 50_000, 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: Iterable[tuple[str, str, str]], wanted: int | None = None) -> Column:
    """The text (or, if ``wanted`` is 0, the verdict) of the longest fitting rule, or null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule[1]) | F.endswith(host, F.lit(f".{rule[1]}"))) & F.startswith(path, F.lit(rule[2]))
        value = F.lit(rule[0] if wanted == 0 else rule[1] + rule[2])
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


class Segmenter:
    """Splits concatenated names into words by their probabilities.

    ``total`` is the count of all words and one, and ``lengths`` are those that
    words have, if ``counts`` holds only some of them.
    """

    def __init__(self, counts: Mapping[str, int], total: int | None = None, lengths: Iterable[int] | None = None):
        self.total = total = sum(counts.values()) + 1 if total is None else total
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.lengths = sorted({len(w) for w in counts} if lengths is None else lengths)
        self.unknown, self.letter = math.log(total), math.log(30)

    def split(self, name: str, more: Mapping[str, int] | None = None) -> tuple[str, ...]:
        """The words of a name; ``more`` has counts of words that only this name needs.

        An unknown word costs more with each letter. The best way whose last word
        is unknown is kept beside the best way, so unknown words have any length.
        """
        rare = {w: math.log(self.total / n) for w, n in more.items()} if more else {}
        best, cut, odd, odd_start = [0.0], [0], math.inf, 0
        for end in range(1, len(name) + 1):
            if best[end - 1] + self.unknown < odd:
                odd, odd_start = best[end - 1] + self.unknown, end - 1
            odd += self.letter
            value, start = odd, odd_start
            for length in self.lengths:
                if length > end:
                    break
                word = name[end - length : end]
                cost = self.cost.get(word, rare.get(word))
                if cost is not None and best[end - length] + cost < value:
                    value, start = best[end - length] + cost, end - length
            best.append(value)
            cut.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[cut[end] : end])
            end = cut[end]
        return tuple(reversed(out))


def runs_of(host: str, path: str) -> list[str]:
    """Runs of letters of the host's labels (``h:``) and of the path (``p:``), whole; numbers become ``0``."""
    return [f"{side}:{'0' if x.isdigit() else x}" for side, text in (("h", host), ("p", path.lower())) for x in re.findall(r"[a-z]+|\d+", text)]


def pieces_of(run: str, lengths: Iterable[int]) -> Iterator[str]:
    """All parts of a run that are as long as words are."""
    return (run[a : a + n] for n in lengths for a in range(len(run) - n + 1))


def page_words(html: Column) -> Column:
    """The lower-case words of a page's text: tags are taken out, and the rest is cut at everything but letters."""
    text = F.lower(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " "))
    return F.split(F.regexp_replace(text, r"[^\p{L}]+", " "), " ")


@dataclass
class Words:
    """Counts of words (key, value), their sum and the lengths that occur."""

    counts: DataFrame
    total: int
    lengths: list[int]


def word_counts(pages: DataFrame, seeds: tuple[str, ...] = SEEDS) -> Words:
    """Counts of the words of all pages' texts.

    Urls don't count: a concatenated name would vouch for itself. Seeds have at
    least the mean count.
    """
    word = F.explode(page_words(F.col("html"))).alias("key")
    counts = pages.select(word).where(F.length("key") >= 2).groupBy("key").agg(F.count("*").alias("value"))
    counts = materialise(counts, "url-words")
    found = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0)).alias("total")).first()
    mean = max(1, found["total"] // max(1, found["n"]))
    own = {r["key"]: r["value"] for r in counts.where(F.col("key").isin(*seeds)).collect()}
    lifted = [(s, max(mean, own.get(s, 0))) for s in dict.fromkeys(seeds)]
    total = found["total"] - sum(own.values()) + sum(n for _, n in lifted)
    # Words that letters of urls can make.
    lengths = {r["n"] for r in counts.where(F.rlike("key", F.lit("^[a-z]+$"))).select(F.length("key").alias("n")).distinct().collect()}
    table = counts.where(~F.col("key").isin(*seeds)).union(pages.sparkSession.createDataFrame(lifted, counts.schema))
    return Words(table, total, sorted(lengths.union(map(len, seeds))))


def look_up(rows: DataFrame, column: str, keys_of: Callable[[object], Iterable[str]], table: DataFrame, label: str, most: int) -> tuple[DataFrame, Broadcast]:
    """What ``table`` (key, value) says of the keys of each row (``id``, ``column``), exactly.

    Returns the rows with ``keys`` and ``values`` of keys that few rows share,
    and a broadcast dictionary of the keys met most often (null where the table
    has no such key). A key that is in neither isn't in the table. The dictionary
    has at most ``most`` keys of at most ``LONGEST_SHARED`` characters.
    """

    def keys(skip: Broadcast | None) -> DataFrame:
        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = skip.value if skip else {}
            for rows in batches:
                each = ((i, k) for i, x in zip(rows["id"], rows[column], strict=True) for k in keys_of(x) if k not in known)
                while part := list(islice(each, 50_000)):
                    yield pd.DataFrame(part, columns=["id", "key"])

        return rows.select("id", column).mapInPandas(spread, "id long, key string")

    met = materialise(keys(None).groupBy("key").agg(F.count("*").alias("times")).join(table, "key", "left"), label)
    # By powers of two, so that no task sends keys that aren't among them.
    frequent = met.where((F.col("times") > 1) & (F.length("key") <= LONGEST_SHARED)).withColumn("level", F.floor(F.log2("times")))
    room, least = most, 99
    for level, n in sorted(((r["level"], r["n"]) for r in frequent.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True):
        if n > room:
            break
        room, least = room - n, level
    often = frequent.where(F.col("level") >= least)
    shared = rows.sparkSession.sparkContext.broadcast({r["key"]: r["value"] for r in often.collect()})
    rest = keys(shared).join(met.where(F.col("value").isNotNull()).select("key", "value"), "key").groupBy("id").agg(F.collect_set(F.struct("key", "value")).alias("found"))
    return rows.join(rest.select("id", F.col("found.key").alias("keys"), F.col("found.value").alias("values")), "id", "left"), shared


def _found(keys, values) -> dict:
    return {} if keys is None else dict(zip(keys, values, strict=True))


def segmented(runs: DataFrame, words: Words, most: int = MOST_SHARED) -> DataFrame:
    """The words of each run (``id``, ``run``) as key, value."""
    total, lengths = words.total, words.lengths
    rows, shared = look_up(runs, "run", lambda run: pieces_of(run, lengths), words.counts, "url-pieces", most)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter = Segmenter({w: n for w, n in shared.value.items() if n is not None}, total + 1, lengths)
        for rows in batches:
            parts = [segmenter.split(run, _found(k, v)) for run, k, v in zip(rows["run"], rows["keys"], rows["values"], strict=True)]
            yield pd.DataFrame({"key": rows["run"], "value": pd.Series(parts, dtype=object)})

    return materialise(rows.select("run", "keys", "values").mapInPandas(split, "key string, value array<string>"), "url-segmented")


def tokens_of(pages: DataFrame, words: Words, most: int = MOST_SHARED, label: Column | None = None) -> DataFrame:
    """Each distinct host and path with its number of pages, of those labelled ``bad``, and its tokens."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def runs(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([runs_of(a, b) for a, b in zip(host, path, strict=True)], dtype=object)

    host, path = host_and_path(F.col("url"))
    marked = F.coalesce(label if label is not None else F.lit(False), F.lit(False))
    urls = pages.select(host.alias("host"), path.alias("path"), marked.alias("bad")).groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    urls = materialise(urls.select("host", "path", "n", "bad", runs("host", "path").alias("runs")).withColumn("id", F.monotonically_increasing_id()), "url-runs")
    names = urls.select(F.explode(F.transform("runs", lambda r: F.substring(r, 3, 2**30))).alias("run")).where("run != '0'").distinct()
    names = materialise(names.withColumn("id", F.monotonically_increasing_id()), "url-names")
    rows, shared = look_up(urls, "runs", lambda runs: {r[2:] for r in runs}, segmented(names, words, most), "url-names", most)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(runs: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for r, k, v in runs:
            out = []
            for own, keys, values in zip(r, k, v, strict=True):
                # Numbers are no names: they are found nowhere, and stay as they are.
                rare = _found(keys, values)
                out.append([x[:2] + w for x in own for w in (("0",) if x[2:] == "0" else rare[x[2:]] if x[2:] in rare else shared.value[x[2:]])])
            yield pd.Series(out, dtype=object)

    return materialise(rows.select("id", "host", "path", "n", "bad", tokens("runs", "keys", "values").alias("tokens")), "url-tokens")


@dataclass
class Bayes:
    """Log odds of ``block`` from token counts of both classes, with one added to each.

    ``odds`` has them for all tokens (key, value).
    """

    odds: DataFrame
    prior: float


def train(pages: DataFrame, label: Column | None = None, seeds: tuple[str, ...] = SEEDS, most: int = MOST_SHARED) -> tuple[Words, Bayes]:
    """Word counts and the class model, both from all pages.

    ``label`` says of a page that it is to be blocked; by default it is that its
    text has a seed word. A null label is no.
    """
    words = word_counts(pages, seeds)
    label = F.arrays_overlap(page_words(F.col("html")), F.array(*map(F.lit, seeds))) if label is None else label
    seen = tokens_of(pages, words, most, label).withColumn("good", F.col("n") - F.col("bad"))
    sums = lambda df: df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "bad")), F.count("*").alias("n")).first()
    table = seen.select("good", "bad", F.explode("tokens").alias("key")).groupBy("key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    table = materialise(table, "url-counts")
    whole, each = sums(seen), sums(table)
    rate = lambda c: F.log((F.col(c) + 1) / F.lit(float(each[c] + each["n"] + 1)))
    return words, Bayes(table.select("key", (rate("bad") - rate("good")).alias("value")), math.log((whole["bad"] + 1) / (whole["good"] + 1)))


def filter_urls(pages: DataFrame, words: Words, model: Bayes, rules: Iterable[tuple[str, str, str]] = RULES, most: int = MOST_SHARED) -> DataFrame:
    """Adds host, path, rule, verdict, the segmented host and the log odds of ``block``."""
    rules, prior = tuple(rules), model.prior
    rows, shared = look_up(tokens_of(pages, words, most), "tokens", set, model.odds, "url-odds", most)

    @F.pandas_udf("double")
    def log_odds(tokens: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, k, v in tokens:
            # An exact sum: no order of tokens changes it. Tokens that training never saw say nothing.
            rare = [_found(*found) for found in zip(k, v, strict=True)]
            yield pd.Series([round(math.fsum([prior, *(r[x] if x in r else shared.value.get(x) or 0.0 for x in own)]), 6) for own, r in zip(t, rare, strict=True)], dtype=float)

    spoken = F.array_join(F.transform(F.filter("tokens", lambda t: F.startswith(t, F.lit("h:"))), lambda t: F.substring(t, 3, 2**30)), " ")
    judged = rows.select("host", "path", spoken.alias("host_words"), log_odds("tokens", "keys", "values").alias("log_odds"))
    host, path = host_and_path(F.col("url"))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "host_words", "log_odds")]
    out = pages.select(*own, host.alias("host"), path.alias("path")).join(judged, ["host", "path"])
    verdict = F.coalesce(rule_column(F.col("host"), F.col("path"), rules, 0), F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return out.select(*own, "host", "path", rule_column(F.col("host"), F.col("path"), rules).alias("rule"), verdict.alias("verdict"), "host_words", "log_odds")
