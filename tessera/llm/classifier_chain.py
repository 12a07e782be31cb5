"""Toxicity: a chain of linear classifiers over category labels.

The categories have an order. The model of each sees the text's features and
the probabilities of the categories before it. While it is trained, these
probabilities come from models that haven't seen the row (out-of-fold
predictions), so a later link doesn't trust earlier ones more than they merit.
The last category is the verdict: what the chain says of the earlier ones is
part of its input.

Features are the presence of lower-case words, of their first four to seven
characters, and a few marks of style; what counts is whether something occurs
in the whole text, not how often, so one insult in a long text counts as much
as in a short one. Training uses at most ``max_per_class`` labelled documents
of each verdict (a bound of the classifier alone; chosen by hash of the id). The
vocabulary is chosen on them by a distributed count and a test of significance;
as the sample is bounded, so are the vocabulary and the weights, which are broadcast.

Defined results: a null text has no words; rows without a verdict are left out,
of repeated ones the greatest of each label counts; a null label of an earlier
category is no; without labels of both kinds every probability is 0 and nothing
is toxic; other columns pass through ``score``, but those that it adds replace
input columns of their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_name

#: The categories that the tables' labels tell apart, in order, as conditions on labels: toxic junk, toxic prose, toxic.
CHAIN = {"toxic_junk": "toxic > 0 AND quality = 0", "toxic_prose": "toxic > 0 AND quality = 1", "toxic": "toxic > 0"}
WORD = re.compile(r"[^\W\d_]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")


def features_of(text: str | None, known: dict[str, int] | None = None) -> set:
    """A text's features; as numbers, and only those of ``known``, if that is given."""
    text = text or ""
    found = set(WORD.findall(text.lower()))
    parts = found.union(f"{w[:k]}~" for w in found for k in range(4, min(len(w), 8)))
    n, letters = text.count(" ") + 1, len(text) + 1
    parts.update(name for name, on in (("<symbols>", len(SYMBOLS.findall(text)) > n), ("<shouts>", 2 * text.count("!!") > n), ("<capitals>", 3 * sum(map(str.isupper, text)) > letters), ("<repeats>", len(found) * 5 < n)) if on)
    return parts if known is None else {known[p] for p in parts if p in known}


@dataclass
class Chain:
    """Weights of each link: features, then earlier categories, then the constant."""

    names: tuple[str, ...]
    known: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.5

    def probabilities(self, rows: Sequence[set]) -> np.ndarray:
        out, n = np.zeros((len(rows), len(self.names))), len(self.known)
        if not self.weights:
            return out
        row, col = _pairs(rows)
        for k, w in enumerate(self.weights):
            out[:, k] = _sigmoid(np.bincount(row, w[:n][col], minlength=len(rows)) + out[:, :k] @ w[n : n + k] + w[-1])
        return out


def _pairs(rows: Sequence[set]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(r) for r in rows]
    return np.repeat(np.arange(len(rows)), sizes), np.fromiter((c for r in rows for c in sorted(r)), np.int64, sum(sizes))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(row: np.ndarray, col: np.ndarray, dense: np.ndarray, y: np.ndarray, n: int, ridge: float = 1e-4, steps: int = 300, rate: float = 0.1) -> np.ndarray:
    """Logistic regression by Adam on all rows; both classes weigh the same."""
    w, m, v = (np.zeros(n + dense.shape[1] + 1) for _ in range(3))
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for t in range(1, steps + 1):
        z = np.bincount(row, w[:n][col], minlength=len(y)) + dense @ w[n:-1] + w[-1]
        miss = share * (_sigmoid(z) - y)
        g = np.concatenate([np.bincount(col, miss[row], minlength=n), dense.T @ miss, [miss.sum()]])
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_chain(known: dict[str, int], rows: list[set], labels: np.ndarray, fold: np.ndarray, allowed: np.ndarray, names: tuple[str, ...] = tuple(CHAIN), false_alarms: float = 0.001) -> Chain:
    """All links, and a threshold for the last category, the verdict.

    ``allowed`` says which features the models of each fold may see (those that
    were chosen without its rows), and, in its last row, which the final ones
    may. The threshold is the least at which no more than ``false_alarms`` of
    the clean rows are taken for toxic by chains that haven't seen them.
    """
    chain, n = Chain(names, known), len(known)
    if not len(rows) or labels[:, -1].min() == labels[:, -1].max():
        return chain
    row, col = _pairs(rows)
    unseen = np.zeros((len(rows), len(names)))
    for k in range(len(names)):
        y, dense = labels[:, k].astype(float), unseen[:, :k]
        for f in np.unique(fold):
            out, inside, may = fold == f, fold != f, allowed[f][col]
            pick, place = inside[row] & may, np.cumsum(inside) - 1
            w = fit_linear(place[row[pick]], col[pick], dense[inside], y[inside], n)
            all_z = np.bincount(row[may], w[:n][col[may]], minlength=len(rows)) + dense @ w[n:-1] + w[-1]
            unseen[out, k] = _sigmoid(all_z[out])
        may = allowed[-1][col]
        chain.weights.append(fit_linear(row[may], col[may], dense, y, n))
    clean = np.sort(unseen[labels[:, -1] == 0, -1])[::-1]
    chain.threshold = float(max(0.5, clean[int(false_alarms * len(clean))] + 1e-6))
    return chain


def train(documents: DataFrame, labels: DataFrame, categories: Mapping[str, str] = CHAIN, max_per_class: int = 4096, folds: int = 3, least_z: float = 4.0) -> Chain:
    """The chain for ``categories``: names and conditions on the label columns, the verdict last.

    A feature is chosen if its share of documents with the verdict is ``least_z``
    standard errors (less one document) from that of the sample.
    """
    names, columns = tuple(categories), [c for c in labels.columns if c != "doc_id"]
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(c).alias(c) for c in columns))
    known = known.select("doc_id", *(F.expr(rule).alias(f"_{k}") for k, rule in enumerate(categories.values()))).withColumnRenamed(f"_{len(names) - 1}", "_on").where("_on IS NOT NULL")
    some = [known.where(F.col("_on") == on).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for on in (True, False)]
    picked = some[0].union(some[1]).withColumn("_fold", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int"))
    sizes = {(r["_fold"], r["_on"]): r["n"] for r in picked.groupBy("_fold", "_on").agg(F.count("*").alias("n")).collect()}
    sample = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def parts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(features_of(t)))

    seen = sample.select(F.explode(parts("text")).alias("feature"), F.col("_on").cast("long").alias("on"), "_fold")
    # For each fold what the others say of a feature, and in the end what all say.
    views = [F.col("_fold") != f for f in range(folds)] + [F.lit(True)]
    counts = seen.groupBy("feature").agg(*(F.sum(F.when(v, F.col("on")).otherwise(0)).alias(f"h{k}") for k, v in enumerate(views)), *(F.count_if(v).alias(f"n{k}") for k, v in enumerate(views)))

    def z(k: int) -> Column:
        toxic, clean = (sum(n for (f, on), n in sizes.items() if f != k and on == which) for which in (True, False))
        p = min(max(toxic / max(1, toxic + clean), 1e-6), 1 - 1e-6)
        n = F.greatest(F.col(f"n{k}"), F.lit(1))
        return (F.abs(F.col(f"h{k}") - n * p) - 1) / F.sqrt(n * p * (1 - p))

    chosen = counts.select("feature", *(z(k).alias(f"z{k}") for k in range(folds + 1)))
    top = F.greatest(*(F.col(f"z{k}") for k in range(folds + 1)))
    best = chosen.where(top >= least_z).orderBy(top.desc(), "feature").collect()
    number = {r["feature"]: k for k, r in enumerate(best)}
    allowed = np.array([[r[f"z{k}"] >= least_z for r in best] for k in range(folds + 1)], bool).reshape(folds + 1, len(best))
    bound = documents.sparkSession.sparkContext.broadcast(number)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def numbers(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(features_of(t, bound.value)))

    marks = [f"_{k}" for k in range(len(names) - 1)] + ["_on"]
    rows = sample.select("doc_id", *marks, "_fold", numbers("text").alias("x")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([[bool(r[m]) for m in marks] for r in rows], int).reshape(-1, len(names))
    return fit_chain(number, [set(r["x"]) for r in rows], y, np.array([r["_fold"] for r in rows], int), allowed, names)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Adds ``p_<category>`` for each category and ``toxic``, the chain's verdict."""
    bound = docs.sparkSession.sparkContext.broadcast(chain)
    schema = T.StructType([T.StructField(f"p_{name}", T.DoubleType()) for name in chain.names] + [T.StructField("toxic", T.BooleanType())])

    @F.pandas_udf(schema)
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = bound.value
        for batch in texts:
            p = own.probabilities([features_of(t, own.known) for t in batch])
            yield pd.DataFrame({f"p_{n}": p[:, k] for k, n in enumerate(own.names)} | {"toxic": p[:, -1] >= own.threshold if own.weights else np.zeros(len(p), bool)})

    clash, judged = {f.name for f in schema}, free_name(docs, "judged")
    own = [c for c in docs.columns if c not in clash]
    return docs.select(*own, judge(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(judged)).select(*own, f"{judged}.*")


def is_toxic() -> Column:
    return F.col("toxic")
