"""Column-parameterised DataFrame operators that the archive plans are made of.

Order is part of their meaning, so each takes explicit order columns; ties are
the caller's to break by giving enough of them. All are plain DataFrame plans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.shared import written


def _struct(names: Sequence[str]) -> Column:
    return F.struct(*names)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. An aggregate, so partial results meet before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(_struct(rest), _struct(order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(_struct(rest), _struct(order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def argmin_pick(df: DataFrame, keys: Sequence[str], priority: Column, order: Sequence[str]) -> DataFrame:
    """The row of least priority for each key; among equals the first seen."""
    return first_wins(df.withColumn("_p", priority), keys, ["_p", *order]).drop("_p")


def label_sets(df: DataFrame, keys: Sequence[str], label: str, own: str, out: str = "others", most: int = 300) -> DataFrame:
    """All labels of a key but its own, sorted, joined by ``;`` and cut at ``most`` characters."""
    sets = df.groupBy(*keys).agg(F.array_sort(F.collect_set(label)).alias("_all"), F.first(own, ignorenulls=True).alias(own))
    rest = F.array_except("_all", F.array(own))
    return sets.select(*keys, own, F.substring(F.array_join(rest, ";"), 1, most).alias(out))


def prefix_offsets(df: DataFrame, length: str, order: Sequence[str], keys: Sequence[str] = (), out: str = "offset") -> DataFrame:
    """The sum of the lengths before each row, within its key."""
    by = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(length).over(by), F.lit(0)).cast("long"))


def global_offsets(df: DataFrame, length: str, order: str, out: str = "offset", slices: int | None = None) -> DataFrame:
    """``prefix_offsets`` over a whole table without one task for all rows.

    Rows are dealt by ranges of ``order`` and written, so that their ranges stay
    what they are; sums within ranges run in parallel, and the sums of the ranges
    (a row for each) are added up before.
    """
    spread = df.repartitionByRange(slices, order) if slices else df.repartitionByRange(order)
    spread = written(spread.withColumn("_part", F.spark_partition_id()), "ranges")
    inner = prefix_offsets(spread, length, [order], ["_part"], out)
    sums = prefix_offsets(spread.groupBy("_part").agg(F.sum(length).alias("_sum")), "_sum", ["_part"], (), "_base").select("_part", "_base")
    return inner.join(F.broadcast(sums), "_part").withColumn(out, (F.col(out) + F.col("_base")).cast("long")).drop("_part", "_base")


def overlapping(df: DataFrame, offset: str, length: str, start: Column, size: Column) -> DataFrame:
    """Rows whose span meets ``[start, start + size)``, with what to cut from each."""
    stop = F.col(offset) + F.col(length)
    meets = (stop > start) & (F.col(offset) < start + size) & (F.col(length) > 0)
    cut = F.greatest(start - F.col(offset), F.lit(0)).cast("long")
    return df.where(meets).withColumn("cut_from", cut).withColumn("cut_size", (F.least(stop, start + size) - F.col(offset) - cut).cast("long"))


def islands(df: DataFrame, keys: Sequence[str], position: str, stride: int = 1, same: Sequence[str] = ()) -> DataFrame:
    """Runs of rows ``stride`` apart (and equal in ``same``): first, last and size of each."""
    by = W.partitionBy(*keys).orderBy(position)
    breaks = F.col(position) - F.lag(position).over(by) != stride
    for name in same:
        breaks = breaks | ~F.lag(name).over(by).eqNullSafe(F.col(name))
    marked = df.withColumn("_new", F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0))
    numbered = marked.withColumn("_run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run", *same).agg(F.min(position).alias("run_first"), F.max(position).alias("run_last"), F.count("*").alias("run_size")).drop("_run")


def longest_island(df: DataFrame, keys: Sequence[str], position: str, stride: int = 1, same: Sequence[str] = ()) -> DataFrame:
    """The longest run of each key; of equal ones the first."""
    runs = islands(df, keys, position, stride, same).withColumn("_size", -F.col("run_size"))
    return first_wins(runs, keys, ["_size", "run_first"]).drop("_size")


def longest_or_all(df: DataFrame, keys: Sequence[str], position: str, stride: int, expected: str) -> DataFrame:
    """The rows of the longest run, or all rows where only their number is what was expected."""
    best = longest_island(df.select(*keys, position), keys, position, stride)
    total = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = df.join(best, list(keys)).join(total, list(keys))
    every = (F.col("run_size") != F.col(expected)) & (F.col("_n") == F.col(expected))
    return joined.where(every | F.col(position).between(F.col("run_first"), F.col("run_last"))).select(*df.columns)


def merge_intervals(df: DataFrame, keys: Sequence[str], begin: str, end: str) -> DataFrame:
    """The union of intervals per key; intervals that touch become one."""
    by = W.partitionBy(*keys).orderBy(begin, end)
    before = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(before.isNull() | (F.col(begin) > before), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(begin).alias(begin), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("_island")


def gaps(df: DataFrame, keys: Sequence[str], begin: str, end: str) -> DataFrame:
    """The gaps between merged intervals of a key."""
    merged = merge_intervals(df, keys, begin, end)
    by = W.partitionBy(*keys).orderBy(begin)
    return merged.withColumn("gap_begin", F.lag(end).over(by)).where("gap_begin IS NOT NULL").select(*keys, "gap_begin", F.col(begin).alias("gap_end"))


def partition_violations(df: DataFrame, keys: Sequence[str], begin: str, end: str, low: Column, high: Column) -> DataFrame:
    """Where intervals of a key fail to cover ``[low, high)`` exactly once.

    Each row starts where its predecessor ends; the last ends at ``high``.
    """
    by = W.partitionBy(*keys).orderBy(begin, end)
    seen = df.withColumn("_want", F.coalesce(F.lag(end).over(by), low)).withColumn("_last", F.lead(begin).over(by).isNull())
    kind = F.when(F.col(begin) > F.col("_want"), "gap").when(F.col(begin) < F.col("_want"), "overlap").when(F.col("_last") & (F.col(end) != high), "end")
    return seen.withColumn("violation", kind).where("violation IS NOT NULL").drop("_want", "_last")


def neighbour_violations(df: DataFrame, keys: Sequence[str], begin: str, end: str) -> DataFrame:
    """Rows whose successor begins before they end."""
    by = W.partitionBy(*keys).orderBy(begin, end)
    return df.withColumn("next_begin", F.lead(begin).over(by)).where(F.col("next_begin") < F.col(end))


def majority(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones that met first."""
    votes = df.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(_struct(order)).alias("_first"))
    votes = votes.withColumn("_rank", F.struct((-F.col("votes")).alias("v"), F.col("_first")))
    return votes.groupBy(*keys).agg(F.min_by(F.struct(value, "votes"), "_rank").alias("_r")).select(*keys, "_r.*")


def positional_join(sets: DataFrame, items: DataFrame, size: str, set_order: Sequence[str], position: str) -> DataFrame:
    """Deals items to sets in order: each takes its next ``size`` items.

    Places become an equi-join by exploding each set's range of positions, so
    no range condition is left to a nested loop. Missing items give nulls.
    """
    placed = global_offsets(sets.withColumn("_order", _struct(set_order)), size, "_order", "_start").drop("_order")
    wanted = placed.where(F.col(size) > 0).withColumn("_pos", F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col(size) - 1)))
    return wanted.join(items.withColumnRenamed(position, "_pos"), "_pos", "left").withColumn("slot", (F.col("_pos") - F.col("_start")).cast("long")).withColumnRenamed("_pos", position).drop("_start")


def closure_path(nodes: DataFrame, node: str, parent: str, name: str, keys: Sequence[str] = (), skip: Column | None = None) -> DataFrame:
    """Each node's names from its root on, joined by ``/``.

    A null parent, or a parent equal to the node or not in the table, marks a root.
    Each step doubles how far every node's pointer reaches, so steps are as many as
    the depth has binary digits. Pointers go first, without names: a node that has
    reached no root after as many steps as the table could need lies on a cycle or
    below one, has ``is_cycle`` set and a null path. Names for which ``skip`` holds
    leave no part.
    """
    keys = list(keys)
    part = F.when(skip, F.lit(None)).otherwise(F.col(name)) if skip is not None else F.col(name)
    listed = nodes.select(*keys, F.col(node).alias("_up"), F.lit(True).alias("_known")).distinct()
    own = nodes.select(*keys, F.col(node).alias("_id"), F.when(F.col(parent) == F.col(node), None).otherwise(F.col(parent)).alias("_up"), F.array_compact(F.array(part)).alias("_parts"))
    own = own.join(listed, [*keys, "_up"], "left").select(*keys, "_id", F.when(F.col("_known"), F.col("_up")).alias("_up"), "_parts")
    own = written(own, "tree")

    def double(now: DataFrame, extra: Sequence[str]) -> DataFrame:
        far = now.select(*keys, F.col("_id").alias("_up"), F.col("_up").alias("_far"), *(F.col(c).alias(f"_above{c}") for c in extra))
        joined = now.join(far, [*keys, "_up"], "left")
        return written(joined.select(*keys, "_id", F.col("_far").alias("_up"), *(F.concat(F.coalesce(F.col(f"_above{c}"), F.array().cast("array<string>")), F.col(c)).alias(c) for c in extra)), "tree")

    reach, steps = own.select(*keys, "_id", "_up"), max(1, own.count().bit_length())
    for _ in range(steps):
        if not reach.where("_up IS NOT NULL").take(1):
            break
        reach = double(reach, ())
    lost = reach.where("_up IS NOT NULL").select(*keys, "_id")
    paths = own.join(lost, [*keys, "_id"], "left_anti")
    while paths.where("_up IS NOT NULL").take(1):
        paths = double(paths, ["_parts"])
    out = paths.select(*keys, F.col("_id").alias(node), F.array_join("_parts", "/").alias("path"), F.lit(False).alias("is_cycle"))
    return out.unionByName(lost.select(*keys, F.col("_id").alias(node), F.lit(None).cast("string").alias("path"), F.lit(True).alias("is_cycle")))


def two_hops(seeds: DataFrame, first: DataFrame, second: DataFrame, on_first: str, on_second: str) -> DataFrame:
    """What is reached over one link, or over one more: duplicates stay."""
    near = seeds.join(first, on_first)
    return near.join(second, on_second)


def without_variant(df: DataFrame, key: str, marker: str) -> DataFrame:
    """Drops rows whose key without ``marker`` is there as well."""
    plain = df.select(F.col(key).alias("_plain")).distinct()
    bare = F.replace(F.col(key), F.lit(marker), F.lit(""))
    return df.withColumn("_bare", bare).join(plain, (F.col("_bare") == F.col("_plain")) & F.contains(F.col(key), F.lit(marker)), "left_anti").drop("_bare")


def histogram(df: DataFrame, value: Column, out: str = "value") -> DataFrame:
    """Counts by value, the most frequent first."""
    return df.groupBy(value.alias(out)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), out)


def first_seen_index(df: DataFrame, value: str, order: Sequence[str], out: str = "index") -> DataFrame:
    """Dense numbers from 0 for the distinct values, in order of first appearance.

    One row for each distinct value is ranked, not each row, and in ranges.
    """
    seen = df.groupBy(value).agg(F.min(_struct(order)).alias("_first")).withColumn("_one", F.lit(1).cast("long"))
    return global_offsets(seen, "_one", "_first", out).select(value, out)


def ordered_distinct(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str = "values") -> DataFrame:
    """The distinct values of each key as a list in order of first appearance."""
    seen = df.groupBy(*keys, value).agg(F.min(_struct(order)).alias("_first"))
    listed = seen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_first", value))).alias("_l"))
    return listed.select(*keys, F.transform("_l", lambda x: x[value]).alias(out))


def apply_patches(df: DataFrame, patches: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Values replaced by their patches (of several the last), and the patches without a row."""
    wanted = patches.select(key, F.col(value).alias("_new"))
    return df.join(wanted, key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new"), wanted.join(df, key, "left_anti")
