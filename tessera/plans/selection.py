"""Audio selection: which media files belong to which category, and why.

Events name banks and banks name media by resource ids. A media file may be
reached in many ways; the way of the best category wins, ties go to the first
in the order of catalogs, files and links.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import kernels as k
from tessera.sources import records


def bank_types(contents: DataFrame) -> DataFrame:
    """Object types of banks from their contents: (full_name, types)."""

    @F.pandas_udf("array<int>")
    def types(found: pd.Series) -> pd.Series:
        return found.map(lambda b: sorted(records.bank(b)["types"]) if b is not None else [])

    return contents.select("full_name", types("content").alias("types"))


def bank_objects(contents: DataFrame) -> DataFrame:
    """(full_name, type, n): how many objects of each type a bank has."""

    @F.pandas_udf("map<int,int>")
    def counts(found: pd.Series) -> pd.Series:
        return found.map(lambda b: records.bank(b)["types"] if b is not None else {})

    return contents.select("full_name", F.explode(counts("content")).alias("type", "n"))


def media_info(contents: DataFrame) -> DataFrame:
    """What audio headers say: codec, channels, rate, seconds."""

    @F.pandas_udf("struct<codec:int,channels:int,sample_rate:bigint,seconds:double>")
    def info(found: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([records.riff(b if b is not None else b"") for b in found], columns=["codec", "channels", "sample_rate", "seconds"])
        return rows.astype({"codec": "Int32", "channels": "Int32", "sample_rate": "Int64", "seconds": "Float64"})

    return contents.select("full_name", F.octet_length("content").alias("size"), info("content").alias("i")).select("full_name", "size", "i.*")


def media_of_banks(resources: DataFrame) -> DataFrame:
    """(bank, bank_ord, media, media_ord): media of a bank and of banks one link on.

    ``resources`` has full_name, ord, primary_id and deps. The general bank
    ``init`` is no second hop. Repeated links stay.
    """
    ids = k.last_wins(resources.select("primary_id", "full_name", "ord"), ["primary_id"], ["ord"]).select(F.col("primary_id").alias("dep"), F.col("full_name").alias("target"))
    banks = resources.where(F.endswith("full_name", F.lit(".bnk")))
    links = banks.select(F.col("full_name").alias("bank"), F.col("ord").alias("bank_ord"), F.posexplode("deps").alias("link", "dep")).join(ids, "dep")
    media = links.where(F.endswith("target", F.lit(".wem")))
    near = media.select("bank", "bank_ord", F.col("target").alias("media"), F.struct(F.col("link").alias("a"), F.lit(-1).alias("b")).alias("media_ord"))
    hops = links.where(F.endswith("target", F.lit(".bnk")) & (F.col("target") != F.col("bank")) & (F.lower(F.substring_index("target", "/", -1)) != "init.bnk"))
    beyond = hops.select("bank", "bank_ord", F.col("link").alias("hop"), F.col("target").alias("next")).join(media.select(F.col("bank").alias("next"), F.col("target").alias("media"), "link"), "next")
    far = beyond.select("bank", "bank_ord", "media", F.struct(F.col("hop").alias("a"), F.col("link").alias("b")).alias("media_ord"))
    return near.unionByName(far)


def select_audio(resources: DataFrame, sizes: DataFrame, types: DataFrame | None = None, min_size: int = 0, wanted: Sequence[str] = tx.CATEGORIES) -> DataFrame:
    """The manifest: a row per selected media file, in order of category, label, path.

    ``sizes`` has full_name and total_size; ``types`` the object types of banks.
    Files of at most ``min_size`` bytes are left out.
    """
    if unknown := set(wanted) - set(tx.CATEGORIES):
        raise ValueError(f"unknown categories: {sorted(unknown)}")
    banks = media_of_banks(resources)
    if types is not None:
        banks = banks.join(types.select(F.col("full_name").alias("bank"), "types"), "bank", "left")
    else:
        banks = banks.withColumn("types", F.lit(None).cast("array<int>"))
    label = tx.stem(F.col("bank"), ".bnk")
    banks = banks.withColumn("bank_label", label).withColumn("bank_cats", tx.categories(label, F.col("types")))
    ids = k.last_wins(resources.select("primary_id", "full_name", "ord"), ["primary_id"], ["ord"]).select(F.col("primary_id").alias("dep"), F.col("full_name").alias("bank"))
    events = resources.where(F.endswith("full_name", F.lit(".sndevent")))
    named = events.select(tx.stem(F.col("full_name"), ".sndevent").alias("event"), F.col("ord").alias("event_ord"), F.posexplode("deps").alias("link", "dep")).join(ids, "dep")
    by_event = named.where(F.endswith("bank", F.lit(".bnk"))).join(banks, "bank")
    own = tx.categories(F.col("event"), F.col("types"))
    first = by_event.select("media", F.col("event").alias("label"), "bank", F.when(F.size(own) > 0, own).otherwise(F.col("bank_cats")).alias("cats"), F.struct(F.lit(0).alias("pass"), F.col("event_ord").alias("a"), F.col("link").alias("b"), "media_ord").alias("seq"))
    event_names = events.select(tx.stem(F.col("full_name"), ".sndevent").alias("bank_label"), F.lit(True).alias("has_event")).distinct()
    music = F.coalesce(F.arrays_overlap("types", F.array(*map(F.lit, tx.MUSIC_OBJECT_TYPES))), F.lit(False))
    # The general bank belongs to every event and speaks for none.
    by_bank = banks.where("bank_label != 'init'").join(event_names, "bank_label", "left").where(F.col("has_event").isNull() | music)
    second = by_bank.select("media", F.col("bank_label").alias("label"), "bank", F.col("bank_cats").alias("cats"), F.struct(F.lit(1).alias("pass"), F.col("bank_ord").alias("a"), F.lit(0).alias("b"), "media_ord").alias("seq"))
    ways = first.unionByName(second).withColumn("category", F.explode("cats")).where(F.col("category").isin(*wanted))
    ways = ways.join(sizes.select(F.col("full_name").alias("media"), F.col("total_size").alias("size")), "media").where(F.col("size") > max(min_size, 0))
    best = k.argmin_pick(ways.select("media", "category", "label", "bank", "size", "seq"), ["media"], tx.priority(F.col("category")), ["seq"])
    others = k.label_sets(ways.join(best.select("media", F.col("label").alias("own")), "media"), ["media"], "label", "own", "other_labels").select("media", "other_labels")
    out = best.join(others, "media").withColumn("rank", tx.priority(F.col("category")))
    return out.select("category", "label", "bank", "media", "size", "other_labels", "rank").orderBy("rank", "label", "media")


def totals(manifest: DataFrame) -> DataFrame:
    """Files and bytes by category."""
    return manifest.groupBy("category").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def manifest(selected: DataFrame, info: DataFrame) -> DataFrame:
    """The rows of the manifest file, in its order; ``info`` is what ``media_info`` says."""
    name = lambda c: F.substring_index(c, "/", -1)
    rows = selected.join(info.select(F.col("full_name").alias("media"), "seconds"), "media", "left")
    return rows.orderBy("rank", "label", "media").select(
        "category", F.col("label").alias("event_or_bank"), tx.stem(name("bank"), ".bnk").alias("bank"), tx.stem(name("media"), ".wem").alias("media_id"), F.col("size").alias("bytes"),
        F.concat_ws("/", "category", tx.safe_name(F.col("label")), name("media")).alias("path"), F.coalesce(F.col("seconds").cast("string"), F.lit("")).alias("duration_s_estimate"), F.col("other_labels").alias("also_used_by"),
    )


def write_manifest(rows: DataFrame, path: str) -> None:
    """The manifest as CSV with a header; its parts, in order of name, are in order."""
    rows.write.mode("overwrite").option("header", "true").csv(path)
