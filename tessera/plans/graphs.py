"""Conversation graphs: nodes with their timelines, options and owners."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import kernels as k
from tessera.sources import records

NODE = "struct<title:string,flags:bigint,content:bigint,out_pins:array<array<int>>,data_pins:array<array<int>>,fallback:array<int>,node_ord:int,type:string>"
GRAPH = f"full_name string, instance int, nodes array<{NODE}>, strings array<string>, hits array<struct<at:int,id:bigint>>, entities array<struct<entity_ord:int,entity_id:bigint,path:string>>"
STRIDE, MOST_IDS = 41, 10_000_000


def parse(contents: DataFrame, timeline_ids: DataFrame) -> DataFrame:
    """A row per graph of each bundle (full_name, content).

    ``timeline_ids`` (id) is the catalog's set of timeline ids, eight bytes each:
    it is sent to the tasks, and more than ``MOST_IDS`` are an error.
    """
    found = timeline_ids.select("id").where("id IS NOT NULL").distinct().limit(MOST_IDS + 1).toPandas()["id"].to_numpy(np.int64)
    if len(found) > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} timeline ids")
    wanted = contents.sparkSession.sparkContext.broadcast(np.sort(found))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, b in zip(rows["full_name"], rows["content"], strict=True):
                try:
                    found = one(b)
                except (ValueError, IndexError, records.struct.error):
                    found = []
                if found:
                    yield pd.DataFrame([{"full_name": name} | g for g in found])

    def one(b: bytes) -> list[dict]:
        directory = records.bundle_directory(b)
        by_kind = {d["kind"]: d for d in directory}
        if records.SECTION_GRAPH not in by_kind:
            return []
        section, named = by_kind[records.SECTION_GRAPH], by_kind.get(records.SECTION_NAMES)
        payload = b[section["offset"] : section["offset"] + section["size"]]
        names = records.debug_names(b[named["offset"] : named["offset"] + named["size"]], named["count"]) if named else []
        refs: dict[tuple[int, int], dict[int, int]] = {}
        for e in records.bundle_entities(b, directory):
            refs.setdefault((e["entity_ord"], e["entity_id"]), {})[e["dir_idx"]] = e["instance"]
        out = []
        for g in records.graphs(payload):
            owners = []
            for (ord_, own), d in refs.items():
                if d.get(section["dir_idx"]) == g["instance"]:
                    at = d.get(named["dir_idx"]) if named else None
                    owners.append({"entity_ord": ord_, "entity_id": own, "path": names[at] if at is not None and at < len(names) else None})
            hits = [{"at": a, "id": v} for a, v in records.id_hits(payload, g["nodes_end"], g["end"], wanted.value)]
            out.append({"instance": g["instance"], "nodes": g["nodes"], "strings": g["strings"], "hits": hits, "entities": owners})
        return out

    return contents.select("full_name", "content").mapInPandas(run, GRAPH)


def timelines(graph: DataFrame, ids: DataFrame) -> DataFrame:
    """(full_name, instance, ord, timeline): the longest stride-41 run of ids.

    If the run isn't as long as the graph has sequence nodes, but all hits
    together are as many, all of them count. ``ids`` has id and name.
    """
    keys = ["full_name", "instance"]
    expected = F.size(F.filter("nodes", lambda n: n["flags"] == 0x40)).alias("expected")
    hits = graph.select(*keys, expected, F.explode("hits").alias("h")).select(*keys, "expected", "h.at", "h.id")
    run = k.longest_or_all(hits, keys, "at", STRIDE, "expected")
    ordered = run.withColumn("ord", F.row_number().over(W.partitionBy(*keys).orderBy("at")) - 1)
    return ordered.join(ids.select("id", F.col("name").alias("timeline")), "id").select(*keys, "ord", "timeline")


def nodes(graph: DataFrame, timeline: DataFrame, strings: DataFrame) -> DataFrame:
    """A row per node: its timeline if it is a sequence, its options if a choice.

    Options are dealt in order: each choice takes as many option texts as it has
    out pins. ``strings`` has key and value.
    """
    keys = ["full_name", "instance"]
    node = graph.select(*keys, F.explode("nodes").alias("n")).select(*keys, "n.*")
    node = node.join(timeline.select(*keys, F.col("ord").alias("content"), "timeline"), [*keys, "content"], "left")
    node = node.withColumn("timeline", F.when(F.col("flags") == 0x40, F.col("timeline")))
    choice = k.prefix_offsets(node.where(F.col("flags") == 2).select(*keys, "node_ord", F.size("out_pins").alias("n_pins")), "n_pins", ["node_ord"], keys, "first")
    slot = choice.where("n_pins > 0").select(*keys, "node_ord", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n_pins") - 1)).alias("slot"))
    option = F.filter("strings", lambda s: F.contains(s, F.lit("CHOICE_")) & ~F.contains(s, F.lit("CHOICE_PROMPT_")) & ~F.contains(s, F.lit("CHOICE_FAIL_")))
    given = graph.select(*keys, F.posexplode(option).alias("slot", "key"))
    texts = k.last_wins(strings.select("key", "value", "ord"), ["key"], ["ord"]).select("key", F.col("value").alias("text"))
    dealt = slot.join(given, [*keys, "slot"]).join(texts, "key", "left")
    options = dealt.groupBy(*keys, "node_ord").agg(F.sort_array(F.collect_list(F.struct("slot", "key", "text"))).alias("options"))
    return node.join(options, [*keys, "node_ord"], "left")


def facts(graph: DataFrame) -> DataFrame:
    """(full_name, instance, ord, fact) of the texts that are facts."""
    own = F.filter("strings", lambda s: F.startswith(s, F.lit("quests/")) | F.startswith(s, F.lit("conv_local/")) | F.rlike(s, F.lit("^wf_[0-9a-f]{16}$")))
    return graph.select("full_name", "instance", F.posexplode(own).alias("ord", "fact"))


def owners(graph: DataFrame) -> DataFrame:
    """The entity that owns each graph; of several the last."""
    own = graph.select("full_name", "instance", F.explode("entities").alias("e")).select("full_name", "instance", "e.*")
    return k.last_wins(own, ["full_name", "instance"], ["entity_ord"])


def prompts(graph: DataFrame, strings: DataFrame) -> DataFrame:
    """(full_name, instance, ord, key, text) of the texts that prompt a choice; ``strings`` has key, value and ord."""
    own = F.filter("strings", lambda s: F.contains(s, F.lit("CHOICE_PROMPT_")))
    texts = k.last_wins(strings.select("key", "value", "ord"), ["key"], ["ord"]).select("key", F.col("value").alias("text"))
    return graph.select("full_name", "instance", F.posexplode(own).alias("ord", "key")).join(texts, "key", "left").select("full_name", "instance", "ord", "key", "text")


def edges(node: DataFrame) -> DataFrame:
    """(full_name, instance, node_ord, pin, link_ord, target): each link of each out pin of ``nodes``."""
    pin = node.select("full_name", "instance", "node_ord", F.posexplode("out_pins").alias("pin", "links"))
    return pin.select("full_name", "instance", "node_ord", "pin", F.posexplode("links").alias("link_ord", "target"))
