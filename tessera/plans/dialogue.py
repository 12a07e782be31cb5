"""Dialogue assembly: lines with their texts, subtitles, types and timing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import kernels as k
from tessera.sources import records

LINE = "full_name string, line_ord int, line_id long, string_key string, string_id long, type_id long, flags array<int>, wem_id long, anim_id long, post struct<first:int,pause:float,last:int>"
TEXT = "full_name string, ord int, string_id long, text string, speaker string"
TYPE = "full_name string, type_id long, priority long, name string"
EVENT = "full_name string, event_ord int, cls string, track int, name string, class_code int, start int, duration long, guid string, refs array<struct<kind:string,id:bigint>>"
STRING = "full_name string, ord int, key string, value string"


def parsed(contents: DataFrame, parse: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """One row per record of each file; a file that can't be parsed gives none."""
    names = [c.strip().split(" ")[0] for c in _top(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, content in zip(rows["full_name"], rows["content"], strict=True):
                try:
                    found = parse(content) if content is not None else []
                except (ValueError, IndexError, records.struct.error):
                    found = []
                if found:
                    yield pd.DataFrame([{"full_name": name} | r for r in found], columns=names, dtype=object)

    return contents.select("full_name", "content").mapInPandas(run, schema)


def _top(schema: str) -> list[str]:
    """A schema's columns: commas within brackets don't divide."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def lines(contents: DataFrame) -> DataFrame:
    return parsed(contents, records.dialogue_lines, LINE)


def texts(contents: DataFrame) -> DataFrame:
    return parsed(contents, records.dialogue_texts, TEXT)


def types(contents: DataFrame) -> DataFrame:
    return parsed(contents, records.dialogue_types, TYPE)


def events(contents: DataFrame) -> DataFrame:
    return parsed(contents, records.timeline, EVENT)


def strings(contents: DataFrame) -> DataFrame:
    return parsed(contents, lambda b: [{"ord": i, "key": a, "value": v} for i, (a, v) in enumerate(records.string_table(b))], STRING)


def join_lines(line: DataFrame, text: DataFrame, string: DataFrame, kind: DataFrame, sidecar_suffix: tuple[str, str] = (".bin", "_strings.bin")) -> DataFrame:
    """Each line with text and speaker of its side file, subtitle and type; nothing is lost.

    Of several values for one id or key the last counts.
    """
    side = k.last_wins(text, ["full_name", "string_id"], ["ord"]).select(F.col("full_name").alias("side"), "string_id", "text", "speaker")
    sub = k.last_wins(string, ["key"], ["full_name", "ord"]).select(F.col("key").alias("string_key"), F.col("value").alias("subtitle"))
    named = k.last_wins(kind, ["type_id"], ["full_name"]).select("type_id", F.col("name").alias("type_name"), F.col("priority").alias("type_priority"))
    base, added = sidecar_suffix
    own = line.withColumn("side", F.concat(F.expr(f"left(full_name, length(full_name) - {len(base)})"), F.lit(added)))
    return own.join(side, ["side", "string_id"], "left").join(sub, "string_key", "left").join(named, "type_id", "left").drop("side")


def timed(line: DataFrame, event: DataFrame) -> DataFrame:
    """Lines with the first timeline event that plays their sound, in seconds."""
    ref = event.select(F.col("full_name").alias("timeline"), "event_ord", "start", "duration", F.explode("refs").alias("r")).select("timeline", "event_ord", "start", "duration", F.col("r.id").alias("wem_id"))
    first = k.first_wins(ref, ["wem_id"], ["timeline", "event_ord"])
    out = line.withColumn("wem_id", F.when(F.col("wem_id") != records.NO_ID, F.col("wem_id"))).join(first, "wem_id", "left")
    return out.withColumn("start_s", tx.frames_to_seconds(F.col("start"))).withColumn("duration_s", tx.frames_to_seconds(F.col("duration")))


def subtitles(line: DataFrame) -> DataFrame:
    """(full_name, srt): the subtitle file of each dialogue file."""
    said = F.coalesce(F.nullif("subtitle", F.lit("")), "text")
    cue = line.where("start_s IS NOT NULL").select("full_name", F.explode(tx.cues(said, F.col("start_s"), F.coalesce("duration_s", F.lit(0.0)))).alias("c"))
    return cue.groupBy("full_name").agg(tx.srt(F.collect_list("c")).alias("srt"))


def documents(line: DataFrame) -> DataFrame:
    """(full_name, n_lines, n_text, document): each file's lines as nested JSON, nulls kept."""
    row = F.struct("line_ord", "line_id", "string_key", "string_id", "type_name", "flags", "wem_id", "anim_id", "text", "speaker", "subtitle")
    listed = line.groupBy("full_name").agg(F.sort_array(F.collect_list(row)).alias("lines"), F.count_if(F.col("text").isNotNull()).alias("n_text"))
    return listed.select("full_name", F.size("lines").alias("n_lines"), "n_text", F.to_json(F.struct("full_name", "lines"), {"ignoreNullFields": "false"}).alias("document"))


def playlist(sets: DataFrame, items: DataFrame, line: DataFrame) -> DataFrame:
    """Sets take their next items in file order; items find their line by id."""
    dealt = k.positional_join(sets, items, "n", ["set_ord"], "pos")
    known = k.last_wins(line.select("line_id", "full_name", "line_ord"), ["line_id"], ["full_name", "line_ord"])
    return dealt.join(known, "line_id", "left").withColumn("resolved", F.col("full_name").isNotNull())


def quests(conversations: DataFrame, entity_paths: DataFrame, facts: DataFrame) -> DataFrame:
    """(conv, quest, quest_source): from an entity path, else the name's grammar, else a vote of facts."""
    named = conversations.select("conv", tx.grammar_quest(F.col("conv")).alias("grammar"))
    part = entity_paths.select("conv", F.col("ord").alias("p"), F.posexplode(F.split("entity_path", "/")).alias("i", "seg"), F.split("entity_path", "/").alias("parts")).join(named, "conv")
    free = F.col("grammar").isNull()
    own = F.rlike("seg", F.lit(tx.QUEST_SEGMENT)) & (free | F.startswith("seg", F.col("grammar")) | F.startswith("grammar", F.col("seg")))
    after = F.get("parts", F.col("i") + 1)
    below = F.col("seg").isin("quests", "mini_quests", "side_quests") & after.isNotNull() & (free | F.startswith(after, F.col("grammar")))
    hit = part.withColumn("quest", F.when(own, F.col("seg")).when(below, after)).where("quest IS NOT NULL")
    by_path = k.first_wins(hit.select("conv", "quest", "p", "i"), ["conv"], ["p", "i"]).select("conv", F.col("quest").alias("by_path"))
    fact = facts.where(F.startswith("fact", F.lit("quests/")) & (F.size(F.split("fact", "/")) > 2)).select("conv", "ord", F.get(F.split("fact", "/"), F.lit(1)).alias("quest"))
    voted = k.majority(fact, ["conv"], "quest", ["ord"]).select("conv", F.col("quest").alias("voted"))
    out = named.join(by_path, "conv", "left").join(voted, "conv", "left")
    source = F.when(F.col("by_path").isNotNull(), "entity-path").when(F.col("grammar").isNotNull(), "conversation-id").when(F.col("voted").isNotNull(), "facts")
    return out.select("conv", F.coalesce("by_path", "grammar", "voted").alias("quest"), source.alias("quest_source"))
