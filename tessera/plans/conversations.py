"""Conversations: sequence files with their timelines, graphs, sounds and documents.

A sequence is a dialogue file; timelines refer to it by id, graphs refer to
timelines. All of it is equi-joins and ordered aggregates; names decide every
order, so results don't depend on how files are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import kernels as k
from tessera.sources import records, storage

# Names of files and of what timelines refer to.
SEQUENCE_FILE = r"^data/dialogue/lines/([^/]+)/sequence_(\d+)\.bin$"
SYSTEMIC_FILE = r"^data/dialogue/lines/(sys_dialogue_[^/]+)\.bin$"
DIALOGUE_EVENT, TO_SEQUENCE, TO_SOUND = "DialogueTimelineEvent", "dialogue", "sound_external_source"
LINE_KEYS = ("line_id", "string_key", "speaker", "text", "subtitle", "type_name", "type_priority", "flags", "post", "wem", "wem_id", "animation")
TIMED_KEYS = ("timeline", "start", "duration", "start_s", "duration_s", "guid", "audio_file")


def wanted_types(files: DataFrame, types: Sequence[str]) -> DataFrame:
    """Files (full_name) of the types asked for, whatever their case; ``all`` takes every file."""
    asked = {t.strip().lower().lstrip(".") for t in types if t.strip()}
    if not asked:
        raise ValueError("no file type is given")
    return files if "all" in asked else files.where(tx.extension(F.col("full_name")).isin(*(f".{t}" for t in asked)))


def sequences(files: DataFrame, only: str | None = None, lang: str = "en") -> DataFrame:
    """(full_name, conv, number, side): sequence files, ``only`` those whose conversation has a match."""
    part = lambda n: F.regexp_extract("full_name", SEQUENCE_FILE, n)
    found = files.where(F.rlike("full_name", F.lit(SEQUENCE_FILE))).select("full_name", part(1).alias("conv"), part(2).alias("number"))
    found = found.withColumn("side", F.concat(F.lit(f"data/dialogue/locale/{lang}/"), "conv", F.lit("/sequence_"), "number", F.lit("strings.bin")))
    return found.where(F.rlike("conv", F.lit(only))) if only else found


def systemic(files: DataFrame, only: str | None = None, lang: str = "en") -> DataFrame:
    """(full_name, name, side): the line files that belong to no conversation."""
    found = files.where(F.rlike("full_name", F.lit(SYSTEMIC_FILE))).select("full_name", F.regexp_extract("full_name", SYSTEMIC_FILE, 1).alias("name"))
    found = found.withColumn("side", F.concat(F.lit(f"data/dialogue/locale/{lang}/"), "name", F.lit("strings.bin")))
    return found.where(F.rlike("name", F.lit(only))) if only else found


def sequence_events(event: DataFrame, ids: DataFrame) -> DataFrame:
    """(sequence, timeline, event_ord, start, duration, guid, sounds): each event with each sequence it refers to.

    ``event`` is as ``dialogue.events`` has it, ``ids`` has id and name.
    """
    refs = lambda kind: F.transform(F.filter("refs", lambda r: r["kind"] == kind), lambda r: r["id"])
    said = event.where(F.col("cls") == DIALOGUE_EVENT).select(F.col("full_name").alias("timeline"), "event_ord", "start", "duration", "guid", refs(TO_SOUND).alias("sounds"), F.explode(F.array_distinct(refs(TO_SEQUENCE))).alias("id"))
    return said.join(ids.select("id", F.col("name").alias("sequence")), "id").drop("id")


def sequence_timelines(events: DataFrame) -> DataFrame:
    """(sequence, timelines): the timelines of each sequence, by name."""
    return events.groupBy("sequence").agg(F.array_sort(F.collect_set("timeline")).alias("timelines"))


def conversation_graphs(sequence: DataFrame, events: DataFrame, graph_timeline: DataFrame) -> DataFrame:
    """(conv, ord, bundle, instance): each conversation's graphs once, in the order they are met.

    That is by sequence, then timeline, then bundle and instance. ``graph_timeline``
    is as ``graphs.timelines`` has it.
    """
    links = events.select(F.col("sequence").alias("full_name"), "timeline").distinct()
    graph = graph_timeline.select(F.col("full_name").alias("bundle"), "instance", "timeline").distinct()
    met = sequence.select("full_name", "conv").join(links, "full_name").join(graph, "timeline")
    first = met.groupBy("conv", "bundle", "instance").agg(F.min(F.struct("full_name", "timeline", "bundle", "instance")).alias("first"))
    listed = first.groupBy("conv").agg(F.sort_array(F.collect_list("first")).alias("graphs"))
    return listed.select("conv", F.posexplode("graphs").alias("ord", "g")).select("conv", "ord", "g.bundle", "g.instance")


def timed_in_sequence(line: DataFrame, events: DataFrame) -> DataFrame:
    """Lines with the first event, of those that refer to their sequence, that plays their sound."""
    played = events.select(F.col("sequence").alias("full_name"), F.explode("sounds").alias("wem_id"), "timeline", "event_ord", "start", "duration", "guid")
    first = k.first_wins(played, ["full_name", "wem_id"], ["timeline", "event_ord"]).drop("event_ord")
    out = line.join(first, ["full_name", "wem_id"], "left")
    return out.withColumn("start_s", tx.frames_to_seconds(F.col("start"))).withColumn("duration_s", tx.frames_to_seconds(F.col("duration")))


def in_language(path: Column, lang: str) -> Column:
    """A path with every locale part changed to ``lang``."""
    return F.regexp_replace(path, "/locale/[^/]+/", f"/locale/{lang}/")


def voiced(line: DataFrame, ids: DataFrame, files: DataFrame, lang: str = "en") -> DataFrame:
    """Adds the paths of sound and animation; a sound's variant in ``lang`` is taken if it exists."""
    known = lambda key, out: ids.select(F.when(F.col("id") != records.NO_ID, F.col("id")).alias(key), F.col("name").alias(out)).where(f"{key} IS NOT NULL")
    out = line.join(known("wem_id", "wem"), "wem_id", "left").join(known("anim_id", "animation"), "anim_id", "left")
    if lang != "en":
        there = files.select(F.col("full_name").alias("_there")).distinct()
        out = out.withColumn("_other", in_language(F.col("wem"), lang)).join(there, F.col("_other") == F.col("_there"), "left")
        out = out.withColumn("wem", F.coalesce("_there", "wem")).drop("_other", "_there")
    return out.withColumn("audio_file", F.concat(F.lit("audio/"), F.substring_index("wem", "/", -1)))


def line_json(line: DataFrame) -> Column:
    """A line as JSON: nulls are kept, but keys of timing and audio are there only if joined."""
    have = set(line.columns)
    pick = lambda names: F.struct(*(tx.hex_id(F.col(c)).alias(c) if c in ("line_id", "wem_id") else F.col(c) for c in names if c in have))
    base = F.to_json(F.struct(F.col("line_ord").alias("index"), pick(LINE_KEYS).alias("_")), {"ignoreNullFields": "false"})
    flat = F.replace(base, F.lit('"_":{'), F.lit(""))
    extra = F.to_json(pick(TIMED_KEYS))
    more = F.when(F.length(extra) > 2, F.concat(F.lit(","), F.substring(extra, 2, 2**30))).otherwise(F.lit("}"))
    return F.concat(F.left(flat, F.length(flat) - 2), more)


def folder(conv: Column, quest: Column) -> Column:
    """Where a conversation's documents go: below its quest, or loose by family."""
    own = tx.safe_name(conv)
    return F.when(quest.isNotNull(), F.concat_ws("/", F.lit("quests"), tx.safe_name(quest), own)).otherwise(F.concat_ws("/", F.lit("loose"), tx.safe_name(tx.family(conv)), own))


def index(sequence: DataFrame, line: DataFrame, quest: DataFrame, graphs: DataFrame) -> DataFrame:
    """A row per conversation: quest, counts of sequences, lines, sounds, cues and graphs, folder.

    ``line`` is as ``voiced`` and ``timed_in_sequence`` have it, ``quest`` as ``dialogue.quests``.
    """
    said = F.coalesce(F.nullif("subtitle", F.lit("")), "text")
    cues = F.when(F.col("start_s").isNotNull(), F.size(tx.cues(said, F.col("start_s"), F.coalesce("duration_s", F.lit(0.0))))).otherwise(0)
    per = line.select("full_name", F.col("wem").isNotNull().alias("heard"), F.greatest(F.coalesce(cues, F.lit(0)), F.lit(0)).alias("cues")).groupBy("full_name").agg(F.count("*").alias("lines"), F.count_if("heard").alias("audio"), F.sum("cues").alias("cues"))
    conv = sequence.join(per, "full_name", "left").groupBy("conv").agg(F.count("*").alias("sequences"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("lines", "audio", "cues")))
    out = conv.join(quest, "conv", "left").join(graphs.groupBy("conv").agg(F.count("*").alias("graphs")), "conv", "left")
    return out.select(
        F.col("conv").alias("conversation"), "quest", F.col("quest_source").alias("source"), "sequences", "lines", "audio", F.col("cues").alias("subtitle_cues"),
        F.coalesce("graphs", F.lit(0)).alias("graphs"), folder(F.col("conv"), F.col("quest")).alias("folder"),
    )


def totals(index_rows: DataFrame) -> DataFrame:
    """Conversations, those in quests, loose ones, and distinct quests, in one row."""
    return index_rows.agg(F.count("*").alias("conversations"), F.count("quest").alias("in_quests"), F.count_if(F.col("quest").isNull()).alias("loose"), F.count_distinct("quest").alias("quests"))


def documents(sequence: DataFrame, line: DataFrame, events: DataFrame, quest: DataFrame) -> DataFrame:
    """(folder, name, body): each conversation's JSON, each quest's list of conversations, each sequence's subtitles."""
    body = line.select("full_name", "line_ord", line_json(line).alias("j")).groupBy("full_name").agg(F.sort_array(F.collect_list(F.struct("line_ord", "j"))).alias("l"))
    lists = sequence.join(body, "full_name", "left").join(sequence_timelines(events).withColumnRenamed("sequence", "full_name"), "full_name", "left")
    one = F.concat(F.lit('{"sequence":'), _quoted("full_name"), F.lit(',"timelines":'), F.to_json(F.coalesce("timelines", F.array().cast("array<string>"))), F.lit(',"lines":['), F.array_join(F.transform(F.coalesce("l", F.array().cast("array<struct<line_ord:int,j:string>>")), lambda x: x["j"]), ","), F.lit("]}"))
    conv = lists.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("full_name", one.alias("j")))).alias("s")).join(quest, "conv", "left")
    head = F.to_json(F.struct(F.col("conv").alias("conversation"), "quest", "quest_source"), {"ignoreNullFields": "false"})
    whole = F.concat(F.left(head, F.length(head) - 1), F.lit(',"sequences":['), F.array_join(F.transform("s", lambda x: x["j"]), ","), F.lit("]}"))
    place = folder(F.col("conv"), F.col("quest"))
    out = conv.select(place.alias("folder"), F.lit("conversation.json").alias("name"), whole.alias("body"))
    by_quest = quest.where("quest IS NOT NULL").groupBy("quest").agg(F.array_sort(F.collect_set("conv")).alias("conversations"))
    out = out.union(by_quest.select(F.concat(F.lit("quests/"), tx.safe_name(F.col("quest"))), F.lit("quest.json"), F.to_json(F.struct("quest", "conversations"))))
    said = F.coalesce(F.nullif("subtitle", F.lit("")), "text")
    cue = line.where("start_s IS NOT NULL").select("full_name", F.explode(tx.cues(said, F.col("start_s"), F.coalesce("duration_s", F.lit(0.0)))).alias("c"))
    srt = cue.groupBy("full_name").agg(tx.srt(F.collect_list("c")).alias("srt")).join(sequence, "full_name").join(quest, "conv", "left")
    return out.union(srt.select(place, F.concat(F.lit("sequence_"), "number", F.lit(".srt")), "srt"))


def _quoted(name: str) -> Column:
    whole = F.to_json(F.struct(F.col(name).alias("x")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def write_documents(rows: DataFrame, root: str) -> DataFrame:
    """Writes each row (folder, name, body) as a file below ``root``: (path, n_bytes)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for place, name, body in zip(batch["folder"], batch["name"], batch["body"], strict=True):
                raw = body.encode()
                storage.write_whole(f"{root.rstrip('/')}/{place}/{name}", raw)
                out.append((f"{place}/{name}", len(raw)))
            yield pd.DataFrame(out, columns=["path", "n_bytes"])

    return rows.mapInPandas(write, "path string, n_bytes long")


def write_index(rows: DataFrame, path: str) -> None:
    """The index as JSON lines, nulls kept, in order of conversation."""
    rows.orderBy("conversation").write.mode("overwrite").option("ignoreNullFields", "false").json(path)
