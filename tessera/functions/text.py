"""Scalar functions on names and texts, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.records import fnv1a

# Categories in order of priority, and the tokens that decide them.
CATEGORIES = ("music", "stingers", "ambience", "beds", "environment")
MUSIC_TOKENS = ("mus", "music")
STINGER_TOKENS = ("stinger", "sting")
AMBIENCE_TOKENS = ("amb", "ambience", "ambient", "atmos", "atmosphere")
BED_TOKENS = ("bed", "drone")
ENVIRONMENT_TOKENS = ("env",)
EXCLUDED_TOKENS = (
    "dlg", "vox", "vo", "dialogue", "dialog", "radio", "foley", "footstep", "footsteps", "step", "steps", "impact", "damage", "explosion",
    "gunshot", "shot", "melee", "weapon", "proj", "projectile", "hit", "pain", "death", "ui", "menu", "haptics", "reverb", "aux",
)
MUSIC_OBJECT_TYPES = (10, 11, 12, 13)
SEGMENT = r"\[(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)\]"
CONVERSATION = r"^(?:cine_|con_|conv_)?(.+?)_s\d{4}_g\d{3,4}[a-z]?(?:_.*)?$"
QUEST_SEGMENT = r"^(mq|dq|wq|sq|cq|tq)_"


def extension(name: Column) -> Column:
    """The lower-case extension with its dot, or ``<no extension>``."""
    return F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))).otherwise("<no extension>")


def split_extension(name: Column) -> Column:
    """The extension in its own case; names that only begin with dots have none."""
    return F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]*)$", 1)


def stem(name: Column, suffix: str) -> Column:
    """The last path part without a fixed suffix."""
    base = F.substring_index(name, "/", -1)
    return F.when(F.endswith(base, F.lit(suffix)), F.left(base, F.length(base) - len(suffix))).otherwise(base)


def tokens(name: Column) -> Column:
    """Distinct lower-case tokens, cut at underscores and all that is no word character."""
    return F.array_distinct(F.split(F.lower(name), r"(?U)[_\W]+"))


def categories(name: Column, object_types: Column | None = None) -> Column:
    """The categories that a name's tokens (and a bank's object types) give, in order of priority."""
    found = tokens(name)
    has = lambda values: F.arrays_overlap(found, F.array(*map(F.lit, values)))
    music = has(MUSIC_TOKENS)
    if object_types is not None:
        music = music | F.coalesce(F.arrays_overlap(object_types, F.array(*map(F.lit, MUSIC_OBJECT_TYPES))), F.lit(False))
    free = ~has(EXCLUDED_TOKENS)
    rules = (music, has(STINGER_TOKENS) & (music | free), has(AMBIENCE_TOKENS) & free, has(BED_TOKENS) & free, has(ENVIRONMENT_TOKENS) & free)
    return F.array_compact(F.array(*(F.when(rule, F.lit(c)) for rule, c in zip(rules, CATEGORIES, strict=True))))


def priority(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), category) - 1


def safe_name(name: Column) -> Column:
    """Characters outside ``A-Za-z0-9._-`` become ``_``; ``x`` where nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), F.lit("_")), F.lit("")), F.lit("x"))


def family(name: Column) -> Column:
    """The leading letters ``a-z``, or ``misc``."""
    return F.coalesce(F.nullif(F.regexp_extract(name, "^([a-z]+)", 1), F.lit("")), F.lit("misc"))


def grammar_quest(name: Column) -> Column:
    """The quest part of a conversation name, or null."""
    return F.nullif(F.regexp_extract(name, CONVERSATION, 1), F.lit(""))


def path_is_safe(name: Column) -> Column:
    """Whether a name stays below its folder: relative, no empty, ``.`` or ``..`` parts."""
    parts = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    return ~F.arrays_overlap(parts, F.array(F.lit(""), F.lit("."), F.lit(".."))) & ~F.rlike(name, F.lit("^[A-Za-z]:"))


def hex_id(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(value), 16, "0")))


def frames_to_seconds(frames: Column, rate: int = 30) -> Column:
    return F.round(frames / F.lit(float(rate)), 3)


def srt_time(milliseconds: Column) -> Column:
    """``hh:mm:ss,mmm`` of whole milliseconds; negative ones count as 0."""
    ms = F.greatest(milliseconds, F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def cues(text: Column, start: Column, seconds: Column) -> Column:
    """Timed segments of a text: array of (begin, end, text), in seconds.

    Marks ``[a-b]`` give times from the start; without any, the text is one cue
    of at least half a second. Segments without text are left out.
    """
    text = F.coalesce(text, F.lit(""))
    marks = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(2)).alias("b"),
        F.slice(F.split(text, SEGMENT), 2, 2**30).alias("t"),
    )
    trimmed = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    cue = lambda a, b, t: F.struct(a.cast("double").alias("begin"), b.cast("double").alias("end"), trimmed(t).alias("text"))
    marked = F.transform(marks, lambda m: cue(start + m["a"].cast("double"), start + m["b"].cast("double"), m["t"]))
    whole = F.array(cue(start, start + F.greatest(seconds, F.lit(0.5)), text))
    return F.filter(F.when(F.size(marks) > 0, marked).otherwise(whole), lambda c: c["text"] != "")


def srt(cue_list: Column) -> Column:
    """The text of a subtitle file from cues, ordered by begin, end, text."""
    line = lambda c, k: F.format_string("%d\n%s --> %s\n%s\n\n", k + 1, srt_time(F.bround(c["begin"] * 1000)), srt_time(F.bround(c["end"] * 1000)), c["text"])
    return F.array_join(F.transform(F.array_sort(cue_list), line), "")


def fnv1a32(data: Column) -> Column:
    """The 32-bit FNV-1a hash of all bytes of a binary, as a long; null of null."""

    @F.pandas_udf(T.LongType())
    def hashed(values: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else fnv1a(b) for b in values], dtype="Int64")

    return hashed(data)
