"""Chat formatting into budgeted windows, with SQL functions only.

Turns are marked as ``<|im_start|>role``, a line break, the text, ``<|im_end|>``
and a line break. Within texts and roles, ``<`` followed by backslashes and
``|`` gets one more backslash, so that no control string is left and the change
can be undone; in roles, ``%`` and line breaks are percent-encoded too.

A window holds a span of new turns, chosen from the prefix sums of turn tokens
so that it fits the budget and ends between turns. Tokens are given as a column,
or else counted as the pieces into which byte-pair vocabularies cut a text before
they merge. The system turn that opens the conversation and a limited number of
turns before the span are repeated in front of it; only the first window, which
repeats nothing, has the whole budget for its span. Targets are the assistant
texts of new turns only, so each is trained on once. A turn that alone exceeds the
room has a window of its own, marked ``over_budget`` if it is; nothing is cut. The
system turn is kept whatever its size: one that leaves no room gives every later
turn its own window, and one above the budget puts all of them over it.

Conversations are handled in blocks of ``block_turns`` turn numbers: a row holds
at most a block, however long a conversation, and a block gets the system turn
and the last turns before it by a join of those few turns. Turn numbers are taken
to be distinct within a conversation; rows that share one (or have none) are kept
and ordered, but stay in one block together.

Defined results: null role or text is empty; a null turn number comes first;
rows of equal number go by role, then text; rows of null ``conv_id`` are one
conversation; an empty table gives no windows; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURN = "array<struct<turn:bigint,role:string,text:string,tokens:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


#: Letters or digits or other marks, with a blank before; or blanks.
PIECE = r" ?\p{L}+| ?\p{N}+| ?[^\x09-\x0D\x20\p{L}\p{N}]+|[\x09-\x0D\x20]+"
MARK_TOKENS = 4


def piece_tokens(text: Column) -> Column:
    """Pieces of a text as byte-pair vocabularies cut it, before any merges."""
    return F.regexp_count(text, F.lit(PIECE)).cast("long")


def _sums(values: Column) -> Column:
    """Prefix sums of an array, with a leading 0."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def chat_windows(turns: DataFrame, budget: int = 1024, history_tokens: int = 256, history_turns: int = 2, block_turns: int = 256, tokens: Column | None = None) -> DataFrame:
    """A row per window: the formatted text, its targets and what was repeated.

    ``loss`` lists the targets as zero-based character positions and lengths;
    ``n_repeated`` counts the leading turns that an earlier window has, too.
    ``tokens`` gives the tokens of a turn's text; each turn has ``MARK_TOKENS`` more.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"), (F.coalesce(tokens if tokens is not None else piece_tokens(text), F.lit(0)).cast("long") + MARK_TOKENS).alias("tokens"))
    rows = turns.select("conv_id", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / block_turns).alias("block"), turn.alias("t"))
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    opening = F.when(F.get("turns", F.lit(0))["role"] == "system", F.slice("turns", 1, 1)).otherwise(F.array().cast(TURN))
    tail = F.slice("turns", -F.least(F.lit(history_turns), F.size("turns")), history_turns) if history_turns else F.array().cast(TURN)
    edge = blocks.select("conv_id", "block", opening.alias("opening"), tail.alias("tail"))
    by = W.partitionBy("conv_id").orderBy("block")
    edge = edge.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), F.first("opening").over(by).alias("system"),
        F.coalesce(F.lag("tail").over(by), F.array().cast(TURN)).alias("before"), (F.row_number().over(by) == 1).alias("first"),
    )
    joined = blocks.join(edge, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    # The turns before a block stand in front of its own; spans begin at its own.
    joined = joined.select("conv_id", "block", "system", "first", F.size("before").alias("lead"), F.concat("before", "turns").alias("turns"))
    joined = joined.withColumn("sums", _sums(F.transform("turns", lambda t: t["tokens"])))
    used = F.coalesce(F.get("system", F.lit(0))["tokens"], F.lit(0)) + history_tokens
    joined = joined.withColumn("room", F.greatest(F.lit(1).cast("long"), budget - used))
    # The first window repeats nothing.
    room = lambda acc: F.when(F.col("first") & (F.size(acc) == 1), F.lit(budget).cast("long")).otherwise(F.col("room"))
    reach = lambda a, b: F.get("sums", b) - F.get("sums", a)  # noqa: E731  tokens of turns a up to b, from 0
    starts = F.aggregate(
        F.sequence(F.col("lead"), F.size("turns") - 1), F.array(F.col("lead")),
        lambda acc, i: F.when((i > F.element_at(acc, -1)) & (reach(F.element_at(acc, -1), i + 1) > room(acc)), F.concat(acc, F.array(i))).otherwise(acc),
    )
    spans = joined.withColumn("starts", starts).select("*", F.posexplode("starts").alias("part", "start"))
    spans = spans.withColumn("stop", F.coalesce(F.get("starts", F.col("part") + 1), F.size("turns")))
    opens = F.col("first") & (F.col("part") == 0)
    kept_system = F.when(opens, F.array().cast(TURN)).otherwise(F.col("system"))
    # The system turn is never history: it stands in front of every later window.
    least = F.coalesce(F.array_position("turns", F.get("system", F.lit(0))), F.lit(0)).cast("int")
    back = F.greatest(least, F.col("start") - history_turns)
    history = F.filter(F.sequence(F.col("start") - history_turns, F.col("start")), lambda h: (h >= back) & (h >= 0) & (reach(h, F.col("start")) <= history_tokens))
    spans = spans.withColumn("from", F.when(opens, F.col("start")).otherwise(F.coalesce(F.array_min(history), F.col("start"))))
    spans = spans.select(
        "conv_id", "block", "part", (F.size(kept_system) + F.col("start") - F.col("from")).alias("n_repeated"),
        F.concat(kept_system, F.slice("turns", F.col("from") + 1, F.col("stop") - F.col("from"))).alias("turns"),
    )
    marked = spans.withColumn("marked", F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), t["role"].alias("role"))))
    marked = marked.withColumn("ends", _sums(F.transform("marked", lambda m: (F.length(m["head"]) + F.length(m["body"]) + len(END) + 1).cast("long"))))
    placed = F.zip_with("marked", "ends", lambda m, at: F.struct(m.alias("m"), at.alias("at")))
    target = lambda x, k: F.when(
        (k >= F.col("n_repeated")) & (x["m"]["role"] == "assistant"),
        F.struct((x["at"] + F.length(x["m"]["head"])).alias("start"), F.length(x["m"]["body"]).cast("long").alias("length")),
    )
    total = F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + t["tokens"])
    return marked.select(
        "conv_id", "block", "part", "n_repeated", F.size("turns").alias("n_turns"), total.alias("n_tokens"), (total > budget).alias("over_budget"),
        F.array_join(F.transform("marked", lambda m: F.concat(m["head"], m["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.filter(F.transform(placed, target), lambda x: x.isNotNull()).alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Each window's new turns and targets, parsed from its formatted text."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), F.col("n_repeated") + 2, F.greatest(F.lit(0), F.col("n_turns") - F.col("n_repeated")))
    cut = lambda p: F.instr(p, "\n")
    turn = lambda p: F.struct(
        _unescape_role(F.substring(p, F.lit(1), cut(p) - 1)).alias("role"),
        unescape(F.substring(p, cut(p) + 1, F.length(p) - cut(p) - len(END) - 1)).alias("text"),
    )
    target = lambda x: unescape(F.substring("formatted", (x["start"] + 1).cast("int"), x["length"].cast("int")))
    return windows.withColumn("new_turns", F.transform(pieces, turn)).withColumn("targets", F.transform("loss", target))


def conversation_digest(windows: DataFrame) -> DataFrame:
    """Digests of each conversation as read back from its windows."""
    said = F.array_join(F.transform("new_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read_windows(windows).select(
        "conv_id", F.size("new_turns").cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"),
        F.struct("block", "part", said.alias("said"), F.array_join("targets", "").alias("wanted")).alias("w"),
    )
    whole = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"), F.sort_array(F.collect_list("w")).alias("w"))
    wanted = F.array_join(F.transform("w", lambda x: x["wanted"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(wanted).cast("long").alias("loss_chars"), F.sha2(wanted.cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
