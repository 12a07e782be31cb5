"""Byte-level BPE encoding and decoding.

A text is cut by the vocabulary's pattern. A piece that is a vocabulary entry
has its rank as id; any other is folded: its single bytes are the parts, and as
long as two neighbours form an entry, the leftmost pair of the least rank is
joined. Decoding takes the binary entry of each id and concatenates them.

Two forms give the same ids. ``encode`` cuts and folds Arrow batches: each
distinct word is folded once and remembered by its worker, in a memory of fixed
size; a fold takes n log n steps for n bytes, however long the piece. Rows stay
where they are, so there is no shuffle and no hot key. ``encode_by_columns`` is
made of SQL functions: distinct words of all documents are folded by a higher-order
function over a literal rank map, and joined back by word. It shuffles every piece
of every text, and its fold is interpreted, which costs more than the check tool
allows (README has figures); the query uses ``encode``.

Defined results: a null text is empty and has no ids; null and repeated
``doc_id`` pass through; an empty table gives no rows; other columns are
dropped. Texts are taken whole. The pattern's classes follow the installed
``regex`` library (``encode``), which agrees with tiktoken on every code point,
or the JVM's Unicode version (``encode_by_columns``).
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, text_runs

NONE = 2**30
BUCKETS = 1 << 16
#: Chunks of up to so many characters are remembered, so many of them a worker.
KEPT_CHARS, KEPT = 48, 800_000
#: The pattern for which texts may be split at spaces, blanks that touch, and blanks but space and line feed.
BLANK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOUCHING = ("  ", " \n", "\n ")
RARE_BLANKS = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: a heap of pairs by rank and place, and a linked list of parts."""
    if piece in ranks:
        return [ranks[piece]]
    end = list(range(1, len(piece) + 1))  # by start of a part; 0 once it is gone
    before = list(range(-1, len(piece) - 1))
    waiting = [(r, i, i + 1, i + 2) for i in range(len(piece) - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, start, middle, stop = heapq.heappop(waiting)
        if end[start] != middle or middle >= len(piece) or end[middle] != stop:
            continue
        end[start], end[middle] = stop, 0
        if stop < len(piece):
            before[stop] = start
            if (r := ranks.get(piece[start : end[stop]])) is not None:
                heapq.heappush(waiting, (r, start, stop, end[stop]))
        if (first := before[start]) >= 0 and (r := ranks.get(piece[first:stop])) is not None:
            heapq.heappush(waiting, (r, first, start, stop))
    out, at = [], 0
    while at < len(piece):
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class Memory(dict):
    """What ``make`` gives for each key, in a bounded memory.

    When it is full, the keys met first stay (frequent ones are met early) and
    the later half makes room.
    """

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= self.most:
                for late in list(self)[self.most // 2 :]:
                    del self[late]
            self[key] = value
        return value


class PieceCoder:
    """Ids of texts as little-endian 32-bit integers, and texts of ids.

    Where the pattern allows it, a text is first split at spaces between words: a
    match of ``BLANK_PATTERN`` never goes on after a space with other characters
    than blanks on both sides, but may begin with one, so what lies between two
    such spaces has its own matches. Codes of these chunks are remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT):
        self.ranks, self.entries = ranks, [b""] * len(ranks)
        for entry, rank in ranks.items():
            self.entries[rank] = entry
        # Blanks as the vocabularies' own library takes them: by Unicode's White_Space property.
        self.cut = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.splits = pattern == BLANK_PATTERN
        self.pieces = Memory(lambda p: np.array(merge(p.encode("utf-8", "surrogatepass"), ranks), "<u4").tobytes(), kept // 4)
        self.opening, self.chunks = Memory(self._matches, kept // 16), Memory(lambda c: self._matches(f" {c}"), kept)

    def _matches(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def encode(self, text: str) -> bytes:
        if not self.splits or any(b in text for b in TOUCHING) or any(b in text for b in (RARE_BLANKS[:4] if text.isascii() else RARE_BLANKS)):
            return self._matches(text)
        first, *rest = text.split(" ")
        return self.opening[first] + b"".join(map(self.chunks.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict = {}


def coder_of(ranks: dict[bytes, int], pattern: str) -> PieceCoder:
    """This worker's coder, made once for each vocabulary."""
    key = (pattern, len(ranks), hash(frozenset(list(ranks.items())[:: max(1, len(ranks) // 97)])))
    if key not in _coders:
        _coders.clear()
        _coders[key] = PieceCoder(ranks, pattern)
    return _coders[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, parts: tuple[str, ...] = ("n_tokens", "ids", "bytes")) -> DataFrame:
    """A row per document: number of ids, the ids and the decoded bytes (binary), or some of these."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks.value, pattern)
        for batch in batches:
            for first, texts in text_runs(batch.column("text")):
                ids = [coder.encode(t or "") for t in texts]
                made = {"n_tokens": lambda: pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": lambda: pa.array(ids, pa.binary()), "bytes": lambda: pa.array([coder.decode(x) for x in ids], pa.binary())}  # noqa: B023
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), *(made[c]() for c in parts)], ["doc_id", *parts])

    kinds = {"n_tokens": "long", "ids": "binary", "bytes": "binary"}
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} {kinds[c]}" for c in parts)
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(code, schema)


def pieces(text: Column, pattern: str) -> Column:
    """The pattern's matches; ``(?U)`` gives blanks their Unicode meaning."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.hash(key), F.lit(buckets))


def constants(spark: SparkSession, ranks: dict[bytes, int]) -> tuple[Column, Column, list[str]]:
    """The vocabulary as literals: bytes to rank, in hash buckets (a look-up in a
    Spark map reads the whole map); and by id its four little-endian bytes and its
    entry. Session variables carry them, whose names are returned, too."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("the ranks of a vocabulary count from 0 without gaps")
    rows = materialise(spark.createDataFrame([(bytearray(k), v) for k, v in ranks.items()], "piece binary, id int").coalesce(1), "bpe-ranks")
    full = rows.groupBy(_bucket(F.col("piece"), BUCKETS).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("piece", "id"))).alias("m"))
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(full, "b", "left")
    filled = every.select("b", F.coalesce("m", F.expr("cast(map() as map<binary,int>)")).alias("m"))
    listed = filled.groupBy().agg(F.sort_array(F.collect_list(F.struct("b", F.map_entries("m").alias("e")))).alias("x"))
    own = F.struct("id", id_bytes(F.col("id")).cast("string").alias("le"), F.col("piece").cast("string").alias("bytes"))
    entry = rows.groupBy().agg(F.sort_array(F.collect_list(own)).alias("x")).select(F.transform("x", lambda e: F.struct(e["le"].alias("le"), e["bytes"].alias("bytes"))))
    names = [_variable(listed.select(F.transform("x", lambda x: F.map_from_entries(x["e"])))), _variable(entry)]
    return F.expr(f"session.{names[0]}"), F.expr(f"session.{names[1]}"), names


def _variable(one_value: DataFrame) -> str:
    """A session variable of the value of a query of one row and column."""
    spark, name = one_value.sparkSession, f"tessera_{uuid.uuid4().hex}"
    one_value.createOrReplaceTempView(name)
    spark.sql(f"DECLARE VARIABLE {name} {one_value.schema[0].dataType.simpleString()}")
    spark.sql(f"SET VAR {name} = (SELECT * FROM {name})")
    spark.catalog.dropTempView(name)
    return name


def look_up(maps: Column, key: Column, buckets: int) -> Column:
    return F.element_at(F.get(maps, _bucket(key, buckets)), key)


def fold(piece: Column, ranks: Column) -> Column:
    """The ids of a binary piece after all merges.

    The state is one array of the bounds between parts. An element holds the
    rank of the pair that its bound divides above the bound's place, so the
    least element is the leftmost pair of the least rank. Joining that pair takes
    the bound out and looks up the pairs at the two bounds beside it. Two
    elements without rank stand at each end.
    """
    size, low = F.octet_length(piece), 2**32 - 1
    bound = lambda rank, place: F.shiftleft(rank.cast("long"), 32) + place
    between = lambda a, b: F.coalesce(look_up(ranks, F.substring(piece, a + 1, b - a), BUCKETS), F.lit(NONE))
    edge = lambda place: F.array(bound(F.lit(NONE), place), bound(F.lit(NONE), place))
    inner = F.transform(F.sequence(F.lit(1), size - 1), lambda i: bound(between(i - 1, i + 1), i))
    start = F.concat(edge(F.lit(0)), inner, edge(size))

    def join(acc: Column, j: Column) -> Column:
        before, left, right, after = (F.get(acc, j + k).bitwiseAND(low).cast("int") for k in (-3, -2, 0, 1))
        new = F.array(
            bound(F.when(left > 0, between(before, right)).otherwise(NONE), left),
            bound(F.when(right < size, between(left, after)).otherwise(NONE), right),
        )
        return F.concat(F.slice(acc, F.lit(1), j - 2), new, F.slice(acc, j + 2, F.size(acc)))

    def step(acc: Column, _: Column) -> Column:
        least = F.array_min(acc)
        place = F.array(F.array_position(acc, least).cast("int"))
        return F.when(least >= NONE << 32, acc).otherwise(F.get(F.transform(place, lambda j: join(acc, j)), F.lit(0)))

    place = lambda acc, i: F.get(acc, i).bitwiseAND(low).cast("int")
    ids = lambda acc: F.transform(F.sequence(F.lit(2), F.size(acc) - 2), lambda i: between(place(acc, i - 1), place(acc, i)))
    return F.aggregate(F.sequence(F.lit(1), size - 1), start, step, ids)


def id_bytes(value: Column) -> Column:
    """An id as four little-endian bytes."""
    big = F.unhex(F.lpad(F.hex(value.cast("long")), 8, "0"))
    return F.concat(*(F.substring(big, k, 1) for k in (4, 3, 2, 1)))


def code_of(piece: Column, ranks: Column, entries: Column) -> Column:
    """A piece's ids as bytes, and the bytes that decoding them gives."""
    whole = piece.cast("binary")
    known = look_up(ranks, whole, BUCKETS)
    ids = F.when(known.isNotNull(), F.array(known)).otherwise(fold(whole, ranks))
    text = lambda e, name: F.array_join(F.transform(e, lambda x: x[name]), "")
    by_id = F.transform(ids, lambda i: F.get(entries, i))
    return F.get(F.transform(F.array(by_id), lambda e: F.struct(text(e, "le").alias("ids"), text(e, "bytes").alias("bytes"))), F.lit(0))


def encode_by_columns(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encode`` with SQL functions alone: each distinct word is folded once, and its code joined back."""
    maps, entries, names = constants(docs.sparkSession, read_ranks(ranks_path))
    rows = materialise(docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "bpe-rows")
    each = rows.select("row", F.posexplode(pieces(F.col("text"), pattern)).alias("pos", "piece"))
    words = each.select("piece").distinct().select("piece", code_of(F.col("piece"), maps, entries).alias("c"))
    words = materialise(words.select("piece", F.col("c.ids").alias("ids"), F.col("c.bytes").alias("bytes")), "bpe-words")
    for name in names:
        docs.sparkSession.sql(f"DROP TEMPORARY VARIABLE {name}")
    whole = each.join(words, "piece").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "ids", "bytes"))).alias("x"))
    joined = lambda name: F.coalesce(F.array_join(F.transform("x", lambda x: x[name]), ""), F.lit("")).cast("binary").alias(name)
    out = rows.select("row", "doc_id").join(whole, "row", "left").select("doc_id", joined("ids"), joined("bytes"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "bytes")


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
