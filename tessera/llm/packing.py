"""Best-fit packing into sequences of several permitted lengths.

All pieces of the corpus are packed together by best-fit decreasing: a piece goes
to the open bin that it fills best. If none has room, a bin of the permitted
length with the least cost per token that can still be used is opened:
``cost(c) / min(c, tokens still to place)``. In the end each bin shrinks to the
shortest permitted length that holds what it got. Documents longer than the
longest length are cut into pieces; all pieces stay.

Pieces of one length are alike, so what is packed is a table of lengths and
their counts, which has at most as many rows as the longest length has tokens,
however many documents there are. Packing it gives classes of equally filled
bins. Pieces are then numbered within their length (one narrow shuffle by ranges
of length and id, and one count for each range), and a piece's number tells its
class, bin and place. Bins depend on lengths and ids alone, not on how files are
cut, and no key decides what a task holds, so there are no hot keys.

``sequences`` puts the token ids of each bin's pieces together.

Defined results: null or non-positive lengths are packed as one token (the end
of an empty document); null and repeated ids are packed like others; pieces of
equal length go by id (null first), then by piece; an empty table has no bins;
other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

#: Permitted sequence lengths with the cost of one sequence of each: a token's
#: linear work plus attention work that grows with the square of the length.
LENGTHS = {c: c * (1 + c / 8192) for c in (512, 1024, 2048, 4096)}
SCHEMA = "doc_id long, piece int, piece_start long, piece_tokens int, bin_id long, bin_pos int, bin_offset int, bin_tokens int, bin_capacity int"


@dataclass
class Bins:
    """``times`` bins of the same content: (length, copies), the longest first."""

    times: int
    room: int
    size: int
    content: tuple[tuple[int, int], ...] = ()
    capacity: int = 0

    def filled(self, times: int, length: int, copies: int) -> Bins:
        return Bins(times, self.room - length * copies, self.size, (*self.content, (length, copies)))


def pack_lengths(counts: Mapping[int, int], costs: Mapping[int, float] = LENGTHS) -> list[Bins]:
    """Best-fit decreasing over lengths and their counts.

    As a bin that has just got a piece fits the next one of that length best (if
    it fits at all), whole classes of bins are filled at once. Of bins with equal
    room the one that was opened shorter is taken.
    """
    sizes = sorted(costs)
    left = sum(n * k for n, k in counts.items())
    rooms: list[tuple[int, int]] = []
    open_bins: dict[tuple[int, int], list[Bins]] = defaultdict(list)

    def put(bins: Bins) -> None:
        if bins.times:
            key = bins.room, bins.size
            if not open_bins[key]:
                insort(rooms, key)
            open_bins[key].append(bins)

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect_left(rooms, (length, 0))
            if at < len(rooms):
                room = rooms[at]
                bins = open_bins[room].pop(0)
                if not open_bins[room]:
                    rooms.pop(at)
            else:
                size = min((c for c in sizes if c >= length), key=lambda c: (costs[c] / min(c, left), c))
                # While more is left than any bin holds, the choice stays the same.
                many = max(1, (left - sizes[-1]) // (size // length * length))
                bins = Bins(min(many, -(-todo // (size // length))), size, size)
            copies = bins.room // length
            full = min(bins.times, todo // copies)
            put(bins.filled(full, length, copies))
            todo, rest, used = todo - full * copies, 0, full * copies
            if full < bins.times and todo and todo < copies:
                put(bins.filled(1, length, todo))
                used, todo, rest = used + todo, 0, 1
            if bins.content:
                put(Bins(bins.times - full - rest, bins.room, bins.size, bins.content))
            left -= used * length
    out = [b for room in sorted(open_bins) for b in open_bins[room]]
    for b in out:
        fill = sum(n * k for n, k in b.content)
        b.capacity = sizes[bisect_left(sizes, fill)]
    return out


def _places(bins: list[Bins]) -> dict[str, np.ndarray]:
    """Which numbers of each length lie in which bins: a row per length and class."""
    rows, given, base = [], defaultdict(int), 0
    for b in bins:
        fill, offset, pos = sum(n * k for n, k in b.content), 0, 0
        for length, copies in b.content:
            rows.append((length, given[length], copies, base, pos, offset, fill, b.capacity))
            given[length] += b.times * copies
            offset, pos = offset + length * copies, pos + copies
        base += b.times
    rows.sort()
    names = ("length", "number", "copies", "bin", "pos", "offset", "fill", "capacity")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, len(names)).T, strict=True))


def best_fit_pack(docs: DataFrame, n_tokens: Column, costs: Mapping[int, float] = LENGTHS, row: str | None = None) -> DataFrame:
    """A row per piece of each document: its bin and its place in the bin.

    ``row`` names a long column that is passed through, to tell rows of equal ids apart.
    """
    longest, extra = max(costs), [row] if row else []
    # Written first: finding ranges reads all lengths once more, which may cost a lot to make.
    whole = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, F.greatest(F.coalesce(n_tokens.cast("long"), F.lit(1)), F.lit(1)).alias("n")), "packing-lengths")
    pieces = whole.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / longest))).alias("piece"))
    pieces = pieces.select("doc_id", *extra, F.col("piece").cast("int").alias("piece"), F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("int").alias("length"))
    # Written in order, with each row's range and place in it: numbers stay what they are.
    order = [F.col("length"), F.col("doc_id").asc_nulls_first(), F.col("piece")]
    ranged = pieces.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = materialise(ranged, "packing-pieces")
    part = F.shiftright("at", 33).cast("int")
    sizes = {r["part"]: r["n"] for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    counts = {r["length"]: r["n"] for r in ranged.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts, lengths = np.array(sorted(sizes), np.int64), np.array(sorted(counts), np.int64)
    before = lambda table, keys: np.concatenate([[0], np.cumsum([table[int(k)] for k in keys])])[:-1].astype(np.int64)
    known = docs.sparkSession.sparkContext.broadcast((parts, before(sizes, parts), lengths, before(counts, lengths), _places(pack_lengths(counts, costs))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, part_base, lengths, length_base, p = known.value
        keys = (p["length"] << 44) | p["number"]
        for batch in batches:
            at, length = (batch.column(c).to_numpy().astype(np.int64) for c in ("at", "length"))
            number = part_base[np.searchsorted(parts, at >> 33)] + (at & ((1 << 33) - 1)) - length_base[np.searchsorted(lengths, length)]
            k = np.searchsorted(keys, (length << 44) | number, "right") - 1
            own = number - p["number"][k]
            slot, piece = own % p["copies"][k], batch.column("piece")
            columns = {
                "doc_id": batch.column("doc_id"), **{c: batch.column(c) for c in extra}, "piece": piece, "piece_start": pa.array(piece.to_numpy().astype(np.int64) * longest), "piece_tokens": batch.column("length"),
                "bin_id": pa.array(p["bin"][k] + own // p["copies"][k]), "bin_pos": pa.array((p["pos"][k] + slot).astype(np.int32)), "bin_offset": pa.array((p["offset"][k] + slot * length).astype(np.int32)),
                "bin_tokens": pa.array(p["fill"][k].astype(np.int32)), "bin_capacity": pa.array(p["capacity"][k].astype(np.int32)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = SCHEMA.replace("doc_id long", f"doc_id long, {row} long") if row else SCHEMA
    return ranged.mapInArrow(place, schema)


def sequences(coded: DataFrame, end_id: int, costs: Mapping[int, float] = LENGTHS) -> DataFrame:
    """Packed sequences of documents' ids: (doc_id, n_tokens, ids as little-endian 32-bit integers).

    Each document gets ``end_id`` at its end. A row per bin: bin_id, tokens (as
    many as the bin has, in the same form), capacity, and for each piece its
    doc_id, piece and offset.
    """
    coded = coded.select("doc_id", (F.col("n_tokens") + 1).alias("n"), F.concat("ids", F.lit(end_id.to_bytes(4, "little"))).alias("ids"))
    coded = materialise(coded.withColumn("row", F.monotonically_increasing_id()), "packing-ids")
    placed = best_fit_pack(coded, F.col("n"), costs, "row").join(coded.select("row", "ids"), "row")
    part = F.struct("bin_pos", "doc_id", "piece", "bin_offset", F.substring("ids", (4 * F.col("piece_start") + 1).cast("int"), 4 * F.col("piece_tokens")).alias("ids"))
    bins = placed.groupBy("bin_id", F.col("bin_capacity").alias("capacity")).agg(F.sort_array(F.collect_list(part)).alias("p"))
    tokens = F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")
    return bins.select("bin_id", F.unhex(tokens).alias("tokens"), "capacity", F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["bin_offset"].alias("offset"))).alias("pieces"))
