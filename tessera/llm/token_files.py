"""Token-ID output: flat files of unsigned integers plus 64-bit document offsets.

A data set is a folder of shards. Shard ``k`` holds the documents of the
``k``-th range of ``doc_id``:

``k.ids``   the token ids of its documents, end to end, as little-endian
            unsigned 16-bit integers (32-bit if the vocabulary needs it)
``k.off``   ``n + 1`` little-endian int64: where each document starts in the
            shard, and the shard's end
``k.doc``   ``n`` little-endian int64: the document ids (null ids are stored as
            the smallest int64; they come first, and the shard's row counts them)

The base of a shard, the number of ids before it in the whole data set, is the
prefix sum of the ids of earlier shards. Readers map the files into memory, so
any document is read without its neighbours.

Defined results: a null text is empty (only the end id); a null ``doc_id``
comes first; rows of equal ``doc_id`` are ordered by a hash of their text, then
as they come; an empty table gives no shard; other columns are ignored. Texts
are encoded whole, and the id is looked up per blank-separated chunk: the
tokenizer drops blanks before it merges, so chunks encode independently.
Names of special tokens in a text are encoded as the library does by default
(``<|endoftext|>`` gives its id); ``names_as_text`` makes them ordinary text.

Ranges are found on ids alone; then texts are encoded where they lie, and ids are
what is dealt. A task writes its shard as rows come, so it holds a batch at a time.
"""

from __future__ import annotations

import os
import sys
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from typing import IO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, fresh_dir, local_path, text_runs

#: Chunks of up to so many characters are remembered, so many of them a worker.
CACHED_CHARS, CACHED_CHUNKS = 40, 1_000_000
NULL_ID = np.iinfo("<i8").min
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"

_encoders: dict = {}


class ChunkEncoder(dict):
    """A tokenizers-library encoder that remembers chunks: chunk to ids as bytes.

    The memory is bounded. When it is full, the chunks met first stay (frequent
    ones are met early) and the later half makes room.
    """

    def __init__(self, path: str, dtype: str, names_as_text: bool = False):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = names_as_text
        self.model = self.tokenizer.model
        self.code, self[""] = {"<u2": "H", "<u4": "I"}[dtype], b""

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            # Plain letters are one piece for the tokenizer: only its model has work to do.
            low = chunk.lower()
            coded = self._bytes([token.id for token in self.model.tokenize(low)]) if low == chunk else self[low]
        elif chunk[-1] in ",." and chunk[:-1].isalpha():
            # Letters and marks are separate pieces.
            coded = self[chunk[:-1]] + self[chunk[-1]]
        else:
            coded = self._bytes(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHED_CHUNKS:
                for late in list(self)[CACHED_CHUNKS // 2 :]:
                    del self[late]
            self[chunk] = coded
        return coded

    def _bytes(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as bytes."""
        flat = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ")
        return b"".join(map(self.__getitem__, flat.split(" ")))


def _encoder(*made_of) -> ChunkEncoder:
    if made_of not in _encoders:
        _encoders.clear()
        _encoders[made_of] = ChunkEncoder(*made_of)
    return _encoders[made_of]


@contextmanager
def _whole_file(folder: str, name: str) -> Iterator[IO[bytes]]:
    """A file to write that appears whole or not at all: a task that is run again writes the same bytes."""
    passing = f".{name}-{uuid.uuid4().hex}"
    if (local := local_path(folder)) is not None:
        os.makedirs(local, exist_ok=True)
        with open(f"{local}/{passing}", "wb") as out:
            yield out
        os.replace(f"{local}/{passing}", f"{local}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{passing}") as out:
        yield out
    store.move(f"{path}/{passing}", f"{path}/{name}")


def _get(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file's integers: mapped into memory if the path is local."""
    if (local := local_path(folder)) is not None:
        path = f"{local}/{name}"
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}/{name}") as file:
        return np.frombuffer(file.read(), dtype=dtype)


def shard_starts(docs: DataFrame, shard_bytes: int, scratch: Scratch) -> list[tuple[bool, int, int]]:
    """Where each shard but the first begins: (whether the id is known, doc_id, hash of the text).

    Ranges of about ``shard_bytes`` bytes of text are found on ids and hashes alone;
    what reaches the driver is a row per shard.
    """
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.octet_length(F.col("text").cast("string")).alias("size"))
    keys = scratch.table(keys, "keys")
    n = -(-(keys.agg(F.sum("size")).first()[0] or 0) // shard_bytes)
    if n < 2:
        return []
    dealt = keys.repartitionByRange(int(n), "doc_id", "tie").groupBy(F.spark_partition_id().alias("part"))
    first = dealt.agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tie")).alias("first"))
    return sorted(tuple(r["first"]) for r in first.collect())[1:]


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, width: str, names_as_text: bool = False, starts: list[tuple[bool, int, int]] = ()) -> DataFrame:
    """(shard, doc_id, tie, ids) of each document, where it lies; ``ids`` are bytes and end with ``end_id``."""
    file, bound = os.path.basename(tokenizer_path), docs.sparkSession.sparkContext.broadcast(list(starts))
    docs.sparkSession.sparkContext.addFile(tokenizer_path)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, starts = _encoder(SparkFiles.get(file), width, names_as_text), np.asarray([end_id], width).tobytes(), bound.value
        for batch in batches:
            for first, texts in text_runs(batch.column("text")):
                own = [batch.column(c).slice(first, len(texts)) for c in ("doc_id", "tie")]
                shards = [bisect_right(starts, (i is not None, i or 0, t)) for i, t in zip(*(c.to_pylist() for c in own), strict=True)]
                ids = pa.array([encoder.encode(t) + end for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), *own, ids], ["shard", "doc_id", "tie", "ids"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(code, "shard int, doc_id long, tie long, ids binary")


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, vocab_size: int, names_as_text: bool = False, shard_bytes: int = 64 << 20) -> DataFrame:
    """Encode and write all documents in order of ``doc_id``; returns the shards.

    The result has a row per shard: shard, name, n_docs, n_tokens, n_null (its
    first documents, whose id is null), base, doc_base. It is small (a row per partition) and made by one action.
    """
    width = "<u2" if max(vocab_size, end_id + 1) <= 1 << 16 else "<u4"
    scratch, size = Scratch(docs.sparkSession, "token-files"), np.dtype(width).itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, at, nulls = TaskContext.get().partitionId(), 0, 0, 0
        name = f"{part:06d}"
        batches = (b for b in batches if b.num_rows)
        if (batch := next(batches, None)) is None:
            return
        with _whole_file(folder, f"{name}.ids") as ids, _whole_file(folder, f"{name}.off") as off, _whole_file(folder, f"{name}.doc") as doc:
            off.write(np.zeros(1, "<i8").tobytes())
            while batch is not None:
                for x in batch.column("ids"):
                    ids.write(x.as_buffer())
                ends = at + np.cumsum(pa.compute.binary_length(batch.column("ids")).to_numpy()) // size
                off.write(ends.astype("<i8").tobytes())
                doc.write(pa.compute.fill_null(batch.column("doc_id"), NULL_ID).to_numpy().astype("<i8").tobytes())
                nulls += batch.column("doc_id").null_count
                n, at, batch = n + batch.num_rows, int(ends[-1]), next(batches, None)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "name": [name], "n_docs": [n], "n_tokens": [at], "n_null": [nulls]})

    starts = shard_starts(docs, shard_bytes, scratch)
    coded = encode(docs, tokenizer_path, end_id, width, names_as_text, starts)
    # Ranges are known before, so that texts are encoded once, and straight into the shuffle.
    ordered = coded.repartitionById(len(starts) + 1, "shard").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    found = ordered.mapInArrow(write, "shard int, name string, n_docs long, n_tokens long, n_null long").collect()
    scratch.clear()
    base, doc_base, shards = 0, 0, []
    for row in sorted(found, key=lambda r: r["shard"]):
        shards.append((row["shard"], row["name"], row["n_docs"], row["n_tokens"], row["n_null"], base, doc_base))
        base, doc_base = base + row["n_tokens"], doc_base + row["n_docs"]
    schema = "shard int, name string, n_docs long, n_tokens long, n_null long, base long, doc_base long"
    return docs.sparkSession.createDataFrame(shards, schema).withColumn("width", F.lit(width))


def read_token_files(shards: DataFrame, folder: str) -> DataFrame:
    """A row per document from the files: its place, length and checksum."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for shard in rows.itertuples():
                ids, off, doc = (_get(folder, f"{shard.name}.{x}", d) for x, d in (("ids", shard.width), ("off", "<i8"), ("doc", "<i8")))
                for at in range(0, len(doc), 4096):
                    own, cut = np.asarray(doc[at : at + 4096]), np.asarray(off[at : at + 4097])
                    wide = np.asarray(ids[cut[0] : cut[-1]]).astype("<u4")
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip(cut[:-1] - cut[0], cut[1:] - cut[0], strict=True)]
                    yield pd.DataFrame({"doc_id": pd.Series(own).astype("Int64").mask(np.arange(at, at + len(own)) < shard.n_null), "start": shard.base + cut[:-1], "n_tokens": np.diff(cut), "ids_crc32": crc, "shard": shard.shard})

    spread = shards.repartition(max(1, min(shards.count(), 100_000)), "shard") if shards.take(1) else shards
    return spread.mapInPandas(read, READ_SCHEMA)


def op3_token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2, vocab_size: int = 49_408, names_as_text: bool = False) -> DataFrame:
    """Write the documents' token files into the shared folder and read them back."""
    folder = fresh_dir(spark, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer_path, end_id, vocab_size, names_as_text), folder)
