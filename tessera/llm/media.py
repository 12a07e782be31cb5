"""Media columns: texts or samples as lossless WebP, and pixels back from it.

``write_media`` stores a payload as grey images of ``WIDTH`` columns, end to end
if one image (16,384 rows, the format's most) doesn't hold it. What the format
offers is used as the content asks: few values are bundled by a palette, samples
that follow their neighbours go through a predictor, long repeats become
back-references. ``read_media`` decodes stored bytes,
ours or any lossless WebP, and writes pixel arrays: width, height, channels
(1 for grey, 4 for ARGB) and the samples row by row.

Defined results: a null text is empty, and an empty payload is one row of
blanks; null media give null pixels; a stored form that can't be decoded gives
null pixels and the reason in ``error``; other columns pass through; equal
texts give equal bytes. Texts are taken whole. Rows are independent, so there
is no shuffle, and a task holds a few rows at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.webp import MAX_SIDE, decode_webp, encode_grey, plan_grey

WIDTH = 192
PIXELS = "struct<width:int,height:int,channels:int,pixels:binary,error:string>"


def payload_of(text: str | None, width: int = WIDTH) -> bytes:
    """UTF-8 and blanks up to a positive multiple of ``width``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * ((-len(raw)) % width if raw else width)


def store(payload: bytes, width: int = WIDTH) -> bytes:
    """A payload as one or more WebP files, end to end; each is stored as its content asks (``plan_grey``)."""
    samples, most = np.frombuffer(payload, np.uint8), width * MAX_SIDE
    parts = (samples[at : at + most] for at in range(0, len(samples), most))
    return b"".join(encode_grey(part, width, **plan_grey(part, width)) for part in parts)


def files_of(media: bytes) -> Iterator[bytes]:
    """The WebP files of a stored form."""
    at = 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        yield media[at : at + size]
        at += size


def load(media: bytes) -> tuple[int, int, int, bytes]:
    """Width, height, channels and samples of a stored form."""
    width, height, images = 0, 0, []
    for file in files_of(media):
        width, rows, pixels = decode_webp(file)
        height += rows
        images.append(pixels)
    argb = images[0] if len(images) == 1 else np.concatenate(images)
    grey = (argb & np.uint32(0xFF)).astype(np.uint8)
    if (argb == np.uint32(0xFF000000) | grey.astype(np.uint32) * np.uint32(0x010101)).all():
        return width, height, 1, grey.tobytes()
    return width, height, 4, argb.astype(">u4").tobytes()


def feature_of(pixels: bytes) -> str:
    """Difference hash: 65 means of even spans of the samples, each against the next, then the mean."""
    samples = np.frombuffer(pixels, np.uint8)
    cuts = np.arange(65, dtype=np.int64) * len(samples) // 65
    means = np.add.reduceat(samples, cuts, dtype=np.int64) / np.diff(np.append(cuts, len(samples)))
    bits = int.from_bytes(np.packbits(means[1:] > means[:-1]).tobytes(), "big")
    return f"{bits:016x}:{samples.mean():.3f}"


def _small_batches(rows: pd.DataFrame, step: int = 64) -> Iterator[pd.DataFrame]:
    for at in range(0, len(rows), step):
        yield rows.iloc[at : at + step]


def write_media(df: DataFrame, text: str = "text", media: str = "media", width: int = WIDTH) -> DataFrame:
    """Adds the stored form of a text column."""

    @F.pandas_udf(T.BinaryType())
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: store(payload_of(t, width), width))

    return df.withColumn(media, encode(F.coalesce(F.col(text), F.lit(""))))


def read_media(df: DataFrame, media: str = "media", pixels: str = "pixels") -> DataFrame:
    """Adds the pixel arrays of a column of stored forms."""

    def one(stored: bytes | None) -> tuple:
        if stored is None:
            return None, None, None, None, None
        try:
            return (*load(stored), None)
        except (ValueError, IndexError, struct.error) as why:
            return None, None, None, None, str(why)

    @F.pandas_udf(PIXELS)
    def decode(stored: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in stored], columns=["width", "height", "channels", "pixels", "error"]).astype({"width": "Int32", "height": "Int32", "channels": "Int32"})

    return df.withColumn(pixels, decode(F.col(media)))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def media_digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Stores each text, reads the stored bytes back and describes both.

    Stored bytes and pixels live within a task only: what ``write_media`` and
    ``read_media`` give as columns would be larger than the documents.
    """

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in (part for batch in batches for part in _small_batches(batch)):
            out = []
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                media = store(payload_of(text, width), width)
                across, down, _, pixels = load(media)
                out.append((doc_id, len((text or "").encode("utf-8", "surrogatepass")), len(pixels), hashlib.sha256(pixels).hexdigest(), zlib.crc32(pixels[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(pixels), across, down))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DIGEST.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(describe, DIGEST)
