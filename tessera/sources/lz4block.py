"""LZ4 blocks by way of Arrow's codec, with an exact check of their size."""

from __future__ import annotations

import pyarrow as pa


def _expanded(data: bytes, room: int) -> bytes | None:
    """The block's content if it has at most ``room`` bytes; shorter content is padded."""
    try:
        return pa.Codec("lz4_raw").decompress(data, decompressed_size=room).to_pybytes()
    except OSError:
        return None


def decode(data: bytes, size: int) -> bytes:
    """The content of a block that must expand to ``size`` bytes: into that room it fits, into less it doesn't."""
    if not size:
        if data not in (b"", b"\0"):
            raise ValueError("an LZ4 block expands to more than nothing")
        return b""
    content = _expanded(data, size) if data else None
    if content is None or _expanded(data, size - 1) is not None:
        raise ValueError(f"an LZ4 block is malformed or doesn't expand to {size} bytes")
    return content


def encode(data: bytes) -> bytes:
    return pa.Codec("lz4_raw").compress(data).to_pybytes()
