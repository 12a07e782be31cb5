"""Distinct word shingles of whole texts as 64-bit hashes, a batch of texts at a time.

Texts stay the UTF-8 bytes in which Arrow holds them. Blanks are found in one
sweep over a batch, each word is hashed eight bytes a step for all words of the
batch at once, and five neighbouring word hashes make a shingle's. Only sorting
goes text by text.

Two of N different shingles have equal hashes with a probability of about
N^2 / 2^65; such a pair would count as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

GRAM = 5
#: Bytes of text that are hashed at once, unless a single text is longer.
CHUNK_BYTES = 1 << 20
#: Longer words are hashed one by one.
STEP, LONG_WORD = 8, 64
#: A-Z to a-z, and the other ASCII blanks to a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FACTOR, _MIX, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray, factor: np.uint64 = _MIX) -> np.ndarray:
    """Well spread 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(33))) * factor
    return x ^ (x >> np.uint64(29))


@dataclass
class Sets:
    """Sets of a run of rows: row ``r`` holds ``values[ends[r] : ends[r + 1]]``, ascending."""

    first_row: int
    values: np.ndarray
    ends: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends)


def word_hashes(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each word; ``data`` has at least ``STEP`` bytes after the last word."""
    windows = np.ndarray((len(data) - STEP + 1,), "<u8", data, strides=(1,))
    out = mixed((windows[starts] & _MASKS[np.minimum(sizes, STEP)]) * _FACTOR + sizes.astype(np.uint64))
    live = np.flatnonzero((sizes > STEP) & (sizes <= LONG_WORD))
    for at in range(STEP, LONG_WORD, STEP):
        if not len(live):
            break
        part = windows[starts[live] + at] & _MASKS[np.minimum(sizes[live] - at, STEP)]
        out[live] = mixed((out[live] ^ part) * _FACTOR)
        live = live[sizes[live] > at + STEP]
    for k in np.flatnonzero(sizes > LONG_WORD):
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + sizes[k]])
    return out


def _sets_of(raw: bytes, cuts: np.ndarray, first_row: int) -> Sets:
    """The sets of the texts ``raw[cuts[r] : cuts[r + 1]]``."""
    data = raw.translate(_PLAIN) + b" " * STEP
    inside = np.frombuffer(data, np.uint8)[: len(raw)] != 32
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    # Neighbouring texts have nothing between them.
    edges = cuts[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(opens)
    hashes = word_hashes(data, starts, np.flatnonzero(closes) + 1 - starts)
    bounds = np.searchsorted(starts, cuts)
    counts = np.diff(bounds)
    grams = np.full(max(len(hashes) - GRAM + 1, 0), GRAM, np.uint64)
    for k in range(GRAM):
        grams = grams * _FACTOR + hashes[k : k + len(grams)]
    grams = mixed(grams).view(np.int64)
    keep = np.zeros(len(hashes), bool)
    values = np.zeros(len(hashes), np.int64)
    values[: len(grams)] = grams
    for row in np.flatnonzero(counts):
        a, b = bounds[row], bounds[row + 1]
        if b - a < GRAM:
            whole = np.uint64(b - a)
            for k in range(a, b):
                whole = whole * _FACTOR + hashes[k]
            values[a], stop = mixed(np.array([whole], np.uint64)).view(np.int64)[0], a + 1
        else:
            stop = b - GRAM + 1
            values[a:stop].sort()
        keep[a:stop] = True
    same = np.zeros(len(values), bool)
    same[1:] = values[1:] == values[:-1]
    same[bounds[:-1][counts > 0]] = False
    keep &= ~same
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])[bounds]
    return Sets(first_row, values[keep], ends)


def shingle_sets(texts: pa.Array) -> Iterator[Sets]:
    """The sets of all rows of a text column, some rows at a time; null has none."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(cuts, cuts[row] + CHUNK_BYTES, "right")) - 1)
        raw = data[int(cuts[row]) : int(cuts[stop])].to_pybytes() if data is not None else b""
        with np.errstate(over="ignore"):
            yield _sets_of(raw, cuts[row : stop + 1] - cuts[row], row)
        row = stop


def shingle_set(text: str | None) -> np.ndarray:
    """The set of one text."""
    return next(shingle_sets(pa.array([text or ""], pa.string()))).values


def first_tokens(sets: Sets, levels: np.ndarray, sizes_of) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens of each set in the order of ``levels``, then of hashes.

    A token is a hash's level above the upper 58 bits of the hash; ``sizes_of``
    tells from the sets' sizes how many are wanted. Returns tokens and ends.
    """
    tokens = levels[sets.values & (len(levels) - 1)].astype(np.int64) << 58 | (sets.values.view(np.uint64) >> np.uint64(6)).view(np.int64)
    for a, b in zip(sets.ends[:-1], sets.ends[1:], strict=True):
        tokens[a:b].sort()
    wanted = sizes_of(sets.sizes)
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(wanted)])
    pick = np.arange(ends[-1]) + np.repeat(sets.ends[:-1] - ends[:-1], wanted)
    return tokens[pick], ends


def set_hashes(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set, in any order of its members."""
    out = []
    for factor in (_MIX, _OTHER):
        spread = mixed(values.view(np.uint64) * _FACTOR + factor, factor)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
        out.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return out[0], out[1]
