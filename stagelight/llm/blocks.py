"""Vectorised work on the bytes of Arrow string columns: words, span hashes, rolling hashes, sliding minima.

All functions take whole texts; a block is a run of texts from one Arrow batch, cut so that the work arrays of
a block stay at a few MB each. Hashes are trees: two neighbours are mixed into one value, which isn't linear in
either, so that no algebra of the units makes unequal strings meet. Where 64 bits don't do, two hashes of
different constants are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
U64 = np.uint64

#: Fixed odd multipliers, a pair for each of the two hashes.
FACTORS = ((0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))
#: A random value for each byte, one table for each hash.
BYTE_VALUES = tuple(np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1) for seed in (11, 12))
#: \x20 and \x09-\x0D end a word; all else, other Unicode spaces included, is part of one.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a span that is hashed in pieces of eight; longer ones go to blake2b.
SHORT = 64


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xA24BAED4963EE407)
    h ^= h >> U64(32)
    return h


def join(left: np.ndarray, right: np.ndarray, which: int = 0) -> np.ndarray:
    """One value for each pair of neighbours."""
    one, two = FACTORS[which]
    h = left * U64(one)
    h ^= h >> U64(32)
    h += right
    h *= U64(two)
    h ^= h >> U64(29)
    return h


def rollings(values: np.ndarray, widths: Sequence[int], which: int = 0) -> list[np.ndarray]:
    """Hashes of each w consecutive values, for some w: from hashes of 1, 2, 4, ... values, as w's binary digits say."""
    out: list[np.ndarray | None] = [None] * len(widths)
    done = [0] * len(widths)
    span, level = 1, values
    while True:
        for i, w in enumerate(widths):
            n = len(values) - w + 1
            if w & span and n > 0:
                part = level[done[i] : done[i] + n]
                out[i] = part if out[i] is None else join(out[i], part, which)
                done[i] += span
        if 2 * span > max(widths) or len(level) <= span:
            break
        level = join(level[:-span], level[span:], which)
        span *= 2
    return [np.empty(0, dtype=U64) if o is None or len(values) < w else mix(o + U64(w)) for o, w in zip(out, widths)]


def rolling(values: np.ndarray, w: int, which: int = 0) -> np.ndarray:
    return rollings(values, [w], which)[0]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the spans [start, end) of bytes: their length and their bytes, eight at a time, through a state
    of 128 bits."""
    size = end - start
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray(len(buf) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    a, b = size.astype(U64) * U64(FACTORS[0][0]), size.astype(U64) * U64(FACTORS[1][0]) + U64(1)
    at = np.flatnonzero((size > 0) & (size <= SHORT))
    done = 0
    while len(at):
        left = np.minimum(size[at] - done, 8).astype(U64)
        chunk = eight[start[at] + done] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * left))
        x = mix(a[at] ^ chunk)
        b[at] = (b[at] + chunk * U64(FACTORS[1][1])) * U64(FACTORS[0][1]) ^ (x >> U64(17))
        a[at] = x + (b[at] >> U64(31))
        done += 8
        at = at[size[at] > done]
    raw = buf.data if buf.flags.c_contiguous else buf.tobytes()
    for i in np.flatnonzero(size > SHORT).tolist():
        digest = hashlib.blake2b(raw[int(start[i]) : int(end[i])], digest_size=16).digest()
        a[i], b[i] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
    return mix(a + (b << U64(23))), mix(b ^ a * U64(FACTORS[1][0]))


def sliding_min(keys: np.ndarray, m: int) -> np.ndarray:
    """Minimum of each m consecutive keys, by doubling."""
    span, cur = 1, keys
    while span * 2 <= m:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    if span < m:
        n = len(keys) - m + 1
        cur = np.minimum(cur[:n], cur[m - span : m - span + n])
    return cur


def runs(bounds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices bounds[r], bounds[r] + 1, ... (counts[r] of them) of each row r, in a row."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(bounds - first, counts)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about `most` bytes; a row larger than that is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(buf: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each row's first word (with the total at the end); `space` tells
    which bytes are part of no word."""
    if not len(buf):
        z = np.empty(0, dtype=np.int64)
        return z, z, np.zeros(len(bounds), dtype=np.int64)
    word = ~space[buf]
    before = np.empty(len(buf), dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(buf))]
    cut = before.copy()
    cut[inner] = False  # a word starts afresh in each text
    start = np.flatnonzero(word & ~cut)
    after = np.zeros(len(buf), dtype=bool)
    after[:-1] = word[1:]
    after[inner - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(start, bounds)
