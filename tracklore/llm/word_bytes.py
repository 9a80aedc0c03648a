"""Words as spans of the bytes of Arrow's UTF-8 buffers, and their hashes, a whole batch at a time."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

#: Words longer than this go through the C library's loop; so many steps are taken by all other words of a batch at once.
TOGETHER = 48


def _automaton() -> np.ndarray:
    """The state that a byte leads to from the lowest byte of a state, by the reversed CRC-32 polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & 1, np.uint32(0xEDB88320), np.uint32(0))
    return t


NEXT = _automaton()
START = np.uint32(0xFFFFFFFF)  # a CRC is its last state, inverted


def step(state: np.ndarray, byte: np.ndarray | np.uint32) -> np.ndarray:
    return NEXT[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC states after data[start : start + size], for all starts at once."""
    order = np.argsort(-size, kind="stable")
    at, left, now = start[order], size[order], state[order]
    falling = -left
    for k in range(min(TOGETHER, int(left[0]) if len(left) else 0)):
        n = int(np.searchsorted(falling, -k, side="left"))  # words with over k bytes come first
        now[:n] = step(now[:n], data[at[:n] + k])
    for i in range(int(np.searchsorted(falling, -TOGETHER, side="left"))):
        rest = data[at[i] + TOGETHER : at[i] + left[i]].tobytes()
        now[i] = zlib.crc32(rest, int(now[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(now)
    out[order] = now
    return out


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, null ones being empty, and where each begins, the end last."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    edge = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[edge[0] : edge[-1]], edge - edge[0]


def spans(data: np.ndarray, edge: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and text number of each run of bytes for which `inside`, a table of 256, holds; no run goes on into another text."""
    own = inside[data]
    begin, end = own.copy(), own.copy()
    begin[1:] &= ~own[:-1]
    end[:-1] &= ~own[1:]
    first = edge[:-1][edge[:-1] < edge[1:]]  # where texts that are not empty begin
    begin[first] = own[first]
    end[first[1:] - 1] = own[first[1:] - 1]
    at = np.flatnonzero(begin)
    return at, np.flatnonzero(end) + 1 - at, np.searchsorted(edge, at, side="right") - 1
