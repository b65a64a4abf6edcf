"""Vectorised word and n-gram hashing of Arrow string columns (numpy over the raw UTF-8 bytes)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words are runs of ASCII letters, ASCII digits and bytes of non-ASCII characters.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = True
_IS_WORD[0x41:0x5B] = True
_IS_WORD[0x61:0x7B] = True
_IS_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse modulo 2**64."""
    if len(_powers[kind]) < n:
        size = max(n, 1 << 18)
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[kind] = np.concatenate(([np.uint64(1)], np.full(size - 1, base, np.uint64))).cumprod()
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _STEP
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def blocks(column: pa.Array, max_bytes: int = 1 << 18):
    """Slices (first row, array) of about ``max_bytes`` of text; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > max_bytes:
            yield first, column.slice(first, i - first)
            first, total = i, 0
        total += int(n)
    if first < len(column):
        yield first, column.slice(first)


def word_hashes(texts: pa.Array, with_lines: bool = False) -> tuple:
    """Hashes of all words, and the n + 1 places at which the words of each text begin. Null has no words.

    With ``with_lines`` also the line number of each word over all texts (a text begins a line), whether its line
    follows a line without words (or begins a text), and the first line number of each text.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if not len(data):
        none = np.zeros(0, np.int64)
        return (np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)) + ((none, none.astype(bool), np.zeros(len(texts), np.int64)) if with_lines else ())
    inside = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    with np.errstate(over="ignore"):
        total = np.concatenate(([np.uint64(0)], ((_LOWER[data] + np.uint64(1)) * _power("up", len(data))).cumsum(dtype=np.uint64)))
        hashes = (total[ends] - total[starts]) * _power("down", len(data))[starts]
    words_at = np.searchsorted(starts, at)
    if not with_lines:
        return mix(hashes), words_at
    breaks = np.zeros(len(data), np.int64)
    breaks[data == 10] = 1
    begins = np.zeros(len(data) + 1, np.int64)
    np.add.at(begins, at[:-1], 1)
    number = np.concatenate(([0], breaks.cumsum()[:-1])) + begins[:-1].cumsum()
    lines = number[starts]
    gap = np.diff(lines, prepend=-9) > 1
    gap[words_at[:-1][words_at[:-1] < len(starts)]] = True
    first = np.concatenate(([0], breaks.cumsum()))[at[:-1]] + begins.cumsum()[at[:-1]]
    return mix(hashes), words_at, lines, gap, first


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of one text's words; a text of fewer words, but not none, is one gram."""
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - n + 1, np.uint64(n))
        for i in range(n):
            out = out * _STEP + words[i : len(words) - n + 1 + i]
    return mix(out)
