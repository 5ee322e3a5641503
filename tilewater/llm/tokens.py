"""Word hashes of many texts at once, for use inside tasks.

A word's hash is a polynomial over its bytes modulo 2**64, mixed at the end; sums over any range come from one running sum, so a
chunk of text costs a few NumPy passes whatever its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: texts are handled in chunks of about so many bytes; one longer text is a chunk of its own
CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def gaps(codes: list[int]) -> np.ndarray:
    """Table of the bytes that stand between words."""
    out = np.zeros(256, bool)
    out[codes] = True
    return out


#: fixed values: blanks, and everything in ASCII but letters and digits
BLANKS = gaps([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = gaps([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = 1 << int(n).bit_length()
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers.update(up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def _letters(fold: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with `fold`, A-Z have those of a-z."""
    t = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if fold:
        t[0x41:0x5B] = t[0x61:0x7B]
    return t


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range [start, end) of a sequence of 64-bit values; equal ranges of values have equal hashes."""
    up, down = _power(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(texts: list[bytes], gap: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, the number of words before each text (and in all), the bytes, starts, ends."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = ~gap[data]
    edge = np.flatnonzero(np.diff(inside)) if len(data) else np.zeros(0, np.int64)
    starts, ends = edge[0::2], edge[1::2]
    hashes = range_hashes(_letters(fold)[data], starts, ends)
    begins = np.zeros(len(texts) + 1, np.int64)
    begins[1:] = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, begins), data, starts, ends


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts (null: empty) as UTF-8 of about `limit` bytes in all, with the place of the first."""
    run, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if run and size + len(b) > limit:
            yield first, run
            run, size, first = [], 0, i
        run.append(b)
        size += len(b)
    if run:
        yield first, run


def portions(batch: pa.RecordBatch, texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """`batch` and its `texts` in slices of about `limit` bytes of text, so that what a task makes of them does not grow with Spark's batches."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.cumsum(size), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, end - at), texts.slice(at, end - at)
        at = end


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of n words; of the whole sequence if it is shorter, nothing if there is none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(_BASE) + words[i : len(words) - n + 1 + i])
    return np.unique(h)
