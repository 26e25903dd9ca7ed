"""Vectorised helpers over one Arrow batch of texts (numpy inside a task).

A batch of documents is laid out as one byte buffer with document offsets, so
rolling hashes, word boundaries and window minima are a handful of array passes
whatever the mix of short and very long documents.  Nothing here keeps state
between batches; the memory need is a small multiple of the batch's bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (the public splitmix64 finaliser)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULT)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    key = str(int(base))
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        _POWERS[key] = have = p
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * MULT**i modulo 2**64; one entry more than values."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.multiply(values, _powers(_MULT, len(values)), out=out[1:])
    np.add.accumulate(out, out=out)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hash of values[start:end] for arrays of spans."""
    inv = _powers(_INV, len(prefix))
    return mix64((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * _INV)


def gram_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive values."""
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return mix64((prefix[k:] - prefix[:-k]) * _powers(_INV, n) + np.uint64(k * int(_INV) % (1 << 64)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string/binary column and its document offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[raw]


def window_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least hash in every window of `width` hashes.

    Uses the upper 32 bits of the hash; the position fills the lower ones, so a
    batch must stay below 2**32 values (an Arrow batch does by far)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    pad = -len(packed) % width
    blocks = np.concatenate([packed, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def window_units(prefix: np.ndarray, offsets: np.ndarray, window: int, k: int):
    """Units: runs of consecutive window starts that share their content-defined trigger.

    A window is `window` consecutive values of one document.  Its trigger is the
    k-gram inside it with the least rolling hash (leftmost on ties), so equal
    windows have equal triggers at equal places.  Returns arrays (doc index,
    trigger position, first start, last start, trigger hash)."""
    h = gram_hash(prefix, k)
    at = window_argmin(h, window - k + 1)
    lengths = np.diff(offsets)
    n_starts = np.maximum(lengths - window + 1, 0)
    total = int(n_starts.sum())
    if not total:
        e = np.zeros(0, dtype=np.int64)
        return e, e, e, e, np.zeros(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(lengths)), n_starts)
    first = np.cumsum(n_starts) - n_starts
    starts = np.arange(total) - np.repeat(first, n_starts) + np.repeat(offsets[:-1], n_starts)
    trigger = at[starts]
    new = np.ones(total, dtype=bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], total) - 1
    return doc[lo], trigger[lo], starts[lo], starts[hi], h[trigger[lo]]
