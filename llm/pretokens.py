"""Splitting texts into pieces that byte-level BPE encodes independently, with caches bounded in bytes.

A piece is a run of pre-tokens.  A single space before a non-space, or any space right
after a non-space, starts a new pre-token under the public pattern, so texts can be cut
there; everything between two cuts is one piece, and equal pieces have equal ids.  Pieces
that the cache does not hold are split into their pre-tokens, which recur far more often.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: A space with white space (or an end) on both sides: cutting there is not safe.
_UNSAFE = re.compile(r"(?<!\S) (?!\S)")
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE_RE2 = rf"\A |{_BLANK} | {_BLANK}| \z"
#: Bytes of a cache's younger half; the older half holds as much.
CACHE_BYTES = 16 << 20
#: Longer strings are not kept, and what one entry weighs besides its characters and ids.
LONGEST, ENTRY_BYTES = 256, 160


def pieces(text: str) -> list[str]:
    """Pieces without their leading space; only the first one never had one.

    ' '.join(pieces(text)) is the text."""
    parts = text.split(" ")
    if _UNSAFE.search(text) is None:
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        last = out[-1]
        if (p and not p[0].isspace()) or (last and not last[-1].isspace()):
            out.append(p)
        else:
            out[-1] = f"{last} {p}"
    return out


def packed(ids: list[int]) -> bytes:
    """ids as unsigned 32-bit integers of this machine (little-endian), a fifth of the memory of a list."""
    return array("I", ids).tobytes()


class Cache:
    """Packed ids by string, made in batches; the less used half is forgotten when the younger one is full."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], most_bytes: int = CACHE_BYTES):
        self.make, self.most = make, most_bytes
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held, self.long = 0, []

    def get(self, need: set[str]) -> dict[str, bytes]:
        """A table that holds what is needed (and more), good until the next call."""
        for k in self.long:
            self.young.pop(k, None)
        self.long = []
        if self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        lack = need.difference(young)
        if lack:
            again = {k: old[k] for k in lack if k in old}
            new = [k for k in lack if k not in again]
            made = self.make(new)
            young.update(zip(new, made))
            young.update(again)
            self.held += sum(map(len, lack)) + sum(map(len, made)) + (ENTRY_BYTES + 8) * len(lack)
            self.long = [k for k in new if len(k) > LONGEST]
            self.held -= sum(len(k) + len(young[k]) for k in self.long)
        return young


class PieceEncoder:
    """Packed ids of whole texts by way of their pieces, and of the pieces by way of their pre-tokens.

    `split` gives the pre-tokens of a string and `encode` the ids of each of a list of them.  Where
    `whole` is given, only strings that `plain` matches are split; the others are encoded whole.  `runs`, where
    an encoder has it, gives the ids of pre-tokens joined from each that begins with a space to the next."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], list[bytes]] | None = None, plain: re.Pattern | None = None, most_bytes: int = CACHE_BYTES, runs: Callable[[list[str]], list[bytes]] | None = None):
        self.split, self.whole, self.runs = split, whole, runs
        self.plain = plain.fullmatch if plain else None
        self.tokens, self.pieces = Cache(encode, most_bytes), Cache(self._pieces, most_bytes)

    def _strings(self, texts: list[str]) -> list[bytes]:
        """Ids of strings, each on its own."""
        cut = [self.split(t) if self.plain is None or self.plain(t) else None for t in texts]
        table = self.tokens.get(set().union(*(c for c in cut if c is not None)))
        out = [None if c is None else b"".join([table[t] for t in c]) for c in cut]
        odd = [i for i, c in enumerate(cut) if c is None]
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]) if odd else ()):
            out[i] = ids
        return out

    def _pieces(self, new: list[str]) -> list[bytes]:
        """Ids of pieces with a space before each.  Those of printable characters without
        white space are split in one go: a pre-token that begins with a space begins a piece."""
        plain = self.plain
        solid = [i for i, p in enumerate(new) if p and p.isprintable() and " " not in p and (plain is None or p.isascii() or plain(p))]
        out: list = [None] * len(new)
        if solid:
            cut = self.split(" " + " ".join([new[i] for i in solid]))
            if self.runs:
                made = self.runs(cut)
                if len(solid) == len(new):
                    return made
                for i, ids in zip(solid, made, strict=True):
                    out[i] = ids
        if solid and not self.runs:
            table = self.tokens.get(set(cut))
            ids, begin = [table[t] for t in cut], [i for i, t in enumerate(cut) if t[0] == " "]
            for i, a, b in zip(solid, begin, [*begin[1:], len(cut)]):
                out[i] = ids[a] if b - a == 1 else b"".join(ids[a:b])
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._strings([f" {new[i]}" for i in rest]) if rest else ()):
            out[i] = ids
        return out

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32-bit) of the whole texts of a column, one after the other, and their offsets; null is empty.

        Each distinct piece of the column is looked up once; numpy puts the ids in place."""
        column = pa.compute.fill_null(column.cast(pa.large_string()), "")
        if pa.compute.any(pa.compute.match_substring_regex(column, _UNSAFE_RE2)).as_py():
            parts = pa.array([pieces(t) for t in column.to_pylist()], pa.large_list(pa.large_string()))
        else:
            parts = pa.compute.split_pattern(column, " ")
        off = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        codes, words = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = off[:-1]
        inner = np.ones(len(codes), dtype=bool)
        inner[first] = False
        used = (np.bincount(codes[inner], minlength=len(words)) > 0).tolist()
        table = self.pieces.get({w for w, u in zip(words, used) if u})
        blobs = [table[w] if u else b"" for w, u in zip(words, used)]
        heads, codes[first] = np.unique(codes[first], return_inverse=True)
        codes[first] += len(words)
        blobs += self._strings([words[i] for i in heads.tolist()])
        size = np.fromiter(map(len, blobs), np.int32, len(blobs)) // 4
        ids, at = np.frombuffer(b"".join(blobs), np.uint32), np.cumsum(size, dtype=np.int32) - size
        n = size[codes]
        ends = np.cumsum(n, dtype=np.int32)
        place = np.repeat(at[codes] - (ends - n), n)
        place += np.arange(len(place), dtype=np.int32)
        return ids[place], np.r_[0, ends].astype(np.int64)[off]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each whole text, in order; for short lists of short texts."""
        split = [pieces(t) for t in texts]
        table = self.pieces.get(set().union(*(p[1:] for p in split)))
        first = list({p[0] for p in split if p[0]})
        heads = dict(zip(first, self._strings(first))) | {"": b""}
        return [heads[p[0]] + b"".join([table[x] for x in p[1:]]) for p in split]


def text_slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Row ranges of a batch of up to `most` bytes of text (one row at least), with their text column."""
    at = batch.schema.get_field_index(text)
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0), dtype=np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        part = batch.slice(start, stop - start)
        yield part, part.column(at)
        start = stop


def binary_column(ids: np.ndarray, off: np.ndarray) -> pa.Array:
    """Rows of packed ids as a binary column, without a copy of each."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64) * 4), pa.py_buffer(ids)]).cast(pa.binary())
