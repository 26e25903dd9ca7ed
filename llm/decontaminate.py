"""Benchmark decontamination by broadcast sets of normalised n-gram hashes.

Words are runs of characters other than ASCII controls, punctuation and space, with A-Z
lower-cased.  Every window of 13 item words (an item with fewer words, but not none, is one
window) is hashed; training texts are scanned window by window, hash hits are verified word
by word, and the words inside verified windows are hit.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .common import trimmed, written

WINDOW = 13
#: Bytes of one broadcast set; a larger benchmark takes several, each with a pass of its own over the texts.
MAX_BROADCAST = 64 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True


def words_of(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Starts and ends (bytes) of the words, and the index of each document's first word."""
    n = len(raw)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = is_word[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Windows:
    """Windows of some items: by length, sorted hashes with their item and its bytes in one text of all items, each item once."""

    def __init__(self, items: list[tuple]):
        column = pa.array([t or "" for _, t in items], pa.large_string())
        raw, off = tb.buffers(column)
        raw = _LOWER[raw]
        s, e, first = words_of(raw, off, _WORD)
        self.items = [i for i, _ in items]
        # The words with single spaces between them, so that a window is one range of bytes.
        lens = e - s
        begin = np.cumsum(lens + 1) - lens - 1
        text = np.full(int((lens + 1).sum()), 32, dtype=np.uint8)
        text[np.repeat(begin - s, lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens - s, lens)] = raw[np.repeat(s - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())]
        self.text = text.tobytes()
        prefix = tb.prefix_hash(tb.span_hash(tb.prefix_hash(tb.byte_values(raw)), s, e)) if len(s) else np.zeros(1, np.uint64)
        count = np.diff(first)
        self.by_size = {}
        for size in np.unique(np.minimum(count[count > 0], WINDOW)).tolist():
            own = np.flatnonzero(count == size if size < WINDOW else count >= size)
            item = np.repeat(own, count[own] - size + 1)
            at = np.arange(len(item)) - np.repeat(np.cumsum(count[own] - size + 1) - (count[own] - size + 1), count[own] - size + 1) + first[item]
            h = tb.gram_hash(prefix, size)[at]
            order = np.argsort(h, kind="stable")
            at, item = at[order], item[order]
            self.by_size[size] = (h[order], item.astype(np.int32), begin[at], begin[at + size - 1] + lens[at + size - 1])

    def size_in_bytes(self) -> int:
        return len(self.text) + sum(x.nbytes for v in self.by_size.values() for x in v)


_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes of one window in a set: its hash, item, and place in the text.
WINDOW_BYTES = 28


def _chunks(bench: DataFrame, most: int):
    """Items in sets that stay below `most` bytes (a single larger item is one set), read one after the other: a window a word, and the words."""
    held, weight = [], 0
    for r in bench.toLocalIterator():
        b = (r.t or "").encode()
        n = len(b) + WINDOW_BYTES * sum(1 for _ in _WORDS.finditer(b)) + 64
        if held and weight + n > most:
            yield Windows(held)
            held, weight = [], 0
        held.append((r.i, r.t))
        weight += n
    yield Windows(held)


_FOUND = "n_words long, n_hit long, item_ids array<string>, hit_spans array<struct<start:long,end:long>>"


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = (), most: int = MAX_BROADCAST) -> DataFrame:
    """Columns id, `keep`, n_words, n_hit (long), item_ids array<string> (sorted), hit_spans array<struct<start,end>>.

    hit_spans are the byte ranges of maximal runs of hit words.  Null texts have no words; null
    item ids mark words but are not listed; repeated items count once; an empty benchmark hits
    nothing; kept columns may have any name.  Items are sent in sets of at most `most` bytes: one
    as a rule, found in one pass; of several each has a pass that writes the hits of numbered rows."""
    bench = items.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t")).distinct()
    names = list(dict.fromkeys((id_col, *keep)))
    kinds = docs.select(*(f"`{c}`" for c in names)).schema
    src = docs.select(F.col(f"`{text_col}`").alias("t"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)))
    fields = ", ".join(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(kinds))
    sc = docs.sparkSession.sparkContext
    chunks = _chunks(bench, most)
    first, second = next(chunks), next(chunks, None)
    if second is None:
        sent = sc.broadcast(first)

        @trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "t"):
                    hits = _hits(part.column(0), sent.value)
                    yield pa.RecordBatch.from_arrays([*part.columns[1:], *_marked(part.column(0), hits)], names=[*part.schema.names[1:], "n_words", "n_hit", "item_ids", "hit_spans"])

        return src.mapInArrow(run, f"{fields}, {_FOUND}").toDF(*names, "n_words", "n_hit", "item_ids", "hit_spans")
    src = written(src.withColumn("row", F.monotonically_increasing_id()), "bench-rows")
    passes = []
    for c in itertools.chain((first, second), chunks):
        sent = sc.broadcast(c)
        passes.append(written(_pass(src, sent), "bench-hits"))
        sent.destroy()  # driver and executors hold one set at a time
    hits = reduce(DataFrame.unionByName, passes).groupBy("row").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("size")).alias("size"), F.flatten(F.collect_list("items")).alias("items"))
    both = src.join(hits, "row", "left").select("t", *(f"_{i}" for i in range(len(names))), "at", "size", "items")

    @trimmed
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                at, size, of = (part.column(part.num_columns - i).to_pylist() for i in (3, 2, 1))
                hits = [(list(zip(a or (), n or ())), set(x or ())) for a, n, x in zip(at, size, of)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:-3], *_marked(part.column(0), hits)], names=[*part.schema.names[1:-3], "n_words", "n_hit", "item_ids", "hit_spans"])

    return both.mapInArrow(finish, f"{fields}, {_FOUND}").toDF(*names, "n_words", "n_hit", "item_ids", "hit_spans")


def _pass(src: DataFrame, sent) -> DataFrame:
    """row, at, size and items of the rows that hold windows of one set."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                hits = _hits(part.column(0), sent.value)
                rows = [i for i, (at, _) in enumerate(hits) if at]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(1).take(pa.array(rows, pa.int64())),
                        pa.array([[a for a, _ in hits[i][0]] for i in rows], pa.list_(pa.int64())),
                        pa.array([[n for _, n in hits[i][0]] for i in rows], pa.list_(pa.int64())),
                        pa.array([sorted(hits[i][1]) for i in rows], pa.list_(pa.string())),
                    ],
                    names=["row", "at", "size", "items"],
                )

    return src.select("t", "row").mapInArrow(run, "row long, at array<long>, size array<long>, items array<string>")


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of up to `most` bytes of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _words(column: pa.Array):
    raw, off = tb.buffers(column)
    raw = _LOWER[raw]
    return raw, off, *words_of(raw, off, _WORD)


def _hits(column: pa.Array, windows: Windows) -> list[tuple[list, set]]:
    """Per text the (first word, number of words) of each verified window, and the ids of their items."""
    raw, _, s, e, first = _words(column)
    doc = np.repeat(np.arange(len(column)), np.diff(first))
    out: list[tuple[list, set]] = [([], set()) for _ in range(len(column))]
    prefix = tb.prefix_hash(tb.span_hash(tb.prefix_hash(tb.byte_values(raw)), s, e)) if len(s) else np.zeros(1, np.uint64)
    for size, (keys, item, begin, end) in windows.by_size.items():
        h = tb.gram_hash(prefix, size)
        low = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        for w in np.flatnonzero((keys[low] == h) & (doc[: len(h)] == doc[size - 1 : size - 1 + len(h)])).tolist():
            words = b" ".join(raw[a:b].tobytes() for a, b in zip(s[w : w + size], e[w : w + size]))
            at, d = int(low[w]), doc[w]
            while at < len(keys) and keys[at] == h[w]:
                if windows.text[begin[at] : end[at]] == words:
                    out[d][0].append((w - int(first[d]), size))
                    if windows.items[item[at]] is not None:
                        out[d][1].add(windows.items[item[at]])
                at += 1
    return out


def _marked(column: pa.Array, hits: list[tuple[list, set]]) -> list[pa.Array]:
    """n_words, n_hit, item_ids and hit_spans of texts from their hits."""
    _, off, s, e, first = _words(column)
    counts = np.diff(first)
    n_hit, spans = np.zeros(len(column), dtype=np.int64), [[] for _ in range(len(column))]
    for d, (at, _) in enumerate(hits):
        if at:
            step = np.zeros(counts[d] + 1, dtype=np.int32)
            a, n = np.array(at, dtype=np.int64).T
            np.add.at(step, a, 1)
            np.add.at(step, a + n, -1)
            on = np.cumsum(step[:-1]) > 0
            n_hit[d] = on.sum()
            edge = np.diff(np.r_[False, on, False].astype(np.int8))
            for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                spans[d].append({"start": int(s[first[d] + x] - off[d]), "end": int(e[first[d] + y - 1] - off[d])})
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return [pa.array(counts, pa.int64()), pa.array(n_hit), pa.array([sorted(x) for _, x in hits], pa.list_(pa.string())), pa.array(spans, kind)]


def contaminated_sql(n_hit: str = "n_hit", n_words: str = "n_words") -> str:
    return f"({n_hit} > 0 AND 20 * {n_hit} >= {n_words})"


def _scanned(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """scan of docs, whose columns all go along by their place."""
    names = docs.columns
    place = {c: f"__d_{i}" for i, c in enumerate(names)}
    return scan(docs.withColumnsRenamed(place), items, place[id_col], place[text_col], keep=tuple(place.values()), most=most).select(*place.values(), "n_words", "n_hit", "hit_spans")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_BROADCAST) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns as they were."""
    out = _scanned(docs, items, id_col, text_col, most)
    return out.where(f"NOT {contaminated_sql()}").select(*(F.col(f"__d_{i}").alias(c) for i, c in enumerate(docs.columns)))


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_BROADCAST) -> DataFrame:
    """docs, all columns and rows, with the byte ranges of hit words cut out of the text; null texts stay null."""
    found = _scanned(docs, items, id_col, text_col, most).drop("n_words", "n_hit")
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                b, last, keep = (t or "").encode(), 0, []
                for x in spans:
                    keep.append(b[last : x["start"]])
                    last = x["end"]
                out.append(None if t is None else (b"".join(keep) + b[last:]).decode())
            cols = batch.columns[:-1]
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != "hit_spans")
    return found.mapInArrow(cut, fields).toDF(*docs.columns)
