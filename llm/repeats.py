"""Repeated windows across documents: the distributed frame of both repeat operators.

A window is `size` consecutive symbols (bytes, or words) of one document.  Every window
has a content-defined trigger, the k-gram with the least rolling hash inside it, and
consecutive windows with one trigger form a phrase: the text from the first of these
windows to the end of the last.  Equal windows have equal triggers at equal places, so
they lie in phrases with the same trigger hash, and each question about windows is
settled within the group of one trigger.

1. Triggers.  Each batch sends every trigger hash once with its documents (a trigger that
   two documents of the batch share is known as shared at once).  Hash buckets find the
   triggers that several documents have; everything else can hold no repeat.
2. Phrases.  Each batch sends the phrases of shared triggers, equal phrases once with their
   least document (later ones of the batch are repeats at once).  A bucket holds a
   dictionary of distinct phrases and their parse (document, place); the caller's function
   puts the windows of its dictionary in suffix order and marks those that an earlier
   document has.
3. The marked ranges go back to their documents.

Hashes only bring candidates together: phrases count as equal by their symbols, and so do windows.

What travels is packed per (batch, bucket) in binary columns.  Hot passages send one entry a
batch, never one a document.  Texts are shuffled once, by id; that exchange is used twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .common import bucket_count, trimmed, written
from .decontaminate import slices

_NO = np.zeros(0, dtype=np.int64)
#: Longer documents are read in stretches of so many symbols, which overlap by a window less one.
STRETCH = 4 << 20
#: Bytes of text that are parsed at once (one row at least): about ten numbers of eight bytes are held for each.
SLICE = 1 << 20


class Units:
    """Phrases of the documents of one batch slice, and the symbols they are made of."""

    def __init__(self, column: pa.Array, words: bool, size: int, k: int):
        self.raw, self.bytes_off = tb.buffers(column)
        self.size = size
        if words:
            space = np.zeros(256, dtype=bool)
            space[[9, 10, 11, 12, 13, 32]] = True
            from .decontaminate import words_of

            self.starts, self.ends, self.off = words_of(self.raw, self.bytes_off, ~space)
        else:
            self.starts = self.ends = None
            self.off = self.bytes_off
        parts = [self._stretch(int(a), int(b), k) for a, b in self._cuts()]
        self.doc, self.first, self.last, self.h = (np.concatenate(x) for x in zip(*parts)) if parts else (_NO, _NO, _NO, np.zeros(0, np.uint64))

    def _cuts(self) -> Iterator[tuple[int, int]]:
        """Ranges of symbols: whole documents together, a long one in overlapping stretches."""
        at = 0
        lengths = np.diff(self.off)
        for i in np.flatnonzero(lengths > STRETCH).tolist():
            if self.off[i] > at:
                yield at, self.off[i]
            a, b = int(self.off[i]), int(self.off[i + 1])
            for x in range(a, max(a + 1, b - self.size + 1), STRETCH):
                yield x, min(b, x + STRETCH + self.size - 1)
            at = b
        if self.off[-1] > at:
            yield at, self.off[-1]

    def _stretch(self, a: int, b: int, k: int):
        off = np.clip(self.off, a, b) - a
        if self.starts is None:
            prefix = tb.prefix_hash(tb.byte_values(self.raw[a:b]))
        else:
            s, e = self.starts[a:b], self.ends[a:b]
            base = int(s[0])
            p = tb.prefix_hash(tb.byte_values(self.raw[base : int(e[-1])]))
            prefix = tb.prefix_hash(tb.span_hash(p, s - base, e - base))
        doc, _, first, last, h = tb.window_units(prefix, off, self.size, k)
        return doc, first + a, last + a, h

    def text(self, i: int) -> bytes:
        """The phrase's symbols: its bytes, or its words joined by single spaces."""
        a, b = int(self.first[i]), int(self.last[i]) + self.size
        if self.starts is None:
            return self.raw[a:b].tobytes()
        return b" ".join(self.raw[x:y].tobytes() for x, y in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist()))


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(payload: bytes) -> bytes:
    return pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), codec="zstd", asbytes=True)


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers; they compress well, and a running sum brings them back."""
    return np.diff(x, prepend=np.int64(0))


def _grouped(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else _NO
    return order, [(int(b[x]), int(x), int(y)) for x, y in zip(cut, np.append(cut[1:], len(b)))]


def _first_of(texts: list[bytes], *less: np.ndarray) -> np.ndarray:
    """Per entry the index of the entry with the same text that is least by `less`; texts themselves are compared."""
    order, seen, out = np.lexsort(tuple(reversed(less))), {}, np.empty(len(texts), dtype=np.int64)
    for i in order.tolist():
        out[i] = seen.setdefault(texts[i], i)
    return out


def removed_ranges(docs: DataFrame, size: int, k: int, words: bool, solve: Callable, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, text and ranges binary per row of docs: pairs (first, last start) of int64, in symbols, of windows that a
    row with a smaller id has.

    `solve(texts, counts, docs)` marks windows of a dictionary of phrases as (phrase, place) arrays; counts has the
    number of windows of each phrase, docs the document of its first occurrence.  Ids that stand for different
    texts are told apart by a tag, the hash of the text; it is 0 for all others."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = bucket_count(docs)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    twice = src.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64(F.coalesce("text", F.lit("")))).alias("a"), F.max(F.xxhash64(F.coalesce("text", F.lit("")))).alias("b")).where("n > 1 AND a <> b").select(F.col("id").alias("twice"))
    twice = written(twice, "repeat-ambiguous")
    if twice.isEmpty():
        src = src.withColumn("tag", F.lit(0).cast("long"))
    else:
        src = src.join(twice, src.id == twice.twice, "left").select("id", "text", F.when(F.col("twice").isNotNull(), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(0).alias("tag"))

    @trimmed
    def triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in slices(batch, "text", SLICE):
                u = Units(part.column(1), words, size, k)
                found.append((u.h, part.column(0).to_numpy()[u.doc], part.column(2).to_numpy()[u.doc]))
            if not found:
                continue
            h, doc, tag = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((tag, doc, h))
            h, doc, tag = h[order], doc[order], tag[order]
            once = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])] if len(h) else np.zeros(0, bool)
            h, doc, tag = h[once], doc[once], tag[once]  # one entry a text
            new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
            run = np.cumsum(new) - 1
            many = np.bincount(run, minlength=1)[run] > 1 if len(h) else np.zeros(0, bool)
            # Shared within the batch: all documents know; one entry tells the bucket.
            key = _short(h, buckets)
            yield _trigger_rows(key[many & ~new], doc[many & ~new], tag[many & ~new], None, buckets)
            yield _trigger_rows(key[new], doc[new], tag[new], many[new].astype(np.uint8), buckets)

    def shared(table: pa.Table) -> pa.Table:
        keys, ids, tags, flags, out = [], [], [], [], []
        for bucket, payload, count in zip(table["bucket"].to_pylist(), table["payload"].to_pylist(), table["n"].to_pylist()):
            raw, n = _unpack(payload), abs(count)
            doc, tag = np.cumsum(np.frombuffer(raw, np.int64, n)), np.frombuffer(raw, np.int64, n, 8 * n)
            if count < 0:
                out.append((np.frombuffer(raw, np.uint64, n, 16 * n), doc, tag))
            else:
                keys.append(np.frombuffer(raw, np.uint32, n, 16 * n).astype(np.uint64) | np.uint64(bucket << 32))
                flags.append(np.frombuffer(raw, np.uint8, n, 20 * n))
                ids.append(doc)
                tags.append(tag)
        if keys:
            key, doc, tag, flag = (np.concatenate(x) for x in (keys, ids, tags, flags))
            _, at, count = np.unique(key, return_inverse=True, return_counts=True)
            ok = (count[at] > 1) | (flag == 1)
            out.append((key[ok], doc[ok], tag[ok]))
        key, doc, tag = (np.concatenate(x) for x in zip(*out))
        order, groups = _of_texts(doc, tag)
        return pa.table({**_addresses(groups), "hashes": pa.array([key[order[a:b]].tobytes() for _, _, a, b in groups], pa.binary())})

    @trimmed
    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, weight = [], 0
            for part in slices(batch, "text", SLICE):
                u = Units(part.column(1), words, size, k)
                key, keep, tags = _short(u.h, buckets), [], part.column(2).to_numpy()
                edges = np.searchsorted(u.doc, np.arange(part.num_rows + 1))
                for d, mine in enumerate(part.column(3).to_pylist()):
                    mine = [x["hashes"] for x in mine or () if x["tag"] == tags[d]]
                    if mine:
                        span = np.arange(edges[d], edges[d + 1])
                        keep.append(span[np.isin(key[span], np.frombuffer(b"".join(mine), np.uint64))])
                if not keep:
                    continue
                keep = np.concatenate(keep)
                doc = u.doc[keep]
                held.append((u.h[keep], part.column(0).fill_null(0).to_numpy(zero_copy_only=False)[doc], tags[doc], u.first[keep] - u.off[doc], u.last[keep] - u.first[keep] + 1, [u.text(i) for i in keep.tolist()]))
                weight += len(keep)
                if weight > 300_000:
                    yield from _phrase_rows(held, buckets)
                    held, weight = [], 0
            if weight:
                yield from _phrase_rows(held, buckets)

    def solved(table: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in range(5)]
        texts, out = [], []
        for payload, count in zip(table["payload"].to_pylist(), table["n"].to_pylist()):
            raw, n = _unpack(payload), abs(count)
            doc = np.cumsum(np.frombuffer(raw, np.int64, n))
            tag, first, many = (np.frombuffer(raw, np.int64, n, 8 * n * i) for i in (1, 2, 3))
            if count < 0:  # ranges that a batch has found
                out.append(np.stack([doc, tag, first, first + many - 1]))
                continue
            ends = np.cumsum(np.frombuffer(raw, np.int64, n, 40 * n)) + 48 * n
            for c, x in zip(cols, (np.frombuffer(raw, np.uint64, n, 32 * n), doc, tag, first, many)):
                c.append(x)
            texts += [raw[a:b] for a, b in zip([48 * n, *ends[:-1].tolist()], ends.tolist())]
        if texts:
            h, doc, tag, first, count = (np.concatenate(c) for c in cols)
            lead = _first_of(texts, doc, tag, first)
            later = np.flatnonzero(doc > doc[lead])
            out.append(np.stack([doc[later], tag[later], first[later], first[later] + count[later] - 1]))
            # The dictionary: distinct phrases of triggers that have several.
            uniq = np.flatnonzero(lead == np.arange(len(lead)))
            _, at, many = np.unique(h[uniq], return_inverse=True, return_counts=True)
            uniq = uniq[many[at] > 1]
            if len(uniq):
                phrase, place = solve([texts[i] for i in uniq.tolist()], count[uniq], doc[uniq])
                hit = uniq[phrase]
                # What holds for a phrase holds for its repeats under the same id.
                twin = np.flatnonzero((doc == doc[lead]) & (lead != np.arange(len(lead))))
                order = np.argsort(hit, kind="stable")
                lo, hi = np.searchsorted(hit[order], lead[twin]), np.searchsorted(hit[order], lead[twin], side="right")
                of = np.repeat(twin, hi - lo)
                at = np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
                entry, place = np.r_[hit, of], np.r_[place, place[order][at]]
                out.append(np.stack([doc[entry], tag[entry], first[entry] + place, first[entry] + place]))
        found = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
        order, groups = _of_texts(found[0], found[1])
        return pa.table({**_addresses(groups), "ranges": pa.array([_joined(found[2, order[a:b]], found[3, order[a:b]]) for _, _, a, b in groups], pa.binary())})

    packed = "bucket long, n long, payload binary"
    by_id = src.repartition(n, "id")
    have = src.where("id IS NOT NULL").mapInArrow(triggers, packed).groupBy("bucket").applyInArrow(shared, "id long, tag long, hashes binary").repartition(n, "id").groupBy("id").agg(F.collect_list(F.struct("tag", "hashes")).alias("hashes"))
    # A left join here too: an inner one would add a filter below the exchange, and Spark could not use it twice.
    sent = by_id.join(have, "id", "left").select("id", "text", "tag", "hashes").mapInArrow(phrases, packed)
    back = sent.groupBy("bucket").applyInArrow(solved, "id long, tag long, ranges binary").repartition(n, "id").groupBy("id").agg(F.collect_list(F.struct("tag", "ranges")).alias("ranges"))
    mine = F.transform(F.filter("ranges", lambda x: x["tag"] == F.col("tag")), lambda x: x["ranges"])
    return by_id.join(back, "id", "left").select("id", "text", mine.alias("ranges"))


def _of_texts(doc: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Order by text, and per text its id, tag and range in that order."""
    order = np.lexsort((tag, doc))
    d, t = doc[order], tag[order]
    cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])]) if len(d) else _NO
    return order, [(int(d[x]), int(t[x]), int(x), int(y)) for x, y in zip(cut, np.append(cut[1:], len(d)))]


def _addresses(groups: list[tuple]) -> dict[str, pa.Array]:
    return {"id": pa.array([g[0] for g in groups], pa.int64()), "tag": pa.array([g[1] for g in groups], pa.int64())}


def _short(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 more bits of a trigger hash; a chance match only adds a candidate."""
    return (h % np.uint64(buckets)) << np.uint64(32) | h >> np.uint64(32)


def _rows(bucket: np.ndarray, doc: np.ndarray, pack: Callable, sign: int) -> pa.RecordBatch:
    order = np.argsort(doc, kind="stable")
    at, groups = _grouped(bucket[order])
    at = order[at]
    return pa.RecordBatch.from_arrays(
        [pa.array([g[0] for g in groups], pa.int64()), pa.array([sign * (b - a) for _, a, b in groups], pa.int64()), pa.array([pack(at[a:b]) for _, a, b in groups], pa.binary())], names=["bucket", "n", "payload"]
    )


def _trigger_rows(key: np.ndarray, doc: np.ndarray, tag: np.ndarray, flag: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """Entries for the bucket of the trigger; without flags known ones, which are dealt by document."""
    if flag is None:
        return _rows(doc % buckets, doc, lambda i: _pack(_steps(doc[i]), tag[i], key[i]), -1)
    low = key.astype(np.uint32)
    return _rows((key >> np.uint64(32)).astype(np.int64), doc, lambda i: _pack(_steps(doc[i]), tag[i], low[i], flag[i]), 1)


def _phrase_rows(held: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    h, doc, tag, first, count = (np.concatenate([x[c] for x in held]) for c in range(5))
    texts = [t for x in held for t in x[5]]
    lead = _first_of(texts, doc, tag, first)
    later = np.flatnonzero(doc > doc[lead])  # a smaller document of these has the same phrase
    if len(later):
        d, t, f, c = doc[later], tag[later], first[later], count[later]
        yield _rows(d % buckets, d, lambda i: _pack(_steps(d[i]), t[i], f[i], c[i]), -1)
    mine = np.flatnonzero(doc == doc[lead])  # the first document's own repeats go along
    h, doc, tag, first, count = (x[mine] for x in (h, doc, tag, first, count))

    def pack(i: np.ndarray) -> bytes:
        body = [texts[x] for x in mine[i].tolist()]
        return _pack(_steps(doc[i]), tag[i], first[i], count[i], h[i], np.array([len(x) for x in body], dtype=np.int64), np.frombuffer(b"".join(body), np.uint8))

    yield _rows((h % np.uint64(buckets)).astype(np.int64), doc, pack, 1)


def _joined(a: np.ndarray, b: np.ndarray) -> bytes:
    """Ranges of starts, touching ones made one, as pairs."""
    a, b = merge(a, b)
    return np.stack([a, b], axis=1).tobytes()


def merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return _NO, _NO
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.r_[True, a[1:] > b[:-1] + 1]
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]


def unpack(ranges: list[bytes] | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Covered symbols [start, stop), maximal, of a document's ranges of window starts."""
    if not ranges:
        return _NO, _NO
    pairs = np.frombuffer(b"".join(ranges), np.int64).reshape(-1, 2)
    a, b = merge(pairs[:, 0], pairs[:, 1] + size - 1)
    return a, b + 1
