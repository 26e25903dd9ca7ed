"""Repeated byte strings by prefix-free parsing and suffix arrays.

Rolling-hash triggers cut every text into phrases (see repeats): the cuts depend on content
alone, so repeated passages parse into the same phrases wherever they stand.  The dictionary
holds each distinct phrase once; a phrase reaches over its right edge by one string length, so
it contains the prefix of the phrases that follow it in the parse.  Suffix arrays of the
dictionary (to the depth of a string, the document of the parse breaking ties) then are the
corpus order of all suffixes of that trigger: equal strings are neighbours, and the first of
each run is the earliest document's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import slices
from .repeats import SLICE, removed_ranges, unpack

LENGTH, TRIGGER = 50, 24


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at `starts` by their first `depth` bytes, then ties; and where a suffix differs from the one before."""
    eight = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(8, np.uint8)], 8)
    at = [*range(0, depth - 7, 8)]
    if at[-1] + 8 < depth:
        at.append(depth - 8)
    keys = [np.ascontiguousarray(eight[starts + d]).view(">u8").ravel().astype(np.uint64) for d in at]
    order = np.lexsort((ties, *reversed(keys)))
    new = np.ones(len(order), dtype=bool)
    if len(order) > 1:
        new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    return order, new


def mark_windows(texts: list[bytes], counts: np.ndarray, docs: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the dictionary (phrase, place) whose string an earlier document has."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum([0, *(len(t) for t in texts)])[:-1]
    phrase = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(phrase)) - np.repeat(np.cumsum(counts) - counts, counts)
    order, new = suffix_order(data, begin[phrase] + place, size, docs[phrase])
    doc = docs[phrase][order]
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    hit = order[doc > least]
    return phrase[hit], place[hit]


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """id, text, n_bytes long, spans array<struct<start,stop>> (bytes to remove, maximal), kept binary, one row per row of docs.

    A byte goes if a string of `length` bytes that covers it also starts in a row with a smaller
    id.  Strings never cross documents and are judged on the input.  Null and empty texts have no
    bytes; rows with a null id stay whole; rows of one id are judged one by one against smaller
    ids, never against each other.  Ids are integers.  Bytes themselves are compared."""
    found = removed_ranges(docs, length, trigger, False, lambda t, c, d: mark_windows(t, c, d, length), id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sizes, spans, kept = [], [], []
                for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = (text or "").encode()
                    a, b = unpack(ranges, length)
                    keep, last = [], 0
                    for x, y in zip(a.tolist(), b.tolist()):
                        keep.append(data[last:x])
                        last = y
                    keep.append(data[last:])
                    sizes.append(len(data))
                    spans.append([{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist())])
                    kept.append(b"".join(keep))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "text", "n_bytes", "spans", "kept"])

    out = found.mapInArrow(cut, "id long, text string, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    return out.withColumnsRenamed({"id": id_col, "text": text_col} if text_col not in ("n_bytes", "spans", "kept") else {"id": id_col})


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with repeated bytes cut out of the text; where a cut splits a character, its remaining bytes go too.

    length_col, if docs has it, is set to the new number of characters of changed texts.  Null
    texts stay null.  Other columns come back by a join on the id with the changed rows only."""
    changed = (
        repeated_bytes(docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")), "i", "t")
        .where("size(spans) > 0")
        .select(F.col("i").alias("__i"), F.xxhash64("t").alias("__x"), F.col("kept").alias("__k"))
        .dropDuplicates(["__i", "__x"])
    )
    joined = docs.join(changed, (docs[f"`{id_col}`"] == changed["__i"]) & (F.xxhash64(docs[f"`{text_col}`"]) == changed["__x"]), "left")
    new = F.when(F.col("__k").isNull(), F.col(f"`{text_col}`")).otherwise(_utf8(F.col("__k")))
    out = joined.withColumn("__new", new)
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("__new").alias(c))
        elif c == length_col:
            cols.append(F.when(F.col("__k").isNull(), docs[f"`{c}`"]).otherwise(F.length("__new").cast(docs.schema[c].dataType)).alias(c))
        else:
            cols.append(docs[f"`{c}`"])
    return out.select(*cols)


def _utf8(kept):
    """Binary as text; bytes that are no whole character any more go (and so does U+FFFD itself in a changed text)."""
    return F.translate(F.make_valid_utf8(kept.cast("string")), "\ufffd", "")
