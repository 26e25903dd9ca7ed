"""Repeated word sequences by prefix-partitioned suffix trees.

Suffixes (from every word whose window has a shared trigger, see repeats) are first dealt to
buckets by content.  In a bucket, prefixes of variable length split them into groups that fit
memory: a group that is too large is split by one more word.  Each group's subtree is grown
from the root by a word a level; branches with one suffix are leaves and are dropped.  The
internal nodes that reach the window's depth are the repeats, and the suffixes below a node
that belong to later documents than its first are marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .decontaminate import slices
from .repeats import SLICE, removed_ranges, unpack

WINDOW, TRIGGER = 13, 4
#: Suffixes of one subtree.
GROUP = 1 << 20

def prefix_groups(words: np.ndarray, starts: np.ndarray, depth: int, most: int = GROUP) -> Iterator[np.ndarray]:
    """Suffixes with common prefixes of variable length, packed into groups of about `most`."""
    todo, pack, size = [(np.arange(len(starts)), 0)], [], 0
    while todo:
        group, length = todo.pop()
        if len(group) > most and length < depth:
            order = np.argsort(words[starts[group] + length], kind="stable")
            key = words[starts[group] + length][order]
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            # Small neighbours stay together; only single large branches go one word deeper.
            edges, last = [0], 0
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(key)]):
                if b - last > most and a > last:
                    edges.append(a)
                    last = a
            edges.append(len(key))
            for a, b in zip(edges, edges[1:]):
                one = key[a] == key[b - 1]
                todo.append((group[order[a:b]], length + 1 if one else length if b - a < len(group) else depth))
            continue
        pack.append(group)
        size += len(group)
        if size >= most:
            yield np.concatenate(pack)
            pack, size = [], 0
    if pack:
        yield np.concatenate(pack)


def deep_nodes(words: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes below internal nodes at `depth`, and the node of each."""
    live, node = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64)
    for level in range(depth):
        word = words[starts[live] + level]
        order = np.lexsort((word, node))
        n, w = node[order], word[order]
        new = np.r_[True, (n[1:] != n[:-1]) | (w[1:] != w[:-1])] if len(n) else np.zeros(0, bool)
        child = np.cumsum(new) - 1
        branch = np.bincount(child, minlength=1)[child] > 1 if len(n) else np.zeros(0, bool)
        live, node = live[order[branch]], child[branch]
    return live, node


def mark_windows(texts: list[bytes], counts: np.ndarray, docs: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the dictionary (phrase, place) whose words an earlier document has."""
    # Words are numbered, so that equal numbers are equal words.
    parts = pa.compute.split_pattern(pa.array(texts, pa.large_binary()), b" ")
    words, first = parts.values.dictionary_encode().indices.to_numpy(), parts.offsets.to_numpy()[:-1]
    phrase = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(phrase)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts, hits = first[phrase] + place, []
    for group in prefix_groups(words, starts, size):
        live, node = deep_nodes(words, starts[group], size)
        doc = docs[phrase[group[live]]]
        least = np.full(int(node.max()) + 1 if len(node) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, node, doc)
        hits.append(group[live[doc > least[node]]])
    hit = np.concatenate(hits) if hits else np.zeros(0, np.int64)
    return phrase[hit], place[hit]


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, trigger: int = TRIGGER) -> DataFrame:
    """id, n_words long, spans array<struct<start,stop>> (words to remove, maximal), kept string (words joined by a space).

    A word goes if a window of words that covers it also starts in a row with a smaller id.
    Windows never cross documents and are judged on the input.  Null and empty texts have no
    words; rows with a null id stay whole; rows of one id are judged one by one against smaller
    ids, never against each other.  Ids are integers.  Words themselves are compared."""
    found = removed_ranges(docs, window, trigger, True, lambda t, c, d: mark_windows(t, c, d, window), id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sizes, spans, kept = [], [], []
                for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = (text or "").encode().split()
                    a, b = unpack(ranges, window)
                    keep, last = [], 0
                    for x, y in zip(a.tolist(), b.tolist()):
                        keep += words[last:x]
                        last = y
                    keep += words[last:]
                    sizes.append(len(words))
                    spans.append([{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist())])
                    kept.append(b" ".join(keep).decode())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], names=["id", "n_words", "spans", "kept"])

    out = found.mapInArrow(cut, "id long, n_words long, spans array<struct<start:long,stop:long>>, kept string")
    return out.withColumnRenamed("id", id_col)
