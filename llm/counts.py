"""Edit-aware token counts: a segment tree of token counts over the pre-token leaves of a document.

Leaves are runs of about LEAF pieces that encode independently; inner nodes are sums.  An
edit re-encodes only the leaves that it touches, widened by leaves while the new text may
join across a leaf's edge, and updates the sums above them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _encoder, load_ranks, sentencepiece_model
from .decontaminate import slices
from .pretokens import pieces

LEAF = 64
#: Bytes of text that a worker handles at once (one row at least).
SLICE = 1 << 20
_EDITS = "array<struct<start:long,stop:long,text:string>>"
_TREE, _COUNTS = "leaf_chars array<int>, tree array<int>", "n_edits long, n_before long, n_tokens long, n_reencoded long"
_INTS = pa.list_(pa.int32())


def leaves_of(text: str, leaf: int = LEAF) -> list[str]:
    """The text cut into runs of up to `leaf` pieces; each but the first begins with a space."""
    p = pieces(text)
    runs = [" ".join(p[i : i + leaf]) for i in range(0, len(p), leaf)]
    return [runs[0], *(f" {r}" for r in runs[1:])] if text else []


def build(tokens: list[int]) -> list[int]:
    """Heap of sums: node 1 is the root, leaf i is node size + i, size a power of two; node 0 holds the number of leaves."""
    size = 1 << max(0, (len(tokens) - 1).bit_length())
    tree = np.zeros(2 * size, dtype=np.int64)
    tree[size : size + len(tokens)] = tokens
    level = size
    while level > 1:
        level //= 2
        tree[level : 2 * level] = tree[2 * level : 4 * level : 2] + tree[2 * level + 1 : 4 * level : 2]
    tree[0] = len(tokens)
    return tree.tolist()


def total(tree: list[int]) -> int:
    return tree[1] if len(tree) > 1 else 0


def _joins(left: str, right: str) -> bool:
    """Whether a cut between the texts may fall inside a pre-token."""
    if not left or not right:
        return False
    return not (right[0] == " " and ((len(right) > 1 and not right[1].isspace()) or not left[-1].isspace()))


def edit(text: str, chars: list[int], tree: list[int], edits: list, count) -> tuple[str, list[int], list[int], int]:
    """Text, leaf sizes and tree after the edits, and the number of characters re-encoded.

    Edits are (start, stop, replacement) in characters of the text, not overlapping.  Where the
    number of leaves stays the same only the paths to the root are updated; else the tree is
    built anew from the stored leaf counts, which needs no encoding."""
    ends = np.cumsum(chars)
    size = len(tree) // 2
    counts = tree[size : size + len(chars)]
    segs: list[list] = [[0, None, n, c] for n, c in zip(chars, counts)]  # touched, new text, chars, tokens
    starts = (ends - chars).tolist()
    done = 0
    out_edits = sorted((e["start"], e["stop"], e["text"] or "") for e in edits)
    if not chars:
        chars, segs, starts, ends = [0], [[0, None, 0, 0]], [0], np.array([0])
    shift: dict[int, list] = {}
    for a, b, new in out_edits:
        i = min(int(np.searchsorted(ends, a, side="right")), len(chars) - 1)
        j = max(i, min(int(np.searchsorted(ends, b, side="left")), len(chars) - 1))
        shift.setdefault(i, []).append((a, b, new))
        for x in range(i, j + 1):
            segs[x][0] = 1
    # New text of every touched run of leaves.
    groups, x = [], 0
    while x < len(segs):
        y = x + 1
        if segs[x][0]:
            while y < len(segs) and segs[y][0]:
                y += 1
            lo, hi = starts[x], int(ends[y - 1])
            parts, at = [], lo
            for g in range(x, y):
                for a, b, new in shift.get(g, ()):
                    parts += [text[at:a], new]
                    at = b
            groups.append([1, "".join(parts) + text[at:hi], None, None])
        else:
            groups.append([0, text[starts[x] : int(ends[x])], segs[x][2], segs[x][3]])
        x = y
    # Boundary context: a neighbour of new (or removed) text is re-encoded too where a pre-token may cross the edge.
    merged: list[list] = []
    gap = False
    for g in groups:
        if not g[1]:
            gap = True
            continue
        if merged and (gap or merged[-1][0] or g[0]) and _joins(merged[-1][1], g[1]):
            g = [1, merged.pop()[1] + g[1], None, None]
        merged.append(g)
        gap = False
    new_chars: list[int] = []
    new_counts: list[int] = []
    fresh: list[tuple[int, str]] = []
    for touched, t, n, c in merged:
        if not touched:
            new_chars.append(n)
            new_counts.append(c)
            continue
        for leaf in leaves_of(t):
            fresh.append((len(new_chars), leaf))
            new_chars.append(len(leaf))
            new_counts.append(0)
            done += len(leaf)
    for (at, _), c in zip(fresh, count([t for _, t in fresh])):
        new_counts[at] = c
    if len(new_counts) == tree[0] and len(tree) > 1:
        tree = list(tree)
        for at, _ in fresh:
            node = size + at
            tree[node] = new_counts[at]
            while node > 1:
                node //= 2
                tree[node] = tree[2 * node] + tree[2 * node + 1]
    else:
        tree = build(new_counts)
    return "".join(t for _, t, _, _ in merged), new_chars, tree, done


def build_trees(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, text, `keep`, leaf_chars array<int> and tree array<int> per row; null and empty texts have no leaves.

    Kept columns may not be called leaf_chars or tree."""
    names = list(dict.fromkeys((id_col, text_col, *keep)))
    src = docs.select(*(f"`{c}`" for c in names))

    def rows(part: pa.RecordBatch, count: Callable) -> pa.RecordBatch:
        texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
        chars, trees = _built(texts, count)
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(chars, _INTS), pa.array(trees, _INTS)], names=[*names, "leaf_chars", "tree"])

    return _run(src, ranks_path, pattern, text_col, rows, f"{_fields(src)}, {_TREE}")


def apply_edits(trees: DataFrame, ranks_path: str, pattern: str, edits: str = "edits", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """trees with text, leaf_chars and tree after the edits in the column `edits` (array of start, stop, text), and
    n_edits, n_before, n_tokens and n_reencoded (characters that were encoded again).

    Null or empty edits change nothing; edits of a null text are ignored."""
    src = trees.select(f"`{id_col}`", f"`{text_col}`", "leaf_chars", "tree", F.col(f"`{edits}`").cast(_EDITS).alias("edits"))

    def rows(part: pa.RecordBatch, count: Callable) -> pa.RecordBatch:
        texts, chars, tree, todo = (c.to_pylist() for c in part.columns[1:])
        return _edited(part.column(0), texts, chars, tree, todo, count, (id_col, text_col))

    return _run(src, ranks_path, pattern, text_col, rows, f"{_fields(src.select(src[0], src[1]))}, {_TREE}, {_COUNTS}")


def recount(docs: DataFrame, ranks_path: str, pattern: str, edits_of: Callable[[str], list[dict]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """build_trees and apply_edits in one pass, with edits that a function derives from the text: columns as of apply_edits.

    Trees are built once per row and updated by its edits, so a text is held once by one worker."""
    src = docs.select(f"`{id_col}`", f"`{text_col}`")

    def rows(part: pa.RecordBatch, count: Callable) -> pa.RecordBatch:
        texts = part.column(1).to_pylist()
        return _edited(part.column(0), texts, *_built(texts, count), [edits_of(t) if t else [] for t in texts], count, (id_col, text_col))

    return _run(src, ranks_path, pattern, text_col, rows, f"{_fields(src)}, {_TREE}, {_COUNTS}")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _built(texts: list, count: Callable) -> tuple[list, list]:
    leaves = [leaves_of(t or "") for t in texts]
    counts = iter(count([x for y in leaves for x in y]))
    return [[len(x) for x in y] for y in leaves], [build([next(counts) for _ in y]) for y in leaves]


def _edited(ids: pa.Array, texts: list, chars: list, trees: list, edits: list, count: Callable, names: tuple[str, str]) -> pa.RecordBatch:
    rows = []
    for t, sizes, tree, todo in zip(texts, chars, trees, edits):
        before = total(tree)
        if t is None or not todo:
            rows.append((t, sizes, tree, 0, before, before, 0))
        else:
            t, sizes, after, done = edit(t, sizes, tree, todo, count)
            rows.append((t, sizes, after, len(todo), before, total(after), done))
    out = list(zip(*rows)) or [[]] * 7
    kinds = (pa.string(), _INTS, _INTS, *[pa.int64()] * 4)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(out, kinds))], names=[*names, "leaf_chars", "tree", "n_edits", "n_before", "n_tokens", "n_reencoded"])


def _run(src: DataFrame, ranks_path: str, pattern: str, text_col: str, rows: Callable, fields: str) -> DataFrame:
    """One worker a task: it holds one encoder, and a slice of texts at a time."""
    sent = src.sparkSession.sparkContext.broadcast(sentencepiece_model(load_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(sent.value, pattern)
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                yield rows(part, lambda texts: [len(x) // 4 for x in enc.encode_texts(texts)])

    return src.mapInArrow(run, fields)


def repeated_lines(text: str) -> list[dict]:
    """Edits that delete each non-empty line equal to an earlier line, with the break before it."""
    seen, at, found = set(), 0, []
    for line in text.split("\n"):
        if line and line in seen:
            found.append({"start": at - 1, "stop": at + len(line), "text": ""})
        seen.add(line)
        at += len(line) + 1
    return found
