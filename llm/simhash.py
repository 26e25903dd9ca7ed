"""SimHash near-duplicates: exact Hamming links found by pigeonring filtering.

A 64-bit fingerprint is a ring of 8 segments of 8 bits.  If two fingerprints differ in at
most t = 4 bits, some start segment i has the property that for every length l the l segments
from i on differ in at most l * t / 8 bits together (the strong pigeonring principle).  So the
segment i is equal, of the next two at least one is equal, of the next four at least two: five
patterns of three equal segments for each start, 40 keys of 24 bits.  Candidates meet on such a
key; the chain of cumulative budgets prunes them before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, written
from .components import components
from .decontaminate import slices
from .textblocks import buffers

SHINGLE, MOST_BITS = 4, 4
SEGMENTS, BITS = 8, 8
#: Distances of the two further equal segments from the start of the chain.
PATTERNS = ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4))
#: A key with more fingerprints than this is split by a fourth equal segment.
HOT_KEY = 20_000
#: Runs up to this size are compared pair by pair; longer ones give a spanning forest.
SMALL_RUN = 24


def fingerprint(words: list[bytes], shingle: int) -> int:
    """SimHash of the word shingles (repeats included) under XXH64, seed 42; 0 without words."""
    import xxhash

    if not words:
        return 0
    digest, text = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        hashes = [digest(text, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.r_[0, ends[:-1] + 1][: len(words) - shingle + 1].tolist()
        hashes = [digest(text[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    h = np.array(hashes, dtype="<u8")
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        count += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of every row; null and empty texts have fp 0."""
    src = docs.select(f"`{id_col}`", f"`{text_col}`")
    kind = src.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                raw, off = buffers(part.column(1))
                data = raw.tobytes()
                out = [fingerprint(data[a:b].lower().split(), shingle) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(out, dtype=np.uint64).view(np.int64))], names=[id_col, "fp"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _keys() -> str:
    seg = lambda i: f"(shiftrightunsigned(fp, {BITS * (i % SEGMENTS)}) & 255L)"
    out = []
    for i in range(SEGMENTS):
        for n, (a, b) in enumerate(PATTERNS):
            out.append(f"({(i * len(PATTERNS) + n) << 40}L | {seg(i)} * 65536L | {seg(i + a)} * 256L | {seg(i + b)})")
    return f"array({', '.join(out)})"


def _rest() -> str:
    """Extended keys: one of the five remaining segments is equal too (at most four differ)."""
    cases = []
    for i in range(SEGMENTS):
        for n, (a, b) in enumerate(PATTERNS):
            left = [j for j in range(SEGMENTS) if j not in {i, (i + a) % SEGMENTS, (i + b) % SEGMENTS}]
            subs = ", ".join(f"(key | {(x + 1) << 56}L | (shiftrightunsigned(fp, {BITS * j}) & 255L) * 4294967296L)" for x, j in enumerate(left))
            cases.append(f"WHEN {i * len(PATTERNS) + n} THEN array({subs})")
    return f"CASE shiftright(key, 40) {' '.join(cases)} END"


def links(nodes: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Edges (a, b) over distinct fingerprints fp that connect exactly what links of <= `most` bits connect.

    Every linked pair meets on a key.  Small runs of a key give each linked pair once over all
    keys (by its first valid chain); a long run gives the edges of a spanning forest of its own
    links, so the output stays below the run's length."""
    if most != MOST_BITS:
        raise ValueError("the patterns are made for four bits")
    rows = nodes.select("fp", F.explode(F.expr(_keys())).alias("key"))
    hot = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(f"n > {HOT_KEY}").select(F.col("key").alias("hot")), "simhash-hot")
    n_hot = hot.count()
    if n_hot:
        tagged = rows.join(small_side(hot, n_hot), rows.key == hot.hot, "left")
        rows = tagged.where("hot IS NULL").select("key", "fp").unionByName(tagged.where("hot IS NOT NULL").select(F.explode(F.expr(_rest())).alias("key"), "fp"))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "fp").repartition(n, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy()])
            f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))
            held_k, held_f = k[cut:], f[cut:]
            yield from _edges(k[:cut], f[:cut])
        yield from _edges(held_k, held_f)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _chain(x: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """For XORs: (n, 8) whether the chain from each start keeps within its budgets."""
    d = np.bitwise_count(x.view(np.uint8).reshape(-1, 8)).astype(np.int16)
    ok = np.ones((len(x), SEGMENTS), dtype=bool)
    total = np.zeros((len(x), SEGMENTS), dtype=np.int16)
    for length in range(1, SEGMENTS + 1):
        total += np.roll(d, -(length - 1), axis=1)
        ok &= total <= length * most // SEGMENTS
    return ok


def chain_holds(x: np.ndarray, most: int) -> np.ndarray:
    """Whether any chain of the ring keeps within the budgets of `most` bits, as it does for every XOR of at most so many."""
    return _chain(np.ascontiguousarray(x), most).any(axis=1)


def _owner(x: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """The first key (start and pattern) whose chain holds and whose three segments are equal."""
    same = x.view(np.uint8).reshape(-1, 8) == 0
    owner = np.full(len(x), 1 << 30, dtype=np.int64)
    for i in range(SEGMENTS - 1, -1, -1):
        for n in range(len(PATTERNS) - 1, -1, -1):
            a, b = PATTERNS[n]
            fits = ok[:, i] & same[:, i] & same[:, (i + a) % SEGMENTS] & same[:, (i + b) % SEGMENTS]
            owner[fits] = i * len(PATTERNS) + n
    return owner


def _edges(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(k) < 2:
        return
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.append(first, len(k)))
    run_of = np.repeat(np.arange(len(first)), size)
    small = (size <= SMALL_RUN)[run_of]
    for d in range(1, SMALL_RUN):
        at = np.flatnonzero(small[:-d] & (run_of[:-d] == run_of[d:])) if len(k) > d else []
        if not len(at):
            break
        pattern = (k[at] >> 40) & 0xFFFF
        start = pattern // len(PATTERNS)
        x = f[at] ^ f[at + d]
        # Chain of consecutive segments from the key's start, budget by budget.
        segs = x.view(np.uint8).reshape(-1, 8)
        total, live = np.zeros(len(at), dtype=np.int16), np.arange(len(at))
        for length in range(SEGMENTS):
            total[live] += np.bitwise_count(segs[live, (start[live] + length) % SEGMENTS])
            live = live[total[live] <= (length + 1) * MOST_BITS // SEGMENTS]
        live = live[(np.bitwise_count(x[live]) <= MOST_BITS) & (x[live] != 0)]
        # A key split by a fourth segment may meet a pair more than once; distinct() follows.
        keep = live[_owner(x[live], _chain(x[live])) == pattern[live] % 256]
        if len(keep):
            yield _batch(f[at[keep]], f[at[keep] + d])
    for r in np.flatnonzero(size > SMALL_RUN).tolist():
        yield from _forest(f[first[r] : first[r] + size[r]])


def _forest(f: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of the links among f: every reached one is compared only with those still unreached.

    Chains prune before the distance is taken: first by an equal segment, then by their budgets."""
    left, a, b = f, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            x = left ^ u
            # Chains begin with a segment within its own budget (none differs, as 4 div 8 is 0).
            may = np.flatnonzero(((x - _ONES) & ~x & _HIGHS) != 0)
            may = may[chain_holds(x[may], MOST_BITS)]
            near = may[np.bitwise_count(x[may]) <= MOST_BITS]
            if len(near):
                found = left[near]
                left = np.delete(left, near)
                a.append(np.full(len(found), u, dtype=np.uint64))
                b.append(found)
                queue.extend(found)
    if a:
        yield _batch(np.concatenate(a), np.concatenate(b))


#: For the test whether a 64-bit word has a zero byte.
_ONES, _HIGHS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = a.view(np.int64), b.view(np.int64)
    ok = a != b
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok])], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp and component_id (the smallest id reachable over links, itself included) per row.

    Equal fingerprints are one node whatever their number.  A null id takes part; it is nobody's
    smallest id unless the component has no other.  Repeated rows share their component.  Texts
    without words have fingerprint 0 and are linked like any other."""
    prints = written(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed(id_col, "id"), "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    root = written(components(links(nodes.select("fp"))), "simhash-roots")
    joined = nodes.join(root, nodes.fp == root.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    least = written(joined.where("linked").groupBy("root").agg(F.min("first").alias("least")), "simhash-least")
    label = joined.join(least, "root", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    label = written(label, "simhash-labels")
    return prints.join(label, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """docs without the near-duplicates (word shingles, similarity 0.8 or more) of a row with a smaller id; rows with a null id stay."""
    from .jaccard import keep_first as similar_first

    return similar_first(docs, id_col, text_col, shingle)
