"""Divergence of the sources of a language, in exact integers over dense chunks of the vocabulary.

A task turns its texts into integer codes and counts them with bincount, per group of language
and source; sums of these counts are all that is shuffled.  The terms that a language keeps are
sorted and cut into chunks of a bounded number, so a term's id (chunk, place in the chunk) follows
UTF-8 order.  A chunk's counts become one dense matrix of groups by terms: searchsorted gives the
ids, bincount the counts; every pair of its rows yields a partial sum, every row its best terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import trimmed, written
from .pretokens import text_slices
from .textblocks import buffers

#: Kept terms of one chunk.
CHUNK = 4096
#: Parts of one in a probability.
ONE = 1_000_000_000


def _letters() -> np.ndarray:
    """Byte to byte: A-Z lower-cased, other bytes of terms as they are, all else a space."""
    table = np.full(256, 0x20, dtype=np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


_LETTERS = _letters()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n_docs, n: documents with the term and its occurrences; null columns are ''."""
    fill = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    src = docs.select(fill(lang).alias("lang"), fill(source).alias("source"), fill(text).alias("text"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text", 8 << 20):
                raw, off = buffers(texts)
                plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(off), pa.py_buffer(_LETTERS[raw]))
                words = pa.compute.split_pattern(plain, " ")
                coded = words.values.dictionary_encode()
                codes, terms = coded.indices.to_numpy(), coded.dictionary
                of = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
                blank = pa.compute.index(terms, pa.scalar("", terms.type)).as_py()
                if blank >= 0:
                    of, codes = of[codes != blank], codes[codes != blank]
                langs, sources = part.column(0).dictionary_encode(), part.column(1).dictionary_encode()
                size = max(1, len(terms))
                group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
                seen, times = np.unique(of * size + codes, return_counts=True)
                key, at = np.unique(group[seen // size] * size + seen % size, return_inverse=True)
                g = key // size
                cols = [langs.dictionary.take(pa.array(g // len(sources.dictionary))), sources.dictionary.take(pa.array(g % len(sources.dictionary))), terms.take(pa.array(key % size)).cast(pa.string())]
                cols += [pa.array(np.bincount(at, minlength=len(key)).astype(np.int64)), pa.array(np.bincount(at, times, len(key)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n_docs", "n"])

    counts = src.mapInArrow(run, "lang string, source string, term string, n_docs long, n long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))


def kept_terms(counts: DataFrame, least_docs: int = 10, chunk: int = CHUNK) -> DataFrame:
    """lang, chunk long, terms array<string>: kept terms in UTF-8 order, up to `chunk` a row; chunks of a language ascend with their terms."""
    kept = counts.groupBy("lang", "term").agg(F.sum("n_docs").alias("d")).where(F.col("d") >= least_docs).select("lang", "term")
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept.repartitionByRange(n, "lang", "term").sortWithinPartitions("lang", "term").select("lang", "term", F.spark_partition_id().cast("long").alias("p"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms, part, at = None, [], 0, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([part << 32 | at], pa.int64()), pa.array([terms], pa.list_(pa.string()))], names=["lang", "chunk", "terms"])
        for batch in batches:
            for k, t, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if terms and (k != lang or len(terms) >= chunk):
                    yield row()
                    at, terms = at + 1, []
                lang, part = k, p
                terms.append(t)
        if terms:
            yield row()

    return ranged.mapInArrow(run, "lang string, chunk long, terms array<string>")


def ratio(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(ONE * count / total) for counts up to their total, exact for totals below 2**53."""
    out, rest = count // total, count % total
    for _ in range(3):  # three digits of a thousand each
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 10, top: int = 10, chunk: int = CHUNK) -> DataFrame:
    """lang, source, part, item, value long, rank int: for every group the other sources of its language by
    divergence (part 'pair', all), and the terms that it has more often than its language (part 'term', `top`).

    Null texts, languages and sources count as ''; rows are documents, repeated ones too; a
    language without kept terms has pairs of value 0; other columns are not read.  Counts are
    exact below 2**53.  A chunk's task holds its terms times the sources of one language; the
    pairs of a language's sources are the result itself."""
    fill = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    counts = written(term_counts(docs, lang, source, text), "term-counts")
    chunks = written(kept_terms(counts, least_docs, chunk), "kept-terms")
    encoded = chunks.select("lang", "chunk", F.explode("terms").alias("term"))
    found = written(counts.join(encoded, ["lang", "term"]).select("lang", "chunk", "source", "term", "n"), "kept-counts")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select(fill(lang).alias("lang"), fill(source).alias("source")).distinct()
    groups = written(groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "groups")
    # One row per language: its sources in order, their totals, and the number of kept terms.
    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g"))
    sizes = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    tasks = chunks.join(langs.join(sizes, "lang"), "lang").select("lang", "chunk", "terms", F.col("g.source").alias("sources"), F.col("g.n").alias("totals"), "v")

    def dense(left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.slice(0, 1).to_pylist()[0]
        sources, size = row["sources"], len(row["terms"])
        # Bytes, as Python's order of strings is not that of UTF-8 bytes.
        terms = np.empty(size, dtype=object)
        terms[:] = [t.encode() for t in row["terms"]]
        have = np.empty(left.num_rows, dtype=object)
        have[:] = [t.encode() for t in left.column("term").to_pylist()]
        ids = np.searchsorted(terms, have)
        place = {s: i for i, s in enumerate(sources)}
        of = np.array([place[s] for s in left.column("source").to_pylist()], dtype=np.int64)
        count = np.bincount(of * size + ids, left.column("n").to_numpy(), len(sources) * size).astype(np.int64).reshape(len(sources), size)
        total = np.array(row["totals"], dtype=np.int64)
        p = ratio(count + 2, total[:, None] + 2 * row["v"])
        q = ratio(count.sum(axis=0) + 2, np.full(size, total.sum() + 2 * row["v"]))
        out = []
        for i, s in enumerate(sources):
            if i + 1 < len(sources):
                out += [(s, "pair", t, int(x)) for t, x in zip(sources[i + 1 :], divergence(p[i], p[i + 1 :]).sum(axis=1))]
            more = np.flatnonzero((count[i] > 0) & (p[i] > q))
            value = divergence(p[i, more], q[more])
            # Ids follow the terms' order, so a stable sort breaks ties.
            best = np.argsort(-value, kind="stable")[:top]
            out += [(s, "term", row["terms"][more[j]], int(value[j])) for j in best.tolist()]
        cols = list(zip(*out)) or [(), (), (), ()]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.table({"lang": pa.array([row["lang"]] * len(out), pa.string())} | {n: pa.array(c, k) for n, c, k in zip(("source", "part", "item", "value"), cols, kinds)})

    both = found.groupBy("lang", "chunk").cogroup(tasks.groupBy("lang", "chunk"))
    parts = written(both.applyInArrow(dense, "lang string, source string, part string, item string, value long"), "chunk-parts")
    half = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    value = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(value, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    every = pairs.unionByName(parts.where("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return every.withColumn("rank", F.row_number().over(order)).where(f"part = 'pair' OR rank <= {int(top)}").select("lang", "source", "part", "item", "value", "rank")
