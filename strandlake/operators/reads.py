"""CIGAR walks, read spans and split-read joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import plain_bases

MIN_LENGTH, MIN_MAPQ = 50, 20


def cigar_ops(col: str) -> Column:
    """array<struct<op,len>> of a CIGAR string."""
    return F.expr(f"transform(regexp_extract_all({col}, '([0-9]+)([MIDNSHP=X])', 0), x -> named_struct('op', right(x, 1), 'len', cast(left(x, length(x) - 1) AS bigint)))")


def query_span(alignments: DataFrame) -> DataFrame:
    """alignments plus q_start (soft-clipped bases before the first match) and q_end (all bases of the query, clips included)."""
    d = alignments.withColumn("__c", cigar_ops("cigar"))
    start = "aggregate(__c, named_struct('n', 0L, 'on', true), (a, x) -> named_struct('n', a.n + if(a.on AND x.op = 'S', x.len, 0L), 'on', a.on AND NOT x.op IN ('M', 'I', '=', 'X')), a -> a.n)"
    return d.withColumn("q_start", F.expr(start)).withColumn("q_end", F.expr("aggregate(__c, 0L, (a, x) -> a + if(x.op IN ('M', 'I', 'S', '=', 'X'), x.len, 0L))")).drop("__c")


def with_ends(alignments: DataFrame) -> DataFrame:
    """alignments plus end_pos, the last reference position by the CIGAR (the first one where nothing is aligned)."""
    used = "aggregate(__c, 0L, (a, x) -> a + if(x.op IN ('M', 'D', 'N', '=', 'X'), x.len, 0L))"
    d = alignments.withColumn("__c", cigar_ops("cigar"))
    return d.withColumn("end_pos", F.expr(f"start_pos + greatest(1L, {used}) - 1")).drop("__c")


def cigar_candidates(alignments: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Insertions, long clips (as insertions) and deletions of at least 50 bases: chrom, qname, sv_start, sv_end, sv_type, evidence, alt.

    The walk carries the offsets in the reference and in the read before each operation; all in one
    expression per read.  Where alignments have the read's bases (seq), an insertion or clip of
    exactly 50 shows them (ambiguous ones as N); others are symbolic.  Clips that begin behind the
    contig's end (contigs: chrom, length) are left out."""
    good = alignments.where((F.col("flag").bitwiseAND(0x704 | 0x800) == 0) & (F.col("mapq") >= MIN_MAPQ)).withColumn("__c", cigar_ops("cigar"))
    event = "named_struct('op', x.op, 'len', x.len, 'at', a.at, 'q', a.q)"
    walk = (
        "aggregate(__c, named_struct('at', 0L, 'q', 0L, 'out', cast(array() AS array<struct<op:string,len:bigint,at:bigint,q:bigint>>)), (a, x) -> named_struct("
        "'at', a.at + if(x.op IN ('M', 'D', 'N', '=', 'X'), x.len, 0L), 'q', a.q + if(x.op IN ('M', 'I', 'S', '=', 'X'), x.len, 0L), "
        f"'out', if(x.len >= {MIN_LENGTH} AND x.op IN ('I', 'D', 'S'), concat(a.out, array({event})), a.out)), a -> a.out)"
    )
    seq = F.col("seq") if "seq" in alignments.columns else F.lit(None).cast("string")
    # Only the bases of short insertions are kept.
    bases = F.when((F.col("e.op") != "D") & (F.col("e.len") == MIN_LENGTH), F.expr("substring(__seq, cast(e.q + 1 AS int), cast(e.len AS int))"))
    found = good.select("chrom", "qname", "start_pos", seq.alias("__seq"), F.explode(F.expr(walk)).alias("e")).withColumn("bases", bases)
    out = found.select(
        "chrom",
        "qname",
        F.expr("start_pos + e.at").alias("sv_start"),
        F.expr("start_pos + e.at + e.len - 1").alias("sv_end"),
        F.expr("if(e.op = 'D', 'DEL', 'INS')").alias("sv_type"),
        F.expr("CASE e.op WHEN 'I' THEN 1 WHEN 'D' THEN 2 ELSE 4 END").alias("evidence"),
        F.coalesce(plain_bases("bases"), F.expr("if(e.op = 'D', '<DEL>', '<INS>')")).alias("alt"),
    )
    if contigs is None:
        return out
    inside = F.expr("evidence <> 4 OR __len IS NULL OR sv_start <= __len")
    # One row per contig.
    return out.join(F.broadcast(contigs.select("chrom", F.col("length").alias("__len"))), "chrom", "left").where(inside).select(out.columns)


def _operations(cigars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code (a byte) and length of every operation of a column of CIGAR strings, by their digits' places."""
    column = pc.fill_null(cigars.cast(pa.large_binary()), b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    at = np.flatnonzero((raw < 48) | (raw > 57))
    digit = raw.astype(np.int64) - 48
    digit[at] = 0
    before = np.r_[0, at[:-1] + 1] if len(at) else at
    place = np.repeat(at, at - before + 1) - np.arange(len(raw[: at[-1] + 1] if len(at) else raw[:0])) - 1
    value = digit[: len(place)] * 10 ** np.clip(place, 0, 18)
    length = np.add.reduceat(value, before) if len(at) else at
    return np.searchsorted(off - off[0], at, side="right") - 1, raw[at], length


def aligned_blocks(alignments: DataFrame) -> DataFrame:
    """chrom, start_pos, end_pos of every run of aligned bases (M, = and X operations) of each alignment; deletions and skips leave holes.

    Offsets are sums over all operations of a batch at once, so a read of many thousand operations costs no more per operation."""
    kind = dict(alignments.dtypes)["chrom"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, op, n = _operations(batch.column(2))
            if not len(row):
                continue
            used = np.where(np.isin(op, np.frombuffer(b"MDN=X", np.uint8)), n, 0)
            before = np.cumsum(used) - used
            first = np.r_[True, row[1:] != row[:-1]]
            before -= np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(row)]))
            is_base = np.isin(op, np.frombuffer(b"M=X", np.uint8)) & (n > 0)
            start = batch.column(1).to_numpy(zero_copy_only=False)[row[is_base]] + before[is_base]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[is_base])), pa.array(start.astype(np.int64)), pa.array((start + n[is_base] - 1).astype(np.int64))], names=["chrom", "start_pos", "end_pos"])

    return alignments.select("chrom", F.col("start_pos").cast("bigint").alias("start_pos"), "cigar").where("start_pos IS NOT NULL").mapInArrow(run, f"chrom {kind}, start_pos bigint, end_pos bigint")


def split_reads(alignments: DataFrame) -> DataFrame:
    """qname, chrom, flag, mapq, start_pos, aln_id of the alignments that pass the split-read filter, with end_pos, query_start and query_end: those of `with_ends` and `query_span`, as sums over all operations of a batch at once."""
    kinds = dict(alignments.dtypes)
    kept = ("qname", "chrom", "flag", "mapq", "start_pos", "aln_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, op, n = _operations(batch.column(len(kept)))
            is_in = lambda codes: np.isin(op, np.frombuffer(codes, np.uint8))
            total = lambda used: np.bincount(row[used], n[used], batch.num_rows).astype(np.int64)
            # Bases of the read before each operation of its row: clips count until there are any.
            matched = np.cumsum(is_in(b"MI=X"))
            before = np.r_[0, matched][np.searchsorted(row, row)] if len(row) else matched
            none = batch.column(len(kept)).is_null().to_numpy(zero_copy_only=False)
            size = pc.max_element_wise(pa.array(total(is_in(b"MDN=X"))), 1)
            end = pc.subtract(pc.add(batch.column(4).cast(pa.int64()), size), 1)
            span = [pa.array(total(used), mask=none) for used in (is_in(b"S") & (matched == before), is_in(b"MIS=X"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), end, *span], names=[*kept, "end_pos", "query_start", "query_end"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in kept), "end_pos bigint, query_start bigint, query_end bigint"])
    return alignments.where((F.col("flag").bitwiseAND(0x704) == 0) & (F.col("mapq") >= MIN_MAPQ)).select(*kept, "cigar").mapInArrow(run, schema)


def split_branches(alignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Primary and supplementary alignments that pass the split-read filter."""
    ok = alignments.where((F.col("flag").bitwiseAND(0x704) == 0) & (F.col("mapq") >= MIN_MAPQ))
    return ok.where(F.col("flag").bitwiseAND(0x800) == 0), ok.where(F.col("flag").bitwiseAND(0x800) != 0)


def primaries_with_supplementary(alignments: DataFrame) -> DataFrame:
    primary, extra = split_branches(alignments)
    return primary.join(extra.select("qname").distinct(), "qname", "left_semi")


def split_pairs(alignments: DataFrame) -> DataFrame:
    """Primary and supplementary of one read on one contig, with signed read and reference distances."""
    primary, extra = split_branches(alignments)
    cols = ("start_pos", "end_pos", "query_start", "query_end", "flag")
    p = primary.select("qname", "chrom", *(F.col(c).alias(f"p_{c}") for c in cols))
    s = extra.select("qname", "chrom", *(F.col(c).alias(f"s_{c}") for c in cols))
    both = p.join(s, ["qname", "chrom"])
    read = "greatest(0, greatest(p_query_start, s_query_start) - least(p_query_end, s_query_end))"
    return both.select(
        "qname", "chrom", "p_start_pos", "s_start_pos",
        F.expr(f"if(p_start_pos < s_start_pos, {read}, -{read})").alias("read_dist"),
        F.expr("greatest(0, greatest(p_start_pos, s_start_pos) - least(p_end_pos, s_end_pos))").alias("ref_dist"),
        F.expr("(p_flag & 16) <> (s_flag & 16)").alias("inverted"),
    )
