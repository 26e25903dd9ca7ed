"""The calling pipeline as one lazy plan: reads to merged, flagged and formatted calls."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import clustering, coverage, filters, hmm, intervals, observations, reads, reports, split_calls, vcf_out
from ..operators.store import stored
from ..sources.text import contig_lengths, substring_at


@dataclass(frozen=True)
class CallerParams:
    """Thresholds of a run; min_points of 0 follows the mean coverage."""

    eps: float = 0.1
    min_points_pct: float = 0.1
    min_points: int = 0
    min_cnv: int = 2000
    gap_share: float = 0.2
    sample: int = observations.SAMPLE
    pfb_match: str = "all"

    def __post_init__(self):
        if not 0 <= self.eps < 1 or self.min_points < 0 or self.sample < 1:
            raise ValueError("eps must be in [0, 1), min_points at least 0 and sample at least 1")

    def points_for(self, mean_cov: float) -> int:
        """The given number; else the share of the mean coverage, rounded up; else 5."""
        if self.min_points:
            return self.min_points
        return max(1, math.ceil(mean_cov * self.min_points_pct)) if self.min_points_pct > 0 else 5


_CALL = ("call_id", "chrom", "start_pos", "end_pos", "sv_type", "alt", "evidence", "cluster_size", "hmm_lh", "genotype", "cn_state", "aln_offset")


def _as_calls(d: DataFrame, *kept: str) -> DataFrame:
    """The columns of a call, and those kept; what a source lacks is unknown."""
    more = {
        "hmm_lh": F.lit(0.0),
        "genotype": F.lit("./."),
        "cn_state": F.lit(0),
        "aln_offset": F.lit(0).cast("bigint"),
        "cluster_size": F.lit(0).cast("bigint"),
        "alt": F.expr("concat('<', sv_type, '>')"),
    }
    for c, e in more.items():
        if c not in d.columns:
            d = d.withColumn(c, e)
    if "call_id" not in d.columns:
        d = d.withColumn("call_id", F.xxhash64("chrom", "start_pos", "end_pos", "sv_type", "evidence", "alt"))
    return d.select(*_CALL, *kept).withColumn("cluster_size", F.col("cluster_size").cast("bigint"))


def merge_pass(calls: DataFrame, eps: float, min_points: int | str, noise: str, weight: str | None = None) -> DataFrame:
    """One merging of calls by reciprocal overlap within contig and type."""
    by = ["chrom", "sv_type"]
    labelled = stored(clustering.labelled_intervals(calls, "call_id", by, eps, min_points, weight))
    if weight:
        labelled = _as_calls(labelled, weight, "cluster_key")
    return clustering.merge_calls(labelled, by, "cluster_key", "call_id", noise, weight).select(*_CALL)


def read_depth(alignments: DataFrame) -> DataFrame:
    """Depth runs of all reads that count: aligned bases only where alignments have a cigar, else whole spans."""
    good = coverage.read_filter(alignments)
    return coverage.coverage_runs(reads.aligned_blocks(good) if "cigar" in alignments.columns else good)


def cigar_calls(alignments: DataFrame, params: CallerParams = CallerParams(), means: DataFrame | None = None, contigs: DataFrame | None = None) -> DataFrame:
    """Calls from CIGAR operations, merged within contig and type; noise is merged too.

    Every candidate counts: equal ones (span, type, evidence, ALT) are one row with their number as
    weight, so a thousand reads with one deletion are no thousand squared pairs.  The points that make
    a cluster follow each contig's mean coverage (means: chrom, mean_cov), as a column of the calls."""
    found = reads.cigar_candidates(alignments, contigs).withColumnsRenamed({"sv_start": "start_pos", "sv_end": "end_pos"})
    calls = filters.valid_spans(found).groupBy("chrom", "start_pos", "end_pos", "sv_type", "evidence", "alt").agg(F.count(F.lit(1)).alias("reads"))
    # What is alike in all of them is added when they are labelled.
    calls = stored(_as_calls(calls, "reads").select("call_id", "chrom", "start_pos", "end_pos", "sv_type", "alt", "evidence", "reads"))
    if params.min_points or params.min_points_pct <= 0:
        return merge_pass(calls, params.eps, params.points_for(0.0), "merge", "reads")
    means = coverage.mean_coverage(read_depth(alignments)) if means is None else means
    least = F.expr(f"greatest(1L, cast(ceil(mean_cov * {params.min_points_pct!r}D) AS bigint))").alias("least_points")
    with_points = calls.join(means.select("chrom", least), "chrom", "left").withColumn("least_points", F.coalesce("least_points", F.lit(1)))
    return merge_pass(with_points, params.eps, "least_points", "merge", "reads")


def copy_numbers(calls: DataFrame, obs: DataFrame, model: hmm.Model, voted: str) -> DataFrame:
    """calls plus voted_type, voted_state and voted_lh from the best path over the observations (region_id = call_id, t, pos, log2_cov, baf, pfb) of each.

    voted is 'split' (the states' shares over the region) or 'cigar' (the majority state inside the call)."""
    best = stored(hmm.viterbi_blocks(obs.select("region_id", "t", "log2_cov", "baf", "pfb"), model))
    # One row per step is far more than the table's files: it must not be broadcast.
    steps = best.select("region_id", F.explode(F.arrays_zip("t", "states")).alias("x")).select("region_id", F.col("x.t").alias("t"), F.col("x.states").alias("state")).hint("merge")
    if voted == "cigar":
        at = steps.join(obs.select("region_id", F.col("t").cast("bigint").alias("t"), "pos"), ["region_id", "t"])
        state = hmm.majority_state(at.join(calls.select(F.col("call_id").alias("region_id"), "start_pos", "end_pos"), "region_id"), ["region_id"])
    else:
        n = {s: f"count_if(state = {s})" for s in range(1, 7)}
        state = steps.groupBy("region_id").agg(hmm.vote(n, "count(1)").alias("cn_state"))
    found = best.where("likelihood IS NOT NULL").select("region_id", "likelihood").join(state, "region_id")
    found = found.select(F.col("region_id").alias("call_id"), F.col("likelihood").alias("voted_lh"), F.col("cn_state").alias("voted_state"))
    return calls.join(found, "call_id", "left").withColumn("voted_state", F.coalesce("voted_state", F.lit(0))).withColumn("voted_type", codes.lookup("voted_state", codes.STATE_TYPE))


def _taken(d: DataFrame, when) -> DataFrame:
    """The model's results where `when` holds, with the evidence bit of the model."""
    new = {"hmm_lh": F.col("voted_lh"), "cn_state": F.col("voted_state"), "genotype": codes.lookup("voted_state", codes.STATE_GENOTYPE), "evidence": F.col("evidence").bitwiseOR(256)}
    return d.withColumns({c: F.when(when, e).otherwise(F.col(c)) for c, e in new.items()})


def cigar_copy_numbers(calls: DataFrame, obs: DataFrame, model: hmm.Model, params: CallerParams = CallerParams()) -> DataFrame:
    """CIGAR calls of min_cnv bases or more with the model's state where it may replace the type; ALT stays as it is."""
    d = copy_numbers(calls, obs, model, "cigar")
    new = F.when(F.col("voted_type") == "LOH", F.col("sv_type")).otherwise(F.col("voted_type"))
    ok = codes.valid_update(F.col("sv_type"), new) & (F.col("end_pos") - F.col("start_pos") >= params.min_cnv) & F.col("voted_lh").isNotNull()
    d = _taken(d.withColumn("__ok", F.coalesce(ok, F.lit(False))), F.col("__ok"))
    return d.withColumn("sv_type", F.when(F.col("__ok"), new).otherwise(F.col("sv_type"))).select(*_CALL)


def upserted(calls: DataFrame, extra: DataFrame) -> DataFrame:
    """calls, where each one of extra replaces those of equal contig, span and type, and is put in where there is none."""
    same = ["chrom", "start_pos", "end_pos", "sv_type"]
    return calls.join(extra.select(*same).distinct(), same, "left_anti").unionByName(extra)


def split_copy_numbers(calls: DataFrame, obs: DataFrame, model: hmm.Model) -> DataFrame:
    """Split-read calls with the model's verdict: retyped, annotated, or joined by an extra call that replaces one of equal span and type."""
    d = reports.split_update(copy_numbers(calls, obs, model, "split").withColumn("voted", F.col("voted_type")))
    retyped = F.when(F.col("new_type") != F.col("sv_type"), F.expr("concat('<', new_type, '>')")).otherwise(F.col("alt"))
    d = _taken(d, F.col("annotated")).withColumn("alt", retyped).withColumn("sv_type", F.col("new_type"))
    d = stored(d.withColumn("call_id", F.when(F.col("added"), F.xxhash64("call_id", F.lit("added"))).otherwise(F.col("call_id"))).select(*_CALL, "added"))
    return upserted(d.where("NOT added").select(*_CALL), d.where("added").select(*_CALL))


def final_calls(cigar: DataFrame, split: DataFrame) -> DataFrame:
    """Split-read calls merged (noise kept), put beside the CIGAR calls, and all merged once more."""
    split = stored(merge_pass(stored(split), 0.1, 2, "keep").withColumn("call_id", F.xxhash64("call_id", F.lit("split"))))
    return merge_pass(stored(cigar.unionByName(split)), 0.1, 2, "keep")


def split_calls_of(alignments: DataFrame) -> DataFrame:
    return _as_calls(split_calls.split_read_calls(reads.split_reads(alignments)))


def call_set(alignments: DataFrame, snps: DataFrame, model: hmm.Model, params: CallerParams = CallerParams(), contigs: DataFrame | None = None) -> dict[str, DataFrame]:
    """All calls of the reads, and the tables behind them: calls, runs (depth), means, split (split-read calls as the model left them) and obs (their observations).

    alignments: chrom, qname, flag, mapq, start_pos, cigar, aln_id, and seq, if ALT bases are wanted;
    ends and read spans come from the CIGAR.  snps: chrom, pos, baf, pfb (null where the population's
    frequency is not known).  Candidates of each kind are merged, their copy number is predicted from
    depth and SNPs, and all are merged once more."""
    runs = stored(read_depth(alignments))
    means = filters.contigs_with_reads(coverage.mean_coverage(runs))
    seen = lambda calls: observations.observations(
        calls.withColumnRenamed("call_id", "region_id"), snps, runs, means, params.sample, params.pfb_match, contigs
    )
    cigar = stored(cigar_calls(alignments, params, means, contigs))
    # Only calls of the model's least length are looked at; the model and the vote both read their observations.
    looked_at = stored(seen(filters.long_enough(cigar, params.min_cnv)))
    cigar = stored(cigar_copy_numbers(cigar, looked_at, model, params))
    split = stored(split_calls_of(alignments))
    obs = stored(seen(split))
    split = stored(split_copy_numbers(split, obs, model))
    return {"calls": final_calls(cigar, split), "runs": runs, "means": means, "split": split, "obs": obs}


def cnv_records(calls: DataFrame, snps: DataFrame, runs: DataFrame, means: DataFrame, model: hmm.Model, contigs: DataFrame, params: CallerParams = CallerParams()) -> DataFrame:
    """JSON objects of saved copy-number calls (region_id, chrom, start_pos, end_pos, sv_type): see vcf_out.cnv_json; write_json_array makes a file of them.

    The call and both flanks are observed alike; the model runs over the call itself.  A flank of no length has no observations."""
    spans = stored(reports.flanks(calls, contigs).where("section = 'sv' OR start_pos < end_pos"))
    named = calls.select("region_id", "chrom", "sv_type", F.col("start_pos").alias("call_start"), F.col("end_pos").alias("call_end"))
    # Tables of calls are small in a file and not in memory: they must not be broadcast.
    spans = spans.join(named.hint("merge"), "region_id")
    parts = observations.packed(spans, snps, runs, means, params.sample, params.pfb_match, contigs, ("region_id", "section"), ("chrom", "call_start", "call_end", "sv_type"))
    return vcf_out.cnv_json(vcf_out.cnv_objects(parts, model))


def saved_records(made: dict[str, DataFrame], snps: DataFrame, model: hmm.Model, contigs: DataFrame, params: CallerParams = CallerParams()) -> DataFrame:
    """JSON objects of the split-read calls of `call_set` that are long enough and that the model changed."""
    changed = made["split"].where("hmm_lh <> 0 AND cn_state NOT IN (0, 3)").select(F.col("call_id").alias("region_id"), "chrom", "start_pos", "end_pos", "sv_type")
    return cnv_records(filters.saved_cnvs(changed), snps, made["runs"], made["means"], model, contigs, params)


def call_variants(alignments: DataFrame, tiles: DataFrame, snps: DataFrame, gaps: DataFrame, model: hmm.Model, params: CallerParams = CallerParams()) -> DataFrame:
    """VCF columns of all calls of the reads: see `call_set`; tiles is the tiled reference, gaps the assembly gaps (chrom, start_pos, end_pos)."""
    made = call_set(alignments, snps, model, params, contig_lengths(tiles))
    calls = stored(filters.known_types(made["calls"]))
    return vcf_rows(calls, made["runs"], gaps, tiles, params)


def vcf_rows(calls: DataFrame, runs: DataFrame, gaps: DataFrame, tiles: DataFrame, params: CallerParams = CallerParams()) -> DataFrame:
    """Calls (call_id unique) with depth (runs) at the record's position, assembly-gap flag and the reference bases of tiles, as VCF columns."""
    # What looks at the calls before it is run comes first, on the calls as they are.
    d = vcf_out.output_span(intervals.gap_flag(_as_calls(calls), gaps, share=params.gap_share))
    d = substring_at(tiles, d, ["call_id"], "ref_start", "ref_end")
    return vcf_out.format_rows(coverage.depth_at(d, runs).withColumnRenamed("depth", "support"))
