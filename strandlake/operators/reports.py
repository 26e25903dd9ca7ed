"""Chart-ready aggregates: histograms, overlaps of call sets, state bands, score bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def size_histogram(sizes: DataFrame, bins: int = 100) -> DataFrame:
    """Counts per type in equal bins between the type's least and greatest size; the last bin is closed."""
    span = sizes.groupBy("sv_type").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    # One row per type.
    d = sizes.join(F.broadcast(span), "sv_type")
    at = f"if(hi = lo, 0, least({bins - 1}, cast(floor((size - lo) * {bins}D / (hi - lo)) AS int)))"
    return d.groupBy("sv_type", F.expr(at).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def call_set_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: calls in both sets, only in a, only in b (distinct keys)."""
    x = a.select(*keys).distinct().withColumn("in_a", F.lit(1))
    y = b.select(*keys).distinct().withColumn("in_b", F.lit(1))
    both = x.join(y, keys, "full_outer").selectExpr("coalesce(in_a, 0) AS in_a", "coalesce(in_b, 0) AS in_b")
    return both.agg(F.coalesce(F.sum(F.expr("in_a * in_b")), F.lit(0)).alias("n_both"), F.coalesce(F.sum(F.expr("in_a * (1 - in_b)")), F.lit(0)).alias("n_a"), F.coalesce(F.sum(F.expr("in_b * (1 - in_a)")), F.lit(0)).alias("n_b"))


def inversion_vote(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Per group whether more than half of its reads have an inverted supplementary alignment."""
    reads = pairs.groupBy(*by, "qname").agg(F.max(F.col("inverted").cast("int")).alias("inv"))
    return reads.groupBy(*by).agg((F.avg("inv") > 0.5).alias("inverted"), F.count(F.lit(1)).alias("n_reads"))


def flanks(regions: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Regions with the halves before and after them: region_id, section, start_pos, end_pos, never below 1 nor, where contigs (chrom, length) are given, beyond the contig's end."""
    half = "cast((end_pos - start_pos) div 2 AS bigint)"
    if contigs is not None:
        regions = regions.join(F.broadcast(contigs.select("chrom", F.col("length").alias("__len"))), "chrom", "left")  # one row per contig
    cap = lambda e: f"least(coalesce(__len, {e}), {e})" if contigs is not None else e
    parts = (
        f"array(named_struct('section', 'before', 's', greatest(1L, start_pos - {half}), 'e', greatest(1L, start_pos - 1)), "
        f"named_struct('section', 'sv', 's', start_pos, 'e', end_pos), named_struct('section', 'after', 's', {cap('end_pos + 1')}, 'e', {cap(f'end_pos + {half}')}))"
    )
    return regions.select("region_id", F.explode(F.expr(parts)).alias("p")).select("region_id", "p.section", F.col("p.s").alias("start_pos"), F.col("p.e").alias("end_pos"))


def split_update(calls: DataFrame) -> DataFrame:
    """Split-read calls (sv_type UNKNOWN, INS or INV) with a voted type: new_type and annotated, and the extra DEL rows of INS."""
    new = "CASE WHEN sv_type = 'UNKNOWN' AND voted IN ('DEL', 'DUP') THEN voted WHEN sv_type = 'INS' AND voted = 'DUP' THEN 'DUP' ELSE sv_type END"
    noted = "CASE sv_type WHEN 'UNKNOWN' THEN voted IN ('DEL', 'DUP') WHEN 'INS' THEN voted IN ('DUP', 'LOH', 'NEUTRAL') WHEN 'INV' THEN voted IN ('DEL', 'DUP', 'LOH', 'NEUTRAL') ELSE false END"
    kept = calls.withColumns({"new_type": F.expr(new), "annotated": F.expr(noted), "added": F.lit(False)})
    extra = calls.where("sv_type = 'INS' AND voted = 'DEL'").withColumns({"new_type": F.lit("DEL"), "annotated": F.lit(True), "added": F.lit(True)})
    return kept.unionByName(extra)
