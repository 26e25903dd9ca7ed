"""Calls from split reads: groups of overlapping primaries, clustered end points and distances, candidate calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import clustering, intervals, reads
from .store import stored

MIN_LENGTH, MAX_LENGTH = 2_000, 1_000_000


def seed_reads(primaries: DataFrame, tile: int = 1 << 16) -> DataFrame:
    """chrom, qname, start_pos, end_pos of the seeds: in the order (start, end, qname) the first read of a contig, then each first read that starts behind the last seed's end.

    Of the reads of one start only the first can be a seed, so a tile of positions holds a bounded
    number.  Each tile says, for every position that the chain may come from, where its last seed ends
    (equal neighbours are one row); one pass over these rows carries the chain through the contig, and
    every tile then marks its own seeds."""
    kinds = dict(primaries.dtypes)
    first = primaries.groupBy("chrom", "start_pos").agg(F.min(F.struct("end_pos", "qname")).alias("f"))
    first = stored(first.select("chrom", F.expr(f"cast(start_pos div {tile} AS bigint)").alias("tile"), "start_pos", "f.end_pos", "f.qname"))
    key = f"chrom {kinds['chrom']}, tile bigint"

    def following(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """A tile's reads by start, and for each the place of the first that starts behind its end."""
        table = table.sort_by("start_pos")
        start, end = (table.column(c).to_numpy().astype(np.int64) for c in ("start_pos", "end_pos"))
        return table, start, end, np.maximum(np.searchsorted(start, end, side="right"), np.arange(len(start)) + 1)

    def ways(table: pa.Table) -> pa.Table:
        table, start, end, after = following(table)
        out = end.copy()
        for i in range(len(out) - 1, -1, -1):
            if after[i] < len(out):
                out[i] = out[after[i]]
        last = np.flatnonzero(np.r_[out[1:] != out[:-1], True])
        head = {c: pa.array([table.column(c)[0].as_py()] * len(last), table.schema.field(c).type) for c in ("chrom", "tile")}
        return pa.table(head | {"below": start[last], "way_out": out[last]})

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contig, tile_of, at, found = object(), None, None, True
        for batch in batches:
            rows = []
            for c, t, below, out in zip(*(x.to_pylist() for x in batch.columns)):
                if c != contig:
                    contig, tile_of, at = c, None, -1
                if t != tile_of:
                    tile_of, found = t, False
                    rows.append((c, t, at))
                if not found and below > at:
                    at, found = out, True
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["chrom", "tile", "came"])

    def marked(table: pa.Table) -> pa.Table:
        table, start, _, after = following(table)
        i, kept = int(np.searchsorted(start, table.column("came")[0].as_py(), side="right")), []
        while i < len(start):
            kept.append(i)
            i = int(after[i])
        return table.select(["chrom", "qname", "start_pos", "end_pos"]).take(pa.array(kept, pa.int64()))

    steps = first.groupBy("chrom", "tile").applyInArrow(ways, f"{key}, below bigint, way_out bigint")
    came = steps.repartition("chrom").sortWithinPartitions("chrom", "tile", "below").mapInArrow(carry, f"{key}, came bigint")
    both = first.join(came, ["chrom", "tile"])
    return both.groupBy("chrom", "tile").applyInArrow(marked, ", ".join(f"{c} {kinds[c]}" for c in ("chrom", "qname", "start_pos", "end_pos")))


def star_groups(primaries: DataFrame) -> DataFrame:
    """(chrom, grp, qname): groups of primaries that overlap a seed, of two or more; a read may be in several.

    In the order (start, end, qname) the first read that no group has is a seed; its group is all
    reads that overlap it.  The groups come from a blocked join of seeds and reads."""
    cols = ("chrom", "qname", "start_pos", "end_pos")
    pairs = intervals.overlap_pairs(seed_reads(primaries.select(*cols)), primaries.select(*cols), "qname", 1 << 14).select("chrom", F.col("a_id").alias("grp"), F.col("b_id").alias("qname"))
    # A group is the reads over one seed.
    size = F.count(F.lit(1)).over(Window.partitionBy("chrom", "grp"))
    return pairs.withColumn("__n", size).where("__n > 1").select("chrom", "grp", "qname")


def split_read_calls(alignments: DataFrame, eps: int = 100, min_points: int = 5, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH) -> DataFrame:
    """chrom, start_pos, end_pos, sv_type, alt, evidence, cluster_size, aln_offset of split-read candidates, equal spans made one.

    alignments: chrom, qname, flag, mapq, start_pos, end_pos, query_start, query_end, aln_id (of several
    primaries of a read on a contig the one of the greatest aln_id counts)."""
    # What several branches read is written once: reads' ends, groups, points and their clusters are not made again for each.
    primary, extra = reads.split_branches(alignments)
    cols = ("start_pos", "end_pos", "query_start", "query_end", "flag")
    extra = stored(extra.select("chrom", "qname", *cols))
    p = primary.join(extra.select("qname").distinct(), "qname", "left_semi")
    p = stored(p.groupBy("chrom", "qname").agg(F.max_by(F.struct(*cols), "aln_id").alias("r")).select("chrom", "qname", "r.*"))
    members = stored(star_groups(p).join(p.select("chrom", "qname", *(F.col(c).alias(f"p_{c}") for c in cols)), ["chrom", "qname"]))
    both = members.join(extra.select("chrom", "qname", *(F.col(c).alias(f"s_{c}") for c in cols)), ["chrom", "qname"])
    both = both.withColumn("opposite", F.expr("(p_flag & 16) <> (s_flag & 16)"))
    far = lambda a: f"greatest(0, greatest(s_{a}start{'_pos' if not a else ''}, p_{a}start{'_pos' if not a else ''}) - least(s_{a}end{'_pos' if not a else ''}, p_{a}end{'_pos' if not a else ''}))"
    both = both.withColumn("read_dist", F.expr(f"if(opposite, null, if(p_start_pos < s_start_pos, 1, -1) * {far('query_')})")).withColumn("ref_dist", F.expr(f"if(opposite, null, {far('')})"))
    both = stored(both.select("chrom", "grp", "qname", "opposite", "s_start_pos", "s_end_pos", "read_dist", "ref_dist"))
    votes = members.select("chrom", "grp", "qname").join(both.where("opposite").select("chrom", "grp", "qname").distinct().withColumn("o", F.lit(1)), ["chrom", "grp", "qname"], "left")
    votes = votes.groupBy("chrom", "grp").agg((F.sum(F.coalesce("o", F.lit(0))) / F.count(F.lit(1)) > 0.5).alias("inversion"))
    # All six point sets in one table, clustered side by side.
    of = lambda d, *kinds: d.select("chrom", "grp", F.explode(F.expr(f"array({', '.join(f'''named_struct('kind', '{k}', 'x', cast({c} AS bigint))''' for k, c in kinds)})")).alias("e")).select("chrom", "grp", "e.kind", "e.x")
    points = of(members, ("ps", "p_start_pos"), ("pe", "p_end_pos")).unionByName(of(both, ("ss", "s_start_pos"), ("se", "s_end_pos"), ("rd", "read_dist"), ("fd", "ref_dist"))).where("x IS NOT NULL")
    by = ["chrom", "grp", "kind"]
    # Equal points are alike, so their order among themselves does not matter.
    labelled = stored(clustering.dbscan_1d(points, by, "x", "x", eps, min_points, keep=stored).where("cluster >= 0"))
    best = stored(clustering.largest_cluster(labelled, by))
    median = clustering.upper_median(labelled.join(best, [*by, "cluster"]), by, "x").join(best, by)
    wide = median.groupBy("chrom", "grp").pivot("kind", ["ps", "pe", "ss", "se", "rd", "fd"]).agg(F.first("median").alias("m"), F.first("n").alias("n"))
    d = stored(wide.join(votes, ["chrom", "grp"]).where("ps_m IS NOT NULL OR pe_m IS NOT NULL"))
    size = "greatest(coalesce(ps_n, 0), coalesce(pe_n, 0))"
    d = d.withColumn("p_size", F.expr(size)).withColumn("s_size", F.expr("greatest(coalesce(ss_n, 0), coalesce(se_n, 0))"))
    # Distances: an insertion where the read has more between the parts, unknown where the reference has.
    first = "CASE WHEN rd_m > 0 AND pe_m IS NOT NULL THEN greatest(ps_m, pe_m) WHEN rd_m <= 0 AND se_m IS NOT NULL THEN greatest(ss_m, se_m) END"
    e = d.where("rd_m IS NOT NULL AND fd_m IS NOT NULL").withColumn("at", F.expr(first)).withColumn("rd", F.abs("rd_m")).where("at IS NOT NULL")
    fits = lambda c: f"{c} BETWEEN {min_length} AND {max_length}"
    e = e.withColumn("len", F.expr(f"CASE WHEN rd > fd_m AND {fits('rd')} THEN rd WHEN fd_m > rd AND {fits('fd_m')} THEN fd_m END")).where("len IS NOT NULL")
    one = e.select("chrom", F.col("at").alias("start_pos"), F.expr("at + len - 1 AS end_pos"), F.expr("if(rd > fd_m, 'INS', 'UNKNOWN') AS sv_type"), F.expr("if(rd > fd_m, '<INS>', '.') AS alt"), F.lit(16).alias("evidence"), F.col("p_size").alias("cluster_size"), F.expr("fd_m - rd AS aln_offset"))
    # Positions: every primary median with every supplementary one.
    f = d.select("chrom", "inversion", F.expr("greatest(p_size, s_size) AS cluster_size"), F.explode(F.expr("array_compact(array(ps_m, pe_m))")).alias("a"), "ss_m", "se_m")
    f = f.select("*", F.explode(F.expr("array_compact(array(ss_m, se_m))")).alias("b")).selectExpr("*", "least(a, b) AS start_pos", "greatest(a, b) - 1 AS end_pos").where(fits("end_pos - start_pos + 1"))
    two = f.select("chrom", "start_pos", "end_pos", F.expr("if(inversion, 'INV', 'UNKNOWN') AS sv_type"), F.expr("if(inversion, '<INV>', '.') AS alt"), F.lit(8).alias("evidence"), "cluster_size", F.lit(0).cast("bigint").alias("aln_offset"))
    calls = one.unionByName(two)
    return clustering.dedupe_calls(calls, "evidence").select(*calls.columns)
