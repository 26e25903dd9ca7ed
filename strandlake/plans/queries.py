"""Registered queries of the structural-variant operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import clustering, coverage, filters, hmm, intervals, observations, quality_control, reads, reports, scoring, split_calls, store, vcf_out
from ..sources import text
from .fixtures import CONTIGS, reference, table, with_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (with_sql(*names) + (", " if sql.lstrip().startswith("!") else " ") + sql.lstrip().lstrip("!")) if names else sql
        return f

    return add


_EVIDENCE = "concat_ws(',', " + ", ".join(f"CASE WHEN cluster_size & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(codes.EVIDENCE)) + ")"
_GENOTYPE = "CASE cn_state " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in codes.STATE_GENOTYPE.items()) + " END"

_TILE = coverage.TILE
_BASES = f"""!blocks AS (SELECT chrom, start_pos, end_pos FROM fx_alignments WHERE flag & 1796 = 0),
cut AS (SELECT chrom, t AS tile, greatest(start_pos, t * {_TILE}) AS a, least(end_pos, (t + 1) * {_TILE} - 1) AS b FROM (SELECT *, unnest(range(start_pos // {_TILE}, end_pos // {_TILE} + 1)) AS t FROM blocks)),
steps AS (SELECT chrom, tile, p, sum(d) AS d FROM (SELECT chrom, tile, a AS p, 1 AS d FROM cut UNION ALL SELECT chrom, tile, b + 1, -1 FROM cut) GROUP BY ALL HAVING sum(d) <> 0),
runs AS (SELECT chrom, p AS start_pos, lead(p) OVER w - 1 AS end_pos, CAST(sum(d) OVER w AS BIGINT) AS depth FROM steps WINDOW w AS (PARTITION BY chrom, tile ORDER BY p)) """


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.coverage_runs(coverage.read_filter(table(spark, sf, "fx_alignments")))


@query(_BASES + "SELECT * FROM runs WHERE depth > 0", "fx_alignments")
def coverage_runs(spark, sf):
    return _runs(spark, sf)


@query("!base AS (SELECT chrom, unnest(range(start_pos, end_pos + 1)) AS p FROM fx_alignments WHERE flag & 1796 = 0) SELECT chrom, count(*) / count(DISTINCT p)::DOUBLE AS mean_cov FROM base GROUP BY chrom", "fx_alignments")
def mean_coverage(spark, sf):
    return coverage.mean_coverage(_runs(spark, sf))


@query("SELECT s.chrom, pos, count(a.aln_id) AS depth FROM fx_snps s LEFT JOIN fx_alignments a ON s.chrom = a.chrom AND pos BETWEEN start_pos AND end_pos AND flag & 1796 = 0 GROUP BY s.chrom, pos", "fx_alignments", "fx_snps")
def depth_at_point(spark, sf):
    return coverage.depth_at(table(spark, sf, "fx_snps").select("chrom", "pos"), _runs(spark, sf))


@query(
    _BASES
    + """, pos AS (SELECT * FROM runs WHERE depth > 0), m AS (SELECT chrom, sum(depth * (end_pos - start_pos + 1)) / sum(end_pos - start_pos + 1) AS mean_cov FROM pos GROUP BY chrom),
w AS (SELECT call_id, chrom, i AS w, CAST(floor(start_pos + i * ((end_pos - start_pos + 1) / 20.0::DOUBLE)) AS BIGINT) AS a, CAST(floor(start_pos + (i + 1) * ((end_pos - start_pos + 1) / 20.0::DOUBLE)) AS BIGINT) - 1 AS b FROM (SELECT *, unnest(range(0, 20)) AS i FROM fx_calls)),
s AS (SELECT call_id, w.chrom, w, a, b, sum(coalesce(depth * (least(b, end_pos) - greatest(a, start_pos) + 1), 0)) AS total FROM w LEFT JOIN pos ON w.chrom = pos.chrom AND start_pos <= b AND end_pos >= a WHERE b >= a GROUP BY ALL)
SELECT call_id AS region_id, CAST(w AS INT) AS w, log2((CASE WHEN total = 0 THEN 1e-9 ELSE total / (b - a + 1)::DOUBLE END) / mean_cov) AS log2_cov FROM s JOIN m USING (chrom)""",
    "fx_alignments",
    "fx_calls",
)
def window_log2(spark, sf):
    runs = store.stored(_runs(spark, sf))
    regions = table(spark, sf, "fx_calls").withColumnRenamed("call_id", "region_id")
    return coverage.window_log2(regions, runs, coverage.mean_coverage(runs))


@query("SELECT aln_id, chrom, flag FROM fx_alignments WHERE flag & 4 = 0 AND flag & 256 = 0 AND flag & 512 = 0 AND flag & 1024 = 0", "fx_alignments")
def read_filter_flags(spark, sf):
    return coverage.read_filter(table(spark, sf, "fx_alignments")).select("aln_id", "chrom", "flag")


@query("SELECT chrom, pos, CASE WHEN ad_ref + ad_alt > 0 THEN ad_alt / (ad_ref + ad_alt)::DOUBLE END AS baf FROM fx_snps WHERE qual > 30 AND dp > 10 AND flt = 'PASS'", "fx_snps")
def snp_filter_baf(spark, sf):
    return quality_control.snp_filter(table(spark, sf, "fx_snps")).select("chrom", "pos", "baf")


_OPS = """!x AS (SELECT *, row_number() OVER () AS rid FROM fx_seqs),
ops AS (SELECT *, unnest(regexp_extract_all(cigar, '[0-9]+[MIDS]')) AS o, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDS]'), 1) AS i FROM x),
u AS (SELECT *, right(o, 1) AS op, CAST(left(o, length(o) - 1) AS BIGINT) AS n FROM ops),
w AS (SELECT *, coalesce(sum(CASE WHEN op IN ('M', 'D') THEN n ELSE 0 END) OVER before, 0) AS off, coalesce(sum(CASE WHEN op <> 'D' THEN n ELSE 0 END) OVER before, 0) AS q
  FROM u WINDOW before AS (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT chrom, qname, CAST(start_pos + off AS BIGINT) AS sv_start, CAST(start_pos + off + n - 1 AS BIGINT) AS sv_end, CASE op WHEN 'D' THEN 'DEL' ELSE 'INS' END AS sv_type, CASE op WHEN 'I' THEN 1 WHEN 'D' THEN 2 ELSE 4 END AS evidence,
  CASE WHEN op = 'D' THEN '<DEL>' WHEN n = 50 THEN regexp_replace(substr(seq, CAST(q + 1 AS INT), 50), '[RY]', 'N', 'g') ELSE '<INS>' END AS alt
  FROM w WHERE op <> 'M' AND n >= 50 AND flag & 3844 = 0 AND mapq >= 20 AND (op <> 'S' OR start_pos + off <= length)) """


def _reads(spark, sf):
    """The alignments with their bases, and the lengths of their contigs."""
    return table(spark, sf, "fx_seqs").drop("length"), spark.createDataFrame(list(CONTIGS.items()), "chrom string, length bigint")


@query(_OPS + "SELECT * FROM c", "fx_seqs")
def cigar_candidates(spark, sf):
    """With the bases of insertions of 50, and without clips behind the contig's end."""
    return reads.cigar_candidates(*_reads(spark, sf))


@query(_OPS + "SELECT chrom, sv_start, sv_end, sv_type, evidence, alt, count(*) AS n FROM c GROUP BY ALL", "fx_seqs")
def cigar_candidate_counts(spark, sf):
    """Equal candidates with their number, which is the weight that clustering gives them."""
    aln, contigs = _reads(spark, sf)
    key = ["chrom", "sv_start", "sv_end", "sv_type", "evidence", "alt"]
    # Nearly all candidates differ, so they are dealt before they are counted, over partitions that grow with the reads.
    return reads.cigar_candidates(aln, contigs).select(*key).repartition(store.parts_for(aln), *key).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))


@query(_OPS + "SELECT aln_id, CAST(start_pos + sum(CASE WHEN op IN ('M', 'D') THEN n ELSE 0 END) - 1 AS BIGINT) AS end_pos FROM w GROUP BY rid, aln_id, start_pos", "fx_seqs")
def alignment_ends(spark, sf):
    return reads.with_ends(table(spark, sf, "fx_alignments").drop("end_pos")).select("aln_id", "end_pos")


@query(_OPS + "SELECT chrom, CAST(start_pos + off AS BIGINT) AS start_pos, CAST(start_pos + off + n - 1 AS BIGINT) AS end_pos, count(*) AS n FROM w WHERE op = 'M' AND flag & 1796 = 0 GROUP BY ALL", "fx_seqs")
def aligned_block_counts(spark, sf):
    """Runs of aligned bases of the reads that count for depth, equal ones with their number."""
    return reads.aligned_blocks(coverage.read_filter(table(spark, sf, "fx_alignments"))).groupBy("chrom", "start_pos", "end_pos").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT aln_id, CAST(regexp_extract(cigar, '^([0-9]+)S', 1) AS BIGINT) AS q_start, CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MIS]', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS q_end FROM fx_alignments", "fx_alignments")
def query_span(spark, sf):
    return reads.query_span(table(spark, sf, "fx_alignments")).select("aln_id", "q_start", "q_end")


@query("SELECT chrom, 'chr' || regexp_replace(chrom, '^chr', '') AS with_prefix, substr(chrom, 4) AS bare, count(*) AS n FROM fx_alignments GROUP BY chrom", "fx_alignments")
def contig_inventory(spark, sf):
    d = table(spark, sf, "fx_alignments").groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))
    return d.select("chrom", F.concat(F.lit("chr"), F.regexp_replace("chrom", "^chr", "")).alias("with_prefix"), F.regexp_replace("chrom", "^chr", "").alias("bare"), "n")


_SPLIT = "!ok AS (SELECT * FROM fx_alignments WHERE flag & 1796 = 0 AND mapq >= 20), p AS (SELECT * FROM ok WHERE flag & 2048 = 0), s AS (SELECT * FROM ok WHERE flag & 2048 <> 0) "


@query(
    _SPLIT
    + """SELECT p.qname, p.chrom, p.start_pos AS p_start_pos, s.start_pos AS s_start_pos,
  CASE WHEN p.start_pos < s.start_pos THEN 1 ELSE -1 END * greatest(0, greatest(p.query_start, s.query_start) - least(p.query_end, s.query_end)) AS read_dist,
  greatest(0, greatest(p.start_pos, s.start_pos) - least(p.end_pos, s.end_pos)) AS ref_dist, (p.flag & 16) <> (s.flag & 16) AS inverted FROM p JOIN s ON p.qname = s.qname AND p.chrom = s.chrom""",
    "fx_alignments",
)
def split_read_join(spark, sf):
    return reads.split_pairs(table(spark, sf, "fx_alignments"))


@query(_SPLIT + "SELECT aln_id FROM p WHERE qname IN (SELECT qname FROM s)", "fx_alignments")
def primary_semi(spark, sf):
    return reads.primaries_with_supplementary(table(spark, sf, "fx_alignments")).select("aln_id")


@query(
    """!m AS (SELECT *, max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM fx_calls),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR start_pos > m THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos, call_id) AS g FROM m) SELECT call_id, chrom, min(start_pos) OVER (PARTITION BY chrom, g) AS island FROM g""",
    "fx_calls",
)
def overlap_islands(spark, sf):
    return intervals.overlap_islands(table(spark, sf, "fx_calls"), ["chrom"], ["call_id"]).select("call_id", "chrom", "island")


@query("SELECT c.call_id AS a_id, count(*) AS n FROM fx_calls c JOIN fx_calls d ON c.chrom = d.chrom AND c.start_pos <= d.end_pos AND c.end_pos >= d.start_pos GROUP BY c.call_id", "fx_calls")
def overlap_self_join(spark, sf):
    return intervals.overlap_counts(table(spark, sf, "fx_calls"), "call_id").where("n > 0").withColumnRenamed("call_id", "a_id")


@query("SELECT call_id, EXISTS (SELECT 1 FROM fx_gaps g WHERE g.chrom = c.chrom AND (least(c.end_pos, g.end_pos + 1) - greatest(c.start_pos, g.start_pos + 1) + 1) / (c.end_pos - c.start_pos + 1)::DOUBLE > 0.2) AS gap FROM fx_calls c", "fx_calls", "fx_gaps")
def assembly_gap_flag(spark, sf):
    return intervals.gap_flag(table(spark, sf, "fx_calls").select("call_id", "chrom", "start_pos", "end_pos"), table(spark, sf, "fx_gaps"), ["call_id"]).select("call_id", "gap")


@query("SELECT s.chrom, s.pos, coalesce((SELECT max(af) FROM fx_pfb f WHERE f.chrom = s.chrom AND f.pos = s.pos AND af > 0.01 AND af < 0.99), 0) AS pfb FROM fx_snps s", "fx_snps", "fx_pfb")
def snp_pfb_left_join(spark, sf):
    return quality_control.attach_frequency(table(spark, sf, "fx_snps"), table(spark, sf, "fx_pfb")).select("chrom", "pos", "pfb")


@query(
    "!f AS (SELECT s.chrom, s.pos, max(af) AS af, row_number() OVER (PARTITION BY s.chrom ORDER BY s.pos) AS r FROM fx_snps s JOIN fx_pfb f ON f.chrom = s.chrom AND f.pos = s.pos WHERE af > 0.01 AND af < 0.99 GROUP BY s.chrom, s.pos) SELECT s.chrom, s.pos, coalesce(af, 0) AS pfb FROM fx_snps s LEFT JOIN f ON s.chrom = f.chrom AND s.pos = f.pos AND r = 1",
    "fx_snps", "fx_pfb",
)
def pfb_first_match(spark, sf):
    return quality_control.attach_frequency(table(spark, sf, "fx_snps"), table(spark, sf, "fx_pfb"), True).select("chrom", "pos", "pfb")


@query("SELECT call_id, count(pos) AS n_snps FROM fx_calls c LEFT JOIN fx_snps s ON s.chrom = c.chrom AND pos BETWEEN start_pos AND end_pos GROUP BY call_id", "fx_calls", "fx_snps")
def window_snp_range_join(spark, sf):
    snps = table(spark, sf, "fx_snps").select("chrom", F.col("pos").alias("start_pos"), F.col("pos").alias("end_pos"))
    return intervals.overlap_counts(table(spark, sf, "fx_calls"), "call_id", snps).withColumnRenamed("n", "n_snps")


_OBSERVED = _BASES + """, m AS (SELECT chrom, sum(depth * (end_pos - start_pos + 1)) / sum(end_pos - start_pos + 1)::DOUBLE AS mean_cov FROM runs WHERE depth > 0 GROUP BY chrom),
snp AS MATERIALIZED (SELECT s.chrom, s.pos, CASE WHEN ad_ref + ad_alt > 0 THEN ad_alt / (ad_ref + ad_alt)::DOUBLE END AS baf, coalesce(f.af, 0)::DOUBLE AS pfb FROM fx_snps s
  LEFT JOIN (SELECT chrom, pos, max(af) AS af FROM fx_pfb WHERE af > 0.01 AND af < 0.99 GROUP BY ALL) f USING (chrom, pos) WHERE qual > 30 AND dp > 10 AND flt = 'PASS'),
inside AS MATERIALIZED (SELECT region_id, pos, baf, pfb FROM fx_regions r JOIN snp USING (chrom) WHERE pos BETWEEN start_pos AND end_pos),
reg AS (SELECT r.*, greatest(20, (SELECT count(*) FROM inside i WHERE i.region_id = r.region_id)) AS n FROM fx_regions r),
win AS (SELECT *, (end_pos - start_pos + 1) / n::DOUBLE AS step, unnest(range(0, n)) AS w FROM reg),
edge AS (SELECT *, CAST(floor(start_pos + w * step) AS BIGINT) AS a, CAST(floor(start_pos + (w + 1) * step) AS BIGINT) AS b FROM win),
one AS MATERIALIZED (SELECT region_id, chrom, a, b, max(w) AS w, any_value(least(end_pos, a + CAST(ceil(step) AS BIGINT) - 1)) AS d FROM edge GROUP BY region_id, chrom, a, b),
dep AS (SELECT one.region_id, one.w, sum(depth * (least(d, runs.end_pos) - greatest(a, runs.start_pos) + 1)) AS total FROM one JOIN runs ON runs.chrom = one.chrom AND depth > 0 AND runs.start_pos <= d AND runs.end_pos >= a GROUP BY ALL),
lr AS (SELECT one.*, CASE WHEN mean_cov IS NULL THEN 0 ELSE log2((CASE WHEN coalesce(total, 0) = 0 THEN 1e-9 ELSE total::DOUBLE END) / (d - a + 1) / mean_cov) END AS log2_cov FROM one LEFT JOIN m USING (chrom) LEFT JOIN dep USING (region_id, w)),
o AS (SELECT lr.region_id, w, coalesce(pos, (a + b) // 2) AS pos, log2_cov, CASE WHEN pos IS NULL THEN -1.0::DOUBLE ELSE baf END AS baf, CASE WHEN pos IS NULL THEN 0.5::DOUBLE ELSE pfb END AS pfb, pos IS NOT NULL AS is_snp
  FROM lr LEFT JOIN inside i ON i.region_id = lr.region_id AND i.pos BETWEEN a AND b)
SELECT region_id, row_number() OVER (PARTITION BY region_id ORDER BY w, pos, baf NULLS FIRST, pfb) AS t, pos, log2_cov, baf, pfb, is_snp FROM o"""


@query(_OBSERVED, "fx_alignments", "fx_snps", "fx_pfb", "fx_regions")
def region_observations(spark, sf):
    """Windows, depth and SNPs of all regions in one plan."""
    runs = store.stored(_runs(spark, sf))
    snps = quality_control.attach_frequency(quality_control.snp_filter(table(spark, sf, "fx_snps")), table(spark, sf, "fx_pfb"))
    return observations.observations(table(spark, sf, "fx_regions"), snps, runs, coverage.mean_coverage(runs))


_PAIR = "1 - least((least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) / (a.end_pos - a.start_pos)::DOUBLE, (least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) / (b.end_pos - b.start_pos)::DOUBLE) <= 0.1"


@query(f"SELECT a.chrom, a.sv_type, a.call_id AS a_id, b.call_id AS b_id FROM fx_calls a JOIN fx_calls b ON a.chrom = b.chrom AND a.sv_type = b.sv_type AND a.call_id < b.call_id AND a.start_pos <= b.end_pos AND b.start_pos <= a.end_pos AND {_PAIR}", "fx_calls")
def reciprocal_overlap_pairs(spark, sf):
    return intervals.reciprocal_pairs(table(spark, sf, "fx_calls"), "call_id", ["chrom", "sv_type"], 0.1)


@query(f"SELECT a.chrom, a.sv_type, a.call_id, count(*) AS n FROM fx_calls a JOIN fx_calls b ON a.chrom = b.chrom AND a.sv_type = b.sv_type AND a.start_pos <= b.end_pos AND b.start_pos <= a.end_pos AND {_PAIR} GROUP BY ALL HAVING count(*) >= 3", "fx_calls")
def dbscan2d_core_calls(spark, sf):
    # An id may stand for several calls; neighbours are counted by row and summed by id.
    n = clustering.core_intervals(table(spark, sf, "fx_calls"), "call_id", ["chrom", "sv_type"], 0.1, 1)
    return n.groupBy("chrom", "sv_type", "call_id").agg(F.sum("n").alias("n")).where("n >= 3")


@query()
def dbscan2d_clusters(spark, sf):
    """Clusters of all distinct calls; an id that stands for several spans gives each its own key."""
    calls = table(spark, sf, "fx_calls").select(F.xxhash64("call_id", "start_pos", "end_pos", "sv_type").alias("call_key"), "chrom", "sv_type", "start_pos", "end_pos").distinct()
    return clustering.dbscan_intervals(calls, "call_key", ["chrom", "sv_type"], 0.1, 3)


_D1 = """!n AS (SELECT call_id, chrom, start_pos AS x, count(*) OVER (PARTITION BY chrom ORDER BY start_pos RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM fx_calls),
core AS (SELECT DISTINCT chrom, x FROM n WHERE n >= 5), c AS (SELECT chrom, x, sum(CASE WHEN p IS NULL OR x - p > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY x) - 1 AS id FROM (SELECT chrom, x, lag(x) OVER (PARTITION BY chrom ORDER BY x) AS p FROM core)),
l AS (SELECT call_id, n.chrom, coalesce((SELECT id FROM c WHERE c.chrom = n.chrom AND c.x >= n.x AND c.x <= n.x + 2 ORDER BY c.x LIMIT 1), (SELECT id FROM c WHERE c.chrom = n.chrom AND c.x <= n.x AND c.x >= n.x - 2 ORDER BY c.x DESC LIMIT 1), -2)::INT AS cluster FROM n) """


@query(_D1 + "SELECT * FROM l", "fx_calls")
def dbscan1d_labels(spark, sf):
    return clustering.dbscan_1d(table(spark, sf, "fx_calls"), ["chrom"], "start_pos", "call_id", 2, 5).select("call_id", "chrom", "cluster")


@query(_D1 + "SELECT chrom, cluster, n FROM (SELECT chrom, cluster, count(*) AS n FROM l WHERE cluster >= 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY n DESC, cluster) = 1", "fx_calls")
def dbscan1d_largest(spark, sf):
    return clustering.largest_cluster(clustering.dbscan_1d(table(spark, sf, "fx_calls"), ["chrom"], "start_pos", "call_id", 2, 5), ["chrom"])


@query(
    """!d AS (SELECT *, start_pos // 50 AS cl, count(*) OVER w AS n, max(CASE WHEN hmm_lh <> 0 THEN 1 ELSE 0 END) OVER w AS h FROM fx_calls WINDOW w AS (PARTITION BY chrom, sv_type, start_pos // 50)),
a AS (SELECT * FROM d WHERE n > 1 AND h = 1 AND hmm_lh <> 0 QUALIFY row_number() OVER (PARTITION BY chrom, sv_type, cl ORDER BY cluster_size DESC, end_pos - start_pos DESC, call_id) = 1),
b AS (SELECT * FROM d WHERE n > 1 AND h = 0 QUALIFY row_number() OVER (PARTITION BY chrom, sv_type, cl ORDER BY end_pos - start_pos DESC, start_pos, call_id) = greatest(1, CAST(floor(n * 0.2) AS INT)) // 2 + 1)
SELECT call_id, cl, CAST(cluster_size AS BIGINT) AS cluster_size FROM a UNION ALL SELECT call_id, cl, n FROM b""",
    "fx_calls",
)
def merge_calls(spark, sf):
    d = table(spark, sf, "fx_calls").withColumn("cl", F.expr("start_pos div 50"))
    return clustering.merge_calls(d, ["chrom", "sv_type"], "cl", "call_id").select("call_id", "cl", "cluster_size")


@query("SELECT chrom, start_pos, end_pos, CAST(sum(cluster_size) AS BIGINT) AS cluster_size, max(sv_type) AS sv_type FROM fx_calls GROUP BY ALL", "fx_calls")
def dedupe_calls(spark, sf):
    return clustering.dedupe_calls(table(spark, sf, "fx_calls")).select("chrom", "start_pos", "end_pos", "cluster_size", "sv_type")


@query("SELECT chrom, sv_type, list_sort(list(start_pos))[count(*) // 2 + 1] AS median FROM fx_calls GROUP BY chrom, sv_type", "fx_calls")
def upper_median(spark, sf):
    calls = table(spark, sf, "fx_calls")
    return clustering.upper_median(calls, ["chrom", "sv_type"], "start_pos", parts=store.parts_for(calls))


@query(
    "!n AS (SELECT chrom, start_pos // 100 AS g, count(*) AS total, " + ", ".join(f"count(*) FILTER (cn_state = {s}) AS c{s}" for s in range(1, 7))
    + " FROM fx_calls GROUP BY ALL), b AS (SELECT *, greatest(c1, c2, c4, c5, c6) AS b FROM n) SELECT chrom, g, CASE WHEN b > 0.3 * total THEN CASE b WHEN c1 THEN 1 WHEN c2 THEN 2 WHEN c4 THEN 4 WHEN c5 THEN 5 ELSE 6 END WHEN c3 > 0.3 * total THEN 3 ELSE 0 END AS state FROM b",
    "fx_calls",
)
def state_vote_split(spark, sf):
    d = table(spark, sf, "fx_calls").groupBy("chrom", F.expr("start_pos div 100").alias("g")).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("cn_state") == s).alias(f"c{s}") for s in range(1, 7)))
    return d.select("chrom", "g", hmm.vote({s: f"c{s}" for s in range(1, 7)}, "total", 0.3).alias("state"))


_EM1 = [e.replace("power(", "pow(") for e in hmm.emission_log2(hmm.DEMO)]
_EM2 = [e.replace("power(", "pow(") for e in hmm.emission_baf(hmm.DEMO)]


@query("SELECT region_id, t, " + ", ".join(f"({e})::DOUBLE AS e{i + 1}" for i, e in enumerate(_EM1)) + " FROM fx_obs", "fx_obs")
def emission_log2(spark, sf):
    return table(spark, sf, "fx_obs").select("region_id", "t", *(F.expr(f"cast({e} AS double)").alias(f"e{i + 1}") for i, e in enumerate(hmm.emission_log2(hmm.DEMO))))


@query("SELECT region_id, t, " + ", ".join(f"({e})::DOUBLE AS e{i + 1}" for i, e in enumerate(_EM2)) + " FROM (SELECT region_id, t, baf::DOUBLE AS baf, pfb::DOUBLE AS pfb FROM fx_obs WHERE baf >= 0)", "fx_obs")
def emission_baf(spark, sf):
    d = table(spark, sf, "fx_obs").where("baf >= 0").select("region_id", "t", F.expr("cast(baf AS double) AS baf"), F.expr("cast(pfb AS double) AS pfb"))
    return d.select("region_id", "t", *(F.expr(f"cast({e} AS double)").alias(f"e{i + 1}") for i, e in enumerate(hmm.emission_baf(hmm.DEMO))))


def _obs(spark, sf):
    return table(spark, sf, "fx_obs").select("region_id", "t", "log2_cov", F.expr("cast(baf AS double) AS baf"), F.expr("cast(pfb AS double) AS pfb"))


def _viterbi_sql() -> str:
    em = ", ".join(f"({a} + CASE WHEN baf = -1 THEN 0 ELSE {b} END)::DOUBLE AS e{i}" for i, (a, b) in enumerate(zip(_EM1, _EM2)))
    import math

    a = hmm.DEMO.a
    step = ", ".join(f"greatest({', '.join(f'd{i} + {math.log(a[i][j])!r}' for i in range(6))}) + e{j}" for j in range(6))
    first = ", ".join(f"{math.log(p)!r} + e{i} AS d{i}" for i, p in enumerate(hmm.DEMO.pi))
    return f"""!em AS MATERIALIZED (SELECT region_id, t, {em} FROM (SELECT region_id, t, log2_cov, baf::DOUBLE AS baf, pfb::DOUBLE AS pfb FROM fx_obs)),
v AS (SELECT region_id, t, {first} FROM em WHERE t = 1 UNION ALL SELECT em.region_id, em.t, {step} FROM v JOIN em ON em.region_id = v.region_id AND em.t = v.t + 1)
SELECT region_id, greatest(d0, d1, d2, d3, d4, d5) AS likelihood FROM v QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY t DESC) = 1"""


@query(_viterbi_sql(), "fx_obs")
def viterbi_likelihood(spark, sf):
    return hmm.viterbi_likelihoods(_obs(spark, sf), hmm.DEMO)


def _viterbi_path_sql() -> str:
    """As above, with the best path to each state as text; ties go to the lowest state."""
    import math

    a = hmm.DEMO.a
    em = ", ".join(f"({x} + CASE WHEN baf = -1 THEN 0 ELSE {y} END)::DOUBLE AS e{i}" for i, (x, y) in enumerate(zip(_EM1, _EM2)))
    way = lambda i, j: f"d{i} + {math.log(a[i][j])!r}"
    top = lambda j: f"greatest({', '.join(way(i, j) for i in range(6))})"
    came = lambda j: f"CASE {top(j)} " + " ".join(f"WHEN {way(i, j)} THEN p{i}" for i in range(6)) + f" END || ',{j + 1}'"
    first = ", ".join(f"{math.log(p)!r} + e{i} AS d{i}" for i, p in enumerate(hmm.DEMO.pi)) + ", " + ", ".join(f"'{i + 1}' AS p{i}" for i in range(6))
    step = ", ".join(f"{top(j)} + e{j}" for j in range(6)) + ", " + ", ".join(came(j) for j in range(6))
    best = "CASE greatest(d0, d1, d2, d3, d4, d5) " + " ".join(f"WHEN d{i} THEN p{i}" for i in range(6)) + " END"
    return f"""!em AS MATERIALIZED (SELECT region_id, t, {em} FROM (SELECT region_id, t, log2_cov, baf::DOUBLE AS baf, pfb::DOUBLE AS pfb FROM fx_obs)),
v AS (SELECT region_id, t, {first} FROM em WHERE t = 1 UNION ALL SELECT em.region_id, em.t, {step} FROM v JOIN em ON em.region_id = v.region_id AND em.t = v.t + 1)
SELECT region_id, {best} AS path FROM v QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY t DESC) = 1"""


@query(_viterbi_path_sql(), "fx_obs")
def viterbi_path(spark, sf):
    return hmm.viterbi(_obs(spark, sf), hmm.DEMO).select("region_id", F.array_join("path", ",").alias("path"))


@query(
    """SELECT call_id, CASE WHEN sv_type = 'INS' AND cn_state IN (5, 6) THEN 'DUP' ELSE sv_type END AS new_type, (sv_type = 'DEL' AND cn_state IN (1, 2, 4)) OR (sv_type = 'INS' AND cn_state IN (5, 6)) AS updated,
  CASE cn_state WHEN 0 THEN './.' WHEN 1 THEN '1/1' WHEN 2 THEN '0/1' WHEN 3 THEN '0/0' WHEN 4 THEN '1/1' WHEN 5 THEN '0/1' ELSE '1/1' END AS genotype FROM fx_calls WHERE sv_type IN ('DEL', 'INS')""",
    "fx_calls",
)
def cn_update_ladder(spark, sf):
    d = table(spark, sf, "fx_calls").where("sv_type IN ('DEL', 'INS')").withColumn("voted", codes.lookup("cn_state", codes.STATE_TYPE))
    d = d.withColumn("voted", F.when(F.col("voted") == "LOH", F.col("sv_type")).otherwise(F.col("voted")))
    d = d.withColumn("updated", codes.valid_update(F.col("sv_type"), F.col("voted")))
    return d.select("call_id", F.when(F.col("updated"), F.col("voted")).otherwise(F.col("sv_type")).alias("new_type"), "updated", codes.lookup("cn_state", codes.STATE_GENOTYPE).alias("genotype"))


@query(
    """!e AS (SELECT -call_id AS call_id, chrom, start_pos, end_pos, 'DEL' AS sv_type, hmm_lh - 1 AS hmm_lh FROM fx_calls WHERE sv_type = 'INS' AND cn_state IN (1, 2))
SELECT call_id, chrom, start_pos, end_pos, sv_type, hmm_lh FROM fx_calls ANTI JOIN e USING (chrom, start_pos, end_pos, sv_type) UNION ALL SELECT * FROM e""",
    "fx_calls",
)
def upsert_calls(spark, sf):
    """Deletions that the model sees in insertions are put in, in place of calls of equal span and type."""
    from .calling import upserted

    d = table(spark, sf, "fx_calls").select("call_id", "chrom", "start_pos", "end_pos", "sv_type", "hmm_lh", "cn_state")
    extra = d.where("sv_type = 'INS' AND cn_state IN (1, 2)").withColumns({"call_id": -F.col("call_id"), "sv_type": F.lit("DEL"), "hmm_lh": F.col("hmm_lh") - 1})
    return upserted(d, extra).drop("cn_state")


@query("SELECT call_id, sv_type FROM fx_calls WHERE sv_type IN ('DEL', 'DUP') UNION ALL SELECT call_id, sv_type FROM fx_calls WHERE sv_type = 'INV'", "fx_calls")
def union_calls(spark, sf):
    d = table(spark, sf, "fx_calls").select("call_id", "sv_type")
    return d.where("sv_type IN ('DEL', 'DUP')").unionByName(d.where("sv_type = 'INV'"))


@query(
    """!r AS (SELECT *, CASE sv_type WHEN 'DEL' THEN greatest(1, start_pos - 1) WHEN 'INS' THEN start_pos - 1 ELSE start_pos END AS pos, CASE sv_type WHEN 'DEL' THEN end_pos WHEN 'INS' THEN start_pos - 1 END AS ref_end,
  CASE WHEN chrom = 'chr5' THEN 9000 ELSE 262144 END AS len FROM fx_calls WHERE NOT (sv_type = 'INS' AND start_pos <= 1)),
q AS (SELECT *, CASE WHEN ref_end <= len THEN substr(repeat('ACGTRYN', 60), CAST(1 + (pos - 1) % 7 AS INT), CAST(ref_end - pos + 1 AS INT)) ELSE '' END AS bases FROM r),
dp AS (SELECT p.chrom, p.pos, count(a.aln_id) AS depth FROM (SELECT DISTINCT chrom, pos FROM r) p LEFT JOIN fx_alignments a ON p.chrom = a.chrom AND p.pos BETWEEN a.start_pos AND a.end_pos AND a.flag & 1796 = 0 GROUP BY ALL)
SELECT chrom AS "CHROM", pos AS "POS", CASE WHEN bases = '' THEN 'N' ELSE regexp_replace(bases, '[RY]', 'N', 'g') END AS "REF", CASE WHEN sv_type = 'DEL' AND bases <> '' THEN left(bases, 1) ELSE '<' || sv_type || '>' END AS "ALT",
  CASE WHEN EXISTS (SELECT 1 FROM fx_gaps g WHERE g.chrom = q.chrom AND (least(q.end_pos, g.end_pos + 1) - greatest(q.start_pos, g.start_pos + 1) + 1) / (q.end_pos - q.start_pos + 1)::DOUBLE > 0.2) THEN 'AssemblyGap' ELSE 'PASS' END AS "FILTER",
  'END=' || CASE sv_type WHEN 'INS' THEN start_pos - 1 ELSE end_pos END || ';SVTYPE=' || sv_type || ';SVLEN=' || CASE sv_type WHEN 'DEL' THEN -1 ELSE 1 END * (end_pos - start_pos + 1) || ';SVMETHOD=strandlake 0.2;ALN=' || """ + _EVIDENCE + """ || ';HMM=' || printf('%.6f', hmm_lh::DOUBLE) || ';SUPPORT=' || depth || ';CLUSTER=' || cluster_size
  || ';ALNOFFSET=' || (cn_state - 3) || ';CN=' || cn_state || CASE WHEN cn_state = 4 THEN ';LOH' ELSE '' END AS "INFO", """ + _GENOTYPE + """ || ':' || depth AS "SAMPLE" FROM q JOIN dp USING (chrom, pos)""",
    "fx_calls", "fx_alignments", "fx_gaps",
)
def vcf_format_rows(spark, sf):
    """Records of all calls: depth and bases at the record's position, over the tiled reference."""
    # Calls are dealt without what is told from their other columns.
    d = vcf_out.output_span(intervals.gap_flag(table(spark, sf, "fx_calls").drop("call_id"), table(spark, sf, "fx_gaps")))
    d = text.substring_at(reference(spark), d.drop("pos"), ["chrom", "ref_start", "ref_end"], "ref_start", "ref_end")
    d = coverage.depth_at(vcf_out.output_span(d).drop("ref_start", "ref_end"), _runs(spark, sf)).withColumnRenamed("depth", "support")
    more = {"alt": F.expr("concat('<', sv_type, '>')"), "evidence": F.col("cluster_size"), "aln_offset": F.col("cn_state") - 3, "genotype": codes.lookup("cn_state", codes.STATE_GENOTYPE)}
    return vcf_out.format_rows(d.withColumns(more))


@query("SELECT call_id, concat_ws(',', " + ", ".join(f"CASE WHEN cluster_size & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(codes.EVIDENCE)) + ") AS evidence FROM fx_calls", "fx_calls")
def evidence_string(spark, sf):
    return table(spark, sf, "fx_calls").select("call_id", codes.evidence_names("cluster_size").alias("evidence"))


@query("SELECT call_id, regexp_replace(sv_type || 'acgtRYKMn', '[RYKMSWBDHVrykmswbdhv]', 'N', 'g') AS bases FROM fx_calls", "fx_calls")
def ambiguous_to_n(spark, sf):
    return table(spark, sf, "fx_calls").withColumn("b", F.concat("sv_type", F.lit("acgtRYKMn"))).select("call_id", codes.plain_bases("b").alias("bases"))


_RX = lambda k: f"CAST(regexp_extract(info, '(^|;){k}=(-?[0-9]+)', 2) AS BIGINT)"


@query(f"SELECT call_id, {_RX('END')} AS end_pos, regexp_extract(info, 'SVTYPE=([A-Z]+)', 1) AS sv_type, {_RX('SVLEN')} AS sv_len, {_RX('SUPPORT')} AS support, {_RX('CLIPSUP')} AS clipsup, info LIKE '%;LOH' AS loh FROM fx_info", "fx_info")
def info_parse(spark, sf):
    return vcf_out.info_map(table(spark, sf, "fx_info").select("call_id", "info")).drop("info")


@query("SELECT call_id, regexp_replace(info, ';SUPPORT=[0-9]+', ';SUPPORT=' || (cluster_size + 1)) || ';CLUSTER=' || cluster_size || ';' AS info FROM fx_info", "fx_info")
def support_rewrite(spark, sf):
    return vcf_out.rewrite_support(table(spark, sf, "fx_info"), "cluster_size + 1", "cluster_size").select("call_id", "info")


@query()
def cnv_json_rows(spark, sf):
    """The JSON objects of all regions as if each were a copy-number call: observations inside and in both flanks, and the best path's states."""
    calls = table(spark, sf, "fx_regions").selectExpr("region_id", "chrom", "start_pos", "end_pos", "if(region_id % 2 = 0, 'DEL', 'DUP') AS sv_type")
    contigs = spark.createDataFrame(list(CONTIGS.items()), "chrom string, length bigint")
    runs = store.stored(_runs(spark, sf))
    snps = quality_control.attach_frequency(quality_control.snp_filter(table(spark, sf, "fx_snps")), table(spark, sf, "fx_pfb"))
    from .calling import cnv_records

    return cnv_records(calls, snps, runs, coverage.mean_coverage(runs), hmm.DEMO, contigs)


_KNOWN = """!k AS (SELECT *, split_part(gt_father, '/', 1) AS f1, split_part(gt_father, '/', 2) AS f2, split_part(gt_mother, '/', 1) AS m1, split_part(gt_mother, '/', 2) AS m2 FROM fx_trio WHERE gt_father <> './.' AND gt_mother <> './.' AND gt_child <> './.'),
e AS (SELECT *, CASE WHEN gt_child IN (least(f1, m1) || '/' || greatest(f1, m1), least(f1, m2) || '/' || greatest(f1, m2), least(f2, m1) || '/' || greatest(f2, m1), least(f2, m2) || '/' || greatest(f2, m2)) THEN 0 ELSE 1 END AS error FROM k) """


@query(_KNOWN + "SELECT sv_type, CAST(sum(error) AS BIGINT) AS errors, count(*) AS total FROM e GROUP BY sv_type", "fx_trio")
def trio_mendelian_ordinal(spark, sf):
    """Three call sets, each numbered in its own order, put side by side by number."""
    t = table(spark, sf, "fx_trio")
    part = lambda *c: store.numbered(t.select("ord", *c), ["ord"])
    return quality_control.mendelian(filters.zip_trio(part("sv_type", "gt_child"), part("gt_father"), part("gt_mother")), ["sv_type"])


@query(_KNOWN + "SELECT chrom, CAST(sum(error) AS BIGINT) AS errors, count(*) AS total FROM e GROUP BY chrom", "fx_trio")
def trio_mendelian_pos(spark, sf):
    t = table(spark, sf, "fx_trio")
    part = lambda g: t.select("chrom", "pos", g)
    return quality_control.mendelian(part("gt_child").join(part("gt_father"), ["chrom", "pos"]).join(part("gt_mother"), ["chrom", "pos"]), ["chrom"])


@query(
    """SELECT sv_type, count(*) AS n, min(s) AS min_size, max(s) AS max_size, avg(s) AS mean_size, quantile_cont(s, 0.5) AS median_size, stddev_pop(s) AS sd_size, count(*) FILTER (s > 10000) AS over_10000,
  count(*) FILTER (s > 50000) AS over_50000, count(*) FILTER (s > 100000) AS over_100000 FROM (SELECT *, (end_pos - start_pos) * 500 AS s FROM fx_calls) GROUP BY ROLLUP (sv_type)""",
    "fx_calls",
)
def sv_size_stats(spark, sf):
    """Sizes of 500 times the calls' spans, so that all bounds are met; the last row is over all types."""
    return quality_control.size_statistics(table(spark, sf, "fx_calls").withColumn("size", (F.col("end_pos") - F.col("start_pos")) * 500))


@query("SELECT sv_type, CASE WHEN s < 80 THEN 0 WHEN s < 120 THEN 1 WHEN s < 200 THEN 2 ELSE 3 END AS bucket, count(*) AS n FROM (SELECT *, end_pos - start_pos AS s FROM fx_calls) GROUP BY ALL", "fx_calls")
def sv_size_buckets(spark, sf):
    return quality_control.size_buckets(table(spark, sf, "fx_calls").withColumn("size", F.col("end_pos") - F.col("start_pos")), (80, 120, 200))


@query("!c AS (SELECT sv_type, cn_state AS eps, count(*) FILTER (hmm_lh <> 0 AND cluster_size > 25) AS tp, count(*) FILTER (hmm_lh <> 0 AND cluster_size <= 25) AS fp, count(*) FILTER (hmm_lh = 0 AND cluster_size > 25) AS fn FROM fx_calls GROUP BY ALL), r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r FROM c) SELECT sv_type, eps, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM r QUALIFY row_number() OVER (PARTITION BY sv_type ORDER BY coalesce(2 * p * r / nullif(p + r, 0), 0) DESC, eps) = 1", "fx_calls")
def f1_best_param(spark, sf):
    """A call with a likelihood is predicted, one of over 25 reads is true; the parameter of the best F1 per type."""
    said, true = "hmm_lh <> 0", "cluster_size > 25"
    n = {"tp": f"{said} AND {true}", "fp": f"{said} AND NOT {true}", "fn": f"NOT {said} AND {true}"}
    d = table(spark, sf, "fx_calls").groupBy("sv_type", F.col("cn_state").alias("eps")).agg(*(F.count_if(F.expr(e)).alias(k) for k, e in n.items()))
    return quality_control.best_f1(quality_control.precision_recall(d))


@query(
    "!s AS (SELECT chrom, call_id, end_pos - start_pos AS a, cluster_size AS b FROM fx_calls), m AS (SELECT *, 0.5 * coalesce((a - min(a) OVER w) / nullif(max(a) OVER w - min(a) OVER w, 0)::DOUBLE, 0) + 0.5 * coalesce((b - min(b) OVER w) / nullif(max(b) OVER w - min(b) OVER w, 0)::DOUBLE, 0) AS score FROM s WINDOW w AS (PARTITION BY chrom)) SELECT chrom, call_id, score FROM m QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY score DESC, call_id) = 1",
    "fx_calls",
)
def normalised_score(spark, sf):
    d = table(spark, sf, "fx_calls").select("chrom", "call_id", (F.col("end_pos") - F.col("start_pos")).alias("a"), F.col("cluster_size").alias("b"))
    return clustering.normalised_score(d, ["chrom"], "call_id").select("chrom", "call_id", "score")


@query("SELECT doc_id, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INT) AS code, n_chars::DOUBLE AS sv_length, label FROM (SELECT d.*, l.quality AS label, min(d.doc_id) OVER (PARTITION BY source) AS f FROM documents d JOIN labels l USING (doc_id))")
def lr_features(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars", "source").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return quality_control.lr_features(d)


@query(
    "!s AS (SELECT sv_type, end_pos - start_pos AS s FROM fx_calls), m AS (SELECT sv_type, s, min(s) OVER (PARTITION BY sv_type) AS lo, max(s) OVER (PARTITION BY sv_type) AS hi FROM s) SELECT sv_type, CASE WHEN hi = lo THEN 0 ELSE least(99, CAST(floor((s - lo) * 100::DOUBLE / (hi - lo)) AS INT)) END AS bin, count(*) AS n FROM m GROUP BY ALL",
    "fx_calls",
)
def sv_size_hist(spark, sf):
    return reports.size_histogram(table(spark, sf, "fx_calls").withColumn("size", F.col("end_pos") - F.col("start_pos")))


@query(
    "!a AS (SELECT DISTINCT chrom, start_pos FROM fx_calls WHERE sv_type = 'DEL'), b AS (SELECT DISTINCT chrom, start_pos FROM fx_calls WHERE sv_type = 'INS'), x AS (SELECT count(*) AS n FROM a SEMI JOIN b USING (chrom, start_pos)) SELECT n AS n_both, (SELECT count(*) FROM a) - n AS n_a, (SELECT count(*) FROM b) - n AS n_b FROM x",
    "fx_calls",
)
def call_set_overlap(spark, sf):
    d = table(spark, sf, "fx_calls")
    return reports.call_set_overlap(d.where("sv_type = 'DEL'"), d.where("sv_type = 'INS'"), ["chrom", "start_pos"])


@query(
    _SPLIT + ", r AS (SELECT p.chrom, p.start_pos // 1000 AS g, p.qname, max(CASE WHEN (p.flag & 16) <> (s.flag & 16) THEN 1 ELSE 0 END) AS inv FROM p JOIN s ON p.qname = s.qname AND p.chrom = s.chrom GROUP BY ALL) SELECT chrom, g, avg(inv) > 0.5 AS inverted, count(*) AS n_reads FROM r GROUP BY ALL",
    "fx_alignments",
)
def inversion_vote(spark, sf):
    pairs = reads.split_pairs(table(spark, sf, "fx_alignments")).withColumn("g", F.expr("p_start_pos div 1000"))
    return reports.inversion_vote(pairs, ["chrom", "g"])


@query(
    "!h AS (SELECT *, (end_pos - start_pos) // 2 AS h FROM fx_calls) SELECT call_id AS region_id, 'before' AS section, greatest(1, start_pos - h) AS start_pos, greatest(1, start_pos - 1) AS end_pos FROM h UNION ALL SELECT call_id, 'sv', start_pos, end_pos FROM h UNION ALL SELECT call_id, 'after', end_pos + 1, end_pos + h FROM h",
    "fx_calls",
)
def flank_regions(spark, sf):
    return reports.flanks(table(spark, sf, "fx_calls").withColumnRenamed("call_id", "region_id"))


_VOTED = "CASE cn_state WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'DEL' WHEN 2 THEN 'DEL' WHEN 3 THEN 'NEUTRAL' WHEN 4 THEN 'LOH' ELSE 'DUP' END"


@query(
    f"""!c AS (SELECT call_id, CASE sv_type WHEN 'DEL' THEN 'UNKNOWN' WHEN 'DUP' THEN 'INS' ELSE sv_type END AS sv_type, {_VOTED} AS voted FROM fx_calls)
SELECT call_id, CASE WHEN sv_type || voted IN ('UNKNOWNDEL', 'UNKNOWNDUP', 'INSDUP') THEN voted ELSE sv_type END AS new_type, voted <> 'UNKNOWN' AND sv_type || voted NOT IN ('UNKNOWNLOH', 'UNKNOWNNEUTRAL', 'INSDEL') AS annotated, false AS added FROM c
UNION ALL SELECT call_id, 'DEL', true, true FROM c WHERE sv_type || voted = 'INSDEL'""",
    "fx_calls",
)
def split_update_ladder(spark, sf):
    d = table(spark, sf, "fx_calls").select("call_id", F.expr("CASE sv_type WHEN 'DEL' THEN 'UNKNOWN' WHEN 'DUP' THEN 'INS' ELSE sv_type END AS sv_type"), codes.lookup("cn_state", codes.STATE_TYPE).alias("voted"))
    return reports.split_update(d).select("call_id", "new_type", "annotated", "added")


@query("!n AS (SELECT region_id, state, count(*) AS n FROM fx_states WHERE pos BETWEEN start_pos AND end_pos GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY region_id) AS total FROM n) SELECT region_id, CAST(CASE WHEN n / total::DOUBLE < 0.5 THEN 0 ELSE state END AS INT) AS cn_state FROM t QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY n DESC, state) = 1", "fx_states")
def state_vote_cigar(spark, sf):
    return hmm.majority_state(table(spark, sf, "fx_states"), ["region_id"])


@query("!t AS (SELECT call_id, CASE WHEN cn_state = 0 THEN 'UNKNOWN' WHEN cn_state = 3 THEN 'NEUTRAL' ELSE sv_type END AS sv_type FROM fx_calls) SELECT call_id, sv_type FROM t WHERE sv_type NOT IN ('UNKNOWN', 'NEUTRAL')", "fx_calls")
def valid_type_filter(spark, sf):
    d = table(spark, sf, "fx_calls").select("call_id", F.expr("CASE cn_state WHEN 0 THEN 'UNKNOWN' WHEN 3 THEN 'NEUTRAL' ELSE sv_type END AS sv_type"))
    return filters.known_types(d)


@query("SELECT chrom, count(*) AS n FROM fx_calls GROUP BY chrom UNION ALL SELECT NULL, count(*) FROM fx_calls", "fx_calls")
def call_totals(spark, sf):
    return table(spark, sf, "fx_calls").rollup("chrom").agg(F.count(F.lit(1)).alias("n"))


@query("WITH f AS (SELECT CAST(dense_rank() OVER (ORDER BY f) - 1 AS INT) AS code, n_chars::DOUBLE AS sv_length, label FROM (SELECT d.*, l.quality AS label, min(d.doc_id) OVER (PARTITION BY source) AS f FROM documents d JOIN labels l USING (doc_id))) SELECT CAST(least(9, floor(10 / (1 + exp(-(0.25 * code + 0.0004 * sv_length - 1.5))))) AS INT) AS bin, label, count(*) AS n FROM f GROUP BY ALL")
def lr_score_hist(spark, sf):
    """Probabilities of a model with given weights, counted per bin and label."""
    return quality_control.score_histogram(quality_control.logistic_score(lr_features(spark, sf), {"code": 0.25, "sv_length": 0.0004}, -1.5))


_FEATURES = """!r AS (SELECT row_number() OVER (ORDER BY call_id, info) AS ordinal, call_id, chrom, start_pos, cluster_size, info || CASE WHEN cluster_size % 7 = 0 THEN ';REPTYPE=DUP' ELSE '' END AS info FROM fx_info),
f AS (SELECT chrom, min(CASE WHEN cluster_size > 25 THEN 0 ELSE 1 END * 10000000000 + ordinal) AS f FROM r GROUP BY chrom), k AS (SELECT chrom, CAST(row_number() OVER (ORDER BY f) - 1 AS INT) AS chrom_code FROM f) """


@query(
    _FEATURES
    + f"""SELECT call_id, chrom_code, start_pos AS start, {_RX('SVLEN')}::INT AS sv_length, CASE CASE WHEN info LIKE '%REPTYPE=DUP%' THEN 'DUP' ELSE regexp_extract(info, 'SVTYPE=([A-Z]+)', 1) END WHEN 'DEL' THEN 0 WHEN 'DUP' THEN 1 WHEN 'INV' THEN 2 ELSE 3 END::INT AS type_code,
  {_RX('SUPPORT')}::INT AS read_support, {_RX('CLIPSUP')}::INT AS clipped_bases, CASE WHEN cluster_size > 25 THEN 1 ELSE 0 END AS label FROM r JOIN k USING (chrom)""",
    "fx_info",
)
def call_features(spark, sf):
    """The six features of two labelled call sets under one table of contig codes."""
    true, false = _call_sets(spark, sf)
    codes_of = scoring.contig_codes(true, false)
    d = filters.labelled_union({1: scoring.call_features(true, codes_of), 0: scoring.call_features(false, codes_of)})
    return d.select("call_id", *scoring.FEATURES, "label")


def _call_sets(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Calls of many and of few reads; their place is in one order of id and INFO, without a number."""
    d = table(spark, sf, "fx_info").withColumn("ordinal", F.struct("call_id", "info")).withColumn("info", F.expr("concat(info, if(cluster_size % 7 = 0, ';REPTYPE=DUP', ''))")).withColumnRenamed("start_pos", "pos")
    return d.where("cluster_size > 25"), d.where("cluster_size <= 25")


@query()
def lr_train_score(spark, sf):
    """A model trained on the two call sets, and the probability of every call."""
    rows, _ = scoring.labelled_features(*_call_sets(spark, sf))
    return scoring.score_features(rows, scoring.fit(rows)).select("call_id", "label", "score")


@query()
def lr_fitted_hist(spark, sf):
    """The histogram of the trained model's scores per label."""
    return quality_control.score_histogram(lr_train_score(spark, sf))


@query("SELECT count(*) FILTER (gt_father <> './.' AND gt_mother <> './.' AND gt_child <> './.' AND ((gt_father = gt_mother AND gt_father <> gt_child) OR (gt_father <> gt_mother AND (gt_father = gt_child OR gt_mother = gt_child)))) AS errors, count(*) AS total, errors / total::DOUBLE AS rate FROM fx_trio", "fx_trio")
def trio_scenarios(spark, sf):
    return quality_control.parent_scenarios(table(spark, sf, "fx_trio"))


@query("SELECT sv_type, row_number() OVER (ORDER BY sv_type) - 1 AS place FROM (SELECT DISTINCT sv_type FROM fx_calls)", "fx_calls")
def type_order(spark, sf):
    return filters.types_in_order(table(spark, sf, "fx_calls")).select("sv_type", F.col("place").cast("bigint").alias("place"))


@query("SELECT ord, gt_child FROM fx_trio ORDER BY ord LIMIT 10000", "fx_trio")
def first_trio_rows(spark, sf):
    """The head of the child's records, as the trio report reads it."""
    return filters.first_rows(table(spark, sf, "fx_trio"), ["ord"]).select("ord", "gt_child")


@query("SELECT call_id FROM fx_calls WHERE end_pos - start_pos >= 120 AND chrom = 'chr2'", "fx_calls")
def drawn_calls(spark, sf):
    return filters.drawn(table(spark, sf, "fx_calls"), 120, "chr2").select("call_id")


@query("SELECT region_id, t, CASE WHEN baf <> -1 THEN baf ELSE 0 END::DOUBLE AS baf FROM fx_obs", "fx_obs")
def drawn_baf(spark, sf):
    return table(spark, sf, "fx_obs").withColumn("is_snp", F.col("baf") != -1).select("region_id", "t", filters.shown_baf().cast("double").alias("baf"))


@query(
    """!x AS (SELECT *, try_cast(nullif(regexp_extract(line, '#EPSILON=([0-9.]+)', 1), '') AS DOUBLE) AS e, CASE WHEN line LIKE 'Running truvari%' THEN regexp_extract(line, 'on ([A-Z]+) calls', 1) WHEN line LIKE '%recall%' THEN '' END AS mark FROM fx_log),
y AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS eps, last_value(mark IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section FROM x),
z AS (SELECT file, line_no, eps, section, unnest([{m: 'comp', v: try_cast(nullif(regexp_extract(line, '.comp.: ([0-9]+)', 1), '') AS DOUBLE)}, {m: 'base', v: try_cast(nullif(regexp_extract(line, '.base.: ([0-9]+)', 1), '') AS DOUBLE)},
  {m: 'FP', v: try_cast(nullif(regexp_extract(line, '"FP": ([0-9]+)', 1), '') AS DOUBLE)}, {m: 'FN', v: try_cast(nullif(regexp_extract(line, '"FN": ([0-9]+)', 1), '') AS DOUBLE)},
  {m: 'precision', v: try_cast(nullif(regexp_extract(line, '"precision": ([0-9.]+)', 1), '') AS DOUBLE)}, {m: 'recall', v: try_cast(nullif(regexp_extract(line, '"recall": ([0-9.]+)', 1), '') AS DOUBLE)}]) AS m FROM y WHERE section <> '')
SELECT file, line_no, eps, section, m.m AS metric, m.v AS value FROM z WHERE m.v IS NOT NULL""",
    "fx_log",
)
def benchmark_log_parse(spark, sf):
    return quality_control.benchmark_log(table(spark, sf, "fx_log"))


@query()
def variant_calls(spark, sf):
    """The whole plan over all alignments, SNPs and frequencies: candidates, copy numbers, split reads, merging, records."""
    from .calling import CallerParams, call_variants

    aln, _ = _reads(spark, sf)
    snps = quality_control.attach_frequency(quality_control.snp_filter(table(spark, sf, "fx_snps")), table(spark, sf, "fx_pfb"))
    return call_variants(aln.drop("end_pos", "query_start", "query_end"), reference(spark), snps, table(spark, sf, "fx_gaps"), hmm.DEMO, CallerParams(min_cnv=30))


@query()
def cigar_call_set(spark, sf):
    """CIGAR candidates through clustering and merging to one call per cluster."""
    from .calling import CallerParams, cigar_calls

    return cigar_calls(table(spark, sf, "fx_alignments"), CallerParams(min_points=2)).drop("call_id")


@query()
def split_read_calls(spark, sf):
    """Split-read candidates of all alignments; the fixture has few and short reads, so two points make a cluster and 50 bases a call."""
    return split_calls.split_read_calls(table(spark, sf, "fx_alignments"), 400, 2, 50)


_NOISE = """!d AS (SELECT *, CASE WHEN start_pos % 5 < 3 THEN start_pos // 50 END AS cl FROM fx_calls),
n AS (SELECT *, count(*) OVER w AS n, max(CASE WHEN hmm_lh <> 0 THEN 1 ELSE 0 END) OVER w AS h, count(*) OVER (PARTITION BY chrom, sv_type) AS total FROM d WINDOW w AS (PARTITION BY chrom, sv_type, cl)),
a AS (SELECT * FROM n WHERE n > 1 AND total > 1 AND {c} AND h = 1 AND hmm_lh <> 0 QUALIFY row_number() OVER (PARTITION BY chrom, sv_type, cl ORDER BY cluster_size DESC, end_pos - start_pos DESC, call_id) = 1),
b AS (SELECT * FROM n WHERE n > 1 AND total > 1 AND {c} AND h = 0 QUALIFY row_number() OVER (PARTITION BY chrom, sv_type, cl ORDER BY end_pos - start_pos DESC, start_pos, call_id) = greatest(1, CAST(floor(n * 0.2) AS INT)) // 2 + 1)
SELECT call_id, cl, CAST(cluster_size AS BIGINT) AS cluster_size FROM a UNION ALL SELECT call_id, cl, n FROM b UNION ALL SELECT call_id, cl, cluster_size FROM n WHERE total = 1{k}"""


def _noise(spark, sf, policy):
    d = table(spark, sf, "fx_calls").withColumn("cl", F.expr("CASE WHEN start_pos % 5 < 3 THEN start_pos div 50 END"))
    return clustering.merge_calls(d, ["chrom", "sv_type"], "cl", "call_id", policy).select("call_id", "cl", "cluster_size")


@query(_NOISE.format(c="cl IS NOT NULL", k=" UNION ALL SELECT call_id, cl, cluster_size FROM n WHERE cl IS NULL AND n > 1 AND total > 1"), "fx_calls")
def merge_calls_keep_noise(spark, sf):
    return _noise(spark, sf, "keep")


@query(_NOISE.format(c="true", k=""), "fx_calls")
def merge_calls_merge_noise(spark, sf):
    return _noise(spark, sf, "merge")


@query("SELECT call_id, sv_type, end_pos - start_pos + 1 AS length FROM fx_calls WHERE start_pos <= end_pos AND end_pos - start_pos + 1 BETWEEN 100 AND 200 AND end_pos - start_pos >= 120", "fx_calls")
def length_filters(spark, sf):
    """The validity, length-range and minimum-length rules one after the other, with bounds that the fixture meets."""
    d = filters.long_enough(filters.length_between(filters.valid_spans(table(spark, sf, "fx_calls")), 100, 200), 120)
    return d.select("call_id", "sv_type", (F.col("end_pos") - F.col("start_pos") + 1).alias("length"))


@query("!t AS (SELECT *, CASE WHEN cn_state = 0 THEN 'UNKNOWN' WHEN cn_state = 3 THEN 'NEUTRAL' ELSE sv_type END AS kind FROM fx_calls) SELECT call_id, kind AS sv_type FROM t WHERE kind NOT IN ('UNKNOWN', 'NEUTRAL') AND end_pos - start_pos >= 150", "fx_calls")
def saved_cnv_filter(spark, sf):
    d = table(spark, sf, "fx_calls").withColumn("sv_type", F.expr("CASE cn_state WHEN 0 THEN 'UNKNOWN' WHEN 3 THEN 'NEUTRAL' ELSE sv_type END"))
    return filters.saved_cnvs(d, 150).select("call_id", "sv_type")


@query("SELECT chrom, min(pos) AS first_pos, max(pos) AS last_pos FROM fx_snps GROUP BY chrom", "fx_snps")
def snp_bounds(spark, sf):
    return filters.position_bounds(table(spark, sf, "fx_snps"))


@query("!t AS (SELECT call_id, chrom || CASE WHEN cn_state = 0 THEN '' ELSE ':' || start_pos || '-' || end_pos END AS region FROM fx_calls) SELECT call_id, split_part(region, ':', 1) AS chrom, try_cast(nullif(regexp_extract(region, ':([0-9]+)-', 1), '') AS BIGINT) AS start_pos, try_cast(nullif(regexp_extract(region, '-([0-9]+)$', 1), '') AS BIGINT) AS end_pos FROM t", "fx_calls")
def region_parse(spark, sf):
    d = table(spark, sf, "fx_calls").select("call_id", F.expr("concat(chrom, if(cn_state = 0, '', concat(':', start_pos, '-', end_pos))) AS region"))
    return d.select("call_id", F.expr(text.parse_region("region")).alias("r")).select("call_id", "r.*")


@query("SELECT call_id, CASE WHEN hmm_lh = 0 THEN -1e-100 ELSE hmm_lh::DOUBLE END AS lh FROM fx_calls", "fx_calls")
def likelihood_floor(spark, sf):
    return table(spark, sf, "fx_calls").select("call_id", filters.likelihood_or_least("hmm_lh").cast("double").alias("lh"))


@query("!t AS (SELECT *, CASE WHEN cn_state = 6 THEN 'BND' ELSE sv_type END AS kind, CASE WHEN cluster_size % 2 = 0 THEN 'DELLY' ELSE 'OTHER' END AS caller FROM fx_calls) SELECT call_id, CASE WHEN caller = 'DELLY' THEN end_pos - start_pos ELSE abs(-(end_pos - start_pos + 1)) END AS size FROM t WHERE kind <> 'BND'", "fx_calls")
def sv_size_choice(spark, sf):
    d = table(spark, sf, "fx_calls").withColumns({"sv_type": F.expr("if(cn_state = 6, 'BND', sv_type)"), "caller": F.expr("if(cluster_size % 2 = 0, 'DELLY', 'OTHER')"), "sv_len": F.expr("-(end_pos - start_pos + 1)")})
    return d.select("call_id", filters.sv_size("caller").alias("size")).where("size IS NOT NULL")


@query("SELECT call_id, 1 AS label FROM fx_calls WHERE cluster_size > 25 UNION ALL SELECT call_id, 0 FROM fx_calls WHERE cluster_size <= 25", "fx_calls")
def labelled_calls(spark, sf):
    d = table(spark, sf, "fx_calls").select("call_id", "cluster_size")
    return filters.labelled_union({1: d.where("cluster_size > 25"), 0: d.where("cluster_size <= 25")}).select("call_id", "label")


@query("SELECT call_id FROM fx_calls WHERE call_id NOT IN (SELECT call_id FROM fx_calls WHERE hmm_lh <> 0)", "fx_calls")
def rows_not_emitted(spark, sf):
    d = table(spark, sf, "fx_calls").select("call_id", "hmm_lh")
    return filters.rows_left(d, d.where("hmm_lh <> 0"), "call_id").select("call_id")


@query("SELECT CASE WHEN info LIKE '%SVTYPE=DEL%' THEN 'DEL' ELSE 'other' END AS kind, count(*) AS n FROM fx_info GROUP BY ALL", "fx_info")
def type_split(spark, sf):
    a, b = filters.type_contains(table(spark, sf, "fx_info"), "DEL")
    return a.withColumn("kind", F.lit("DEL")).unionByName(b.withColumn("kind", F.lit("other"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (chrom IS NULL) AS chrom, count(*) FILTER (pos IS NULL) AS pos, count(*) FILTER (baf IS NULL) AS baf FROM (SELECT chrom, pos, CASE WHEN ad_ref + ad_alt > 0 THEN ad_alt / (ad_ref + ad_alt)::DOUBLE END AS baf FROM fx_snps)", "fx_snps")
def feature_nulls(spark, sf):
    return filters.null_counts(table(spark, sf, "fx_snps").select("chrom", "pos", F.expr("try_divide(cast(ad_alt AS double), ad_ref + ad_alt)").alias("baf")))


