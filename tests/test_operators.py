"""Hand-made vectors and brute-force models for the operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import clustering, coverage, hmm, intervals, reads, split_calls, vcf_out
from strandlake.sources import text


def test_cigar_walk(spark):
    d = spark.createDataFrame([("c", "r", 0, 60, 1000, "30S100M60I80M55D120M")], "chrom string, qname string, flag int, mapq int, start_pos long, cigar string")
    got = {(r.sv_type, r.sv_start, r.sv_end) for r in reads.cigar_candidates(d).collect()}
    assert got == {("INS", 1100, 1159), ("DEL", 1180, 1234)}


def test_depth_across_tiles(spark):
    r = random.Random(1)
    rows = [("c", a, a + r.randrange(1, 6000)) for a in (r.randrange(1, 9000) for _ in range(40))]
    runs = coverage.coverage_runs(spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long")).collect()
    depth = {p: x.depth for x in runs for p in range(x.start_pos, x.end_pos + 1)}
    assert depth == {p: n for p in range(0, 16000) if (n := sum(a <= p <= b for _, a, b in rows))}


def brute_dbscan(xs, eps, least):
    core = [x for x in xs if sum(abs(x - y) <= eps for y in xs) >= least]
    ids, last, n = {}, None, -1
    for x in sorted(set(core)):
        n += last is None or x - last > eps
        ids[x], last = n, x
    out = []
    for x in xs:
        right = [c for c in ids if 0 <= c - x <= eps]
        left = [c for c in ids if 0 <= x - c <= eps]
        out.append(ids[min(right)] if right else ids[max(left)] if left else -2)
    return out


def test_dbscan_1d(spark):
    r = random.Random(2)
    rows = [(g, i, r.randrange(300)) for g in range(5) for i in range(40)]
    d = spark.createDataFrame(rows, "g int, k int, x long")
    got = {(x.g, x.k): x.cluster for x in clustering.dbscan_1d(d, ["g"], "x", "k", 6, 4).collect()}
    for g in range(5):
        own = [x for x in rows if x[0] == g]
        assert [got[g, k] for _, k, _ in own] == brute_dbscan([x for *_, x in own], 6, 4)


def test_viterbi_path(spark):
    r = random.Random(3)
    rows = [(g, t, r.gauss(0, 1), -1.0, 0.5) for g in range(6) for t in range(1, 9)]
    d = spark.createDataFrame(rows, "region_id long, t int, log2_cov double, baf double, pfb double")
    m = hmm.DEMO
    em = {(x.region_id, x.t): x.em for x in hmm.emissions(d, m).collect()}
    for row in hmm.viterbi(d, m).collect():
        score = [(math.log(m.pi[s]) + em[row.region_id, 1][s], [s + 1]) for s in range(6)]
        for t in range(2, 9):
            score = [max(((v + math.log(m.a[i][j]) + em[row.region_id, t][j], -i, p + [j + 1]) for i, (v, p) in enumerate(score)), key=lambda x: x[:2]) for j in range(6)]
            score = [(v, p) for v, _, p in score]
        best = max(score, key=lambda x: x[0])
        assert math.isclose(best[0], row.likelihood, rel_tol=1e-9) and best[1] == row.path


def test_text_sources(spark, tmp_path):
    (tmp_path / "g.bed").write_text("# x\n\nchr1\t5\t9\nbad\tx\t1\n")
    assert [tuple(r) for r in text.read_bed(spark, str(tmp_path / "g.bed")).collect()] == [("chr1", 5, 9)]
    (tmp_path / "g.fa").write_text(">a len>5\nACGT\nRY\n>b\nTT\n")
    fasta = text.read_fasta(spark, str(tmp_path / "g.fa"))
    assert {tuple(r) for r in fasta.collect()} == {("a", "ACGTRY"), ("b", "TT")}
    ranges = spark.createDataFrame([("a", 2, 5), ("a", 5, 9), ("z", 1, 1)], "chrom string, start_pos long, end_pos long")
    got = text.substring_at(text.base_tiles(fasta, 4), ranges, ["chrom", "start_pos"], tile=4).collect()
    assert {(r.chrom, r.start_pos, r.ref_seq) for r in got} == {("a", 2, "CGTR"), ("a", 5, ""), ("z", 1, "")}
    (tmp_path / "s.vcf").write_text("##h\n#CHROM\nchr1\t7\t.\tA\tC\t50\tPASS\tX=1\tGT:DP:AD\t0/1:20:12,8\nchr1\t8\t.\tAT\tC\t50\tPASS\tX=1\n")
    s = text.vcf_snps(text.read_vcf(spark, str(tmp_path / "s.vcf"))).collect()
    assert [(r.pos, r.dp, r.ad_ref, r.ad_alt) for r in s] == [(7, 20, 12, 8)]
    (tmp_path / "m.hmm").write_text("M=1\nN=2\nA:\n0.5 0.5\n0.1 0.9\nB:\n1\n1\npi:\n0.5 0.5\nB1_mean:\n-1 0\nB1_sd:\n1 1\nB1_uf:\n0.01\nB2_mean:\n0 0.2 0.3 0.5 0.5\nB2_sd:\n1 1 1 1 1\nB2_uf:\n0.02\n")
    assert text.read_hmm(spark, str(tmp_path / "m.hmm")).a == ((0.5, 0.5), (0.1, 0.9))


def test_vcf_insertion_and_lines(spark, tmp_path):
    kinds = "chrom string, start_pos long, end_pos long, sv_type string, alt string, ref_seq string, genotype string, evidence int, hmm_lh double, support int, cluster_size int, aln_offset int, cn_state int, gap boolean"
    d = spark.createDataFrame([("c", 10, 59, "INS", "ACG", "R", "0/1", 5, -1.5, 3, 2, 7, 5, False), ("c", 1, 50, "INS", "<INS>", "A", "./.", 1, 0.0, 3, 2, 0, 5, False)], kinds)
    rows = vcf_out.format_rows(d)
    assert [(r.POS, r.REF, r.ALT, r.SAMPLE) for r in rows.collect()] == [(9, "N", "RACG", "0/1:3")]
    assert "ALN=CIGARINS,CIGARCLIP;HMM=-1.500000;SUPPORT=3;CLUSTER=2;ALNOFFSET=7;CN=5" in rows.first().INFO
    assert vcf_out.lines(rows).first().value.count("\t") == 9
    head = vcf_out.header(spark.createDataFrame([("c", 99), ("b", 5)], "chrom string, length long"), "r.fa", "20250101")
    assert head[4:6] == ["##contig=<ID=b,length=5>", "##contig=<ID=c,length=99>"] and head[-1].startswith("#CHROM")
    vcf_out.write_vcf(rows, head, str(tmp_path / "out"))
    assert text.read_vcf(spark, str(tmp_path / "out/*")).first().POS == 9


def scan_clusters(rows, eps, least):
    """Density clustering by one scan in the order (start, end, id): id -> label, -2 noise."""
    rows = sorted(rows, key=lambda r: (r[2], r[3], r[0]))

    def near(i):
        x = rows[i]
        over = [max(0, min(x[3], y[3]) - max(x[2], y[2])) for y in rows]
        return [j for j, (o, y) in enumerate(zip(over, rows)) if 1 - min(o / (x[3] - x[2]), o / (y[3] - y[2])) <= eps]

    label, now = [-1] * len(rows), 0
    for i in range(len(rows)):
        if label[i] != -1:
            continue
        around = near(i)
        if len(around) < least:
            label[i] = -2
            continue
        for j in around:
            label[j] = now
        todo = [j for j in around if j != i]
        while todo:
            more = near(todo.pop())
            if len(more) >= least:
                for m in more:
                    if label[m] == -1:
                        todo.append(m)
                    if label[m] < 0:
                        label[m] = now
        now += 1
    return {r[0]: x for r, x in zip(rows, label)}


def test_dbscan_intervals_like_a_scan(spark):
    r = random.Random(9)
    for least in (1, 2, 3, 5):
        rows = [(i, "c", a, a + r.choice((100, 104, 110, 120, 300))) for i, a in enumerate(r.randrange(1, 700) for _ in range(150))]
        d = spark.createDataFrame(rows, "call_id long, chrom string, start_pos long, end_pos long")
        got = {x.call_id: x.cluster_key for x in clustering.dbscan_intervals(d, "call_id", ["chrom"], 0.15, least).collect()}
        want = scan_clusters(rows, 0.15, least)
        first = {}
        for i, x in want.items():
            assert (got[i] is None) == (x == -2)
            assert x == -2 or first.setdefault(x, got[i]) == got[i]
        assert len(set(first.values())) == len(first)


def test_tiles_do_not_show(spark):
    r = random.Random(4)
    rows = [(g, i, a, a + r.randrange(1, 40)) for g in range(3) for i, a in enumerate(r.randrange(3000) for _ in range(150))]
    d = spark.createDataFrame(rows, "chrom int, call_id int, start_pos long, end_pos long")
    small = {(x.chrom, x.call_id): x.cluster for x in clustering.dbscan_1d(d, ["chrom"], "start_pos", "call_id", 12, 3, tile=48).collect()}
    for g in range(3):
        own = [x for x in rows if x[0] == g]
        assert [small[g, x[1]] for x in own] == brute_dbscan([x[2] for x in own], 12, 3)
    spans = lambda t: {(x.chrom, x.call_id): x.island for x in intervals.overlap_islands(d, ["chrom"], ["call_id"], t).collect()}
    assert spans(7) == spans(1 << 20)


def test_split_read_calls(spark):
    """Reads with a primary before and a supplementary part behind a gap of 5,000 bases, and an inverted group."""
    rows = []
    for i in range(8):
        rows += [("c", f"d{i}", 0, 60, 1000 + i, 9000 + i, 0, 8000, 2 * i), ("c", f"d{i}", 2048, 60, 14001 + i, 20000, 8000, 14000, 2 * i + 1)]
        rows += [("c", f"v{i}", 0, 60, 50000 + i, 55000, 0, 5000, 100 + 2 * i), ("c", f"v{i}", 2048 | 16, 60, 61000, 66000 + i, 5000, 10000, 101 + 2 * i)]
    rows.append(("c", "lone", 0, 60, 90000, 91000, 0, 1000, 999))
    d = spark.createDataFrame(rows, "chrom string, qname string, flag int, mapq int, start_pos long, end_pos long, query_start long, query_end long, aln_id long")
    got = {(x.start_pos, x.end_pos): (x.sv_type, x.cluster_size, x.aln_offset, x.evidence) for x in split_calls.split_read_calls(d).collect()}
    want = {}
    for a in (1004, 9004):
        for b in (14005, 20000):
            want[a, b - 1] = ("UNKNOWN", 8, 0, 8)
    for a in (50004, 55000):
        for b in (61000, 66004):
            want[a, b - 1] = ("INV", 8, 0, 8)
    # The read distance is 0, so the supplementary end is the start of the distance call.
    want[20000, 20000 + 5001 - 1 - 0] = ("UNKNOWN", 8, 5001, 16)
    read = {k: v for k, v in got.items() if v[3] == 8}
    assert read == {k: v for k, v in want.items() if v[3] == 8}
    assert [(k[0], v[0], v[1]) for k, v in got.items() if v[3] == 16] == [(20000, "UNKNOWN", 8)]


def test_calling_plan(spark):
    from strandlake.plans import calling

    a = spark.createDataFrame([("c", f"r{i}", 0, 60, 100 + i % 2, 500, "100M60D200M") for i in range(6)], "chrom string, qname string, flag int, mapq int, start_pos long, end_pos long, cigar string")
    params = calling.CallerParams(min_points=2)
    calls = calling.cigar_calls(a, params)
    assert [(x.sv_type, x.cluster_size) for x in calls.collect()] == [("DEL", 6)]
    assert calling.cigar_calls(a, calling.CallerParams()).count() == 1
    assert [calling.CallerParams(min_points_pct=p).points_for(31.0) for p in (0.1, 0)] == [4, 5]
    gaps = spark.createDataFrame([("c", 150, 260)], "chrom string, start_pos long, end_pos long")
    sequence = "ACGTTGCA" * 100
    tiles = text.base_tiles(spark.createDataFrame([("c", sequence)], "chrom string, sequence string"), text.BASES)
    call, row = calls.first(), calling.vcf_rows(calls, calling.read_depth(a), gaps, tiles, params).first()
    assert (row.POS, row.REF) == (call.start_pos - 1, sequence[call.start_pos - 2 : call.end_pos])
    assert row.FILTER == "AssemblyGap" and row.REF[0] == row.ALT and "SVLEN=-60" in row.INFO and row.SAMPLE == "./.:6"  # the base before the deletion
    # Copy numbers: a long deletion whose windows are all at half depth.
    long = calling._as_calls(spark.createDataFrame([("c", 1000, 9000, "DEL", 2, 4)], "chrom string, start_pos long, end_pos long, sv_type string, evidence int, cluster_size long"))
    key = long.first().call_id
    obs = spark.createDataFrame([(key, t, 1000 + 400 * t, -1.0, -1.0, 0.5) for t in range(20)], "region_id long, t int, pos long, log2_cov double, baf double, pfb double")
    new = calling.cigar_copy_numbers(long, obs, hmm.DEMO).first()
    assert (new.sv_type, new.cn_state, new.genotype, new.evidence) == ("DEL", 2, "0/1", 2 | 256) and new.hmm_lh < 0
    unknown = long.withColumn("sv_type", F.lit("UNKNOWN")).withColumn("alt", F.lit("."))
    assert [(x.sv_type, x.alt) for x in calling.split_copy_numbers(unknown, obs, hmm.DEMO).collect()] == [("DEL", "<DEL>")]
    extra = calling.split_copy_numbers(long.withColumn("sv_type", F.lit("INS")), obs, hmm.DEMO).collect()
    assert sorted(x.sv_type for x in extra) == ["DEL", "INS"]
    assert calling.final_calls(long, unknown).count() == 2


def test_table_readers(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("SVTYPE=DEL\nPOS=c:5-9\nHMM_LOGLH=-3.5\nposition\tstate\n5\t2\n6\t2\n")
    meta, body = text.read_cnv_table(spark, str(tmp_path / "c.tsv"))
    assert meta == {"SVTYPE": "DEL", "POS": "c:5-9", "HMM_LOGLH": "-3.5"} and [tuple(r) for r in body.collect()] == [("5", "2"), ("6", "2")]
    (tmp_path / "c.json").write_text('[{"chromosome": "c", "start": 5}, {"chromosome": "d", "start": 6}]')
    assert text.read_cnv_json(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "t.tsv").write_text("c\t5\tDEL\t0/1\n")
    assert tuple(text.read_trio(spark, str(tmp_path / "t.tsv")).first()) == ("c", 5, "DEL", "0/1")
    from pyspark.errors import PySparkException

    from strandlake.operators import filters, store

    d = store.numbered(spark.range(100).selectExpr("100 - id AS x").repartition(5), ["x"])
    assert [(r.x, r.ordinal) for r in d.orderBy("x").collect()] == [(i + 1, i) for i in range(100)]
    with pytest.raises(ValueError):
        filters.zip_trio(d, d.limit(3).withColumn("gt_father", F.lit("0/0")), d)
    with pytest.raises(PySparkException):
        filters.require_no_nulls(spark.sql("SELECT cast(null AS int) AS a")).collect()


def test_calls_and_gaps_are_whole_tables(spark):
    from strandlake.plans.fixtures import table

    sf = "/root/testdata/sf0.001"
    for name, source in (("fx_calls", "lineitem"), ("fx_gaps", "part")):
        assert table(spark, sf, name).count() == spark.read.parquet(f"{sf}/{source}.parquet").count()
