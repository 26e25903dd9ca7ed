"""The calling plan: observations, long regions, weighted clustering, the CIGAR walk, and a planted genome from reads to records."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import clustering, coverage, hmm, intervals, observations, reads
from strandlake.plans import calling
from strandlake.sources import text

ALN = "chrom string, qname string, flag int, mapq int, start_pos long, cigar string"


def test_two_deletions_of_equal_reads(spark):
    """Equal candidates count one by one: five reads each with one of two deletions are two calls of five."""
    rows = [("c", f"a{i}", 0, 60, 1000, "100M60D200M") for i in range(5)] + [("c", f"b{i}", 0, 60, 50000, "100M60D200M") for i in range(5)]
    d = spark.createDataFrame(rows, ALN)
    got = calling.cigar_calls(d, calling.CallerParams(min_points=3)).collect()
    assert sorted((r.start_pos, r.end_pos, r.sv_type, r.cluster_size) for r in got) == [(1100, 1159, "DEL", 5), (50100, 50159, "DEL", 5)]


def test_points_follow_each_contig(spark):
    """Six reads of each contig have the deletion: enough for the low coverage, noise (merged to one call) for the high one."""
    rows = [(c, f"{c}{i}", 0, 60, 1000 if i % 2 else 9000, "100M60D200M") for c in ("low", "high") for i in range(6)]
    rows += [("high", f"h{i}", 0, 60, 1000, "8300M") for i in range(94)]
    d = spark.createDataFrame(rows, ALN)
    means = {r.chrom: r.mean_cov for r in coverage.mean_coverage(calling.read_depth(d)).collect()}
    assert means["low"] == 3 and means["high"] > 80
    got = calling.cigar_calls(d, calling.CallerParams(min_points_pct=0.1)).collect()
    assert sorted((r.chrom, r.cluster_size) for r in got) == [("high", 6), ("low", 3), ("low", 3)]


@pytest.mark.parametrize("noise", ["keep", "merge"])
def test_weights_are_repeated_calls(spark, noise):
    r = random.Random(5)
    rows = []
    for i in range(120):
        a = r.randrange(1, 2500)
        rows.append((i, r.choice("cd"), r.choice(("DEL", "INS")), a, a + r.choice((100, 104, 110, 300)), r.choice((1, 1, 2, 5)), 0, r.choice((0.0, 0.0, -2.5)) if i % 3 == 0 else 0.0))
    d = spark.createDataFrame(rows, "call_id long, chrom string, sv_type string, start_pos long, end_pos long, w int, cluster_size int, hmm_lh double")
    many = d.withColumn("copy", F.explode(F.expr("sequence(1, w)"))).withColumn("call_id", F.expr("call_id * 10 + copy")).drop("copy")
    by = ["chrom", "sv_type"]
    for least in (2, 4):
        out = []
        for calls, weight in ((d, "w"), (many, None)):
            label = clustering.dbscan_intervals(calls, "call_id", by, 0.1, least, weight).select("call_id", "cluster_key")
            merged = clustering.merge_calls(calls.join(label, "call_id"), by, "cluster_key", "call_id", noise, weight)
            out.append(sorted((x.chrom, x.sv_type, x.start_pos, x.end_pos, x.cluster_size, x.hmm_lh) for x in merged.collect()))
        assert out[0] == out[1]


def test_pairs_of_equal_ids_stay(spark):
    d = spark.createDataFrame([(1, "c", 100, 200), (2, "c", 100, 201), (2, "c", 101, 200)], "call_id long, chrom string, start_pos long, end_pos long")
    assert [(r.a_id, r.b_id) for r in intervals.reciprocal_pairs(d, "call_id", ["chrom"], 0.1).collect()] == [(1, 2), (1, 2)]


def test_gap_flag_of_all_lengths(spark):
    r = random.Random(8)
    span = lambda: (lambda a, n: (a, a + n))(r.randrange(1, 60_000), r.choice((0, 1, 5, 60, 700, 9_000, 50_000)) + r.randrange(9))
    calls = [(i, r.choice("cd"), *span()) for i in range(300)] + [(400, "e", 5, 9)]
    gaps = [(r.choice("cd"), *span()) for _ in range(60)]
    gaps += gaps[:3]
    c = spark.createDataFrame(calls, "call_id long, chrom string, start_pos long, end_pos long")
    g = spark.createDataFrame(gaps, "chrom string, start_pos long, end_pos long")
    for share in (0.2, 0.5):
        want = {i: any(h == k and (min(e, b + 1) - max(s, a + 1) + 1) / (e - s + 1) > share for h, a, b in gaps) for i, k, s, e in calls}
        assert {x.call_id: x.gap for x in intervals.gap_flag(c, g, ["call_id"], share).collect()} == want
        assert set(want.values()) == {True, False}


def brute_observations(region, snps, depth, mean, sample, first, length):
    """Rows (pos, log2, baf, pfb, is_snp) of one region, window by window."""
    s, e = region
    inside = sorted((p, b, f) for p, b, f in snps if s <= p <= e)
    n = max(len(inside), sample)
    step = (e - s + 1) / n
    seen = {}
    for i in range(n):
        a, b = int(s + i * step), int(s + (i + 1) * step)
        at = [int(s + i * step) + j for j in range(math.ceil(step))]
        at = [p for p in at if p <= e and p <= length]
        total = sum(depth.get(p, 0) for p in at)
        seen[a, b] = math.log2((total or 1e-9) / len(at) / mean) if at else 0.0
    have = next((p for p, _, f in inside if f), None)
    out = []
    for (a, b), lr in seen.items():
        hits = [(p, lr, v, (f or 0.0) if not first or p == have else 0.0, True) for p, v, f in inside if a <= p <= b]
        out += hits or [((a + b) // 2, lr, -1.0, 0.5, False)]
    return out


@pytest.mark.parametrize("match", ["all", "first"])
def test_observations(spark, match):
    r = random.Random(6)
    regions = [(1, "c", 100, 5000), (2, "c", 4000, 4007), (3, "c", 1, 1), (4, "d", 50, 9000), (5, "c", 20_000, 20_050), (6, "c", 3000, 3400), (7, "c", 40_990, 41_020)]
    snps = [("c", p, r.choice((0.0, 0.5, 1.0, None)), r.choice((None, 0.0, 0.3, 0.9))) for p in sorted(r.sample(range(1, 6000), 500))]
    snps += [("c", p, 0.5, 0.2) for p in range(20_000, 20_051)] + [("d", 4, 0.1, 0.2)]
    blocks = [(c, a, a + r.randrange(1, 3000)) for c in "cd" for a in (r.randrange(1, 8000) for _ in range(25))]
    runs = coverage.coverage_runs(spark.createDataFrame(blocks, "chrom string, start_pos long, end_pos long"))
    means = coverage.mean_coverage(runs)
    lengths = {"c": 41_000, "d": 8_000}
    depth, mean = {c: {} for c in lengths}, {x.chrom: x.mean_cov for x in means.collect()}
    for c, a, b in blocks:
        for p in range(a, b + 1):
            depth[c][p] = depth[c].get(p, 0) + 1
    got = observations.observations(
        spark.createDataFrame(regions, "region_id long, chrom string, start_pos long, end_pos long"),
        spark.createDataFrame(snps, "chrom string, pos long, baf double, pfb double"),
        runs, means, 20, match, spark.createDataFrame(list(lengths.items()), "chrom string, length long"),
    ).collect()
    for i, c, s, e in regions:
        own = sorted((x for x in got if x.region_id == i), key=lambda x: x.t)
        assert [x.t for x in own] == list(range(1, len(own) + 1))
        have = [(x.pos, round(x.log2_cov, 9), x.baf, x.pfb, x.is_snp) for x in own]
        of = [(p, b, f) for k, p, b, f in snps if k == c]
        want = [(p, round(lr, 9), b, f, k) for p, lr, b, f, k in brute_observations((s, e), of, depth[c], mean[c], 20, match == "first", lengths[c])]
        assert sorted(have, key=repr) == sorted(want, key=repr)


def fold(em, m):
    """Best path and its score by the plain recursion, ties to the lowest state."""
    la = [[math.log(x) if x > 0 else -math.inf for x in row] for row in m.a]
    d, back = [math.log(p if p > 0 else 1e-9) + e for p, e in zip(m.pi, em[0])], []
    for e in em[1:]:
        best = [max(range(6), key=lambda i: (d[i] + la[i][j], -i)) for j in range(6)]
        d = [d[best[j]] + la[best[j]][j] + e[j] for j in range(6)]
        back.append(best)
    z = max(range(6), key=lambda i: (d[i], -i))
    path = [z]
    for b in reversed(back):
        path.append(b[path[-1]])
    return max(d), [z + 1 for z in reversed(path)]


@pytest.mark.parametrize("block", [1, 3, 7, 512])
def test_viterbi_by_blocks(spark, block):
    """Paths over many blocks equal the recursion over the whole region; zero transitions and starts are allowed."""
    from dataclasses import replace

    r = random.Random(3)
    a = [list(row) for row in hmm.DEMO.a]
    a[0][5] = a[5][0] = 0.0
    m = replace(hmm.DEMO, a=tuple(map(tuple, a)), pi=(0.0, *hmm.DEMO.pi[1:]))
    rows = []
    for g, n in enumerate((1, 2, 3, 8, 40, 700)):
        level = 0.0
        for t in range(1, n + 1):
            level = r.choice((-3.0, -1.0, 0.0, 0.6, 1.0)) if r.random() < 0.08 else level
            snp = r.random() < 0.5
            rows.append((g, t, r.gauss(level, 0.2), r.choice((0.0, 0.3, 0.5, 1.0)) if snp else -1.0, 0.3 if snp else 0.5))
    d = spark.createDataFrame(rows, "region_id long, t int, log2_cov double, baf double, pfb double").repartition(3)
    em = {(x.region_id, x.t): x.em for x in hmm.emissions(d, m).collect()}
    states = {(x.region_id, x.t): x.state for x in hmm.viterbi_states(d, m, block).collect()}
    score = {x.region_id: x.likelihood for x in hmm.viterbi_likelihoods(d, m, block).collect()}
    whole = {x.region_id: x for x in hmm.viterbi(d, m, block).collect()}
    for g in range(6):
        n = max(t for k, t in em if k == g)
        want, path = fold([em[g, t] for t in range(1, n + 1)], m)
        assert math.isclose(score[g], want, rel_tol=1e-9) and math.isclose(whole[g].likelihood, want, rel_tol=1e-9)
        assert [states[g, t] for t in range(1, n + 1)] == path == whole[g].path


def test_cigar_walk_with_bases(spark):
    seq = "A" * 30 + "C" * 100 + "GTRYK" * 10 + "T" * 80 + "G" * 60 + "A" * 50
    rows = [("c", "r", 0, 60, 1000, "30S100M50I80M55D60M50S", seq), ("c", "edge", 0, 60, 1200, "100M60S", "T" * 160), ("c", "low", 0, 5, 1, "60I", "A" * 60), ("c", "sup", 2048, 60, 1, "60D", "")]
    d = spark.createDataFrame(rows, f"{ALN}, seq string")
    contigs = spark.createDataFrame([("c", 1299)], "chrom string, length long")
    got = {(r.qname, r.sv_type, r.evidence, r.sv_start, r.sv_end, r.alt) for r in reads.cigar_candidates(d, contigs).collect()}
    assert got == {("r", "INS", 1, 1100, 1149, "GTNNN" * 10), ("r", "DEL", 2, 1180, 1234, "<DEL>"), ("r", "INS", 4, 1295, 1344, "A" * 50)}
    assert ("edge", "INS", 4, 1300, 1359, "<INS>") in {(r.qname, r.sv_type, r.evidence, r.sv_start, r.sv_end, r.alt) for r in reads.cigar_candidates(d).collect()}
    assert {r.qname: r.end_pos for r in reads.with_ends(d).collect()} == {"r": 1294, "edge": 1299, "low": 1, "sup": 60}


def test_aligned_blocks(spark):
    r = random.Random(2)
    rows, want = [("c", "n", 0, 60, 5, None), ("c", "star", 0, 60, 5, "*"), ("c", "none", 0, 60, 5, "")], []
    for i in range(60):
        ops = [(r.randrange(1, 10 ** r.randrange(1, 6)), r.choice("MIDNSHP=X")) for _ in range(r.randrange(1, 30))]
        start = p = r.randrange(1, 10_000)
        for n, o in ops:
            if o in "M=X":
                want.append(("c", p, p + n - 1))
            p += n if o in "MDN=X" else 0
        rows.append(("c", str(i), 0, 60, start, "".join(f"{n}{o}" for n, o in ops)))
    d = spark.createDataFrame(rows, ALN).repartition(4)
    assert sorted(tuple(x) for x in reads.aligned_blocks(d).collect()) == sorted(want)
    assert reads.aligned_blocks(d.limit(0)).count() == 0


@pytest.mark.parametrize("split", ["200b", "1m"])
def test_fasta_tiles(spark, tmp_path, split):
    r = random.Random(7)
    contigs = {f"chr{i}": "".join(r.choice("ACGTN") for _ in range(n)) for i, n in enumerate((1, 63, 64, 1000, 3000, 5))}
    lines = ["no contig's"]
    for name, seq in contigs.items():
        lines += [f">{name} some text", *(seq[i : i + 37] for i in range(0, len(seq), 37)), ""]
    (tmp_path / "g.fa").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        tiles = text.fasta_tiles(spark, str(tmp_path / "g.fa"), 64)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for x in sorted(tiles.collect(), key=lambda x: (x.chrom, x.tile)):
        assert x.length == len(contigs[x.chrom]) and len(x.bases) == min(64, x.length - 64 * x.tile)
        got[x.chrom] = got.get(x.chrom, "") + x.bases
    assert got == contigs
    want = text.base_tiles(spark.createDataFrame(list(contigs.items()), "chrom string, sequence string"), 64)
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, tiles.collect()))
    assert {r.chrom: r.length for r in text.contig_lengths(tiles).collect()} == {k: len(v) for k, v in contigs.items()}


def planted(spark):
    """A contig of 200,000 bases at depth 20 with a deletion of 120 in half of the reads, a deletion of 20,000 and a duplication of 30,000 seen by split reads."""
    r = random.Random(11)
    genome = "".join(r.choice("ACGT") for _ in range(200_000))
    rows, n = [], 0

    def read(name, flag, start, cigar):
        nonlocal n
        n += 1
        size = sum(int(k) for k, o in __import__("re").findall(r"(\d+)([MIS])", cigar))
        rows.append(("c", name, flag, 60, start, cigar, "A" * size, n))

    for i in range(2000):
        a = 1 + (i * 97) % 198_000
        if 60_000 <= a + 2000 and a <= 80_000:
            if i % 2:  # one allele has the long deletion
                continue
        if a <= 30_000 and a + 2000 > 30_500:
            read(f"r{i}", 0, a, "2000M" if i % 2 else f"{30_200 - a}M120D{2000 - (30_200 - a)}M" if 200 < 30_200 - a < 1800 else "2000M")
        else:
            read(f"r{i}", 0, a, "2000M")
        if 120_000 <= a <= 148_000:  # one more copy
            read(f"x{i}", 0, a, "2000M")
    for i in range(12):
        read(f"d{i}", 0, 58_001 + i, f"{2000 - i}M2000S")
        read(f"d{i}", 2048, 80_001, f"{2000 - i}S2000M")
        read(f"u{i}", 0, 148_001 + i, f"{2000 - i}M2000S")
        read(f"u{i}", 2048, 120_001, f"{2000 - i}S2000M")
    aln = spark.createDataFrame(rows, f"{ALN}, seq string, aln_id long")
    snps = [("c", p, 0.5 if r.random() < 0.5 else 1.0, 0.5) for p in range(500, 200_000, 1000)]
    snps = [(c, p, r.choice((0.0, 1.0)) if 60_000 < p < 80_000 else r.choice((0.0, 0.33, 0.67, 1.0)) if 120_000 < p < 150_000 else b, f) for c, p, b, f in snps]
    tiles = text.base_tiles(spark.createDataFrame([("c", genome)], "chrom string, sequence string"))
    return genome, aln, spark.createDataFrame(snps, "chrom string, pos long, baf double, pfb double"), tiles


def test_whole_plan_on_a_planted_genome(spark):
    genome, aln, snps, tiles = planted(spark)
    gaps = spark.createDataFrame([("c", 30_000, 30_500)], "chrom string, start_pos long, end_pos long")
    rows = calling.call_variants(aln, tiles, snps, gaps, hmm.DEMO).collect()
    found = {(r.POS, kind): r for r in rows for kind in [dict(x.split("=") for x in r.INFO.split(";") if "=" in x)["SVTYPE"]]}
    small = found[30_199, "DEL"]
    assert small.REF == genome[30_198:30_319] and small.ALT == small.REF[0] and small.FILTER == "AssemblyGap" and "ALN=CIGARDEL;" in small.INFO
    info = lambda r: dict(x.split("=") for x in r.INFO.split(";") if "=" in x)
    near = lambda r, p, a, b: min(int(info(r)["END"]), b) - max(p, a) > 0.8 * max(b - a, int(info(r)["END"]) - p)
    big = [r for (p, k), r in found.items() if k == "DEL" and near(r, p, 60_000, 80_000)]
    assert big and info(big[0])["CN"] == "2" and big[0].SAMPLE.startswith("0/1:") and big[0].FILTER == "PASS" and "HMM" in info(big[0])["ALN"]
    dup = [r for (p, k), r in found.items() if k == "DUP" and near(r, p, 120_000, 150_000)]
    assert dup and info(dup[0])["CN"] == "5" and dup[0].ALT == "<DUP>" and float(info(dup[0])["HMM"]) < 0
