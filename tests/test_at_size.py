"""Steps that must not grow with pairs, windows or broadcast rows: small tables, and the plans that make them hold at size."""

import math
import random
from collections import defaultdict

import duckdb
import numpy as np
from test_calling import brute_observations

from strandlake.operators import clustering, coverage, hmm, intervals, neighbours, observations, reads, scoring, store
from strandlake.plans.fixtures import with_sql
from strandlake.plans.queries import _EM1, _EM2, QUERIES, _call_sets, _obs
from strandlake.sources import text

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


def test_paths_are_not_broadcast(spark):
    """a table of paths has one row per step, its file a few bytes each."""
    text = plan(QUERIES["cnv_json_rows"](spark, SF))
    assert "BroadcastHashJoin" not in text and text.count("SortMergeJoin") >= 3


def test_window_sums_over_tiles(spark):
    """windows meet no runs row by row; those across tiles and those of repeated ids are summed up."""
    blocks = [("a", 3, 40), ("a", 10, 12), ("a", 38, 41), ("b", 5, 5)]
    regions = [(1, "a", 1, 60), (1, "a", 1, 60), (2, "a", 15, 34), (3, "b", 1, 7), (4, "c", 1, 30), (1, "a", 2, 61), (5, "a", 200, 260)]
    runs = coverage.coverage_runs(spark.createDataFrame(blocks, "chrom string, start_pos long, end_pos long"), 16)
    d = coverage.window_log2(spark.createDataFrame(regions, "region_id long, chrom string, start_pos long, end_pos long"), runs, coverage.mean_coverage(runs), 20, 16)
    depth = lambda c, p: sum(x == c and s <= p <= e for x, s, e in blocks)
    total = defaultdict(int)
    for i, c, s, e in regions:
        step = (e - s + 1) / 20
        for w in range(20):
            a, b = math.floor(s + w * step), math.floor(s + (w + 1) * step) - 1
            if b >= a and c != "c":
                total[i, c, w, a, b] += sum(depth(c, p) for p in range(a, b + 1))
    covered = {c: [n for n in (depth(c, p) for p in range(100)) if n] for c in "ab"}
    mean = {c: sum(n) / len(n) for c, n in covered.items()}
    want = sorted((i, w, round(math.log2((t / (b - a + 1) if t else 1e-9) / mean[c]), 9)) for (i, c, w, a, b), t in total.items())
    assert sorted((r.region_id, r.w, round(r.log2_cov, 9)) for r in d.collect()) == want
    assert "SortMergeJoin" not in plan(d) and "ShuffledHashJoin" not in plan(d)


def test_emissions_to_the_last_bit(spark):
    """paths change between states that are alike without SNPs, so ties hang on the last bit."""
    sf = "/root/testdata/sf0.01"
    got = {(r.region_id, r.t): r.em for r in hmm.emissions(_obs(spark, sf), hmm.DEMO).collect()}
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    em = ", ".join(f"({x} + CASE WHEN baf = -1 THEN 0 ELSE {y} END)::DOUBLE" for x, y in zip(_EM1, _EM2))
    rows = con.sql(with_sql("fx_obs") + f" SELECT region_id, t, {em} FROM (SELECT region_id, t, log2_cov, baf::DOUBLE AS baf, pfb::DOUBLE AS pfb FROM fx_obs)").fetchall()
    assert {r[:2]: list(r[2:]) for r in rows} == got


def test_long_path_in_order_of_observations(spark):
    """blocks of one region are summed as the plain recursion does, to the last bit."""
    n, m = 700, hmm.DEMO
    obs = [(r, t, math.sin(t * (r + 1)), -1.0 if t % 7 else (t % 101) / 100, 0.3) for r in (0, 1, 2) for t in range(1, n + 1 - r)]
    d = spark.createDataFrame(obs, "region_id long, t long, log2_cov double, baf double, pfb double")
    em = {(r.region_id, r.t): r.em for r in hmm.emissions(d, m).collect()}
    want = {}
    for r in (0, 1, 2):
        d0, back = [math.log(p) + e for p, e in zip(m.pi, em[r, 1])], []
        for t in range(2, n + 1 - r):
            ways = [[d0[i] + math.log(m.a[i][j]) for i in range(6)] for j in range(6)]
            back.append([w.index(max(w)) for w in ways])
            d0 = [max(w) + e for w, e in zip(ways, em[r, t])]
        path = [d0.index(max(d0))]
        for b in reversed(back):
            path.append(b[path[-1]])
        want[r] = (max(d0), [z + 1 for z in reversed(path)])
    assert {r.region_id: (r.likelihood, r.path) for r in hmm.viterbi(d, m, 16).collect()} == want
    assert {r.region_id: r.likelihood for r in hmm.viterbi_likelihoods(d, m, 16).collect()} == {r: v[0] for r, v in want.items()}


def test_partitions_grow_with_the_input(spark):
    """a task's memory is that of one partition, whose number follows the input."""
    small, large = spark.range(10), spark.range(10_000_000)
    assert store.parts_for(small) == 4 and store.parts_for(large) >= 8
    assert "REPARTITION_BY_NUM" in plan(QUERIES["cigar_candidate_counts"](spark, SF)) and "REPARTITION_BY_NUM" in plan(QUERIES["dbscan1d_labels"](spark, SF))


def test_cells_do_not_show(spark, monkeypatch):
    """Pairs, counts and clusters are those of one large cell, in which they are those of a plain comparison."""
    r = random.Random(3)
    rows = [(i, "c", a, a + r.choice((7, 8, 9, 60, 63, 64, 66, 70))) for i, a in enumerate(r.randrange(1, 400) for _ in range(120))]
    d = spark.createDataFrame(rows, "call_id long, chrom string, start_pos long, end_pos long")

    def made():
        pairs = {(x.a_id, x.b_id) for x in intervals.reciprocal_pairs(d, "call_id", ["chrom"], 0.15).collect()}
        n = {x.call_id: x.n for x in clustering.core_intervals(d, "call_id", ["chrom"], 0.15, 1).collect()}
        return pairs, n, {x.call_id: x.cluster_key for x in clustering.dbscan_intervals(d, "call_id", ["chrom"], 0.15, 3).collect()}

    whole = made()
    monkeypatch.setattr(neighbours, "WIDE", 1)
    monkeypatch.setattr(neighbours, "STEP", 2)
    assert made() == whole
    near = lambda x, y: 1 - min((min(x[3], y[3]) - max(x[2], y[2])) / (z[3] - z[2]) for z in (x, y)) <= 0.15
    assert whole[0] == {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and near(x, y)}
    assert whole[1] == {x[0]: sum(near(x, y) for y in rows) for x in rows}


def test_calls_are_dealt_once(spark):
    """Calls meet in cells, no pair of calls is joined or counted as a row."""
    text = plan(QUERIES["reciprocal_overlap_pairs"](spark, SF)) + plan(QUERIES["dbscan2d_core_calls"](spark, SF))
    assert "Join" not in text and text.count("FlatMapGroupsInArrow") == 2


def test_usual_lengths_are_in_one_cell(spark):
    """calls of 50 to 800 bases are copied to other cells from the edges of positions only."""
    rows = [(i, "c", 5000 + i, 5050 + i * 2) for i in range(700)]
    d = spark.createDataFrame(rows, "call_id long, chrom string, start_pos long, end_pos long")
    assert neighbours.cells(d, ["chrom"], 0.1, 2).count() == len(rows)


def test_ranges_of_groups_are_broadcast(spark):
    """a contig's rows are not dealt to one task to meet its range."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["normalised_score"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_contigs_are_broadcast(spark):
    """five contigs are no five tasks that read all candidates."""
    text = plan(QUERIES["cigar_candidates"](spark, SF))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Exchange hashpartitioning" not in text


def test_counts_of_overlaps(spark):
    """overlaps are counted from starts and ends, and are those of a plain comparison; no pair is a row."""
    r = random.Random(5)
    rows = [(i % 90, r.choice("ab"), s, s + r.choice((0, 3, 40, 300))) for i, s in enumerate(r.randrange(-50, 900) for _ in range(120))]
    rows += [(90, "a", 70, 20), (91, None, 1, 5), (92, "b", None, 9), (93, "c", 4, 4), (None, "a", 1, 800)]
    other = [(r.choice("ab"), s, s + r.choice((0, 0, 9))) for s in (r.randrange(-50, 900) for _ in range(80))] + [("a", 500, 400), ("a", None, 3)]
    kind = "chrom string, start_pos long, end_pos long"
    a, b = spark.createDataFrame(rows, "call_id long, " + kind), spark.createDataFrame(other, kind)
    meet = lambda x, y: None not in (*x, *y) and x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1]
    for given, second in ((None, [x[1:] for x in rows]), (b, other)):
        want = defaultdict(int)
        for x in rows:
            want[x[0]] += sum(meet(x[1:], y) for y in second)
        for tile in (16, 1 << 16):
            assert {x.call_id: x.n for x in intervals.overlap_counts(a, "call_id", given, tile).collect()} == want
    text = plan(QUERIES["overlap_self_join"](spark, SF)) + plan(QUERIES["window_snp_range_join"](spark, SF))
    assert text.count("Join") == 2 and text.count("REPARTITION_BY_NUM") == 4


def test_medians_by_tiles(spark):
    """a group is not sorted by one task; the middle is that of the sorted list."""
    r = random.Random(7)
    rows = [(g, r.choice((r.randrange(-400, 400), 5))) for g in ("x", "y", None) for _ in range(r.randrange(60, 90))] + [("one", 7), ("two", 3), ("two", -9)]
    want = defaultdict(list)
    for g, x in rows:
        want[g].append(x)
    d = spark.createDataFrame(rows, "g string, x long")
    for tile in (8, 1 << 16):
        assert {y.g: y.median for y in clustering.upper_median(d, ["g"], "x", tile).collect()} == {g: sorted(x)[len(x) // 2] for g, x in want.items()}
    text = plan(QUERIES["upper_median"](spark, SF))
    assert text.count("__t#") > 0 and "REPARTITION_BY_NUM" in text


def test_features_are_read_from_info_once(spark):
    """A fit and its scores read written features, and call sets are not sorted to number their calls."""
    calls, rows = _call_sets(spark, SF), QUERIES["lr_train_score"](spark, SF)
    assert "regexp_extract" not in plan(rows) and not any("Exchange" in plan(d) or "Sort" in plan(d) for d in calls)
    model, codes = scoring.train(*calls)
    want = {(r.call_id, i): round(r.score, 9) for i, d in ((1, calls[0]), (0, calls[1])) for r in scoring.score(d, model, codes).collect()}
    assert {(r.call_id, r.label): round(r.score, 9) for r in rows.collect()} == want


def test_records_are_dealt_once_a_join(spark):
    """gap flags and bases need no grouping of calls by their key, equal calls stay, and contigs are told apart."""
    rng, spans = random.Random(5), "chrom string, start_pos long, end_pos long"
    gaps = [(rng.choice("ab"), a, a + rng.choice([3, 40, 700, 9000])) for a in (rng.randrange(200_000) for _ in range(120))]
    calls = [(rng.choice("abc"), a, a + rng.choice([0, 1, 7, 50, 300, 2047, 2048, 30_000])) for a in (rng.randrange(200_000) for _ in range(1500))]
    c, g = spark.createDataFrame(calls + calls[:9], spans), spark.createDataFrame(gaps, spans)
    want = [(k, b, e, any(x == k and (min(e, f + 1) - max(b, a + 1) + 1) / (e - b + 1) > 0.2 for x, a, f in gaps)) for k, b, e in calls + calls[:9]]
    flagged = intervals.gap_flag(c, g)
    assert 50 < sum(w[3] for w in want) < 1400 and sorted(tuple(r) for r in flagged.collect()) == sorted(want)
    bases = {k: "".join(rng.choice("ACGT") for _ in range(n)) for k, n in (("a", 37), ("b", 16))}
    tiles = spark.createDataFrame([(k, i // 8, s[i : i + 8], len(s)) for k, s in bases.items() for i in range(0, len(s), 8)], "chrom string, tile long, bases string, length long")
    ranges = [(k, a, a + n) for k in "abc" for a in (-1, 0, 1, 7, 8, 9, 16, 30, 37, 38) for n in (-2, 0, 1, 6, 7, 8, 20)] + [("a", None, 4), ("a", 3, None)]
    shown = lambda k, a, e: bases[k][a - 1 : e] if None not in (a, e) and k in bases and 1 <= a <= e <= len(bases[k]) else ""
    for some in (ranges, [x for x in ranges if None in x or x[2] - x[1] < 8]):
        d = text.substring_at(tiles, spark.createDataFrame(some, spans), ["chrom", "start_pos", "end_pos"], tile=8)
        assert sorted(map(str, d.collect())) == sorted(f"Row(chrom={k!r}, start_pos={a}, end_pos={e}, ref_seq={shown(k, a, e)!r})" for k, a, e in some)
    # Runs, gaps and bases: one join each.
    assert plan(QUERIES["vcf_format_rows"](spark, SF)).count("Join") == 3


def test_observations_are_packed_by_tile(spark):
    """no window and no SNP of a region is dealt; windows across tiles, and regions across batches, are put together in order."""
    r = random.Random(9)
    edge = observations.TILE
    regions = [(i, "c", s, s + n) for i, (s, n) in enumerate([(edge - 30, 60), (edge - 1, 0), (edge - 3, 5), (100, 3 * edge), (edge - 400, 20), (2 * edge - 5, 4), (900, edge), (edge, 7), (5 * edge, 2000)])]
    snps = [("c", p, r.choice((0.0, 0.5, None)), r.choice((None, 0.0, 0.3))) for p in sorted({r.randrange(1, 4 * edge) for _ in range(90)} | set(range(edge - 12, edge + 3)))]
    blocks = [("c", a, a + r.randrange(1, 9000)) for a in (r.randrange(1, 3 * edge) for _ in range(12))]
    runs = coverage.coverage_runs(spark.createDataFrame(blocks, "chrom string, start_pos long, end_pos long"))
    means = coverage.mean_coverage(runs)
    depth = defaultdict(int)
    for _, a, b in blocks:
        for p in range(a, b + 1):
            depth[p] += 1
    given = spark.createDataFrame(regions, "region_id long, chrom string, start_pos long, end_pos long"), spark.createDataFrame(snps, "chrom string, pos long, baf double, pfb double")
    for size in (1, 2, 3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        try:
            rows = observations.observations(*given, runs, means).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for i, _, s, e in regions:
            own = sorted((x for x in rows if x.region_id == i), key=lambda x: x.t)
            want = brute_observations((s, e), [x[1:] for x in snps], depth, means.first().mean_cov, 20, False, math.inf)
            assert [x.t for x in own] == list(range(1, len(want) + 1))
            assert [(x.pos, round(x.log2_cov, 9), x.baf, x.pfb, x.is_snp) for x in own] == [(p, round(lr, 9), b, f, k) for p, lr, b, f, k in want]
    # Counts of SNPs meet their regions, and nothing else is joined.
    text = plan(QUERIES["region_observations"](spark, SF))
    assert text.count("Join") == 1 and "Window" not in text


def test_json_records_deal_packed_rows(spark, monkeypatch):
    """F1: observations of a call are dealt once, as a row per tile, and the model runs where they meet; paths and scores are those of the blocks."""
    text = plan(QUERIES["cnv_json_rows"](spark, SF))
    assert "collect_list" not in text and text.count("SortMergeJoin") == 3 and text.count("MapInArrow") == 3
    r = random.Random(4)
    sizes = [1, 40, 7, 2, 700, 3, 40, 513]
    rows = [(i, t, r.gauss(0, 1), r.choice((-1.0, 0.0, 0.5, 1.0, None)), r.choice((0.0, 0.3))) for i, n in enumerate(sizes) for t in range(1, n + 1)]
    d = spark.createDataFrame(rows, "region_id long, t long, log2_cov double, baf double, pfb double")
    want = {x.region_id: (x.likelihood, x.path) for x in hmm.viterbi(d, hmm.DEMO, 16).collect()}
    columns = (np.array([math.nan if x is None else x for x in c]) for c in list(zip(*rows))[2:])
    em = hmm.emitted(hmm.DEMO, *columns)
    for most in (1, 50, 1 << 18):
        monkeypatch.setattr(hmm, "PADDED", most)
        states, score = hmm.best_paths(em, np.array(sizes), hmm.DEMO)
        at = [0, *np.cumsum(sizes).tolist()]
        assert {i: (score[i], states[at[i] : at[i + 1]].tolist()) for i in range(len(sizes))} == want


def test_split_reads_are_read_once(spark):
    """ends and read spans are those of the CIGAR walk; what branches share is written, so no clustering is planned twice."""
    cigars = ["30S100M50I80M55D60M50S", "5H3S2D4S10M1S", "100M", "*", "", None, "7S", "3D5S2=1X4P2N9S"]
    rows = [("c", f"r{i}", 16 * (i % 2), 20 + i, 1000 + i, x, i) for i, x in enumerate(cigars)] + [("c", "low", 0, 19, 1, "5M", 90), ("c", "bad", 256, 60, 1, "5M", 91), ("c", "none", 0, 60, None, "5M", 92)]
    d = spark.createDataFrame(rows, "chrom string, qname string, flag int, mapq int, start_pos long, cigar string, aln_id long")
    want = reads.with_ends(reads.query_span(d)).where("mapq >= 20 AND flag & 1796 = 0").selectExpr("qname", "aln_id", "end_pos", "q_start", "q_end")
    got = reads.split_reads(d.repartition(2)).select("qname", "aln_id", "end_pos", "query_start", "query_end")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 9
    text = plan(QUERIES["split_read_calls"](spark, SF))
    assert "Window" not in text and text.count("Join") == 0


def test_tiles_are_swept_in_batches(spark):
    """depth is swept by tile over batches of any size; contigs without name, equal, touching and reversed blocks count as they did."""
    r = random.Random(12)
    rows = [(r.choice(("a", "b", None)), s, s + r.choice((0, 1, 9, 40, 130))) for s in (r.randrange(1, 400) for _ in range(150))] + [("a", 5, 9), ("a", 10, 12), ("d", 9, 5), ("d", 60, 20), ("d", 7, 7)]
    d = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long")
    step = defaultdict(int)
    for c, a, b in rows:
        for t in range(min(a // 32, b // 32), max(a // 32, b // 32) + 1):
            step[c, t, max(a, t * 32)] += 1
            step[c, t, min(b, t * 32 + 31) + 1] -= 1
    want, tiles = [], defaultdict(list)
    for (c, t, p), n in step.items():
        if n:
            tiles[c, t].append((p, n))
    for (c, _), steps in tiles.items():
        depth = 0
        for (p, n), (q, _) in zip(sorted(steps), sorted(steps)[1:]):
            depth += n
            want += [(c, p, q - 1, depth)] if depth > 0 else []
    for size in (1, 3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        try:
            got = coverage.coverage_runs(d, 32).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(map(str, got)) == sorted(f"Row(chrom={c!r}, start_pos={a}, end_pos={b}, depth={n})" for c, a, b, n in want)
    assert "Window" not in plan(QUERIES["coverage_runs"](spark, SF))
