"""Framed files, logs in line order, saved models and small rules."""

import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandlake.operators import coverage, filters, hmm, quality_control, reports, scoring, vcf_out
from strandlake.plans import calling
from strandlake.sources import text


def whole(folder):
    """A folder's text files in order of their names, as one text."""
    return "".join(f.read_text() for f in sorted(Path(folder).glob("*/part-*")))


def test_json_records_of_calls(spark, tmp_path):
    regions = [(1, "c", 2000, 3999, "DEL"), (2, "c", 1, 3, "DUP"), (3, "c", 9000, 9999, "DUP")]
    calls = spark.createDataFrame(regions, "region_id long, chrom string, start_pos long, end_pos long, sv_type string")
    snps = spark.createDataFrame([("c", p, 1 / 3 if p % 200 else None, 0.25) for p in range(100, 10_000, 100)], "chrom string, pos long, baf double, pfb double")
    runs = coverage.coverage_runs(spark.createDataFrame([("c", 1, 10_000), ("c", 1, 1999), ("c", 4000, 10_000)], "chrom string, start_pos long, end_pos long"))
    contigs = spark.createDataFrame([("c", 10_000)], "chrom string, length long")
    rows = calling.cnv_records(calls, snps, runs, coverage.mean_coverage(runs), hmm.DEMO, contigs)
    vcf_out.write_json_array(rows, str(tmp_path / "out"))
    got = json.loads(whole(tmp_path / "out"))
    assert [(x["start"], x["end"], x["sv_type"], x["size"]) for x in got] == [(1, 3, "DUP", 3), (2000, 3999, "DEL", 2000), (9000, 9999, "DUP", 1000)]
    for x in got:
        for part in ("before_sv", "after_sv", "sv"):
            n = len(x[part]["positions"])
            assert all(len(v) == n for v in x[part].values()) and ("states" in x[part]) == (part == "sv")
    first, long, last = got
    assert first["before_sv"]["positions"] == [] and first["sv"]["positions"] == [1, 1, 2, 2, 3, 3] and first["likelihood"] < 0
    # Flanks of 999 bases; the last call's is cut by the contig's end.
    assert all(1001 <= p <= 2000 for p in long["before_sv"]["positions"]) and all(4000 <= p <= 4999 for p in long["after_sv"]["positions"])
    assert last["after_sv"]["positions"] == [] and set(long["sv"]["states"]) <= {1, 2, 3, 4, 5, 6}
    snp = long["sv"]["is_snp"].index(1)
    assert long["sv"]["population_freq"][snp] == 0.25 and {x for x, k in zip(long["sv"]["b_allele_freq"], long["sv"]["is_snp"]) if k} == {0.333333, None}
    assert all(b == 0 and f == 0.5 for b, f, k in zip(long["sv"]["b_allele_freq"], long["sv"]["population_freq"], long["sv"]["is_snp"]) if not k)
    vcf_out.write_json_array(rows.limit(0), str(tmp_path / "none"))
    assert json.loads(whole(tmp_path / "none")) == []


def test_merged_vcf(spark, tmp_path):
    head = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"]
    body = [f"c\t{i}\t.\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;SUPPORT={i}\tGT:DP\t0/1:{i}" for i in range(50)] + ["c\t99\t.\tN\t<INS>\t.\tPASS\tSVTYPE=INS"]
    lines = spark.createDataFrame(list(enumerate(head + body)), "ordinal long, value string").repartition(3)
    chosen = spark.createDataFrame([(7, "SVTYPE=DEL;SUPPORT=9;"), (2, "X=1"), (7, "SVTYPE=DEL;SUPPORT=9;"), (52, "Y=2"), (999, "none")], "ordinal long, info string")
    vcf_out.write_merged_vcf(lines, chosen, str(tmp_path / "v"))
    want = [*head, "c\t0\t.\tN\t<DEL>\t.\tPASS\tX=1\tGT:DP\t0/1:0", "c\t5\t.\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;SUPPORT=9;\tGT:DP\t0/1:5", "c\t99\t.\tN\t<INS>\t.\tPASS\tY=2"]
    assert [x.rstrip("\t") for x in whole(tmp_path / "v").splitlines()] == want


def brute_log(lines):
    out, eps, section = [], None, None
    for i, x in enumerate(lines):
        if "#EPSILON=" in x:
            eps = float(x.split("=")[1])
        elif "Running truvari" in x:
            section = next((k for k in ("DEL", "DUP", "INS", "INV") if k in x), section)
        elif section and "Zipped" in x and "Counter" in x:
            out += [(i, eps, section, k, float(x.split(f"'{k}':")[1].split(",")[0].split("}")[0])) for k in ("comp", "base")]
        elif section:
            for k in ("FP", "FN", "precision", "recall", "f1"):
                if k in x:
                    out.append((i, eps, section, k, float(x.split(":")[1].replace(",", ""))))
                    if k == "recall":
                        section = None
                    break
    return out


@pytest.mark.parametrize("split", ["300b", "1m"])
def test_logs_keep_their_order(spark, tmp_path, monkeypatch, split):
    """Files in small splits and blocks of lines: the parser's state crosses both."""
    monkeypatch.setattr(quality_control, "LOG_BLOCK", 7)
    r, logs = random.Random(4), {}
    for f in ("a.log", "b.log"):
        lines = []
        for e in range(6):
            lines += [f"#EPSILON={0.1 * e:.2f}", "text"]
            for kind in r.sample(["DEL", "INS", "DUP"], 2):
                lines += [f"Running truvari for {kind}", *["more text"] * r.randrange(9), f"[INFO] Zipped {e} variants Counter({{'comp': {r.randrange(900)}, 'base': {r.randrange(90)}}})"]
                lines += [f'  "FP": {r.randrange(99)},', f'  "FN": {r.randrange(99)},', f'  "precision": 0.{r.randrange(1, 99):02d},', f'  "recall": 0.{r.randrange(1, 99):02d},', '  "FN": 5,']
        logs[f] = lines
        (tmp_path / f).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = text.numbered_lines(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    have = {}
    for x in lines.collect():
        have.setdefault(x.file.rsplit("/", 1)[1], {})[x.line_no] = x.line
    assert {f: [d[i] for i in range(len(d))] for f, d in have.items()} == logs
    got = quality_control.benchmark_log(lines).collect()
    for f, own in logs.items():
        assert sorted((x.line_no, x.eps, x.section, x.metric, x.value) for x in got if x.file.endswith(f)) == sorted(brute_log(own))


def test_model_is_saved_and_scores(spark, tmp_path):
    r = random.Random(1)
    row = lambda i, good: (i, r.choice(("chr2", "chr1")), r.randrange(1, 900), f"END=5;SVTYPE={r.choice(('DEL', 'INS'))};SVLEN={r.randrange(-500, 500)};SUPPORT={r.randrange(20, 60) if good else r.randrange(1, 25)}" + (";CLIPSUP=3" if i % 3 else ""))
    schema = "ordinal long, chrom string, pos int, info string"
    true, false = (spark.createDataFrame([row(i, k) for i in range(150)], schema) for k in (1, 0))
    model, codes = scoring.train(true, false)
    first = true.orderBy("ordinal").first().chrom
    assert {x.chrom: x.chrom_code for x in codes.collect()}[first] == 0
    scoring.save(model, codes, str(tmp_path / "m"))
    again, table = scoring.load(spark, str(tmp_path / "m"))
    new = spark.createDataFrame([(1, "chrNew", 5, "SVTYPE=DEL;SVLEN=-60;SUPPORT=55"), (2, "chr1", 5, "SVTYPE=INS;SVLEN=60;SUPPORT=2;REPTYPE=DUP")], schema)
    a, b = (sorted((x.ordinal, round(x.score, 9)) for x in scoring.score(new, m, c).collect()) for m, c in ((model, codes), (again, table)))
    assert a == b and a[0][1] > 0.8 > 0.2 > a[1][1]
    hits = sum((x.score > 0.5) == k for d, k in ((true, True), (false, False)) for x in scoring.score(d, again, table).collect())
    assert hits > 270
    kinds = {x.ordinal: (x.type_code, x.clipped_bases) for x in scoring.call_features(new, codes, strict=False).collect()}
    assert kinds == {1: (0, 0), 2: (1, 0)}
    with pytest.raises(Exception, match="null in read_support"):
        scoring.call_features(spark.createDataFrame([(1, "chr1", 5, "SVTYPE=DEL;SVLEN=1")], schema), codes).collect()


def test_small_rules(spark):
    trio = spark.createDataFrame([("0/1", "0/1", "1/1"), ("0/1", "0/1", "0/1"), ("0/0", "0/1", "0/1"), ("0/0", "1/1", "0/1"), ("./.", "0/1", "0/1"), (None, "0/1", "0/0")], "gt_father string, gt_mother string, gt_child string")
    assert tuple(quality_control.parent_scenarios(trio).first()) == (2, 6, 2 / 6)
    assert tuple(quality_control.parent_scenarios(trio.limit(0)).first()) == (0, 0, None)
    calls = spark.createDataFrame([(1, "c", 1, 10_001, "DEL"), (2, "d", 1, 10_000, "INS"), (3, "d", 5, 20_005, "DEL")], "region_id long, chrom string, start_pos long, end_pos long, sv_type string")
    assert [r.region_id for r in filters.drawn(calls).collect()] == [1, 3] and [r.region_id for r in filters.drawn(calls, contig="d").collect()] == [3]
    assert [tuple(r) for r in filters.types_in_order(calls).collect()] == [("DEL", 0), ("INS", 1)]
    assert [r.region_id for r in filters.first_rows(calls, ["region_id"], 2).collect()] == [1, 2]
    b = spark.createDataFrame([(0.5, True), (-1.0, False)], "baf double, is_snp boolean")
    assert [r[0] for r in b.select(filters.shown_baf()).collect()] == [0.5, 0.0]
    assert math.isnan(b.select(filters.shown_baf(empty=float("nan"))).collect()[1][0])
    assert filters.saved_cnvs(calls.withColumn("end_pos", F.col("start_pos") + 30_000 - F.col("region_id") % 2)).count() == 1
    contigs = spark.createDataFrame([("c", 12_000), ("d", 99_999)], "chrom string, length long")
    got = {(r.region_id, r.section): (r.start_pos, r.end_pos) for r in reports.flanks(calls, contigs).collect()}
    assert got[1, "after"] == (10_002, 12_000) and got[1, "before"] == (1, 1) and got[3, "after"] == (20_006, 30_005)
    extra = calls.where("region_id = 1").withColumn("region_id", F.lit(9).cast("long"))
    assert sorted(r.region_id for r in calling.upserted(calls, extra).collect()) == [2, 3, 9]
