"""SNP filters, trios, size statistics and evaluation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines of one block of a log.
LOG_BLOCK = 1 << 16


def snp_filter(snps: DataFrame) -> DataFrame:
    """Sites with QUAL > 30, DP > 10 and a passing filter, plus baf (null where no read covers it)."""
    return snps.where("qual > 30 AND dp > 10 AND flt IN ('PASS', '.')").withColumn("baf", F.expr("try_divide(cast(ad_alt AS double), ad_ref + ad_alt)"))


def attach_frequency(snps: DataFrame, freq: DataFrame, first_only: bool = False) -> DataFrame:
    """snps plus pfb from sites strictly between 0.01 and 0.99; missing ones 0. first_only keeps the first hit per contig."""
    f = freq.where("af > 0.01 AND af < 0.99").groupBy("chrom", "pos").agg(F.max("af").alias("pfb"))
    hit = snps.join(f, ["chrom", "pos"])
    if first_only:
        best = hit.groupBy("chrom").agg(F.min("pos").alias("pos"))
        f = f.join(best, ["chrom", "pos"], "left_semi")
    return snps.join(f, ["chrom", "pos"], "left").withColumn("pfb", F.coalesce("pfb", F.lit(0.0)))


def possible_child(father: str, mother: str) -> str:
    """SQL: sorted genotypes that a child of the two can have."""
    return f"transform(flatten(transform(split({father}, '/'), a -> transform(split({mother}, '/'), b -> array_sort(array(a, b))))), g -> array_join(g, '/'))"


def mendelian(trio: DataFrame, by: list[str]) -> DataFrame:
    """Errors and totals per group over trios whose three genotypes are known."""
    known = trio.where("NOT './.' IN (gt_father, gt_mother, gt_child)")
    wrong = known.withColumn("error", F.expr(f"int(NOT array_contains({possible_child('gt_father', 'gt_mother')}, array_join(array_sort(split(gt_child, '/')), '/')))"))
    return wrong.groupBy(*by).agg(F.sum("error").alias("errors"), F.count(F.lit(1)).alias("total"))


def parent_scenarios(trio: DataFrame) -> DataFrame:
    """One row: errors by the two scenarios of the parents' genotypes, all child records, and the rate.

    Like parents with another child, or unlike parents of which the child equals one.  trio has a row
    per child record; genotypes that are null or './.' make no error but count as records."""
    known = "NOT './.' IN (gt_father, gt_mother, gt_child)"
    wrong = "(gt_father = gt_mother AND gt_father <> gt_child) OR (gt_father <> gt_mother AND (gt_father = gt_child OR gt_mother = gt_child))"
    d = trio.agg(F.count_if(F.expr(f"coalesce({known} AND ({wrong}), false)")).alias("errors"), F.count(F.lit(1)).alias("total"))
    return d.withColumn("rate", F.expr("try_divide(cast(errors AS double), total)"))


def size_statistics(sizes: DataFrame, bounds: tuple[int, ...] = (10_000, 50_000, 100_000)) -> DataFrame:
    """Per type, and over all (sv_type null): count, size figures (population deviation) and the numbers above the bounds."""
    return sizes.rollup("sv_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.avg("size").alias("mean_size"),
        F.expr("percentile(size, 0.5)").alias("median_size"), F.stddev_pop("size").alias("sd_size"),
        *(F.count_if(F.col("size") > b).alias(f"over_{b}") for b in bounds),
    )


def size_buckets(sizes: DataFrame, edges: tuple[int, ...]) -> DataFrame:
    """Counts per type and half-open bucket between edges."""
    bucket = "CASE " + " ".join(f"WHEN size < {e} THEN {i}" for i, e in enumerate(edges)) + f" ELSE {len(edges)} END"
    return sizes.groupBy("sv_type", F.expr(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def precision_recall(counts: DataFrame) -> DataFrame:
    """Columns p and r from counts of true and false positives and false negatives (tp, fp, fn)."""
    return counts.withColumn("p", F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))).withColumn("r", F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0)))


def logistic_score(df: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """df plus score, the probability of a fitted logistic model given by its weights."""
    z = " + ".join([repr(float(intercept)) + "D", *(f"{float(w)!r}D * `{c}`" for c, w in weights.items())])
    return df.withColumn("score", F.expr(f"1D / (1D + exp(-({z})))"))


def score_histogram(scored: DataFrame, by: str = "label", bins: int = 10) -> DataFrame:
    """Counts of scores in [0, 1] per label and equal bin, the last one closed."""
    return scored.groupBy(F.expr(f"cast(least({bins - 1}, floor(score * {bins})) AS int)").alias("bin"), by).agg(F.count(F.lit(1)).alias("n"))


def best_f1(runs: DataFrame) -> DataFrame:
    """Per type the parameter of the best F1 (the smallest on ties)."""
    d = runs.withColumn("f1", F.expr("coalesce(try_divide(2 * p * r, p + r), 0D)"))
    w = Window.partitionBy("sv_type").orderBy(F.desc("f1"), "eps")
    return d.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("sv_type", "eps", "f1")


def benchmark_log(lines: DataFrame, by: str = "file") -> DataFrame:
    """Figures of evaluation logs: `by`, line_no, eps, section (type), metric (comp, base, FP, FN, precision, recall, f1), value, in file order.

    lines: `by`, line_no, line.  The epsilon and the section above a line are carried down; a section ends
    behind its recall, and figures outside one are not taken.  Lines are cut into blocks of their
    numbers and one row per block carries on, so a long log is not one group."""
    eps = F.expr("try_cast(nullif(regexp_extract(line, '#EPSILON= *([0-9.eE+-]+)', 1), '') AS double)")
    # A section's name opens it; an empty one closes it, from the next line on.
    opens = F.expr("nullif(regexp_extract(line, 'Running truvari.*?(DEL|DUP|INS|INV)', 1), '')")
    closes = F.expr("CASE WHEN line RLIKE 'recall[^:]*:' THEN '' END")
    d = lines.withColumns({"__b": F.expr(f"line_no div {LOG_BLOCK}"), "__eps": eps, "__at": F.coalesce(opens, closes)})
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    blocks = d.groupBy(by, "__b").agg(last("__eps"), last("__at"))
    before = Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(by, "__b", *(F.last(c, ignorenulls=True).over(before).alias(f"{c}0") for c in ("__eps", "__at")))
    w = Window.partitionBy(by, "__b").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(carried, [by, "__b"])
    d = d.withColumn("eps", F.coalesce("__eps", F.last("__eps", ignorenulls=True).over(w), "__eps0")).withColumn("section", F.coalesce(F.last("__at", ignorenulls=True).over(w), "__at0"))
    counter = lambda k: f"try_cast(nullif(regexp_extract(line, 'Zipped.*Counter.*[^a-z]{k}[^a-z0-9]+([0-9]+)', 1), '') AS double)"
    plain = lambda k: f"try_cast(replace(nullif(regexp_extract(line, '{k}[^:]*: *([0-9.,eE+-]*[0-9])', 1), ''), ',', '') AS double)"
    kinds = {"comp": counter("comp"), "base": counter("base"), **{k: f"if(line LIKE '%Zipped%', null, {plain(k)})" for k in ("FP", "FN", "precision", "recall", "f1")}}
    found = F.expr("array(" + ", ".join(f"named_struct('metric', '{k}', 'value', {e})" for k, e in kinds.items()) + ")")
    rows = d.where("section <> ''").select(by, "line_no", "eps", "section", F.explode(found).alias("m"))
    return rows.select(by, "line_no", "eps", "section", "m.metric", "m.value").where("value IS NOT NULL")


def lr_features(docs: DataFrame) -> DataFrame:
    """Numeric feature rows: contig-like codes by first appearance, sizes and labels."""
    first = docs.groupBy("source").agg(F.min("doc_id").alias("f"))
    # One row per source, numbered by first appearance.
    codes = first.select("source", (F.row_number().over(Window.orderBy("f")) - 1).alias("code"))
    return docs.join(codes, "source").select("doc_id", "code", F.col("n_chars").cast("double").alias("sv_length"), "label")
