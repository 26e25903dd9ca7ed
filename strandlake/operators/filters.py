"""Small filters and scalar rules of calls and call sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_CNV, SAVED_CNV = 2_000, 30_000


def valid_spans(calls: DataFrame) -> DataFrame:
    """Calls that do not end before they start."""
    return calls.where("start_pos <= end_pos")


def long_enough(calls: DataFrame, least: int = MIN_CNV) -> DataFrame:
    """Calls that copy-number prediction looks at: end - start of at least `least`."""
    return calls.where(F.col("end_pos") - F.col("start_pos") >= least)


def length_between(calls: DataFrame, least: int, most: int) -> DataFrame:
    """Calls of `least` to `most` bases, both included."""
    return calls.where((F.col("end_pos") - F.col("start_pos") + 1).between(least, most))


def saved_cnvs(calls: DataFrame, least: int = SAVED_CNV) -> DataFrame:
    """Calls of a known, not neutral type with an end at least `least` behind the start, whose observations are saved."""
    return known_types(calls).where(F.col("end_pos") - F.col("start_pos") >= least)


def known_types(calls: DataFrame) -> DataFrame:
    """Calls but those of type UNKNOWN or NEUTRAL, which are not put out."""
    return calls.where(~F.col("sv_type").isin("UNKNOWN", "NEUTRAL"))


def contigs_with_reads(means: DataFrame) -> DataFrame:
    return means.where("mean_cov > 0")


def type_contains(info: DataFrame, part: str, col: str = "info") -> tuple[DataFrame, DataFrame]:
    """Rows whose SVTYPE contains `part`, and the others (null INFO among them)."""
    has = F.coalesce(F.col(col).contains(f"SVTYPE={part}"), F.lit(False))
    return info.where(has), info.where(~has)


def null_counts(df: DataFrame) -> DataFrame:
    """One row with the number of nulls of every column, in one pass."""
    return df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns))


def require_no_nulls(df: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """df; a job over it fails at the first null in the columns (all by default), with the column's name."""
    checked = {c: F.when(F.col(f"`{c}`").isNull(), F.raise_error(F.lit(f"null in {c}")).cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")) for c in columns or df.columns}
    return df.withColumns(checked)


def likelihood_or_least(col: str) -> Column:
    """A likelihood of 0 counts as the least negative one when scores are scaled."""
    return F.when(F.col(col) == 0, F.lit(-1e-100)).otherwise(F.col(col))


def sv_size(caller: str, span: str = "end_pos - start_pos", sv_len: str = "sv_len") -> Column:
    """Size of a call: its span for callers that give no signed length, else the absolute SVLEN; none for BND."""
    return F.expr(f"CASE WHEN sv_type = 'BND' THEN NULL WHEN {caller} = 'DELLY' THEN {span} ELSE abs({sv_len}) END")


def labelled_union(parts: dict[int, DataFrame], label: str = "label") -> DataFrame:
    """UNION ALL of call sets with the label of each."""
    return reduce(DataFrame.unionByName, (d.withColumn(label, F.lit(v)) for v, d in parts.items()))


def rows_left(chunk: DataFrame, emitted: DataFrame, key: str) -> DataFrame:
    """Rows of chunk that are not emitted yet."""
    return chunk.join(emitted.select(key).distinct(), key, "left_anti")


def rewritten(chunk: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """chunk with the INFO of merged rows of the same key, once each; others are dropped."""
    return chunk.drop("info").join(merged.select(key, "info").dropDuplicates([key]), key).dropDuplicates([key])


def position_bounds(snps: DataFrame) -> DataFrame:
    return snps.groupBy("chrom").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def zip_trio(child: DataFrame, father: DataFrame, mother: DataFrame) -> DataFrame:
    """Rows of three call sets put side by side by their ordinal; different lengths are an error."""
    sides = {"child": child, "father": father, "mother": mother}
    sizes = {k: d.count() for k, d in sides.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"call sets differ in length: {sizes}")
    return child.join(father.select("ordinal", "gt_father"), "ordinal").join(mother.select("ordinal", "gt_mother"), "ordinal")


def drawn(calls: DataFrame, least: int = 10_000, contig: str | None = None) -> DataFrame:
    """Calls that a chart shows: `least` bases or more between their ends, on one contig if it is named."""
    d = calls.where(F.col("end_pos") - F.col("start_pos") >= least)
    return d if contig is None else d.where(F.col("chrom") == contig)


def shown_baf(col: str = "baf", is_snp: str = "is_snp", empty: float = 0.0) -> Column:
    """The allele frequency of SNPs, and `empty` (0 in files, NaN in charts) where there is none."""
    return F.when(F.col(is_snp), F.col(col)).otherwise(F.lit(empty))


def types_in_order(calls: DataFrame) -> DataFrame:
    """The types that occur, by their names: sv_type, place (from 0)."""
    order = Window.orderBy("sv_type")  # one row per type
    return calls.select("sv_type").distinct().select("sv_type", (F.row_number().over(order) - 1).alias("place"))


def first_rows(df: DataFrame, order: list[str], n: int = 10_000) -> DataFrame:
    """The first n rows in an order, as a reader with a row limit gives them."""
    return df.orderBy(*order).limit(n)
