"""Scores of calls by a logistic model: features from INFO, training on two labelled call sets, saving, loading, scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import labelled_union, require_no_nulls
from .store import stored

FEATURES = ("chrom_code", "start", "sv_length", "type_code", "read_support", "clipped_bases")
# Codes of the types.
TYPE_CODE = {"DEL": 0, "DUP": 1, "INV": 2, "INS": 3, "BND": 4}


def contig_codes(*call_sets: DataFrame) -> DataFrame:
    """chrom, chrom_code: contigs numbered by their first appearance over all call sets, one after the other (each has chrom and ordinal, which is anything with an order)."""
    first = [d.groupBy("chrom").agg(F.min(F.struct(F.lit(i).alias("s"), "ordinal")).alias("f")) for i, d in enumerate(call_sets)]
    every = first[0]
    for d in first[1:]:
        every = every.unionByName(d)
    # One row per contig.
    order = Window.orderBy("f")
    return every.groupBy("chrom").agg(F.min("f").alias("f")).select("chrom", (F.row_number().over(order) - 1).cast("int").alias("chrom_code"))


def call_features(calls: DataFrame, codes: DataFrame, strict: bool = True) -> DataFrame:
    """calls (chrom, pos, info, ordinal, ...) plus the six features; a repeat of type DUP counts as a duplication.

    CLIPSUP is 0 where absent.  Where `strict` is set, a job over rows that lack a feature fails and names it."""
    # Patterns begin with a fixed string, which is searched faster than a choice at every place.
    number = lambda k: F.expr(f"try_cast(nullif(regexp_extract(concat(';', info), ';{k}=(-?[0-9]+)', 1), '') AS int)")
    kind = F.expr("if(info LIKE '%REPTYPE=DUP%', 'DUP', nullif(regexp_extract(concat(';', info), ';SVTYPE=([A-Za-z0-9_]+)', 1), ''))")
    code = "CASE __kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_CODE.items()) + " END"
    d = calls.join(F.broadcast(codes), "chrom", "left").withColumn("__kind", kind)  # one row per contig
    d = d.withColumns({"start": F.col("pos"), "sv_length": number("SVLEN"), "type_code": F.expr(code), "read_support": number("SUPPORT"), "clipped_bases": F.coalesce(number("CLIPSUP"), F.lit(0))}).drop("__kind")
    if not strict:
        return d
    return require_no_nulls(d.select(*FEATURES, *(c for c in d.columns if c not in FEATURES)), FEATURES)


def labelled_features(true: DataFrame, false: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The features of two call sets (chrom, pos, info, ordinal, ...) with their label and other columns but info and ordinal, and the code table: one for both sets.

    They are written once, as INFO is dear to read and a fit and its scores take several passes."""
    codes = contig_codes(true, false)
    rows = labelled_union({1: call_features(true, codes), 0: call_features(false, codes)})
    return stored(rows.drop("info", "ordinal")), codes


def fit(rows: DataFrame) -> PipelineModel:
    """The model of labelled features: L2 with unit strength, features as they are."""
    n = rows.count()
    model = LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), model]).fit(rows.select(*FEATURES, "label"))


def train(true: DataFrame, false: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """The fitted model of two call sets (chrom, pos, info, ordinal), and the code table that scoring needs."""
    rows, codes = labelled_features(true, false)
    return fit(rows), codes


def save(model: PipelineModel, codes: DataFrame, path: str) -> None:
    """The model and its code table below one folder."""
    model.write().overwrite().save(f"{path}/model")
    codes.coalesce(1).write.mode("overwrite").parquet(f"{path}/contigs")


def load(spark, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/contigs")


def score(calls: DataFrame, model: PipelineModel, codes: DataFrame) -> DataFrame:
    """calls plus score, the probability of being true; contigs that training did not see get the number after the last."""
    unseen = codes.agg(F.coalesce(F.max("chrom_code") + 1, F.lit(0)).alias("n")).first().n
    d = call_features(calls, codes, strict=False).withColumn("chrom_code", F.coalesce("chrom_code", F.lit(unseen)))
    return score_features(require_no_nulls(d, FEATURES), model).select(*calls.columns, "score")


def score_features(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """rows with the six features plus score, the probability of being true."""
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")
