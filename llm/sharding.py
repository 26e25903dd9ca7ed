"""Weighted rendezvous hashing: every record goes to the shard that scores its key highest.

The score of shard s for key k is -weight / ln(u), u in (0, 1) from a hash of (k, s); adding
a shard moves only the records that it wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def unit(key: str, shard: int) -> str:
    """SQL: u in (0, 1) from 52 bits of md5; the same text runs nearly as is in other engines."""
    return f"((conv(substr(md5(concat({key}, ':{shard}')), 1, 13), 16, 10) + 0.5D) / 4503599627370496D)"


def rendezvous(key: str, weights: Sequence[float]) -> Column:
    """The shard (int) that wins the key (a SQL string expression)."""
    scores = [f"named_struct('score', {float(w)!r}D / -ln({unit(key, i)}), 'shard', {-i})" for i, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("a shard needs a positive weight")
    return F.expr(f"-(greatest({', '.join(scores)}).shard)" if len(scores) > 1 else f"-({scores[0]}.shard)")


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """id, `keep`, shard, grown_shard (with the grown weights, else null) and slot long, gapless from 0 in each shard.

    Slots number a shard by hash bucket, then id: counts per (shard, bucket) give each bucket's
    first slot and a window numbers its rows, so no task holds a whole shard.  A null id is a key
    of its own; repeated ids share their shard and get slots of their own."""
    cols = list(dict.fromkeys((id_col, *keep)))
    key = f"coalesce(cast(`{id_col}` AS string), 'null')"
    rows = docs.select(*(F.col(f"`{c}`") for c in cols), rendezvous(key, weights).alias("shard"), (rendezvous(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"), F.expr(bucket(key)).alias("__b"))
    counts = rows.groupBy("shard", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    # At most BUCKETS rows per shard, whatever the input.
    out = rows.join(F.broadcast(first) if len(weights) * BUCKETS <= 1_000_000 else first, ["shard", "__b"])
    local = F.row_number().over(Window.partitionBy("shard", "__b").orderBy(F.col(f"`{id_col}`").asc_nulls_first()))
    return out.select(*(F.col(f"`{c}`") for c in cols), "shard", "grown_shard", (F.col("__first") + local - 1).cast("long").alias("slot"))


def bucket(key: str) -> str:
    return f"cast(conv(substr(md5(concat({key}, ':slot')), 1, 8), 16, 10) AS bigint) % {BUCKETS}"


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, id_col: str = "doc_id") -> None:
    """docs as Parquet, one folder per shard; a shard's rows spread over files by hash bucket."""
    key = f"coalesce(cast(`{id_col}` AS string), 'null')"
    docs.withColumn("shard", rendezvous(key, weights)).write.partitionBy("shard").parquet(path)
