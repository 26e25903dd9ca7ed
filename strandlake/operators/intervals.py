"""Interval joins and islands, blocked by position so that no contig is one group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import neighbours
from .store import parts_for


def overlap_islands(df: DataFrame, by: list[str], keys: list[str], tile: int = 1 << 16) -> DataFrame:
    """df plus island: rows of one `by` group whose closed intervals chain together share it (the island's start).

    Tiles of start positions are swept on their own; one row per tile carries the greatest end, and
    the last island's start, to the tiles after it."""
    group = [*by, "__t"]
    rows = df.withColumn("__t", F.expr(f"start_pos div {tile}"))
    carried = lambda t, c: t.select(*group, F.max(c).over(Window.partitionBy(*by).orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    w = Window.partitionBy(*group).orderBy("start_pos", "end_pos", *keys)
    seen = rows.join(carried(rows.groupBy(*group).agg(F.max("end_pos").alias("m")), "m"), group)
    seen = seen.withColumn("__m", F.greatest("__before", F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1)))).drop("__before")
    seen = seen.withColumn("__new", F.expr("CASE WHEN __m IS NULL OR start_pos > __m THEN start_pos END"))
    # Starts ascend, so the last one is the greatest.
    last = carried(seen.groupBy(*group).agg(F.max("__new").alias("m")), "m")
    out = seen.join(last, group).withColumn("island", F.coalesce(F.max("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__before"))
    return out.select(*df.columns, "island")


def overlap_pairs(a: DataFrame, b: DataFrame, key: str, bin_size: int) -> DataFrame:
    """Pairs (a_id, b_id) on one contig with overlapping closed intervals.

    Both sides are put in every bin they touch; a pair is kept in the first bin they share only."""
    cut = lambda d, p: d.select(F.col("chrom").alias("chrom"), F.col(key).alias(f"{p}_id"), F.col("start_pos").alias(f"{p}_s"), F.col("end_pos").alias(f"{p}_e"), F.explode(F.expr(f"sequence(start_pos div {bin_size}, end_pos div {bin_size})")).alias("bin"))
    x, y = cut(a, "a"), cut(b, "b")
    return x.join(y, ["chrom", "bin"]).where(f"a_s <= b_e AND a_e >= b_s AND bin = greatest(a_s div {bin_size}, b_s div {bin_size})")


def overlap_counts(a: DataFrame, key: str, b: DataFrame | None = None, tile: int = 1 << 16) -> DataFrame:
    """key and n, the rows of b (without b: of a) whose closed intervals overlap those of the key's rows on their contig; 0 where none do, or contig or ends are null.

    An interval overlaps all that start by its end, less those that end before its start, so no pair
    is a row.  Starts and ends are counted in tiles of positions, and one row per tile carries the counts
    to the tiles after it."""
    good, odd = "chrom IS NOT NULL AND start_pos <= end_pos", "chrom IS NOT NULL AND start_pos > end_pos"
    keyed = a.select(F.col(key).alias("a_id"), "chrom", *(F.col(c).cast("bigint").alias(c) for c in ("start_pos", "end_pos")))
    own = int(b is None)
    # A place: starts (s) and ends (e) of b there, and the call that asks, from its start (q -1) or end (1).
    place = lambda p, s, e, q: f"named_struct('p', {p}, 's', {s}L, 'e', {e}L, 'q', {q})"
    asked = F.expr(f"array({place('start_pos', own, 0, -1)}, {place('end_pos', 0, own, 1)})")
    d = keyed.where(good).select("a_id", "chrom", F.explode(asked).alias("x")).select("a_id", "chrom", "x.*")
    if b is not None:
        ends = F.expr(f"array({place('cast(start_pos AS bigint)', 1, 0, 0)}, {place('cast(end_pos AS bigint)', 0, 1, 0)})")
        given = b.where(good).select("chrom", F.explode(ends).alias("x")).select("chrom", "x.*").groupBy("chrom", "p").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
        d = d.unionByName(given.withColumn("q", F.lit(0)), allowMissingColumns=True)
    d = d.withColumn("t", F.expr(f"cast(floor(p / {float(tile)!r}D) AS bigint)"))
    n = parts_for(d)
    before = Window.partitionBy("chrom").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("chrom", "t").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    base = sums.select("chrom", "t", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in "se"))
    w = Window.partitionBy("chrom", "t").orderBy("p")
    started, ended = F.sum("s").over(w.rangeBetween(Window.unboundedPreceding, 0)), F.sum("e").over(w.rangeBetween(Window.unboundedPreceding, -1))
    seen = d.repartition(n, "chrom", "t").withColumn("__started", started).withColumn("__ended", F.coalesce(ended, F.lit(0))).where("q <> 0")
    found = seen.join(base, ["chrom", "t"]).select("a_id", F.expr("if(q = 1, __s + __started, -(__e + __ended))").alias("n"))
    found = found.unionByName(keyed.where(f"NOT coalesce({good}, false)").select("a_id", F.lit(0).cast("bigint").alias("n")))
    # Reversed intervals, which no count of ends tells, are looked at pair by pair.
    other = a if b is None else b
    named = other.select("chrom", "start_pos", "end_pos", F.lit(None).cast(dict(keyed.dtypes)["a_id"]).alias("a_id"))
    for x, y in ((keyed.where(odd), named), (keyed.where(good), named.where(odd))):
        if not (x if y is named else y).isEmpty():
            found = found.unionByName(overlap_pairs(x, y, "a_id", 256).select("a_id", F.lit(1).cast("bigint").alias("n")))
    return found.repartition(n, "a_id").groupBy(F.col("a_id").alias(key)).agg(F.sum("n").alias("n"))


def reciprocal_pairs(df: DataFrame, key: str, by: list[str], eps: float) -> DataFrame:
    """Pairs a_id < b_id with 1 - min(overlap / length) <= eps, length end - start: see `neighbours`; rows of equal ids are pairs of their own."""
    long = {c: F.col(c).cast("bigint") for c in ("start_pos", "end_pos")}
    return neighbours.pairs(df.withColumns(long), key, by, eps)


def gap_flag(calls: DataFrame, gaps: DataFrame, key: list[str] | None = None, share: float = 0.2) -> DataFrame:
    """calls plus gap: whether one assembly gap, both ends moved up by one, covers more than `share` of the call.

    Calls go by bands of their length and, in bins as wide as the band's longest call, to the one of their
    start: it ends in that bin or the next.  A gap is cut into the bins of those bands only of which it is
    long enough to cover the share, and into the one before.  A bin's gaps are one row (twenty or so, as
    gaps do not overlap), so calls are dealt once and need no key; `key` is not looked at."""
    start, end = "start_pos", "greatest(end_pos, start_pos)"
    spans = calls.withColumn("__band", F.expr(f"cast(floor(log2({end} - {start} + 1)) AS int)"))
    # Width of a band's bins: the greatest length in it.
    cell = lambda x: f"cast(floor(({x}) / shiftleft(2L, __band)) AS bigint)"
    spans = spans.withColumn("__bin", F.expr(cell(start)))
    g = gaps.selectExpr("chrom", "start_pos + 1 AS g_s", "end_pos + 1 AS g_e").where("g_e >= g_s")
    # Some thirty numbers at most.
    bands = [r[0] for r in spans.select("__band").distinct().where("__band IS NOT NULL").collect()]
    g = g.withColumn("__band", F.explode(F.lit(bands).cast("array<int>"))).where(f"g_e - g_s + 1 > {share!r}D * shiftleft(1L, __band)")
    g = g.withColumn("__bin", F.explode(F.expr(f"sequence({cell('g_s')} - 1, {cell('g_e')})")))
    g = g.groupBy("chrom", "__band", "__bin").agg(F.collect_set(F.struct("g_s", "g_e")).alias("__gaps"))
    over = f"(least(end_pos, g.g_e) - greatest(start_pos, g.g_s) + 1) / cast(end_pos - start_pos + 1 AS double) > {share!r}D"
    d = spans.join(g, ["chrom", "__band", "__bin"], "left")
    return d.select(*calls.columns, F.expr(f"coalesce(exists(__gaps, g -> {over}), false)").alias("gap"))
