"""Density clustering of positions and of intervals, and the choice of one call per cluster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import neighbours
from .store import components, parts_for, stored


def dbscan_1d(points: DataFrame, by: list[str], x: str, key: str, eps: int = 100, min_points: int = 5, tile: int = 1 << 16, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """points plus cluster (0, 1, ... by position in each `by` group; -2 noise).

    Core points have min_points within eps, themselves included; cores at most eps apart join; a
    border point belongs to the cluster of the nearest core on the right, else on the left.
    Every tile of positions is judged on its own with the points up to 2 * eps around it; the
    number of clusters that start in the tiles before comes from one row per tile.  Those rows and the
    labels both read what was found of the points, for which `keep` may be `store.stored`."""
    width = max(tile, 4 * eps)
    at = lambda e: f"cast(floor(({e}) / {float(width)!r}D) AS bigint)"
    d = points.withColumn("__t", F.explode(F.expr(f"array_distinct(array({at(f'{x} - {2 * eps}')}, {at(x)}, {at(f'{x} + {2 * eps}')}))")))
    d = d.withColumn("__own", F.expr(f"__t = {at(x)}"))
    group = [*by, "__t"]
    d = d.repartition(parts_for(points), *group)
    near = Window.partitionBy(*group).orderBy(x).rangeBetween(-eps, eps)
    ahead, back = Window.partitionBy(*group).orderBy(x, key), Window.partitionBy(*group).orderBy(F.desc(x), F.desc(key))
    inside = f"{x} >= __t * {width} - {eps} AND {x} < (__t + 1) * {width} + {eps}"
    d = d.withColumn("__n", F.count(F.lit(1)).over(near)).withColumn("__core", F.expr(f"CASE WHEN __n >= {min_points} AND {inside} THEN {x} END"))
    d = d.withColumn("__prev", F.last("__core", ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("__new", F.expr(f"int(__core IS NOT NULL AND (__prev IS NULL OR __core - __prev > {eps}))"))
    d = d.withColumn("__id", F.sum(F.expr("if(__own, __new, 0)")).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__left", F.last("__core", ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__right", F.last(F.when(F.col("__core").isNotNull(), F.struct("__core", "__new")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    own = keep(d.where("__own").select(*points.columns, "__t", "__core", "__id", "__new", "__left", "__right"))
    starts = own.groupBy(*group).agg(F.sum("__new").alias("__s"))
    before = starts.select(*group, F.coalesce(F.sum("__s").over(Window.partitionBy(*by).orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    label = F.expr(
        f"CASE WHEN __core IS NOT NULL THEN __base + __id - 1 WHEN __right.__core - {x} <= {eps} THEN __base + __id + __right.__new - 1 WHEN {x} - __left <= {eps} THEN __base + __id - 1 ELSE -2 END"
    )
    return _same(own, before, group).withColumn("cluster", label.cast("int")).select(*points.columns, "cluster")


def largest_cluster(labels: DataFrame, by: list[str]) -> DataFrame:
    """Cluster of most points per group; ties go to the lowest id, noise never wins."""
    n = labels.where("cluster >= 0").groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("cluster"), F.max("n").alias("n"))


def upper_median(df: DataFrame, by: list[str], x: str, tile: int = 1 << 16, parts: int | None = None) -> DataFrame:
    """Element size div 2 of the sorted values (whole numbers), per group: counts per value are summed up, so equal values are one row.

    Counts per tile of values find the tile of the middle, and only that tile's values are sorted: no task sorts a group.
    Where `parts` is given, tiles are dealt over so many partitions (see `store.parts_for`)."""
    d = df.select(*by, F.col(x).alias("median"), F.expr(f"`{x}` div {tile}").alias("__t"))
    d = d.repartition(parts, *by, "__t") if parts else d
    counts = d.groupBy(*by, "median", "__t").agg(F.count(F.lit(1)).alias("__k"))
    upto = lambda d, group, order: d.withColumn("__upto", F.sum("__k").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    tiles = counts.groupBy(*by, "__t").agg(F.sum("__k").alias("__k")).withColumn("__n", F.sum("__k").over(Window.partitionBy(*by)))
    # Of the middle's tile, the place of the middle in it.
    middle = upto(tiles, by, "__t").where("__n div 2 < __upto AND __n div 2 >= __upto - __k").select(*by, "__t", F.expr("__n div 2 - (__upto - __k)").alias("__place"))
    seen = upto(_same(counts, middle, [*by, "__t"]), by, "median")
    return seen.where("__place < __upto AND __place >= __upto - __k").select(*by, "median")


def _weighed(calls: DataFrame, min_points: int | str, weight: str | None) -> DataFrame:
    """calls plus __w and __least, and positions as bigint."""
    long = {c: F.col(c).cast("bigint") for c in ("start_pos", "end_pos")}
    return calls.withColumns(long | {"__w": F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint"), "__least": F.col(min_points) if isinstance(min_points, str) else F.lit(min_points)})


def core_intervals(calls: DataFrame, key: str, by: list[str], eps: float, min_points: int | str, weight: str | None = None) -> DataFrame:
    """Core calls (by, key, n) under reciprocal overlap: those of at least min_points neighbours.

    n counts the neighbours, the call itself among them; a call of weight w counts as w equal calls.
    min_points is a number, or a column of calls.  A call without length has no neighbour."""
    n = neighbours.counts(_weighed(calls, min_points, weight).select(*by, key, "start_pos", "end_pos", "__w", "__least"), key, by, eps)
    return n.where("n >= __least").select(*by, key, "n")


def labelled_intervals(calls: DataFrame, key: str, by: list[str], eps: float, min_points: int | str, weight: str | None = None) -> DataFrame:
    """calls plus cluster_key (null: noise), the key of the first core call of each call's cluster in the order (start, end, key).

    A border call goes to the first cluster that reaches it; a later one takes it over if that
    cluster's first core call is its neighbour (as a scan in that order does).  Cells of calls are
    clustered on their own; what they share are components over the core calls that several of them
    hold, and only clusters that leave a cell are looked up there.  Keys are unique; `weight` and
    `min_points` are those of `core_intervals`."""
    kinds = dict(calls.dtypes)
    # The carried columns keep their own types; positions that are bigint are there already.
    kept = {c if c in ("start_pos", "end_pos") and kinds[c] == "bigint" else f"__c{i}": c for i, c in enumerate(calls.columns) if c not in (*by, key)}
    copies = [k for k, c in kept.items() if k != c]
    d = _weighed(calls.select("*", *(F.col(kept[k]).alias(k) for k in copies)), min_points, weight)
    wide = d.select(*by, key, "start_pos", "end_pos", "__w", "__least", *copies)
    found = stored(neighbours.local_clusters(wide, key, by, eps, list(kept)))
    place = F.struct(F.col("r_start").alias("start"), F.col("r_end").alias("end"), F.col("r_key").alias("key"))
    links = found.where("kind = 2")
    root = components(links.select(F.col(key).alias("a"), F.col("r_key").alias("b")))
    ends = links.groupBy(F.col("r_key").alias("node")).agg(F.min(place).alias("place")).join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    seeds = ends.groupBy("root").agg(F.min("place").alias("seed"))
    seeds = stored(ends.select(F.col("node").alias("r_key"), "root").join(seeds, "root").select("r_key", "seed"))
    own = [*by, key, *kept]
    final = found.where("kind = 0 AND NOT open").select(*own, F.col("r_key").alias("cluster_key"))
    cores = found.where("kind = 0 AND open").join(seeds, "r_key").select(*own, F.col("seed.key").alias("cluster_key"))
    reach = found.where("kind = 1").join(seeds, "r_key", "left").withColumn("seed", F.coalesce("seed", place))
    taken = F.max(F.when(F.col("adj") & (F.col("seed.key") == F.col("r_key")), F.col("seed"))).alias("taken")
    border = reach.groupBy(key).agg(F.min("seed").alias("first"), taken, F.first(F.struct(*own)).alias("r"))
    border = border.select("r.*", F.greatest("first", "taken").getField("key").alias("cluster_key"))
    # Calls that can have no neighbours are core only by their own weight, and only if they have a length.
    alone = wide.where(f"NOT coalesce({neighbours.usable(by)}, false)")
    alone = alone.select(*own, F.when(F.expr("end_pos > start_pos AND __w >= __least"), F.col(key)).alias("cluster_key"))
    every = final.unionByName(cores).unionByName(border).unionByName(alone)
    names = {c: k for k, c in kept.items()}
    return every.select(*(F.col(names.get(c, c)).alias(c) for c in calls.columns), "cluster_key")


def dbscan_intervals(calls: DataFrame, key: str, by: list[str], eps: float, min_points: int | str, weight: str | None = None) -> DataFrame:
    """by, key and cluster_key of every call: see `labelled_intervals`."""
    more = [c for c in (weight, min_points) if isinstance(c, str)]
    narrow = calls.select(*by, key, "start_pos", "end_pos", *(c for c in dict.fromkeys(more) if c not in (*by, key, "start_pos", "end_pos")))
    return labelled_intervals(narrow, key, by, eps, min_points, weight).select(*by, key, "cluster_key")


def merge_calls(calls: DataFrame, by: list[str], cluster: str, key: str, noise: str | None = None, weight: str | None = None) -> DataFrame:
    """One call per cluster: if any has a likelihood, the first non-zero one by (support, length); else the middle of the longest fifth.

    Clusters of one call are dropped.  Where `noise` is 'keep' or 'merge', `by` are the contig and
    type, a null cluster is noise, and types with a single call pass through; noise calls of a type
    (two or more) are kept as they are, or merged like one more cluster.  A call of weight w counts
    as w equal calls (and is w rows where noise is kept)."""
    d = calls.withColumn("__len", F.col("end_pos") - F.col("start_pos")).withColumn("__w", F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint"))
    group = [*by, "__c"]
    d = d.withColumn("__c", F.struct(F.col(cluster).alias("c")))
    # Counts per length carry all that is asked of a cluster, so calls themselves are dealt once.
    lengths = d.groupBy(*group, "__len").agg(F.sum("__w").alias("__k"), F.max((F.col("hmm_lh") != 0).cast("int")).alias("__any"))
    alone = None
    if noise:
        # One row per contig and type.
        total = F.broadcast(lengths.groupBy(*by).agg(F.sum("__k").alias("__all"), F.sum(F.expr("if(__c.c IS NULL, __k, 0)")).alias("__noise")))
        alone = _same(d, total, by).where("__all = 1" + (" OR (__c.c IS NULL AND __noise > 1)" if noise == "keep" else ""))
        if weight:
            alone = alone.withColumn("__i", F.explode(F.expr("sequence(1L, __w)")))
        used = "__all > 1" if noise == "merge" else "__all > 1 AND __c.c IS NOT NULL"
        lengths = _same(lengths, total, by).where(used).drop("__all", "__noise")
        d = d.where("__c.c IS NOT NULL") if noise == "keep" else d
    rank = "(greatest(1, cast(floor(__n * 0.2D) AS bigint)) div 2) + 1"
    every = Window.partitionBy(*group)
    above = F.coalesce(F.sum("__k").over(every.orderBy(F.desc("__len")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(every.orderBy(F.desc("__len")))
    lengths = lengths.withColumns({"__n": F.sum("__k").over(every), "__some": F.max("__any").over(every), "__above": above, "__place": place}).where("__n > 1")
    # By likelihood: a maximum, combined before the shuffle.
    row = F.struct(*calls.columns)
    best = d.where("hmm_lh <> 0").groupBy(*group).agg(F.max_by(row, F.struct("cluster_size", "__len", F.expr(f"-`{key}`"))).alias("r"))
    best = _same(best, lengths.where("__some = 1 AND __place = 1").select(*group), group).select("r.*")
    # By length: counts per length find the length of that rank; only calls of that length are ranked.
    at = lengths.where("__some = 0").withColumn("__left", F.expr(f"{rank} - __above")).where("__left BETWEEN 1 AND __k").select(*group, "__len", "__left", "__n")
    upto = F.sum("__w").over(Window.partitionBy(*group).orderBy("start_pos", key).rowsBetween(Window.unboundedPreceding, 0))
    ties = _same(d, at, [*group, "__len"]).withColumn("__upto", upto).where("__left BETWEEN __upto - __w + 1 AND __upto")
    out = best.withColumn("cluster_size", F.col("cluster_size").cast("bigint")).unionByName(ties.withColumn("cluster_size", F.col("__n")).select(*calls.columns))
    return out.unionByName(alone.withColumn("cluster_size", F.col("cluster_size").cast("bigint")).select(*calls.columns)) if alone is not None else out


def _same(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which nulls are equal."""
    other = b.select(*(F.col(c).alias(f"__b{i}") for i, c in enumerate(on)), *(c for c in b.columns if c not in on))
    hit = a.join(other, [a[c].eqNullSafe(other[f"__b{i}"]) for i, c in enumerate(on)])
    return hit.drop(*(f"__b{i}" for i in range(len(on))))


def dedupe_calls(calls: DataFrame, key: str = "call_id") -> DataFrame:
    """Calls of equal span made one: support summed, all other attributes those of the last by (type, key)."""
    rest = [c for c in calls.columns if c not in ("chrom", "start_pos", "end_pos", "cluster_size")]
    last = F.max_by(F.struct(*rest), F.struct("sv_type", key)).alias("r")
    return calls.groupBy("chrom", "start_pos", "end_pos").agg(F.sum("cluster_size").alias("cluster_size"), last).select("chrom", "start_pos", "end_pos", "cluster_size", "r.*")


def normalised_score(df: DataFrame, by: list[str], key: str, weight: float = 0.5) -> DataFrame:
    """Row with the best weighted min-max score of two columns (a, b) per group (the smallest key on ties); constant columns score nothing.

    Ranges and best rows are aggregates, combined before the shuffle, so a group is never one window."""
    span = df.groupBy(*by).agg(*(f(c).alias(f"__{n}_{c}") for c in "ab" for n, f in (("lo", F.min), ("hi", F.max))))
    d = _same(df, F.broadcast(span), by)  # one row per group
    scale = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__lo_{c}"), F.col(f"__hi_{c}") - F.col(f"__lo_{c}")), F.lit(0.0))
    d = d.withColumn("score", weight * scale("a") + (1 - weight) * scale("b")).select(*df.columns, "score")
    # The smallest of (-score, key).
    first = d.groupBy(*by).agg(F.min_by(F.struct(*d.columns), F.struct(-F.col("score"), F.col(key))).alias("__r"))
    return first.select("__r.*")
