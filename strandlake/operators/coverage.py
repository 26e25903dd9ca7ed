"""Depth of coverage as run-length tables.

Blocks are cut at tile edges, so that every tile is swept on its own: no task holds a contig.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = 1 << 11
SKIPPED = 0x704


def read_filter(alignments: DataFrame) -> DataFrame:
    """Reads that count for depth: neither unmapped, secondary, QC-failed nor duplicate."""
    return alignments.where(F.col("flag").bitwiseAND(SKIPPED) == 0)


def tiled(blocks: DataFrame, tile: int = TILE) -> DataFrame:
    """Closed intervals cut at multiples of the tile: chrom, tile, start_pos, end_pos."""
    cut = blocks.select("chrom", "start_pos", "end_pos", F.explode(F.expr(f"sequence(start_pos div {tile}, end_pos div {tile})")).alias("tile"))
    return cut.select("chrom", "tile", F.greatest("start_pos", F.expr(f"tile * {tile}")).alias("start_pos"), F.least("end_pos", F.expr(f"(tile + 1) * {tile} - 1")).alias("end_pos"))


def _swept(table: pa.Table) -> pa.RecordBatch:
    """Runs of positive depth of blocks (chrom, tile, start_pos, end_pos) whose tiles follow each other and are whole."""
    chrom, tile, start, end = (c.chunk(0) for c in table.combine_chunks().columns)
    start, end = (x.to_numpy().astype(np.int64) for x in (start, end))
    new = _tile_starts(chrom, tile.to_numpy())
    group = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(start)]))
    p, of = np.concatenate([start, end + 1]), np.concatenate([group, group])
    order = np.lexsort((p, of))
    p, of, step = p[order], of[order], np.where(order < len(start), 1, -1)
    heads = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (of[1:] != of[:-1])])
    # Steps of a tile sum up to nothing, so the sum goes on over tiles; places without a step end no run.
    step = np.add.reduceat(step, heads)
    p, of, step = p[heads][step != 0], of[heads][step != 0], step[step != 0]
    depth = np.cumsum(step)
    at = np.flatnonzero(depth > 0)
    return pa.RecordBatch.from_arrays([chrom.take(pa.array(new[of[at]])), pa.array(p[at]), pa.array(p[at + 1] - 1), pa.array(depth[at])], names=["chrom", "start_pos", "end_pos", "depth"])


def _tile_starts(chrom: pa.Array, tile: np.ndarray) -> np.ndarray:
    code = chrom.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (tile[1:] != tile[:-1])])


def coverage_runs(blocks: DataFrame, tile: int = TILE) -> DataFrame:
    """chrom, start_pos, end_pos, depth of every maximal run of positive depth inside a tile (sweep line).

    Blocks are dealt to their tiles once; a task sweeps the tiles of a batch at once and holds those of the last one until the tile is whole."""
    d = tiled(blocks, tile).select("chrom", "tile", F.col("start_pos").cast("bigint").alias("start_pos"), F.col("end_pos").cast("bigint").alias("end_pos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            first = (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
            if held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != first:
                yield _swept(pa.Table.from_batches(held))
                held = []
            cut = int(_tile_starts(batch.column(0), batch.column(1).to_numpy())[-1])
            if cut:
                yield _swept(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield _swept(pa.Table.from_batches(held))

    return d.repartition("chrom", "tile").sortWithinPartitions("chrom", "tile").mapInArrow(run, f"chrom {dict(blocks.dtypes)['chrom']}, start_pos bigint, end_pos bigint, depth bigint")


def mean_coverage(runs: DataFrame) -> DataFrame:
    """Mean depth over the covered positions of each contig."""
    return runs.groupBy("chrom").agg(F.try_divide(F.sum(F.expr("depth * (end_pos - start_pos + 1)")), F.sum(F.expr("end_pos - start_pos + 1"))).alias("mean_cov"))


def depth_at(points: DataFrame, runs: DataFrame, tile: int = TILE) -> DataFrame:
    """points (chrom, pos, ...) plus depth, 0 outside all runs: an equi-join on the tile with the run check in it."""
    r = runs.select(F.col("chrom").alias("__c"), F.expr(f"start_pos div {tile}").alias("__t"), F.col("start_pos").alias("__s"), F.col("end_pos").alias("__e"), "depth")
    p = points.withColumn("__pt", F.expr(f"pos div {tile}"))
    on = (p.chrom == r["__c"]) & (p["__pt"] == r["__t"]) & p.pos.between(r["__s"], r["__e"])
    # Run lengths are small in a file and not in memory: no broadcast.
    return p.join(r.hint("merge"), on, "left").select(*points.columns, F.coalesce("depth", F.lit(0)).alias("depth"))


def over_tiles(items: DataFrame, runs: DataFrame, make: Callable, schema: str, tile: int = TILE) -> DataFrame:
    """Batches make(rows, tile number, below) of the items (chrom, tile, ...), where below(p) is the sum of the depths at the tile's positions before each of p.

    Runs and items of a tile follow each other, runs first, so a tile's runs (one per position at
    most) are held once however many items ask for them, and no pair of item and run is a row."""
    kinds = dict(items.dtypes)
    more = [c for c in items.columns if c not in ("chrom", "tile")]
    lead = runs.selectExpr("chrom", f"start_pos div {tile} AS tile", "0 AS __kind", "start_pos AS __s", "end_pos AS __e", "cast(depth AS bigint) AS __d", *(f"cast(null AS {kinds[c]}) AS `{c}`" for c in more))
    rest = items.selectExpr("chrom", "tile", "1 AS __kind", *(f"cast(null AS bigint) AS {c}" for c in ("__s", "__e", "__d")), *(f"`{c}`" for c in more))
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lead.unionByName(rest).repartition(n, "chrom", "tile").sortWithinPartitions("chrom", "tile", "__kind", "__s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, below = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            chrom, at, kind = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            code = chrom.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (at[1:] != at[:-1]) | (kind[1:] != kind[:-1])])
            out = []
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)]):
                now = (chrom[a].as_py(), int(at[a]))
                if now != key:
                    key, held, below = now, [], None
                if kind[a] == 0:
                    held.append([batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False) for c in (3, 4, 5)])
                else:
                    below = below or _depth_below(held)
                    out.append(make(batch.slice(a, b - a), now[1], below))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return dealt.mapInArrow(run, schema)


def _depth_below(held: list) -> Callable[[np.ndarray], np.ndarray]:
    """The sum of the depths of runs (start, end, depth arrays in order of the start) at all positions before p."""
    if not held:
        return np.zeros_like
    s, e, d = (np.concatenate(x) for x in zip(*held))
    full = d * (e - s + 1)
    before = np.cumsum(full) - full

    def below(p: np.ndarray) -> np.ndarray:
        i = np.searchsorted(s, p) - 1
        return np.where(i < 0, 0, before[i] + d[i] * (np.minimum(p, e[i] + 1) - s[i]))

    return below


def window_log2(regions: DataFrame, runs: DataFrame, means: DataFrame, windows: int = 20, tile: int = TILE) -> DataFrame:
    """region_id, w, log2 of the window's mean depth over the contig's mean; an empty sum counts as 1e-9.

    Regions, not windows, are dealt to the tiles, and most windows end where they begin: only those
    across a tile's edge, and those of repeated ids, are summed up once more."""
    d = regions.select("region_id", "chrom", "start_pos", "end_pos").withColumn("again", F.count(F.lit(1)).over(Window.partitionBy("region_id", "chrom")) > 1)
    cut = d.where("start_pos <= end_pos").withColumn("tile", F.explode(F.expr(f"sequence(start_pos div {tile}, end_pos div {tile})")))
    kinds = dict(regions.dtypes)

    def make(rows: pa.RecordBatch, t: int, below: Callable) -> pa.RecordBatch:
        start, end, again = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("start_pos", "end_pos", "again"))
        step = (end - start + 1) / float(windows)
        edge = np.floor(start[:, None] + np.arange(windows + 1) * step[:, None]).astype(np.int64)
        a, b = edge[:, :-1], edge[:, 1:] - 1
        low, high = np.maximum(a, t * tile), np.minimum(b, (t + 1) * tile - 1)
        at, w = np.nonzero(low <= high)
        low, high, a, b = low[at, w], high[at, w], a[at, w], b[at, w]
        parts = (low > a) | (high < b) | again[at].astype(bool)
        row = pa.array(at)
        columns = [rows.column("region_id").take(row), rows.column("chrom").take(row), pa.array(w.astype(np.int32)), pa.array(a), pa.array(b), pa.array(below(high + 1) - below(low)), pa.array(parts)]
        return pa.RecordBatch.from_arrays(columns, names=["region_id", "chrom", "w", "start_pos", "end_pos", "total", "parts"])

    schema = f"region_id {kinds['region_id']}, chrom {kinds['chrom']}, w int, start_pos bigint, end_pos bigint, total bigint, parts boolean"
    found = over_tiles(cut, runs, make, schema, tile)
    key = ["region_id", "chrom", "w", "start_pos", "end_pos"]
    whole = found.where("NOT parts").select(*key, "total")
    total = whole.unionByName(found.where("parts").groupBy(*key).agg(F.sum("total").alias("total")))
    # One row per contig.
    out = total.join(F.broadcast(means), "chrom")
    return out.select("region_id", "w", F.expr("log2(if(total = 0, 1e-9D, total / (end_pos - start_pos + 1D)) / mean_cov)").alias("log2_cov"))
