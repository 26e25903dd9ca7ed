"""Neighbours under reciprocal overlap by cells of length and position: a call goes to its own cell once, and to others only from their edges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import parts_for

#: A cell holds lengths of one power of STEP, and starts of WIDE times the longest of them.
STEP, WIDE = 32, 16
#: Pairs that are looked at in one go.
CHUNK = 1 << 20


def usable(by: list[str]) -> str:
    """SQL: whether a call can have neighbours."""
    return " AND ".join(["end_pos > start_pos", *(f"`{c}` IS NOT NULL" for c in by)])


def cells(df: DataFrame, by: list[str], eps: float, hops: int = 1) -> DataFrame:
    """Usable rows of df in every cell (__k, __t) whose calls they may reach in so many steps from neighbour to neighbour, plus __own (their own cell) and __shared (they are in several).

    Lengths of neighbours differ by a factor of at most 1 / (1 - eps) and starts by at most eps times
    the longer one, length being end - start."""
    r = ((1 - eps) * 0.999) ** hops  # a little loose; the exact predicate follows
    size, log = "(end_pos - start_pos)", math.log(STEP)
    band = lambda x: f"cast(floor(ln({x}) / {log!r}D) AS int)"
    d = df.where(usable(by)).withColumn("__k0", F.expr(band(size))).withColumn("__reach", F.expr(f"cast(ceil({hops * eps!r}D * {size} / {r!r}D) AS bigint) + 1"))
    width = lambda k: f"(cast(pow({STEP}D, greatest({k}, 0) + 1) AS bigint) * {WIDE}L)"
    cell = lambda x, k: f"cast(floor({x} / cast({width(k)} AS double)) AS bigint)"
    ks = f"sequence({band(f'{size} * {r!r}D')}, {band(f'{size} / {r!r}D')})"
    each = f"flatten(transform({ks}, k -> transform(sequence({cell('(start_pos - __reach)', 'k')}, {cell('(start_pos + __reach)', 'k')}), t -> named_struct('k', k, 't', t))))"
    d = d.withColumn("__cells", F.expr(each)).withColumn("__t0", F.expr(cell("start_pos", "__k0")))
    d = d.select(*df.columns, "__k0", "__t0", F.expr("size(__cells) > 1").alias("__shared"), F.explode("__cells").alias("__c"))
    d = d.select(*df.columns, F.col("__c.k").alias("__k"), F.col("__c.t").alias("__t"), F.expr("__c.k = __k0 AND __c.t = __t0").alias("__own"), "__shared")
    return d.repartition(parts_for(df, 8 << 20), *by, "__k", "__t")


def array(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def ranks(values: np.ndarray) -> np.ndarray:
    """Values as numbers of the same order."""
    return values if values.dtype.kind in "iu" else np.unique(values, return_inverse=True)[1].astype(np.int64)


def near(start: np.ndarray, end: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all neighbours (i before j) of calls sorted by start, a bounded number of candidates at a time."""
    size = (end - start).astype(np.float64)
    top = np.searchsorted(start, start + np.ceil(eps * size / ((1 - eps) * 0.999)).astype(np.int64) + 1, side="right")
    n = np.maximum(top - np.arange(len(start)) - 1, 0)
    upto = np.cumsum(n)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CHUNK, side="right")))
        # Of one call's candidates no more at a time either.
        for low in range(0, int(n[i]) if j == i + 1 else 1, CHUNK):
            count = n[i:j] if j > i + 1 else np.array([min(CHUNK, int(n[i]) - low)])
            a = np.repeat(np.arange(i, j), count)
            b = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + a + 1 + low
            over = np.minimum(end[a], end[b]) - start[b]
            good = (over >= 0) & (1.0 - np.minimum(over / size[a], over / size[b]) <= eps)
            yield a[good], b[good]
        i = j


def pairs(df: DataFrame, key: str, by: list[str], eps: float) -> DataFrame:
    """by, a_id, b_id of all neighbours, a_id < b_id."""
    kinds = dict(df.dtypes)
    group = [*by, "__k", "__t"]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), f"a_id {kinds[key]}", f"b_id {kinds[key]}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by("start_pos")
        ids, own = ranks(array(table, key)), array(table, "__own")
        names = {c: table.column(c)[0] for c in by}
        for a, b in near(array(table, "start_pos"), array(table, "end_pos"), eps):
            a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
            mine = own[a] & (ids[a] != ids[b])
            left, right = pa.array(a[mine]), pa.array(b[mine])
            cols = {c: pa.repeat(v, len(left)) for c, v in names.items()} | {"a_id": table.column(key).take(left), "b_id": table.column(key).take(right)}
            yield from pa.table(cols).combine_chunks().to_batches()

    d = cells(df.where(F.col(key).isNotNull()).select(*by, key, "start_pos", "end_pos"), by, eps)
    return d.groupBy(*group).applyInArrow(run, schema)


def _sums(start: np.ndarray, end: np.ndarray, weight: np.ndarray, eps: float) -> np.ndarray:
    n = weight.copy()
    for a, b in near(start, end, eps):
        np.add.at(n, a, weight[b])
        np.add.at(n, b, weight[a])
    return n


def counts(df: DataFrame, key: str, by: list[str], eps: float) -> DataFrame:
    """by, key, n, __least of every usable row of df (by, key, start_pos, end_pos, __w, __least): the weights of its neighbours and itself, summed up in its cell."""
    kinds = dict(df.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("start_pos")
        n = _sums(array(table, "start_pos"), array(table, "end_pos"), array(table, "__w"), eps)
        return table.append_column("n", pa.array(n)).filter(table.column("__own")).select([*by, key, "n", "__least"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*by, key)), "n bigint", f"__least {kinds['__least']}"])
    return cells(df, by, eps).groupBy(*by, "__k", "__t").applyInArrow(run, schema)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place of each one's component."""
    at = np.arange(n)
    while len(a):
        x, y = at[a], at[b]
        least = np.minimum(x, y)
        np.minimum.at(at, x, least)
        np.minimum.at(at, y, least)
        while True:
            on = at[at]
            if np.array_equal(on, at):
                break
            at = on
        apart = at[a] != at[b]
        a, b = a[apart], b[apart]
    return at


def local_clusters(df: DataFrame, key: str, by: list[str], eps: float, carried: list[str]) -> DataFrame:
    """What each cell knows of the clusters of its calls (df: by, key, start_pos, end_pos, __w, __least, carried).

    kind 0: an own call with its first core call (r_start, r_end, r_key; null: noise), which is final
    unless `open`; kind 1: one of several first core calls that a border call reaches, with `adj` where
    that one is its neighbour; kind 2: a core call that other cells hold too, with the first core
    call of its cluster here.  Cells hold what is two steps away, so it is known of each neighbour whether
    it is core."""
    kinds = dict(df.dtypes)
    kept = [*by, key, *carried]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("start_pos", "ascending"), ("end_pos", "ascending"), (key, "ascending")])
        start, end, own, shared = (array(table, c) for c in ("start_pos", "end_pos", "__own", "__shared"))
        n = _sums(start, end, array(table, "__w"), eps)
        core = n >= array(table, "__least")
        size = len(start)
        known = own.copy()
        at, tips = np.arange(size), []
        for a, b in near(start, end, eps):
            mine = own[a] | own[b]
            a, b = a[mine], b[mine]
            known[a] = known[b] = True
            inner = core[a] & core[b]
            # Only the joins of the trees so far are kept, and the pairs of a border call with a core one.
            joined = at[a[inner]], at[b[inner]]
            at = _roots(size, *joined)[at]
            for x, y in ((a, b), (b, a)):
                edge = own[x] & ~core[x] & core[y]
                tips.append((x[edge], y[edge]))
        at_core = core & known
        open_root = np.zeros(size, bool)
        out = at_core & (shared | ~own)
        open_root[at[out]] = True
        x, y = (np.concatenate(c) if tips else np.zeros(0, np.int64) for c in (zip(*tips) if tips else ((), ())))
        r = at[y]
        # A border call and the first core calls that it reaches, each once; whether one of the pairs is with that call itself.
        code, place = np.unique(x * size + r, return_inverse=True)
        adj = np.zeros(len(code), bool)
        np.logical_or.at(adj, place, y == r)
        x, r = code // max(size, 1), code % max(size, 1)
        first, taken = np.full(size, size), np.full(size, -1)
        np.minimum.at(first, x, r)
        np.maximum.at(taken, x[adj], r[adj])
        unsure = np.zeros(size, bool)
        unsure[x[open_root[r]]] = True
        many = unsure[x]
        label = np.where(core, at, np.where(first < size, np.maximum(first, taken), -1))
        zero = np.flatnonzero(own & ~unsure)
        two = np.flatnonzero(out)
        rows = np.concatenate([zero, x[many], two])
        root = np.concatenate([label[zero], r[many], at[two]])
        kind = np.repeat(np.array([0, 1, 2], np.int32), [len(zero), int(many.sum()), len(two)])
        none = root < 0
        take = pa.array(np.where(none, 0, root), mask=none)
        found = {f"r_{c}": table.column(s).take(take) for c, s in (("start", "start_pos"), ("end", "end_pos"), ("key", key))}
        more = {"kind": pa.array(kind), "open": pa.array(open_root[root] & ~none), "adj": pa.array(np.concatenate([np.zeros(len(zero), bool), adj[many], np.zeros(len(two), bool)]))}
        return pa.table({c: table.column(c).take(pa.array(rows)) for c in kept} | found | more)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "r_start bigint", "r_end bigint", f"r_key {kinds[key]}", "kind int", "open boolean", "adj boolean"])
    return cells(df, by, eps, 2).groupBy(*by, "__k", "__t").applyInArrow(run, schema)
