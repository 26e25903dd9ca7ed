"""Seeds and groups of split reads, and their calls, against plain scans."""

import random
from collections import defaultdict

import pytest

from strandlake.operators import split_calls

READ = "chrom string, qname string, start_pos long, end_pos long"


def scan_seeds(rows):
    """Contig by contig: a read that no group has yet is a seed, and takes all that overlap it."""
    seeds, groups = [], {}
    for c in {r[0] for r in rows}:
        own, taken = sorted((s, e, q) for k, q, s, e in rows if k == c), set()
        for s, e, q in own:
            if q in taken:
                continue
            group = {y for a, b, y in own if a <= e and b >= s}
            taken |= group
            seeds.append((c, q))
            if len(group) > 1:
                groups[c, q] = group
    return sorted(seeds), groups


@pytest.mark.parametrize("tile", [5, 64, 1 << 16])
def test_seeds_and_groups(spark, tile, monkeypatch):
    r = random.Random(tile)
    rows = [("c", f"a{i}", s, s + r.choice((0, 3, 40, 90, 400))) for i, s in enumerate(r.randrange(1, 3000) for _ in range(260))]
    rows += [("d", f"b{i}", 700, 700 + i % 4) for i in range(30)] + [("e", "alone", 5, 9), ("f", "x", 1, 10_000)] + [("f", f"y{i}", 3 * i + 1, 3 * i + 2) for i in range(50)]
    d = spark.createDataFrame(rows, READ).repartition(3)
    seeds, groups = scan_seeds(rows)
    assert sorted((x.chrom, x.qname) for x in split_calls.seed_reads(d, tile).collect()) == seeds
    got = defaultdict(set)
    for x in split_calls.star_groups(d).collect():
        got[x.chrom, x.grp].add(x.qname)
    assert got == groups


def largest(xs, eps, least):
    """Points of the largest cluster on a line (the first on ties)."""
    near = lambda x: [y for y in xs if abs(x - y) <= eps]
    core = sorted({x for x in xs if len(near(x)) >= least})
    label, n, last = {}, -1, None
    for x in core:
        n += last is None or x - last > eps
        label[x], last = n, x
    out = defaultdict(list)
    for x in xs:
        right = [c for c in core if 0 <= c - x <= eps]
        left = [c for c in core if 0 <= x - c <= eps]
        if right or left:
            out[label[min(right)] if right else label[max(left)]].append(x)
    return max(out.values(), key=len, default=[])


def plain_calls(rows, eps, least, low, high):
    """(start, end) -> (type, size) of split-read candidates, read by read."""
    ok = [r for r in rows if not r[2] & 0x704 and r[3] >= 20]
    supp = defaultdict(list)
    for r in ok:
        if r[2] & 0x800:
            supp[r[1]].append(r)
    prim = {}
    for r in sorted(ok, key=lambda r: r[8]):
        if not r[2] & 0x800 and r[1] in supp:
            prim[r[0], r[1]] = r
    _, groups = scan_seeds([(c, q, r[4], r[5]) for (c, q), r in prim.items()])
    middle = lambda xs: sorted(xs)[len(xs) // 2] if xs else None
    calls = []
    for (c, _), names in groups.items():
        members = [prim[c, q] for q in names]
        pairs = [(p, s) for p in members for s in supp[p[1]] if s[0] == c]
        turned = {p[1] for p, s in pairs if (p[2] ^ s[2]) & 16}
        inversion = len(turned) / len(members) > 0.5
        far = lambda a, b, i, j: max(0, max(a[i], b[i]) - min(a[j], b[j]))
        same = [(p, s) for p, s in pairs if not (p[2] ^ s[2]) & 16]
        best = [largest(x, eps, least) for x in ([p[4] for p in members], [p[5] for p in members], [s[4] for _, s in pairs], [s[5] for _, s in pairs])]
        rd = largest([(1 if p[4] < s[4] else -1) * far(p, s, 6, 7) for p, s in same], eps, least)
        fd = largest([far(p, s, 4, 5) for p, s in same], eps, least)
        if not best[0] and not best[1]:
            continue
        m, size = [middle(x) for x in best], [len(x) for x in best]
        if rd and fd:
            d, f = middle(rd), middle(fd)
            at = max(x for x in m[:2] if x is not None) if d > 0 and best[1] else max(x for x in m[2:] if x is not None) if d <= 0 and best[3] else None
            d = abs(d)
            if at is not None and d != f and low <= max(d, f) <= high:
                calls.append((c, at, at + max(d, f) - 1, "INS" if d > f else "UNKNOWN", max(size[:2])))
        for a in m[:2]:
            for b in m[2:]:
                if a is not None and b is not None and low <= abs(a - b) <= high:
                    calls.append((c, min(a, b), max(a, b) - 1, "INV" if inversion else "UNKNOWN", max(size)))
    out = {}
    for c, s, e, k, n in calls:
        kind, total = out.get((c, s, e), ("", 0))
        out[c, s, e] = max(kind, k), total + n
    return out


def test_calls_like_a_plain_scan(spark):
    """Random groups of all kinds: deletions, insertions with more of the read than of the reference, inversions, strays."""
    r = random.Random(12)
    rows, n = [], 0
    for g in range(14):
        at, kind = 20_000 * g + 5_000, r.choice(("del", "ins", "inv", "far", "mixed"))
        for i in range(r.choice((4, 8, 12))):
            name, j = f"g{g}r{i}", lambda: r.randrange(30)  # noqa: B023
            k = r.choice(("del", "ins", "inv")) if kind == "mixed" else kind
            p = (at + j(), at + 3000 + j())
            s = {"del": (at + 6000, at + 9000), "ins": (at + 3010, at + 6000), "inv": (at + 7000, at + 9000), "far": (at + 9000, at + 9900)}[k]
            q = {"ins": (6000, 9000)}.get(k, (3000, 6000))
            rows.append(("c", name, 0, 60, *p, 0, 3000, n))
            rows.append(("c" if k != "far" or i % 2 else "d", name, 2048 | (16 if k == "inv" else 0), 60, s[0] + j(), s[1] + j(), *q, n + 1))
            n += 2
    rows += [("c", "low", 0, 5, 1, 900, 0, 900, n), ("c", "g0r0", 0, 60, 5_100, 8_100, 0, 3000, n + 1), ("d", "lone", 0, 60, 1, 900, 0, 900, n + 2)]
    d = spark.createDataFrame(rows, "chrom string, qname string, flag int, mapq int, start_pos long, end_pos long, query_start long, query_end long, aln_id long")
    want = plain_calls(rows, 100, 5, 500, 1_000_000)
    got = {(x.chrom, x.start_pos, x.end_pos): (x.sv_type, x.cluster_size) for x in split_calls.split_read_calls(d, 100, 5, 500).collect()}
    assert got == want and {k for k, _ in want.values()} >= {"INS", "INV", "UNKNOWN"}
