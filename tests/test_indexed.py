"""Alignments and indexed lines: files made here block by block, read whole, by region, and with all other blocks broken."""

import random
import struct
import zlib

import pytest

from strandlake.sources import indexed, text

CONTIGS = [("chr1", 400_000), ("chr2", 90_000), ("chrEmpty", 500)]


class Writer:
    """A block-compressed file with small blocks."""

    def __init__(self, size):
        self.size, self.out, self.held, self.starts = size, b"", b"", []

    def tell(self):
        return len(self.out) << 16 | len(self.held)

    def flush(self):
        self.starts.append(len(self.out))
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(self.held) + c.flush()
        size = 18 + len(body) + 8
        self.out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, size - 1) + body + struct.pack("<II", zlib.crc32(self.held), len(self.held))
        self.held = b""

    def write(self, data):
        while data:
            part = data[: self.size - len(self.held)]
            self.held, data = self.held + part, data[len(part) :]
            if len(self.held) == self.size:
                self.flush()

    def done(self):
        if self.held:
            self.flush()
        self.flush()  # the empty last block
        return self.out


def bin_of(a, b):
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if a >> shift == (b - 1) >> shift:
            return first + (a >> shift)
    return 0


def index_of(spans, n):
    """Bins and linear index of (contig, start, end, from, to), as both formats have them."""
    out = struct.pack("<i", n)
    return out + bins_of(spans, n)


def bins_of(spans, n):
    out = b""
    for tid in range(n):
        bins, linear = {}, {}
        for t, a, b, x, y in spans:
            if t == tid:
                chunks = bins.setdefault(bin_of(a, b), [])
                if chunks and chunks[-1][1] == x:
                    chunks[-1][1] = y
                else:
                    chunks.append([x, y])
                for w in range(a >> 14, ((b - 1) >> 14) + 1):
                    linear[w] = min(linear.get(w, x), x)
        out += struct.pack("<i", len(bins) + 1)
        for k, chunks in bins.items():
            out += struct.pack("<Ii", k, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        out += struct.pack("<Ii4Q", 37450, 2, 0, 0, 0, 0)
        last, table = 0, []
        for w in range(max(linear, default=-1) + 1):
            last = linear.get(w, last)
            table.append(last)
        out += struct.pack("<i", len(table)) + struct.pack(f"<{len(table)}Q", *table)
    return out


@pytest.fixture(scope="module")
def bam(tmp_path_factory):
    r = random.Random(3)
    folder = tmp_path_factory.mktemp("bam")
    w = Writer(700)
    head = b"@HD\tVN:1.6\n"
    w.write(b"BAM\x01" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(CONTIGS)))
    for name, n in CONTIGS:
        w.write(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n))
    reads = []
    for tid, length in ((0, 400_000), (1, 90_000)):
        for a in sorted(r.randrange(length - 3000) for _ in range(250)):
            ops = [(r.randrange(1, 60), r.choice("MIDS=XN")) for _ in range(r.randrange(1, 6))] + [(r.randrange(1, 2000), "M")]
            n = sum(k for k, o in ops if o in "MIS=X")
            reads.append((tid, a, f"r{len(reads)}", r.choice((0, 16, 2048, 1024)), r.randrange(61), ops, "".join(r.choice("ACGTN") for _ in range(n))))
    reads += [(-1, -1, f"u{i}", 4, 0, [], "ACG"[: i % 4]) for i in range(5)]
    spans, rows = [], []
    for tid, a, name, flag, mapq, ops, seq in reads:
        used = max(1, sum(k for k, o in ops if o in "MDN=X"))
        codes = [indexed.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", tid, a, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", k << 4 | indexed.OPERATIONS.index(o)) for k, o in ops) + bytes(x << 4 | y for x, y in zip(codes[::2], codes[1::2])) + b"\xff" * len(seq) + b"NMC\x05"
        at = w.tell()
        w.write(struct.pack("<i", len(body)) + body)
        if tid >= 0:
            spans.append((tid, a, a + used, at, w.tell()))
        rows.append((CONTIGS[tid][0] if tid >= 0 else None, name, flag, mapq, a + 1, "".join(f"{k}{o}" for k, o in ops) or "*", seq, a + used))
    path = folder / "a.bam"
    path.write_bytes(w.done())
    (folder / "a.bam.bai").write_bytes(b"BAI\x01" + index_of(spans, len(CONTIGS)))
    return str(path), rows, w.starts


def test_whole_file_in_ranges(spark, bam):
    path, rows, _ = bam
    for split in (1500, 1 << 30):
        d = indexed.read_bam(spark, path, split=split)
        got = d.collect()
        assert [tuple(x)[:7] for x in sorted(got, key=lambda x: x.aln_id)] == [x[:7] for x in rows]
        assert len({x.aln_id for x in got}) == len(rows)
        assert (d.rdd.getNumPartitions() > 20) == (split == 1500)
    assert [tuple(x) for x in indexed.bam_contigs(spark, path).collect()] == [(i, *c) for i, c in enumerate(CONTIGS)]


def test_without_index(spark, bam, tmp_path):
    path, rows, _ = bam
    alone = tmp_path / "b.bam"
    alone.write_bytes(open(path, "rb").read())
    assert indexed.read_bam(spark, str(alone)).count() == len(rows)
    with pytest.raises(Exception, match="needs the index"):
        indexed.read_bam(spark, str(alone), "chr1").count()


def test_regions_and_filters(spark, bam):
    path, rows, _ = bam
    for region, chrom, a, b in (("chr1", "chr1", 1, 1 << 40), ("chr2:20,000-31000", "chr2", 20_000, 31_000), ("chr1:399999-400000", "chr1", 399_999, 400_000), ("chrEmpty", "chrEmpty", 1, 500), ("none:1-5", "none", 1, 5)):
        want = sorted(x[1] for x in rows if x[0] == chrom and x[4] <= b and x[7] >= a)
        assert sorted(x.qname for x in indexed.read_bam(spark, path, region, 900).collect()) == want
    d = indexed.read_bam(spark, path, split=900).where("chrom = 'chr2' AND start_pos >= 30000 AND start_pos < 40000")
    assert sorted(x.qname for x in d.collect()) == sorted(x[1] for x in rows if x[0] == "chr2" and 30_000 <= x[4] < 40_000)


def test_a_region_reads_its_blocks_only(spark, bam, tmp_path):
    """Blocks that the region does not need are broken; reading them would fail."""
    path, rows, starts = bam
    reader = indexed.BamReader({"path": path, "region": "chr1:200000-203000"})
    chunks = [c for p in reader.partitions() for c in p.chunks]
    keep = [s for s in starts if any(a >> 16 <= s <= b >> 16 for a, b in chunks) or s == 0]
    assert len(keep) < len(starts) / 3
    data = bytearray(open(path, "rb").read())
    for s, e in zip(starts, [*starts[1:], len(data)]):
        if s not in keep:
            data[s:e] = b"?" * (e - s)
    hurt = tmp_path / "hurt.bam"
    hurt.write_bytes(bytes(data))
    (tmp_path / "hurt.bam.bai").write_bytes(open(path + ".bai", "rb").read())
    want = sorted(x[1] for x in rows if x[0] == "chr1" and x[4] <= 203_000 and x[7] >= 200_000)
    assert want and sorted(x.qname for x in indexed.read_bam(spark, str(hurt), "chr1:200000-203000").collect()) == want
    pushed = indexed.read_bam(spark, str(hurt)).where("chrom = 'chr1' AND start_pos >= 200000 AND start_pos <= 203000")
    assert sorted(x.qname for x in pushed.collect()) == sorted(x[1] for x in rows if x[0] == "chr1" and 200_000 <= x[4] <= 203_000)
    with pytest.raises(Exception):
        indexed.read_bam(spark, str(hurt)).count()


def vcf_file(folder, name, rows):
    """rows of (contig, pos, rest of the line), sorted by contig."""
    w, spans, contigs = Writer(300), [], list(dict.fromkeys(r[0] for r in rows))
    w.write(b"##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE\n")
    for c, p, rest in rows:
        at = w.tell()
        w.write(f"{c}\t{p}\t{rest}\n".encode())
        spans.append((contigs.index(c), p - 1, p, at, w.tell()))
    path = folder / name
    path.write_bytes(w.done())
    names = "".join(f"{c}\0" for c in contigs).encode()
    t = Writer(5000)
    t.write(b"TBI\x01" + struct.pack("<8i", len(contigs), 2, 1, 2, 0, 35, 0, len(names)) + names + bins_of(spans, len(contigs)))
    (folder / f"{name}.tbi").write_bytes(t.done())
    return str(path)


def test_indexed_vcf(spark, tmp_path):
    r = random.Random(5)
    rows = [(c, p, f".\tA\t{r.choice(('C', 'CT', 'G'))}\t50\tPASS\tAF=0.{r.randrange(1, 99):02d};AF_nfe=0.{r.randrange(1, 99):02d}\tGT:DP:AD\t0/1:20:12,8") for c in ("chr1", "chr2") for p in sorted(r.sample(range(1, 200_000), 300))]
    path = vcf_file(tmp_path, "s.vcf.gz", rows)
    assert sorted((x.CHROM, x.POS) for x in indexed.read_indexed_vcf(spark, path).collect()) == sorted((c, p) for c, p, _ in rows)
    part = indexed.read_indexed_vcf(spark, path, "chr2:50000-90000")
    want = [(c, p) for c, p, _ in rows if c == "chr2" and 50_000 <= p <= 90_000]
    assert sorted((x.CHROM, x.POS) for x in part.collect()) == want
    snps = [(c, p) for c, p, x in rows if (c, p) in set(want) and "\tCT\t" not in x]
    assert sorted((x.chrom, x.pos, x.dp, x.ad_alt) for x in text.vcf_snps(part).collect()) == [(c, p, 20, 8) for c, p in snps]
    assert indexed.read_indexed_vcf(spark, path, "chr9:1-5").count() == 0
    # Population files without and with the prefix, by the manifest.
    bare = vcf_file(tmp_path, "pop.1.vcf.gz", [("1", p, x) for c, p, x in rows if c == "chr1"])
    (tmp_path / "m.txt").write_text(f"# files\nchr1={bare}\n2={path}\n")
    manifest = text.read_manifest(spark, str(tmp_path / "m.txt"))
    for contig, key in (("chr1", ""), ("chr1", "nfe"), ("chr2", "nfe")):
        if contig == "chr2" and "chr" not in path:
            continue
        got = {(x.chrom, x.pos): round(x.af, 6) for x in indexed.read_frequencies(spark, manifest, f"{contig}:1000-99000", key).collect()}
        field = f"AF_{key}=" if key else "AF="
        assert got == {(c, p): float(x.split(field)[1][:4]) for c, p, x in rows if c == contig and 1000 <= p <= 99_000 and "\tCT\t" not in x}
    assert indexed.read_frequencies(spark, manifest, "chrX:1-9").count() == 0


def test_from_file_to_calls(spark, bam):
    """The plan's first steps on a file: ends, blocks and candidates of its reads."""
    from strandlake.operators import reads

    path, rows, _ = bam
    d = reads.with_ends(indexed.read_bam(spark, path).where("chrom IS NOT NULL"))
    assert {x.qname: x.end_pos for x in d.collect()} == {x[1]: x[7] for x in rows if x[0]}
    assert reads.cigar_candidates(d).count() == sum(int(k) >= 50 for x in rows if x[0] and not x[2] & 0xF04 and x[3] >= 20 for k, o in __import__("re").findall(r"(\d+)([IDS])", x[5]))
