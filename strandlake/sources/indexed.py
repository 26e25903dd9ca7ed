"""Block-compressed, indexed files as Spark data sources: alignments (BAM with .bai) and lines by position (VCF with .tbi).

A file is a chain of small gzip members; a virtual offset is a member's place in the file and a place
inside it.  The index gives virtual offsets of records, so partitions are ranges of them that executors
read on their own, and a region, pushed as filter or given as option, reads only its ranges.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Compressed bytes of a partition, at least; rows of an Arrow batch.
SPLIT, ROWS = 32 << 20, 2048
END = 1 << 62
# The formats' standard.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
ALIGNMENT = "chrom string, qname string, flag int, mapq int, start_pos bigint, cigar string, seq string, aln_id bigint"
_HEX = str.maketrans("0123456789abcdef", BASES)


def open_file(uri: str):
    """A seekable file by any scheme that pyarrow knows."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


class Blocks:
    """Bytes of a block-compressed file from a virtual offset on."""

    def __init__(self, file, offset: int = 0):
        self.file, self.at, self.data, self.next = file, 0, b"", offset >> 16
        self._load()
        self.at = offset & 0xFFFF

    def _load(self) -> bool:
        self.start, self.at, self.data = self.next, 0, b""
        self.file.seek(self.start)
        head = self.file.read(12)
        if len(head) < 12:
            return False
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no block at byte {self.start}")
        extra, size, i = self.file.read(struct.unpack("<H", head[10:])[0]), None, 0
        while i + 4 <= len(extra):
            n = struct.unpack_from("<H", extra, i + 2)[0]
            if extra[i : i + 2] == b"BC":
                size = struct.unpack_from("<H", extra, i + 4)[0] + 1
            i += 4 + n
        if size is None:
            raise ValueError(f"block at byte {self.start} without its size: not a block-compressed file")
        body = self.file.read(size - 12 - len(extra))
        self.data = zlib.decompress(body[:-8], wbits=-15)
        self.next = self.start + size
        return True

    def tell(self) -> int:
        """Virtual offset of the next byte; END behind the last."""
        while self.at >= len(self.data):
            if not self._load():
                return END
        return self.start << 16 | self.at

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            if self.tell() == END:
                break
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)

    def numbers(self, form: str) -> tuple:
        return struct.unpack(form, self.read(struct.calcsize(form)))

    def line(self) -> bytes | None:
        """The next line without its end; None behind the last."""
        parts = []
        while self.tell() != END:
            i = self.data.find(b"\n", self.at)
            parts.append(self.data[self.at : i if i >= 0 else None])
            self.at = i + 1 if i >= 0 else len(self.data)
            if i >= 0:
                return b"".join(parts)
        return b"".join(parts) if parts else None


@dataclass
class Index:
    """Chunks by contig and bin, and the linear index: by contig the least offset of each 16,384 bases."""

    bins: list[dict[int, list[tuple[int, int]]]]
    linear: list[tuple[int, ...]]

    @staticmethod
    def read(source) -> Index:
        """From the number of contigs on; both index formats are the same from there."""
        bins, linear = [], []
        take = lambda form: struct.unpack(form, source.read(struct.calcsize(form)))
        (contigs,) = take("<i")
        return Index._contigs(take, contigs, bins, linear)

    @staticmethod
    def _contigs(take, contigs: int, bins: list, linear: list) -> Index:
        for _ in range(contigs):
            own = {}
            for _ in range(take("<i")[0]):
                number, chunks = take("<Ii")
                flat = take(f"<{2 * chunks}Q")
                if number < 37450:  # beyond are statistics
                    own[number] = list(zip(flat[::2], flat[1::2]))
            bins.append(own)
            linear.append(take(f"<{take('<i')[0]}Q"))
        return Index(bins, linear)

    def region(self, contig: int, start: int, end: int) -> list[tuple[int, int]]:
        """Merged chunks that may hold records of [start, end), 0-based."""
        end = min(max(end, start + 1), 1 << 29)
        linear = self.linear[contig]
        least = linear[min(start >> 14, len(linear) - 1)] if linear else 0
        found = []
        for shift, first in ((29, 0), (26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
            for number in range(first + (start >> shift), first + ((end - 1) >> shift) + 1):
                found += self.bins[contig].get(number, [])
        out: list[tuple[int, int]] = []
        for a, b in sorted(c for c in found if c[1] > least):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def cuts(self, first: int, split: int) -> list[tuple[int, int]]:
        """The whole file from its first record on as ranges of `split` compressed bytes or more, cut where chunks begin."""
        starts = sorted({a for own in self.bins for chunks in own.values() for a, _ in chunks if a > first})
        edges = [first]
        for a in starts:
            if (a >> 16) - (edges[-1] >> 16) >= split:
                edges.append(a)
        return list(zip(edges, [*edges[1:], END]))


@dataclass
class Ranges(InputPartition):
    """Virtual ranges, and the region (contig number, start, end; 0-based) that their records must meet."""

    chunks: list
    region: tuple | None = None

    def __init__(self, chunks, region=None):
        self.chunks, self.region = chunks, region


class Pushed:
    """What filters on a contig column and a position column (1-based) say about a region."""

    def __init__(self, chrom: str, pos: str):
        self.columns = chrom, pos
        self.contig, self.start, self.end = None, None, None

    def see(self, filters: list) -> None:
        chrom, pos = self.columns
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (chrom,):
                self.contig = f.value
            elif isinstance(f, EqualTo) and f.attribute == (pos,):
                self.start = self.end = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == (pos,):
                self.start = max(self.start or 1, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == (pos,):
                self.end = min(self.end or END, f.value - isinstance(f, LessThan))


def _region(text: str | None) -> tuple[str, int, int] | None:
    """contig, start, end (1-based, closed) of 'contig' or 'contig:start-end'."""
    if not text:
        return None
    contig, sep, span = text.rpartition(":")
    if not sep or "-" not in span:
        return text, 1, END
    a, b = span.replace(",", "").split("-")
    return contig, int(a), int(b)


def _exists(uri: str) -> bool:
    try:
        open_file(uri).close()
    except OSError:
        return False
    return True


class BamSource(DataSource):
    """format('bam'): options path, index (path + '.bai' by default), region, split, and table='contigs' for the header's contigs."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "place int, chrom string, length bigint" if self.options.get("table") == "contigs" else ALIGNMENT

    def reader(self, schema) -> DataSourceReader:
        return BamReader(dict(self.options))


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.index = options["path"], options.get("index") or options["path"] + ".bai"
        self.split, self.contigs = int(options.get("split", SPLIT)), options.get("table") == "contigs"
        self.region = _region(options.get("region"))
        self.pushed = Pushed("chrom", "start_pos")

    def pushFilters(self, filters: list) -> Iterator:
        self.pushed.see(filters)
        yield from filters  # Spark tests the rows once more

    def _header(self, blocks: Blocks) -> list[tuple[str, int]]:
        if blocks.read(4) != b"BAM\x01":
            raise ValueError(f"{self.path} is no BAM file")
        blocks.read(blocks.numbers("<i")[0])
        out = []
        for _ in range(blocks.numbers("<i")[0]):
            name = blocks.read(blocks.numbers("<i")[0])[:-1].decode()
            out.append((name, blocks.numbers("<i")[0]))
        return out

    def partitions(self) -> list[Ranges]:
        if self.contigs:
            return [Ranges([])]
        with open_file(self.path) as f:
            blocks = Blocks(f)
            names = [n for n, _ in self._header(blocks)]
            first = blocks.tell()
        if not _exists(self.index):
            if self.region:
                raise ValueError(f"a region needs the index {self.index}")
            return [Ranges([(first, END)])]
        with open_file(self.index) as f:
            if f.read(4) != b"BAI\x01":
                raise ValueError(f"{self.index} is no BAM index")
            index = Index.read(f)
        # An option asks for reads that overlap, filters for reads that start there; these are a part of those.
        region = self.region or (self.pushed.contig and (self.pushed.contig, self.pushed.start or 1, self.pushed.end or END))
        if not region:
            return [Ranges([c]) for c in index.cuts(first, self.split)]
        contig, start, end = region
        if contig not in names or end < start:
            return [Ranges([])]
        tid = names.index(contig)
        out: list[Ranges] = []
        size = self.split
        for a, b in index.region(tid, start - 1, end):
            if size >= self.split:
                out.append(Ranges([], (tid, start - 1, end)))
                size = 0
            out[-1].chunks.append((a, b))
            size += (b >> 16) - (a >> 16)
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        with open_file(self.path) as f:
            contigs = self._header(Blocks(f))
            if self.contigs:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(contigs)), pa.int32()), pa.array([n for n, _ in contigs], pa.string()), pa.array([k for _, k in contigs], pa.int64())], names=["place", "chrom", "length"])
                return
            names = [n for n, _ in contigs]
            rows: list[tuple] = []
            for a, b in partition.chunks:
                blocks = Blocks(f, a)
                while (at := blocks.tell()) < b:
                    record = blocks.read(blocks.numbers("<i")[0])
                    row = alignment(record, names, at, partition.region)
                    if row == "behind":
                        break
                    if row:
                        rows.append(row)
                    if len(rows) >= ROWS:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in ALIGNMENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def alignment(record: bytes, names: list[str], at: int, region: tuple | None) -> tuple | str | None:
    """A row of ALIGNMENT of one record; None outside the region, 'behind' when no later record can be in it."""
    tid, pos, name_size, mapq, _, n_ops, flag, n_bases = struct.unpack_from("<iiBBHHHi", record)
    ops = struct.unpack_from(f"<{n_ops}I", record, 32 + name_size)
    if region:
        if tid != region[0] or pos >= region[2]:
            return "behind" if tid > region[0] or tid == region[0] else None
        used = sum(x >> 4 for x in ops if x & 15 in (0, 2, 3, 7, 8))
        if pos + max(1, used) <= region[1]:
            return None
    bases = 32 + name_size + 4 * n_ops
    seq = record[bases : bases + (n_bases + 1) // 2].hex().translate(_HEX)[:n_bases]
    cigar = "".join([f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops])
    return (names[tid] if tid >= 0 else None, record[32 : 31 + name_size].decode(), flag, mapq, pos + 1, cigar or "*", seq, at)


class LinesSource(DataSource):
    """format('indexed_lines'): the lines of a block-compressed file by position: chrom, pos, value.

    Options path, index (path + '.tbi' by default), region, split; header lines are left out."""

    @classmethod
    def name(cls) -> str:
        return "indexed_lines"

    def schema(self) -> str:
        return "chrom string, pos bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(dict(self.options))


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.index = options["path"], options.get("index") or options["path"] + ".tbi"
        self.split, self.region = int(options.get("split", SPLIT)), _region(options.get("region"))
        self.pushed = Pushed("chrom", "pos")

    def pushFilters(self, filters: list) -> Iterator:
        self.pushed.see(filters)
        yield from filters

    def partitions(self) -> list[Ranges]:
        with open_file(self.index) as f:
            blocks = Blocks(f)
            if blocks.read(4) != b"TBI\x01":
                raise ValueError(f"{self.index} is no position index")
            contigs, _, _, _, _, _, _, size = blocks.numbers("<8i")
            names = blocks.read(size).decode().split("\0")[:-1]
            index = Index._contigs(blocks.numbers, contigs, [], [])
        region = self.region or (self.pushed.contig and (self.pushed.contig, self.pushed.start or 1, self.pushed.end or END))
        if not region:
            return [Ranges([c]) for c in index.cuts(0, self.split)]
        contig, start, end = region
        if contig not in names or end < start:
            return [Ranges([])]
        return [Ranges([c], (contig, start, end)) for c in index.region(names.index(contig), start - 1, end)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        with open_file(self.path) as f:
            for a, b in partition.chunks:
                blocks = Blocks(f, a)
                while blocks.tell() < b:
                    line = blocks.line().decode()
                    if not line or line.startswith("#"):
                        continue
                    chrom, pos = line.split("\t", 2)[:2]
                    if partition.region and (chrom != partition.region[0] or not partition.region[1] <= int(pos) <= partition.region[2]):
                        continue
                    yield chrom, int(pos), line


def register(spark: SparkSession) -> None:
    """Both sources, and the setting by which Spark hands them its filters."""
    spark.dataSource.register(BamSource)
    spark.dataSource.register(LinesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    register(spark)
    r = spark.read.format(kind).option("path", path)
    for k, v in options.items():
        if v is not None:
            r = r.option(k, v)
    return r.load()


def read_bam(spark: SparkSession, path: str, region: str | None = None, split: int = SPLIT) -> DataFrame:
    """Alignments of a BAM file, all or those that overlap a region; start_pos is 1-based, aln_id ascends in file order."""
    return _read(spark, "bam", path, region=region, split=split)


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """place, chrom, length of the header's contigs."""
    return _read(spark, "bam", path, table="contigs")


def read_indexed_vcf(spark: SparkSession, path: str, region: str | None = None) -> DataFrame:
    """The ten columns of a VCF's records, all or those of a region."""
    names = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "SAMPLE")
    d = _read(spark, "indexed_lines", path, region=region).withColumn("p", F.split("value", "\t"))
    d = d.select(F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"), *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names) if i > 1))
    return d.withColumn("QUAL", F.expr("try_cast(QUAL AS double)"))


def frequency_path(manifest: dict[str, str], contig: str) -> str | None:
    """The population file of a contig, whatever prefix either side has."""
    return manifest.get(contig.removeprefix("chr"))


def read_frequencies(spark: SparkSession, manifest: dict[str, str], region: str, ethnicity: str = "") -> DataFrame:
    """chrom, pos, af of a region's population file: INFO key AF, or AF_<ethnicity>; a contig without file gives no row.

    The region's contig takes the prefix chr where the path of the file has it, and the rows keep the
    region's own name."""
    contig, start, end = _region(region)
    path = frequency_path(manifest, contig)
    if path is None:
        return spark.createDataFrame([], "chrom string, pos bigint, af double")
    bare = contig.removeprefix("chr")
    theirs = f"chr{bare}" if "chr" in path else bare
    key = f"AF_{ethnicity}" if ethnicity else "AF"
    d = read_indexed_vcf(spark, path, f"{theirs}:{start}-{end}")
    af = F.expr(f"try_cast(nullif(regexp_extract(INFO, '(^|;){key}=([^;,]+)', 2), '') AS float)").cast("double")
    return d.where("length(REF) = 1 AND length(ALT) = 1").select(F.lit(contig).alias("chrom"), F.col("POS").alias("pos"), af.alias("af")).where("af IS NOT NULL")
