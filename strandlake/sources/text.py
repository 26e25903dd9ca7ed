"""Readers of text formats: BED, FASTA, VCF, HMM parameter files and manifests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.store import stored


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start_pos, end_pos; blank, comment and malformed lines are dropped."""
    d = spark.read.text(path).where("NOT value RLIKE '^\\\\s*(#|$)'").select(F.split(F.trim("value"), r"\s+").alias("p"))
    d = d.select(F.get("p", F.lit(0)).alias("chrom"), F.expr("try_cast(get(p, 1) AS bigint)").alias("start_pos"), F.expr("try_cast(get(p, 2) AS bigint)").alias("end_pos"))
    return d.where("start_pos IS NOT NULL AND end_pos IS NOT NULL")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom (the header up to its first white space) and sequence, lines joined; a record begins with '>' at the start of a line."""
    d = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value")).where("trim(value) <> ''")
    return d.select(F.regexp_extract("value", r"^(\S+)", 1).alias("chrom"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("sequence"))


BASES = 1 << 11


def base_tiles(contigs: DataFrame, tile: int = BASES) -> DataFrame:
    """Contigs (chrom, sequence) cut into tiles: chrom, tile, bases and the contig's length; look-ups then join tiles, not contigs.

    One walk along each sequence; for references of long contigs, `fasta_tiles` never has one in a row."""
    cut = F.posexplode(F.expr(f"regexp_extract_all(sequence, '(?s).{{1,{tile}}}', 0)")).alias("tile", "bases")
    d = contigs.select("chrom", F.length("sequence").cast("bigint").alias("length"), cut)
    return d.select("chrom", F.col("tile").cast("bigint").alias("tile"), "bases", "length")


def fasta_tiles(spark: SparkSession, path: str, tile: int = BASES) -> DataFrame:
    """The tiles of `base_tiles` from a FASTA file of any size, as a written table.

    Lines are read where the file's splits lie, with their place since the last header or the split's
    start; one row per split then tells each split the contig that is open at its start and how much
    of it lies before.  Bases before the first header are no contig's."""
    meta = ("_metadata.file_path AS file", "_metadata.file_block_start AS split", "value")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chrom, part, start, held, size = None, None, 0, 0, [], 0
        names = ["file", "split", "part", "chrom", "start", "bases"]
        rows: list[list] = [[] for _ in names]

        def flush() -> None:
            nonlocal start, held, size
            if size or chrom is not None:
                for column, x in zip(rows, (*at, part, chrom, start, "".join(held))):
                    column.append(x)
            start, held, size = start + size, [], 0

        for batch in batches:
            for file, split, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, split) != at:
                    if at is not None:
                        flush()
                    at, chrom, part, start = (file, split), None, 0, 0
                if line.startswith(">"):
                    flush()
                    part, start, chrom = part + 1, 0, (line[1:].split() or [""])[0]
                else:
                    line = "".join(line.split())
                    held.append(line)
                    size += len(line)
                    if size >= tile:
                        flush()
            if len(rows[0]) > 256:
                yield pa.RecordBatch.from_arrays([pa.array(c) if n != "chrom" else pa.array(c, pa.string()) for n, c in zip(names, rows)], names=names)
                rows = [[] for _ in names]
        if at is not None:
            flush()
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c) if n != "chrom" else pa.array(c, pa.string()) for n, c in zip(names, rows)], names=names)

    d = stored(spark.read.text(path).selectExpr(*meta).mapInArrow(pieces, "file string, split long, part long, chrom string, start long, bases string"))
    # One row per split: what it holds of the contig that is open before it, and the contig it leaves open.
    last = F.max_by(F.struct("chrom", (F.col("start") + F.length("bases")).alias("n")), F.struct("part", "start")).alias("last")
    splits = d.groupBy("file", "split").agg(F.coalesce(F.sum(F.when(F.col("part") == 0, F.length("bases"))), F.lit(0)).alias("lead"), last, F.max("part").alias("parts"))
    order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy("file").orderBy("split")
    splits = splits.withColumn("opened", F.sum(F.expr("int(parts > 0)")).over(run))
    splits = splits.withColumn("before", F.last(F.expr("if(parts > 0, last.chrom, null)"), ignorenulls=True).over(order))
    # Bases since the open header: the end of the split that has it, and all of the splits without a header after it.
    held = splits.withColumn("n", F.expr("if(parts > 0, last.n, lead)")).withColumn("upto", F.sum("n").over(Window.partitionBy("file", "opened").orderBy("split")))
    held = held.withColumn("open_at", F.coalesce(F.lag("upto").over(run), F.lit(0))).select("file", "split", "before", "open_at")
    e = d.join(held, ["file", "split"]).select(F.expr("if(part > 0, chrom, before) AS chrom"), F.expr("start + if(part > 0, 0L, open_at) AS start"), "bases").where("chrom IS NOT NULL AND bases <> ''")
    cut = e.withColumn("tile", F.explode(F.expr(f"sequence(start div {tile}, (start + length(bases) - 1) div {tile})"))).withColumn("first", F.greatest("start", F.expr(f"tile * {tile}")))
    size = f"cast(least(start + length(bases), (tile + 1) * {tile}) - first AS int)"
    cut = cut.select("chrom", "tile", "first", F.expr(f"substring(bases, cast(first - start + 1 AS int), {size})").alias("b"))
    whole = cut.groupBy("chrom", "tile").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "b"))), lambda x: x["b"]), "").alias("bases"))
    lengths = e.groupBy("chrom").agg(F.sum(F.length("bases").cast("bigint")).alias("length"))
    return stored(whole.join(lengths, "chrom").select("chrom", "tile", "bases", "length"))


def contig_lengths(tiles: DataFrame) -> DataFrame:
    """chrom, length of every contig of a tiled reference, from its first tiles."""
    return tiles.where("tile = 0").select("chrom", "length")


def substring_at(tiles: DataFrame, ranges: DataFrame, key: list[str], start: str = "start_pos", end: str = "end_pos", tile: int = BASES) -> DataFrame:
    """ranges (chrom, start, end; 1-based, closed; key unique) plus ref_seq; empty for null or reversed ranges and beyond the contig's ends.

    A range of up to a tile lies in two tiles at most and finds both in one row, so it is dealt once;
    longer ones, if there are any, are put together from their tiles by key."""
    long = f"coalesce({start} >= 1 AND {end} - {start} >= {tile}, false)"
    at = "struct(tile AS t, bases AS b0, cast(null AS string) AS b1), struct(tile - 1 AS t, cast(null AS string) AS b0, bases AS b1)"
    two = tiles.select("chrom", "length", F.explode(F.expr(f"array({at})")).alias("x")).groupBy(F.col("chrom").alias("__c"), F.col("x.t").alias("__t"))
    two = two.agg(F.max("x.b0").alias("__b0"), F.max("x.b1").alias("__b1"), F.max("length").alias("__length"))
    # Place in the first tile, and what is left for the next.
    d = ranges.where(f"NOT {long}").withColumn("__at", F.expr(f"if({start} >= 1 AND {end} >= {start}, cast({start} - 1 AS bigint), null)"))
    d = d.withColumn("__n", F.expr(f"cast({end} - {start} + 1 AS int)"))
    # Rows without a place are spread over tiles that are not there.
    d = d.withColumn("__tile", F.coalesce(F.expr(f"__at div {tile}"), -2 - F.pmod(F.xxhash64(*ranges.columns), F.lit(1 << 20))))
    hit = d.join(two, (d["chrom"] == two["__c"]) & (d["__tile"] == two["__t"]), "left")
    first = f"coalesce(substring(__b0, cast(__at % {tile} + 1 AS int), __n), '')"
    rest = f"if(__at % {tile} + __n > {tile}, coalesce(substring(__b1, 1, cast(__at % {tile} + __n - {tile} AS int)), ''), '')"
    short = hit.select(*ranges.columns, F.expr(f"if(__at + __n <= __length, concat({first}, {rest}), '') AS ref_seq"))
    far = ranges.where(long)
    if far.isEmpty():
        return short
    cut = far.select(*key, "chrom", F.col(start).cast("bigint").alias("__s"), F.col(end).cast("bigint").alias("__e")).distinct()
    cut = cut.withColumn("tile", F.explode(F.expr(f"sequence((__s - 1) div {tile}, (__e - 1) div {tile})")))
    head = f"(tile * {tile} + 1)"
    part = F.expr(f"substring(bases, cast(greatest(__s, {head}) - {head} + 1 AS int), cast(least(__e, {head} + {tile} - 1) - greatest(__s, {head}) + 1 AS int))")
    parts = cut.join(tiles, ["chrom", "tile"]).where("__e <= length").select(*key, "tile", part.alias("b"))
    seq = parts.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "b"))), lambda x: x["b"]), "").alias("ref_seq"))
    return short.unionByName(far.join(seq, key, "left").withColumn("ref_seq", F.coalesce("ref_seq", F.lit(""))))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0, per file, in file order), line: rows are numbered within their splits, whose counts give the first number of each."""
    d = spark.read.text(path).selectExpr("_metadata.file_path AS file", "_metadata.file_block_start AS split", "value AS line", "monotonically_increasing_id() AS __i", "spark_partition_id() AS __p")
    d = stored(d)
    sizes = d.groupBy("file", "split", "__p").agg(F.min("__i").alias("__first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    base = sizes.withColumn("__base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return d.join(base, ["file", "split", "__p"]).select("file", F.expr("__base + __i - __first AS line_no"), "line")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Columns of body lines of any width (gzip by extension); missing FORMAT and SAMPLE are null."""
    d = spark.read.text(path).where("NOT value LIKE '#%' AND value <> ''").select(F.split("value", "\t").alias("p"))
    names = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "SAMPLE")
    d = d.select(*(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)))
    return d.withColumn("POS", F.expr("try_cast(POS AS bigint)")).withColumn("QUAL", F.expr("try_cast(QUAL AS double)"))


def sample_field(key: str) -> str:
    """SQL: a FORMAT field of the sample."""
    return f"get(split(SAMPLE, ':'), cast(array_position(split(FORMAT, ':'), '{key}') - 1 AS int))"


def vcf_snps(vcf: DataFrame) -> DataFrame:
    """Single-base sites with their quality, depth and allele depths, for quality_control.snp_filter."""
    ok = vcf.where("length(REF) = 1 AND NOT exists(split(ALT, ','), a -> length(a) <> 1)")
    ad = f"split({sample_field('AD')}, ',')"
    d = ok.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.col("QUAL").alias("qual"), F.expr(f"try_cast({sample_field('DP')} AS int)").alias("dp"), F.expr(f"try_cast(get({ad}, 0) AS int)").alias("ad_ref"), F.expr(f"try_cast(get({ad}, 1) AS int)").alias("ad_alt"), F.col("FILTER").alias("flt"))
    return d.where("ad_alt IS NOT NULL")


def read_manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """contig=path lines (a small file); comments are skipped and a leading chr is dropped."""
    out = {}
    for row in spark.read.text(path).collect():
        name, sep, where = row.value.partition("=")
        if sep and not name.startswith("#"):
            out[name.strip().removeprefix("chr")] = where.strip()
    return out


def read_hmm(spark: SparkSession, path: str):
    """Model of a parameter file: sections M, N, A, B, pi, B1_* and B2_* in order; later ones are not read."""
    from ..operators.hmm import Model

    tokens: dict[str, list[float]] = {}
    name = ""
    for row in spark.read.text(path).collect():  # a few dozen lines
        for part in row.value.replace(":", " ").replace("=", " ").split():
            try:
                tokens.setdefault(name, []).append(float(part))
            except ValueError:
                name = part
    n = int(tokens["N"][0])
    a = tokens["A"]
    return Model(tuple(tuple(a[i * n : (i + 1) * n]) for i in range(n)), tuple(tokens["pi"]), tuple(tokens["B1_mean"]), tuple(tokens["B1_sd"]), tokens["B1_uf"][0], tuple(tokens["B2_mean"]), tuple(tokens["B2_sd"]), tokens["B2_uf"][0])


def read_cnv_table(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """Metadata of the KEY=VALUE lines above the header (SVTYPE, POS, HMM_LOGLH), and the tab-separated rows below it as strings."""
    top = [r.value for r in spark.read.text(path).limit(4).collect()]
    meta = dict(x.split("=", 1) for x in top if "=" in x and "\t" not in x)
    names = next((x for x in top if "=" not in x or "\t" in x), "").split("\t")
    body = spark.read.text(path).where(~F.col("value").isin([*(x for x in top if x.split("=", 1)[0] in meta), "\t".join(names)]) & (F.col("value") != ""))
    parts = F.split("value", "\t")
    return meta, body.select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


def read_cnv_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Objects of a JSON array, one row each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_trio(spark: SparkSession, path: str, names: tuple[str, ...] = ("chrom", "pos", "sv_type", "genotype")) -> DataFrame:
    """Rows of a tab-separated file without header, as strings but for pos."""
    return spark.read.csv(path, sep="\t", schema=", ".join(f"{n} {'bigint' if n == 'pos' else 'string'}" for n in names))


def parse_region(col: str) -> str:
    """SQL: struct<chrom,start_pos,end_pos> of 'chr:start-end'; a bare contig has null ends."""
    ends = lambda i: f"try_cast(replace(regexp_extract({col}, '^[^:]+:([0-9,]+)-([0-9,]+)$', {i}), ',', '') AS bigint)"
    return f"named_struct('chrom', regexp_extract({col}, '^([^:]+)', 1), 'start_pos', {ends(1)}, 'end_pos', {ends(2)})"
