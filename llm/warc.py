"""WARC archives: written by Spark's text writer, indexed first, read by coalesced byte ranges.

A record ends with CR LF CR LF, which is also the line separator that the writer is given, so
a part file is a valid uncompressed WARC file, committed by Spark like any other output.  The
index has file, offset, length, URL and digest per record; reads of selected records sort by
file and offset and merge neighbouring byte ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_side, work_dir, written
from .files import open_fs

MIN_REVISIT_BYTES = 1000
END = "\r\n\r\n"
_FIELDS = "file string, offset long, length long, type string, record_id string, url string, digest string, record_key string, refers_to string, refers_to_key string, payload_offset long, payload_bytes long"


def _clean(col: str) -> str:
    """SQL: a header value without line breaks (percent-encoded)."""
    return f"replace(replace({col}, '\\r', '%0D'), '\\n', '%0A')"


def write_archives(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2000-01-01T00:00:00Z", path: str | None = None) -> str:
    """Write one record per row of pages and return the folder.

    Payload: the UTF-8 bytes of payload_col (null: empty).  Of rows with equal payloads of at
    least 1000 bytes the one with the largest key is a response and the others are revisits
    that refer to it; all others are responses.  Rows that tie on key and payload are alike, and
    each is a response.  A null key never is the largest unless all are null (then all are
    responses).  Null URLs leave out the header.  Other columns are not read."""
    spark = pages.sparkSession
    src = pages.select(F.col(f"`{key_col}`").alias("k"), F.col(f"`{url_col}`").alias("u"), F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("p"))
    src = src.withColumn("d", F.sha1("p"))
    ids = F.expr("md5(concat_ws('|', coalesce(cast(k AS string), 'null'), d))")
    uuid = lambda h: F.expr(f"concat(substr({h},1,8),'-',substr({h},9,4),'-',substr({h},13,4),'-',substr({h},17,4),'-',substr({h},21,12))")
    # Counts per payload first (combined before the shuffle); only payloads that occur twice are joined.
    repeated = written(
        src.where(F.octet_length("p") >= MIN_REVISIT_BYTES).groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("rk"), F.max_by(F.coalesce("u", F.lit("")), "k").alias("ru")).where("n > 1").drop("n"),
        "warc-repeated",
    ).withColumnRenamed("d", "rd")
    rows = src.join(small_side(repeated, repeated.count()), (src.d == repeated.rd) & (F.octet_length("p") >= MIN_REVISIT_BYTES), "left")
    rows = rows.withColumn("revisit", F.expr("rk IS NOT NULL AND NOT (k <=> rk)")).withColumn("h", ids).withColumn("rh", F.expr("md5(concat_ws('|', cast(rk AS string), d))"))
    http = "concat('HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ', octet_length(p), '\\r\\n\\r\\n')"
    opt = lambda name, value: f"coalesce(concat('{name}: ', {_clean(value)}, '\\r\\n'), '')"
    rows = rows.withColumn("http", F.expr(http)).withColumn("id", uuid("h")).withColumn("rid", uuid("rh"))
    head = (
        "concat('WARC/1.1\\r\\nWARC-Type: ', if(revisit, 'revisit', 'response'), '\\r\\nWARC-Record-ID: <urn:uuid:', id, '>\\r\\nWARC-Date: " + date + "\\r\\n', "
        + opt("WARC-Target-URI", "u") + ", 'WARC-Payload-Digest: sha1:', d, '\\r\\n', " + opt("X-Record-Key", "cast(k AS string)")
        + ", if(revisit, concat('WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\\r\\nWARC-Refers-To: <urn:uuid:', rid, '>\\r\\n', "
        + opt("WARC-Refers-To-Target-URI", "nullif(ru, '')") + ", 'X-Refers-To-Key: ', rk, '\\r\\n'), ''), "
        "'Content-Type: application/http; msgtype=response\\r\\nContent-Length: ', octet_length(http) + if(revisit, 0, octet_length(p)), '\\r\\n\\r\\n', http)"
    )
    record = rows.select(F.expr(f"concat(encode({head}, 'UTF-8'), if(revisit, X'', p))").cast("string").alias("value"))
    out = path or work_dir(spark, "warc")
    record.write.option("lineSep", END).text(out)
    return out


def build_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of every archive in the folder, as a written table.

    A task streams through whole files: it reads headers and skips blocks, so it needs a few MB."""
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        kinds = [pa.string() if f.endswith("string") else pa.int64() for f in _FIELDS.split(", ")]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                for row in _records(uri):
                    rows.append(row)
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return written(files.repartition(n, "path").mapInArrow(run, _FIELDS), "warc-index")


def _header(f, at: int, buffered: bytes, base: int) -> tuple[bytes, bytes, int]:
    """The header block that starts at `at`, and the buffer (with its place) that holds it."""
    size = 1 << 16
    while True:
        if base <= at and at < base + len(buffered):
            end = buffered.find(b"\r\n\r\n", at - base)
            if end >= 0:
                return buffered[at - base : end + 4], buffered, base
        f.seek(at)
        more = f.read(size)
        if base == at and len(more) <= len(buffered):
            return b"", buffered, base
        buffered, base, size = more, at, size * 2


def _records(uri: str) -> Iterator[tuple]:
    system, p = open_fs(uri)
    with system.open_input_file(p) as f:
        total, at, buf, base = f.size(), 0, b"", 0
        while at < total:
            head, buf, base = _header(f, at, buf, base)
            if not head.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at {at} of {uri}")
            h = {}
            for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
                name, sep, value = line.partition(":")
                if sep:
                    h[name.lower()] = value.strip()
            block = int(h["content-length"])
            http, skip = b"", 0
            if h.get("content-type", "").startswith("application/http"):
                http, buf, base = _header(f, at + len(head), buf, base)
                skip = min(len(http), block)
            key, digest = h.get("x-record-key"), h.get("warc-payload-digest", "")
            yield (uri, at, len(head) + block + 4, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), digest.rpartition(":")[2], key, h.get("warc-refers-to"), h.get("x-refers-to-key"), len(head) + skip, block - skip)
            at += len(head) + block + 4


def read_records(selected: DataFrame, gap: int = 64 << 10, most: int = 16 << 20) -> DataFrame:
    """selected (rows of the index) plus payload binary, by merged byte-range reads.

    Ranges of one file that lie at most `gap` bytes apart are read together, up to `most` bytes
    (a longer record alone).  The order of the sorted ranges is the order of the reads."""
    n = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = selected.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            files, offs, lens, skip, size = get("file"), get("offset"), get("length"), get("payload_offset"), get("payload_bytes")
            row = 0
            while row < len(files):
                stop, end = row + 1, offs[row] + lens[row]
                while stop < len(files) and files[stop] == files[row] and offs[stop] - end <= gap and offs[stop] + lens[stop] - offs[row] <= most:
                    end = max(end, offs[stop] + lens[stop])
                    stop += 1
                if files[row] != name:
                    system, p = open_fs(files[row])
                    name, f = files[row], system.open_input_file(p)
                f.seek(offs[row])
                block = f.read(end - offs[row])
                out = []
                for i in range(row, stop):
                    a = offs[i] - offs[row] + skip[i]
                    out.append(block[a : a + size[i]])
                yield pa.RecordBatch.from_arrays([*batch.slice(row, stop - row).columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "payload"])
                row = stop

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema)
    return src.mapInArrow(run, f"{fields}, payload binary")


def resolve(index: DataFrame) -> DataFrame:
    """record_key, type, refers_to_key, payload_bytes and payload_digest of the full payload per record.

    Responses are read and digested anew; a revisit takes the figures of the response it refers to."""
    read = read_records(index.where("type <> 'revisit'")).select("record_id", "record_key", "type", "refers_to_key", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    read = written(read, "warc-read")
    full = read.groupBy("record_id").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    revisits = index.where("type = 'revisit'").select("record_key", "type", "refers_to_key", "refers_to")
    wanted = written(full.join(revisits.select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi"), "warc-targets")
    found = revisits.join(small_side(wanted, wanted.count()), revisits.refers_to == wanted.record_id, "left").select("record_key", "type", "refers_to_key", "payload_bytes", "payload_digest")
    return read.select("record_key", "type", "refers_to_key", "payload_bytes", "payload_digest").unionByName(found)
