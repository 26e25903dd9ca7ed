"""Token ids in raw binary shards, with a minimal perfect hash index for keyed access.

A shard is the little-endian ids of its documents, nothing else: 16-bit where the
vocabulary allows, else 32-bit.  Documents lie in ascending id order over the shards.
The index splits keys by hash into buckets; each bucket holds a minimal perfect hash
(levels of bit sets: keys that are alone at their bit stay, the others go down a level),
and at a key's rank a slot with its fingerprint, shard, offset and length.  A lookup costs
one bucket, a few bit probes and one slot, however many documents there are.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import work_dir, written
from .files import open_fs
from .pretokens import PieceEncoder, packed, text_slices
from .textblocks import mix64

SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<i4"), ("offset", "<i8"), ("length", "<i8")])
_WORKER: dict = {}


#: Strings whose pre-tokens are the same in every Unicode version and library: Latin letters, digits, marks and plain white space.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f]*")


def separator(model: dict) -> int | None:
    """A control byte of which plain strings have none and that no merge of a BPE model (of a tokenizer file) touches; none where the model's ids hang on more than merges."""
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    used = set().union(*("".join(m) for m in model["merges"]))
    characters = byte_characters()
    return next((b for b in range(9) if characters[b] not in used and characters[b] in model["vocab"]), None)


class _Encoder:
    """Ids as the library gives them for whole texts.  Texts that hold an added token are encoded whole, as a cut at a space may change the ids around it."""

    def __init__(self, blob: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(blob)
        model, characters = t.model, dict(enumerate(byte_characters()))
        given = json.loads(blob)["model"]
        mark = separator(given)
        self.added = [x.content for x in t.get_added_tokens_decoder().values()]
        self.whole = lambda texts: [packed(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        one = lambda x: packed([y.id for y in model.tokenize(x.encode().decode("latin-1").translate(characters))])
        bare = Tokenizer(model)
        at = None if mark is None else given["vocab"][characters[mark]]

        spaced = np.zeros(t.get_vocab_size(), dtype=bool)
        spaced[[i for x, i in given["vocab"].items() if x.startswith(characters[32])]] = True

        def coded(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Ids of pre-tokens one after the other, and where each begins.  They go to the model some dozens at a time, as one word with a mark between them that no merge crosses."""
            rows = [chr(mark).join(tokens[i : i + 64]).encode().decode("latin-1").translate(characters) for i in range(0, len(tokens), 64)]
            ids = np.fromiter(chain.from_iterable(chain(e.ids, (at,)) for e in bare.encode_batch_fast(rows, add_special_tokens=False)), np.uint32)
            ends = np.flatnonzero(ids == at)
            return ids[ids != at], np.r_[0, ends[:-1] + 1 - np.arange(1, len(ends))] if len(ends) else ends

        def blobs(ids: np.ndarray, first: np.ndarray) -> list[bytes]:
            data, first = ids.tobytes(), (first * 4).tolist()
            return [data[a:b] for a, b in zip(first, [*first[1:], len(data)])]

        def runs(tokens: list[str]) -> list[bytes]:
            ids, first = coded(tokens)
            return blobs(ids, first[spaced[ids[first]]])

        whole_tokens = (lambda tokens: [one(x) for x in tokens]) if mark is None else lambda tokens: blobs(*coded(tokens))
        self.pieces = PieceEncoder(regex.compile(pattern).findall, whole_tokens, self.whole, _PLAIN, runs=None if mark is None else runs)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        apart = np.zeros(len(column), dtype=bool)
        for a in self.added:
            apart |= pa.compute.fill_null(pa.compute.match_substring(column, a), False).to_numpy(zero_copy_only=False)
        ids, off = self.pieces.encode_column(pa.compute.if_else(pa.array(apart), pa.scalar("", column.type), column))
        if apart.any():
            rows = [ids[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            for i, x in zip(np.flatnonzero(apart).tolist(), self.whole(column.filter(pa.array(apart)).to_pylist())):
                rows[i] = np.frombuffer(x, np.uint32)
            ids, off = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        return ids, off


def _tokenizer(blob: str, pattern: str) -> _Encoder:
    key = hash((blob, pattern))
    if key not in _WORKER:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _WORKER.clear()
        _WORKER[key] = _Encoder(blob, pattern)
    return _WORKER[key]


def write_shards(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode whole texts, append end_id, write shards; the manifest as a written table.

    `pattern` is the pre-token pattern of the tokenizer file's byte-level splitter, by which encoded
    pre-tokens are kept for reuse.
    Manifest: id, occurrence long, shard int, file string, offset and n_tokens (long, in ids).
    Documents are range-partitioned and sorted by id (nulls first), so shards ascend; rows with
    equal ids are told apart by `occurrence`.  A task writes its shard under a name of its own
    and only the manifest of committed tasks counts, so a repeated task leaves at most an orphan.
    Null texts hold only end_id; an empty table gives no shard."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        blob = f.read()
    from tokenizers import Tokenizer

    width = "<u2" if Tokenizer.from_str(blob).get_vocab_size() <= 1 << 16 else "<u4"
    sent = spark.sparkContext.broadcast(blob)
    out = path or work_dir(spark, "token-shards")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).repartitionByRange(n, "id").sortWithinPartitions("id").select("id", "text", F.spark_partition_id().alias("shard"))
    kind = dict(src.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sink, file, at, last, seen, first = _tokenizer(sent.value, pattern), None, "", 0, None, 0, True
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                if sink is None:
                    file = f"{out}/shard-{part.column(2)[0].as_py():06d}-{uuid.uuid4().hex}.ids"
                    system, p = open_fs(file)
                    system.create_dir(p.rsplit("/", 1)[0], recursive=True)
                    sink = system.open_output_stream(p)
                ids, off = enc.encode_column(texts)
                ids = np.insert(ids, off[1:], end_id)
                sink.write(ids.astype(width).tobytes())
                lengths = np.diff(off) + 1
                offsets = at + np.cumsum(lengths) - lengths
                at += len(ids)
                same = []
                for key in part.column(0).to_pylist():
                    seen = seen + 1 if key == last and not first else 0
                    last, first = key, False
                    same.append(seen)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(same, pa.int64()), part.column(2), pa.array([file] * len(same), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                    names=["id", "occurrence", "shard", "file", "offset", "n_tokens"],
                )
        if sink is not None:
            sink.close()

    manifest = src.mapInArrow(run, f"id {kind}, occurrence long, shard int, file string, offset long, n_tokens long")
    return written(manifest, "token-manifest")


def shard_table(manifest: DataFrame) -> DataFrame:
    """One row per shard: shard, file, width in bytes, n_ids and start, the ids of all shards before it."""
    totals = manifest.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard file
    return totals.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _hash_pair(*cols):
    return F.xxhash64(*cols), F.xxhash64(*cols, F.lit("second"))


def build_mph(h1: np.ndarray, h2: np.ndarray, spread: float = 1.7) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit sets of a minimal perfect hash over distinct pairs, and each key's rank (0 to n - 1)."""
    levels, rank, base = [], np.full(len(h1), -1, dtype=np.int64), 0
    left = np.arange(len(h1))
    while len(left):
        size = max(64, int(len(left) * spread))
        at = _place(h1[left], h2[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        stay = alone[at]
        order = np.cumsum(alone) - 1
        rank[left[stay]] = base + order[at[stay]]
        base += int(alone.sum())
        levels.append(alone)
        left = left[~stay]
        if len(levels) > 200:
            raise ValueError("keys of a minimal perfect hash must be distinct")
    return levels, rank


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(h1 + h2 * np.uint64(2 * level + 1)) % np.uint64(size)).astype(np.int64)


def build_index(manifest: DataFrame) -> DataFrame:
    """Index rows (bucket, n_keys, sizes array<int>, bits binary, slots binary), written to the shared folder.

    Buckets hold a few thousand keys at most by their number, which follows the manifest's row
    count; each is built in one task's memory."""
    n = manifest.count()
    buckets = max(1, -(-n // 4096))
    a, b = _hash_pair("id", "occurrence")
    keys = manifest.select(a.alias("h1"), b.alias("h2"), "shard", "offset", "n_tokens").withColumn("bucket", F.pmod("h1", F.lit(buckets)))

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        levels, rank = build_mph(h1, h2)
        slots = np.zeros(len(h1), dtype=SLOT)
        slots["fingerprint"][rank] = (h2 >> np.uint64(32)).astype(np.uint32)
        for name, col in (("shard", "shard"), ("offset", "offset"), ("length", "n_tokens")):
            slots[name][rank] = table[col].to_numpy()
        bits = np.packbits(np.concatenate(levels))
        return pa.table({"bucket": table["bucket"][:1], "n_keys": pa.array([len(h1)], pa.int64()), "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int32())), "bits": pa.array([bits.tobytes()], pa.binary()), "slots": pa.array([slots.tobytes()], pa.binary())})

    index = keys.groupBy("bucket").applyInArrow(build, "bucket long, n_keys long, sizes array<int>, bits binary, slots binary")
    return written(index.withColumn("buckets", F.lit(buckets)), "token-index")


def lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """keys (id, occurrence) that the index knows, with shard, offset and n_tokens.

    Unknown keys are refused by the stored fingerprint (wrongly accepted once in 2**32)."""
    first = index.select("buckets").first()
    buckets = first.buckets if first else 1
    a, b = _hash_pair("id", "occurrence")
    asked = keys.select("id", "occurrence", a.alias("h1"), b.alias("h2")).withColumn("bucket", F.pmod("h1", F.lit(buckets)))
    kind = dict(keys.dtypes)["id"]

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"id": left["id"][:0], "occurrence": left["occurrence"][:0], "shard": pa.array([], pa.int32()), "offset": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        h1, h2 = (left[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        sizes = right["sizes"][0].as_py()
        bits = np.unpackbits(np.frombuffer(right["bits"][0].as_py(), np.uint8))[: sum(sizes)]
        ranks = np.cumsum(bits, dtype=np.int64) - 1
        slots = np.frombuffer(right["slots"][0].as_py(), SLOT)
        rank, base = np.full(len(h1), -1, dtype=np.int64), 0
        for level, size in enumerate(sizes):
            at = base + _place(h1, h2, level, size)
            new = (rank < 0) & (bits[at] == 1)
            rank[new] = ranks[at[new]]
            base += size
        ok = (rank >= 0) & (slots["fingerprint"][rank] == (h2 >> np.uint64(32)).astype(np.uint32))
        hit = slots[rank[ok]]
        keep = pa.array(np.flatnonzero(ok))
        return pa.table({"id": left["id"].take(keep), "occurrence": left["occurrence"].take(keep), "shard": pa.array(hit["shard"]), "offset": pa.array(hit["offset"]), "n_tokens": pa.array(hit["length"])})

    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(find, f"id {kind}, occurrence long, shard int, offset long, n_tokens long")


def read_ids(found: DataFrame, shards: DataFrame, width: int = 2, most: int = 8 << 20) -> DataFrame:
    """found plus start (ids of all documents before) and ids (binary, unsigned 32-bit), read by sorted byte ranges.

    Neighbouring ranges of a shard are read at once, up to `most` bytes."""
    # One row per shard file: a hundred thousand at 100 TB.
    src = found.join(F.broadcast(shards.select("shard", "file", F.col("start").alias("shard_start"))), "shard")
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = src.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset").select("id", "occurrence", "file", "offset", "n_tokens", (F.col("shard_start") + F.col("offset")).alias("start"))
    kind = dict(found.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, handle = None, None
        for batch in batches:
            files, offs, lens = batch.column(2).to_pylist(), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            row = 0
            while row < len(files):
                stop = row + 1
                while stop < len(files) and files[stop] == files[row] and offs[stop] == offs[stop - 1] + lens[stop - 1] and (offs[stop] + lens[stop] - offs[row]) * width <= most:
                    stop += 1
                if files[row] != name:
                    system, p = open_fs(files[row])
                    name, handle = files[row], system.open_input_file(p)
                handle.seek(int(offs[row]) * width)
                block = np.frombuffer(handle.read(int(offs[stop - 1] + lens[stop - 1] - offs[row]) * width), f"<u{width}").astype("<u4")
                ids = [block[a : a + b].tobytes() for a, b in zip((offs[row:stop] - offs[row]).tolist(), lens[row:stop].tolist())]
                part = batch.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(5), part.column(4), pa.array(ids, pa.binary())], names=["id", "occurrence", "start", "n_tokens", "ids"])
                row = stop

    return src.mapInArrow(run, f"id {kind}, occurrence long, start long, n_tokens long, ids binary")


def id_width(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
