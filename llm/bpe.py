"""Byte-level BPE by a sentencepiece model that is serialised from the vocabulary itself.

Every rank becomes a piece: its bytes mapped to printable characters, its score the
negative rank, so that the best-scoring merge is the lowest rank; the normaliser is the
identity and no dummy prefix is added.  Pre-tokens are encoded one by one; decoding maps
the characters of the pieces back to bytes.  No tokenizer is trained.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import trimmed
from .pretokens import PieceEncoder, binary_column, packed, text_slices


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of base64 tokens and numbers, read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """A printable character for every byte: itself where printable Latin-1, else from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value % (1 << 64))


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model; piece i is rank i, the unknown piece follows the last.

    Field numbers are those of the public sentencepiece_model.proto: pieces 1 (piece 1, score 2,
    type 3: normal 1, unknown 2), trainer_spec 2 (model_type 3: BPE 2; unk/bos/eos/pad id 40-43),
    normalizer_spec 3 (name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5)."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n - 1")
    chars = byte_characters()
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    out += _field(2, _field(3, 2) + _field(40, len(ranks)) + _field(41, -1) + _field(42, -1) + _field(43, -1))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


_WORKER: dict = {}


def _encoder(model: bytes, pattern: str) -> PieceEncoder:
    """One encoder and its caches for a Python worker, kept between its tasks."""
    key = (hash(model), pattern)
    if key not in _WORKER:
        import regex
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        table = dict(enumerate(byte_characters()))
        _WORKER.clear()
        _WORKER[key] = PieceEncoder(regex.compile(pattern).findall, lambda tokens: [packed(x) for x in sp.encode([t.encode().decode("latin-1").translate(table) for t in tokens], num_threads=1)])
    return _WORKER[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """Columns id, `keep`, n_tokens long, ids binary (little-endian unsigned 32-bit), one row per input row.

    Where `decoded` is set, column decoded (as by `decode`) follows, made from the ids in the same pass.

    Null and empty texts have no tokens; repeated rows are encoded each; a very long text is
    split at safe places, so it needs no more than its own ids in memory.  The model (under 2 MB,
    fixed by the vocabulary) travels with the task; only `id`, `keep` and `text` are read."""
    model = sentencepiece_model(load_ranks(ranks_path))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names, made = list(dict.fromkeys((id_col, *keep))), ["n_tokens", "ids", *(["decoded"] if decoded else [])]
    src = docs.select(*(f"`{c}`" for c in dict.fromkeys((*names, text_col))))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(sent.value, pattern)
        table = _bytes_of_ids(sent.value) if decoded else []
        for batch in batches:
            for part, texts in text_slices(batch, text_col):
                ids, off = enc.encode_column(texts)
                cols = [part.column(part.schema.get_field_index(c)) for c in names]
                cols += [pa.array(np.diff(off), pa.int64()), binary_column(ids, off)]
                if decoded:
                    cols.append(pa.array([_joined(ids[a:b], table) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[*(f"_{i}" for i in range(len(names))), *made])

    # Inside, kept columns go by their place, so that they may be called n_tokens or ids; of equal names the kept one comes first.
    fields = ", ".join(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(src.select(*(f"`{c}`" for c in names)).schema))
    return src.mapInArrow(run, f"{fields}, n_tokens long, ids binary{', decoded binary' if decoded else ''}").toDF(*names, *made)


def _bytes_of_ids(model: bytes) -> list[bytes]:
    """The bytes of every id: its piece by the inverse of the byte mapping."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    back = {ord(c): b for b, c in enumerate(byte_characters())}
    return [bytes(back[ord(c)] for c in sp.id_to_piece(i)) for i in range(sp.get_piece_size() - 1)]


def _joined(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids.tolist()])


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded plus decoded binary: the bytes of the ids, by the inverse of the byte mapping; null ids give null."""
    sent = encoded.sparkSession.sparkContext.broadcast(sentencepiece_model(load_ranks(ranks_path)))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes_of_ids(sent.value)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                out = [None if x is None else _joined(np.frombuffer(x, "<u4"), table) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")
