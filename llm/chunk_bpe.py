"""BPE over content-defined chunks: equal chunks are encoded once, then the joins are repaired.

A rolling hash over the bytes cuts every text where its last bits are zero, so passages that
documents share fall into equal chunks wherever they stand.  A distinct chunk is encoded once
(per Python worker, in a cache bounded in bytes).  Ids of two neighbours, put side by side, are
wrong where a pre-token crosses the join: the text from the left chunk's last undetermined
pre-token on is split again, until a boundary falls on one of the right chunk's own.  From there
on both splits agree for good, because the splitter only looks ahead; pre-tokens are encoded
independently, so the ids are those of the whole text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .bpe import byte_characters
from .common import trimmed
from .pretokens import text_slices
from .textblocks import buffers, byte_values, gram_hash, prefix_hash
from .token_files import _PLAIN, _Encoder

#: Bytes that the rolling hash sees; one position in 2**CUT_BITS is a cut; no chunk but a text's last is shorter than LEAST.
WINDOW, CUT_BITS, LEAST = 24, 10, 64
#: Characters at a chunk's start whose pre-tokens are kept for joins.
HEAD = 64
#: Characters that the splitter may look at from a pre-token's start, and one behind its end.
LOOK = 3
CHUNK_CACHE_BYTES = 24 << 20


def cut_points(raw: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Per text its chunk boundaries in the buffer, first and last byte included; always between characters."""
    h = gram_hash(prefix_hash(byte_values(raw)), WINDOW)
    at = np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    at = at[at < len(raw)]
    for _ in range(3):  # on to the next character's first byte
        inside = (raw[np.minimum(at, len(raw) - 1)] & 0xC0) == 0x80 if len(at) else np.zeros(0, bool)
        at = at + inside
    first = np.searchsorted(at, offsets[:-1], side="right").tolist()
    stop = np.searchsorted(at, offsets[1:], side="left").tolist()
    at, out = at.tolist(), []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        bounds = [a]
        for c in at[first[i] : stop[i]]:
            if c - bounds[-1] >= LEAST:
                bounds.append(c)
        out.append([*bounds, b])
    return out


class Chunk:
    """A chunk's own ids (packed) and what a join needs: early boundaries with the ids before each, and the open end."""

    __slots__ = ("text", "ids", "starts", "open", "before_open")

    def __init__(self, text: str, ids: bytes, starts: dict[int, int], open_: int, before_open: int):
        self.text, self.ids, self.starts, self.open, self.before_open = text, ids, starts, open_, before_open


class ChunkEncoder:
    """Ids of whole texts, chunk by chunk, as the tokenizers library gives them."""

    def __init__(self, blob: str, pattern: str, most_bytes: int = CHUNK_CACHE_BYTES):
        import regex
        from tokenizers import Tokenizer

        self.encoder = _Encoder(blob, pattern)
        self.find = regex.compile(pattern).finditer
        self.pre = Tokenizer.from_str(blob).pre_tokenizer
        self.most, self.held = most_bytes, 0
        self.young: dict[str, Chunk] = {}
        self.old: dict[str, Chunk] = {}

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Pre-tokens of a text; the library splits what other Unicode tables might class in another way."""
        if _PLAIN.fullmatch(text):
            return [m.span() for m in self.find(text)]
        return [s for _, s in self.pre.pre_tokenize_str(text)]

    def size(self, text: str, spans: list[tuple[int, int]]) -> list[int]:
        """Ids of each pre-token."""
        table = self.encoder.pieces.tokens.get({text[a:b] for a, b in spans})
        return [len(table[text[a:b]]) // 4 for a, b in spans]

    def coded(self, text: str, spans: list[tuple[int, int]]) -> bytes:
        table = self.encoder.pieces.tokens.get({text[a:b] for a, b in spans})
        return b"".join([table[text[a:b]] for a, b in spans])

    def chunk(self, text: str, ids: bytes) -> Chunk:
        head = text[:HEAD]
        spans = self.spans(head)
        if len(head) < len(text):
            spans = spans[: settled(spans, len(head))]
        starts, n = {0: 0}, 0
        for (_, b), k in zip(spans, self.size(text, spans)):
            n += k
            if b < len(text):
                starts[b] = n
        # The end: from the last lone space between others, where a pre-token begins in any case.
        i = text.rfind(" ", 0, max(0, len(text) - LOOK))
        while i > 0 and (text[i - 1].isspace() or text[i + 1].isspace()):
            i = text.rfind(" ", 0, i)
        i = max(i, 0)
        rest = text[i:]
        spans = self.spans(rest)
        spans = spans[settled(spans, len(rest)) :]
        open_ = i + spans[0][0] if spans else len(text)
        return Chunk(text, ids, starts, open_, len(ids) // 4 - sum(self.size(rest, spans)))

    def chunks(self, texts: list[str]) -> dict[str, Chunk]:
        """Chunks of distinct texts; those that the cache lacks are encoded in one batch."""
        if self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0
        out, new = {}, []
        for t in texts:
            c = self.young.get(t) or self.old.get(t)
            if c is None:
                new.append(t)
            else:
                out[t] = c
        ids, off = self.encoder.pieces.encode_column(pa.array(new, pa.large_string()))
        off = off.tolist()
        for i, t in enumerate(new):
            out[t] = self.chunk(t, ids[off[i] : off[i + 1]].tobytes())
        for t, c in out.items():
            if t not in self.young and len(t) <= 1 << 16:
                self.young[t] = c
                self.held += 3 * len(t) + len(c.ids) + 64 * len(c.starts) + 400
        return out

    def joined(self, parts: list[Chunk]) -> tuple[bytes, int]:
        """Ids of the parts' whole text, and the number of joins whose ids changed."""
        out, repaired = [], 0
        left = parts[0]
        out.append(left.ids[: 4 * left.before_open])
        tail, tail_ids = left.text[left.open :], left.ids[4 * left.before_open :]
        tries = 0  # no new try below this length of open text, so that one endless pre-token costs no square
        for right in parts[1:]:
            if len(tail) >= tries:
                found = self._agree(tail, right, HEAD)
                if found is None and len(right.text) > HEAD:
                    found = self._agree(tail, right, len(right.text))
                if found:
                    spans, text, at, before = found
                    fixed = self.coded(text, spans)
                    repaired += at > 0 or fixed != tail_ids
                    out.append(fixed)
                    if at >= right.open:
                        out.append(b"")
                        tail, tail_ids = right.text[at:], right.ids[4 * before :]
                    else:
                        out.append(right.ids[4 * before : 4 * right.before_open])
                        tail, tail_ids = right.text[right.open :], right.ids[4 * right.before_open :]
                    tries = 0
                    continue
                tries = 2 * len(tail)
            repaired += 1
            # The right chunk is part of the open text; what is settled in it leaves.
            text = tail + right.text
            if len(text) >= tries:
                spans = self.spans(text)
                k = settled(spans, len(text))
                out.append(self.coded(text, spans[:k]))
                text = text[spans[k][0] :] if k < len(spans) else ""
                tail_ids = self.coded(text, self.spans(text))
                tries = 2 * len(text)
            else:
                tail_ids = b""
            tail = text
        out.append(tail_ids if tail_ids or not tail else self.coded(tail, self.spans(tail)))
        return b"".join(out), repaired

    def _agree(self, tail: str, right: Chunk, most: int):
        """Spans of tail and the right chunk's start up to the first boundary that is the right chunk's own
        too, their text, that boundary's place in the right chunk, and the right chunk's ids before it."""
        head = right.text[:most]
        text = tail + head
        starts = right.starts
        if most > HEAD:
            spans = self.spans(right.text)
            ends = np.cumsum(self.size(right.text, spans)).tolist()
            starts = {0: 0} | {b: n for (_, b), n in zip(spans, ends) if b < len(right.text)}
        if not tail:
            return [], text, 0, 0
        spans = self.spans(text)
        for i in range(settled(spans, len(text))):
            at = spans[i][1] - len(tail)
            if at >= 0 and at in starts:
                return spans[: i + 1], text, at, starts[at]
        return None

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
        """Ids of the texts one after the other, their offsets, and the chunks and repaired joins of each."""
        column = pa.compute.fill_null(column.cast(pa.large_string()), "")
        apart = np.zeros(len(column), dtype=bool)
        for a in self.encoder.added:
            apart |= pa.compute.match_substring(column, a).to_numpy(zero_copy_only=False)
        raw, offsets = buffers(column)
        blob = raw.tobytes()
        bounds = [[a, a] if x else b for a, x, b in zip(offsets[:-1].tolist(), apart.tolist(), cut_points(raw, offsets))]
        cut = [[blob[a:b].decode() for a, b in zip(bs, bs[1:])] for bs in bounds]
        table = self.chunks(list(dict.fromkeys(t for ts in cut for t in ts)))
        rows, fixed = [], []
        for ts in cut:
            ids, n = self.joined([table[t] for t in ts]) if len(ts) > 1 else (table[ts[0]].ids, 0)
            rows.append(ids)
            fixed.append(n)
        for i, x in zip(np.flatnonzero(apart).tolist(), self.encoder.whole(column.filter(pa.array(apart)).to_pylist()) if apart.any() else ()):
            rows[i] = x
        off = np.cumsum([0, *(len(x) // 4 for x in rows)])
        return np.frombuffer(b"".join(rows), np.uint32), off, [len(ts) for ts in cut], fixed


def settled(spans: list[tuple[int, int]], length: int) -> int:
    """Number of leading pre-tokens that more text behind cannot change."""
    for i, (a, b) in enumerate(spans):
        if b >= length or a + LOOK > length:
            return i
    return len(spans)


def _check(blob: str) -> None:
    """Chunks need a byte-level splitter without normalisation or dropout."""
    d = json.loads(blob)
    pre = d.get("pre_tokenizer") or {}
    plain_added = all(not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) for a in d.get("added_tokens") or ())
    if d.get("normalizer") or d["model"].get("dropout") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain_added:
        raise ValueError("chunks need a byte-level tokenizer without normaliser, dropout and prefix space")


_WORKER: dict = {}


def _encoder(blob: str, pattern: str) -> ChunkEncoder:
    key = hash((blob, pattern))
    if key not in _WORKER:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _WORKER.clear()
        _WORKER[key] = ChunkEncoder(blob, pattern)
    return _WORKER[key]


def _bytes_of_ids(blob: str) -> list[bytes]:
    """The bytes of every id by the inverse of the byte mapping; an added token's text as it is."""
    d = json.loads(blob)
    back = {c: bytes([b]) for b, c in enumerate(byte_characters())}
    vocab = d["model"]["vocab"]
    added = {a["id"]: a["content"].encode() for a in d.get("added_tokens") or ()}
    out = [b""] * (1 + max([*vocab.values(), *added]))
    for t, i in vocab.items():
        out[i] = b"".join([back[c] for c in t])
    for i, b in added.items():
        out[i] = b
    return out


def encode(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """id, `keep`, n_tokens long, ids array<int>, n_chunks and n_repaired long; one row per input row.

    Ids are those of the library for the whole text, without special tokens around it; `decoded`
    adds the string that they decode to.  `pattern` is the byte-level splitter's.  Null and empty
    texts have no ids (one empty chunk); repeated rows are encoded each, their chunks once per
    worker.  Texts that hold an added token are encoded whole.  Other columns are not read, and
    kept ones may have any name."""
    with open(tokenizer_path, encoding="utf-8") as f:
        blob = f.read()
    _check(blob)
    sent = docs.sparkSession.sparkContext.broadcast(blob)  # the tokenizer's file, a few MB whatever the corpus
    names = list(dict.fromkeys((id_col, *keep)))
    src = docs.select(*(f"`{c}`" for c in dict.fromkeys((*names, text_col))))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(sent.value, pattern)
        table = _bytes_of_ids(sent.value) if decoded else []
        for batch in batches:
            for part, texts in text_slices(batch, text_col):
                ids, off, n, fixed = enc.encode_column(texts)
                cols = [part.column(part.schema.get_field_index(c)) for c in names]
                cols += [pa.array(np.diff(off), pa.int64()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.view(np.int32))), pa.array(n, pa.int64()), pa.array(fixed, pa.int64())]
                if decoded:
                    at = off.tolist()
                    cols.append(pa.array([b"".join([table[i] for i in ids[a:b].tolist()]).decode("utf-8", "replace") for a, b in zip(at, at[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*(f"_{i}" for i in range(len(names))), *made])

    made = ["n_tokens", "ids", "n_chunks", "n_repaired", *(["decoded"] if decoded else [])]
    fields = ", ".join(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(src.select(*(f"`{c}`" for c in names)).schema))
    kinds = f"{fields}, n_tokens long, ids array<int>, n_chunks long, n_repaired long{', decoded string' if decoded else ''}"
    return src.mapInArrow(run, kinds).toDF(*names, *made)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded plus decoded string, by the inverse of the byte mapping; bytes that are no text show as U+FFFD; null ids give null."""
    with open(tokenizer_path, encoding="utf-8") as f:
        blob = f.read()
    sent = encoded.sparkSession.sparkContext.broadcast(blob)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes_of_ids(sent.value)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                out = [None if x is None else b"".join([table[i] for i in x]).decode("utf-8", "replace") for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded string")
