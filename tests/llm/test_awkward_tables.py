"""Nulls, repeated rows, empty tables and clashing names in the operators that other tests see on plain tables only."""

import hashlib

import public_tokenizers as P

from llm import bpe, counts, queries, sharding, warc

DOCS = "doc_id long, text string, n_tokens string, ids string, shard string, slot string"


def docs(spark):
    rows = [(1, "one  two\none  two\n", "a", "b", "c", "d"), (1, "one  two\none  two\n", "a", "b", "c", "d"), (2, None, "a", "b", "c", "d"), (None, "", "a", "b", "c", "d"), (None, "日本 🎉\n日本 🎉", None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(2)


def test_counts(spark):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(queries.RANKS), special_tokens={})
    d = docs(spark)
    got = counts.recount(d, queries.RANKS, P.PATTERN, counts.repeated_lines).collect()
    assert len(got) == 5
    for r in got:
        assert r.n_tokens == len(lib.encode_ordinary(r.text or ""))
    assert sorted((r.n_edits, r.n_before) for r in got if r.doc_id == 1) == [(1, len(lib.encode_ordinary("one  two\none  two\n")))] * 2
    assert counts.recount(d.limit(0), queries.RANKS, P.PATTERN, counts.repeated_lines).count() == 0


def test_archives(spark):
    page = "<p>" + "x" * 1200
    rows = [(5, "http://a/", page, "k"), (5, "http://a/", page, "k"), (3, None, page, "k"), (None, "http://n/", page, "k"), (7, "u", None, "k"), (8, "u", "", "k"), (9, "u", "short", "k"), (2, "u", "short", "k")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, record_key string").repartition(2)
    out = warc.resolve(warc.build_index(spark, warc.write_archives(d))).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    got = sorted((str(r.record_key), r.type, str(r.refers_to_key), r.payload_bytes, r.payload_digest) for r in out)
    want = [("5", "response", "None", 1203, sha(page))] * 2 + [("3", "revisit", "5", 1203, sha(page)), ("None", "revisit", "5", 1203, sha(page))]
    want += [("7", "response", "None", 0, sha("")), ("8", "response", "None", 0, sha("")), ("9", "response", "None", 5, sha("short")), ("2", "response", "None", 5, sha("short"))]
    assert got == sorted(want)
    assert warc.resolve(warc.build_index(spark, warc.write_archives(d.limit(0)))).count() == 0


def test_encoding_and_sharding_of_nothing(spark):
    d = docs(spark)
    assert bpe.decode(bpe.encode(d.limit(0), queries.RANKS, P.PATTERN), queries.RANKS).count() == 0
    assert sharding.assign(d.limit(0), [1.0] * 4, [1.0] * 5).count() == 0
    got = sharding.assign(d, [1.0] * 4, [1.0] * 5, keep=("text",)).collect()
    assert len(got) == 5 and len({(r.shard, r.slot) for r in got}) == 5
    assert len({r.shard for r in got if r.doc_id == 1}) == 1


def test_shards_on_disk(spark, tmp_path):
    d = spark.range(500).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    sharding.write_shards(d, [1.0, 2.0, 1.0], str(tmp_path / "s"))
    back = {r.doc_id: r.shard for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert back == {r.doc_id: r.shard for r in sharding.assign(d, [1.0, 2.0, 1.0]).collect()} and len(back) == 500


def test_token_files_join_pretokens_by_a_mark():
    """New pre-tokens go to the model many at a time, with a mark between them that no merge crosses, and have the library's ids."""
    import json

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from llm.token_files import _Encoder, separator

    path = public_tokenizers.path("byte_bpe_50k.json")
    blob = open(path, encoding="utf-8").read()
    model = json.loads(blob)["model"]
    assert separator(model) is not None and separator(model | {"ignore_merges": True}) is None
    texts = ["", " ", "a", "a  b\n\nc, d's 12345", " ".join(f"w{i}x,é{i * 7919}" for i in range(700)), "\x00 a\x00b \x01", "你好 ẃ x y", "tail  ", "\tq r"]
    enc, whole = _Encoder(blob, public_tokenizers.PATTERN), Tokenizer.from_file(path)
    assert enc.pieces.runs is not None
    ids, off = enc.encode_column(pa.array([*texts, None]))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [*(whole.encode(t, add_special_tokens=False).ids for t in texts), []]
