"""Centroids by ball trees, divergence of sources and chunked BPE against brute force, on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from llm import balls, chunk_bpe, divergence, queries

SF = "/root/testdata/sf0.001"


def brute_kmeans(rows, k=8, rounds=10, dims=64):
    """rows of (id, vector): list of (id, cluster, distance, cluster inertia, inertia, digest)."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [list(v) for _, v in first[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda v: min((away(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        at = [place(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    end = [place(v) for _, v in kept]
    per = Counter()
    for d, j in end:
        per[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, per[j], sum(per.values()), digest[j]) for (i, _), (d, j) in zip(kept, end)), key=repr)


def vectors(n, seed=3, spread=0.05):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, spread) for x in r.choice(centres)]) for i in range(n)]
    flat = [0.25] * 64
    rows += [(1000 + i, flat) for i in range(40)]  # ties and repeated vectors
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (2000, None), (2001, flat[:-1]), (2002, [*flat, 0.0]), (2003, [None, *flat[1:]])]
    return rows + [(2004, [math.nan, *flat[1:]]), (2005, [math.inf, *flat[1:]]), (2006, []), (2007, [-0.0] * 64), (2008, [-1e-9] * 64)]


@pytest.mark.parametrize("n,block", [(300, 4096), (300, 64), (3, 16)])
def test_centroids(spark, n, block):
    rows = vectors(n)
    d = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)
    got = balls.cluster(d, block=block).drop("centroid").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_kmeans(rows)


def test_centroids_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = [(5, [0.5] * 64), (5, [0.5] * 64), (9, [-0.5] * 64)]
    assert sorted((tuple(r) for r in balls.cluster(spark.createDataFrame(few, schema)).drop("centroid").collect()), key=repr) == brute_kmeans(few)
    assert balls.cluster(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(Exception, match="too large"):
        balls.cluster(spark.createDataFrame([(1, [1e30] * 64)], schema)).count()


def test_whole_balls_are_assigned():
    """Far groups are assigned ball by ball: no leaf is compared."""
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(-20, 20, (512, 8)) + 10_000 * i for i in range(4)])
    tree = balls.Tree(x)
    row = tree.columns()
    cents = np.array([[10_000 * i] * 8 for i in range(4)])
    found = list(balls.assign(row, cents))
    assert all(len(among) == 1 for *_, among in found) and sum(b - a for a, b, *_ in found) == 2048
    assert len(found) < 40
    ordered = x[tree.order]
    for a, b, node, among in found:
        assert (balls.nearest(ordered[a:b], cents, np.arange(4))[0] == among[0]).all()


def brute_audit(rows, least=10, top=10):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(g or "", s or "", term.findall((t or "").translate(low))) for g, s, t in rows]
    seen, count, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for g, s, ts in docs:
        groups[g].add(s)
        seen.update((g, t) for t in set(ts))
        count[g, s].update(ts)
    out = []
    for g, sources in groups.items():
        kept = sorted((t for (x, t), n in seen.items() if x == g and n >= least), key=str.encode)
        v = len(kept)
        n = {s: sum(count[g, s][t] for t in kept) for s in sources}
        p = {s: [1 + 10**9 * (count[g, s][t] + 2) // (n[s] + 2 * v) for t in kept] for s in sources}
        q = [1 + 10**9 * (sum(count[g, s][t] for s in sources) + 2) // (sum(n.values()) + 2 * v) for t in kept]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted(((-sum(map(f, p[s], p[o])), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted((-f(a, b), t) for t, a, b in zip(kept, p[s], q) if count[g, s][t] and a > b)
            terms = sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(g, s, kind, i, -x, r) for kind, found in (("pair", pair), ("term", terms)) for r, (x, i) in enumerate(found, 1)]
    return sorted(out)


def corpus():
    r = random.Random(4)
    words = ["the", "The", "of", "é", "É", "日本", "ﬀ", "𝒳", "a-b", "x1y", "z" * 300, "q_q", "straße"] + [f"{c}{c}" for c in "bcdefghijk"]
    rows = [("en", f"s{r.randrange(4)}", " ".join(r.choice(words[: r.randrange(3, len(words))]) for _ in range(r.randrange(60)))) for _ in range(120)]
    rows += [("en", "s1", rows[3][2])] * 3  # repeated rows
    rows += [("de", "s1", "nur wenige"), ("de", "leer", ""), ("de", None, None), (None, "a", "the the"), (None, "", None), ("fr", "one", "of")]
    return rows + [("en", "𝒳", "rare of"), ("en", "ﬀ", "1 2 3"), ("en", "long", "the " * 20_000)]


@pytest.mark.parametrize("chunk", [4096, 5])
def test_divergence(spark, chunk):
    rows = corpus()
    d = spark.createDataFrame([(i, g, s, t, "n", 1, 2) for i, (g, s, t) in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, value int, rank int").repartition(4)
    assert sorted(tuple(r) for r in divergence.audit(d, chunk=chunk).collect()) == brute_audit(rows)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_ratio_is_exact():
    r = random.Random(9)
    for _ in range(2000):
        total = r.randrange(1, 1 << r.randrange(2, 53))
        count = r.randrange(total + 1)
        assert divergence.ratio(np.array([count]), np.array([total]))[0] == 1 + 10**9 * count // total


def odd_texts():
    r = random.Random(2)
    parts = ["'", " ", "  ", "\n", "re", "s", "'s", "'ll", "é", "日本", "1", "23", "!", "a", "the", " the", "🎉", "ﬁ", "́", "zzzzz", "<|", "\t", "İ", "<|endoftext|>"]
    say = lambda a, n: "".join(r.choice(a) for _ in range(n))
    shared = say(parts[13:16], 400)
    out = [None, "", " ", "z" * 5000, " " * 700, "'" * 900, "the " * 900, "日" * 900, "<|endoftext|>" * 5]
    out += [say(parts[: r.choice((6, 12, 20, 23, 24))], r.randrange(1, 500)) for _ in range(150)]
    return out + [say(parts[:20], 60) + shared + say(parts[:20], 60) for _ in range(6)]


@pytest.mark.parametrize("bits,least,head", [(10, 64, 64), (1, 24, 8), (3, 30, 16)])
def test_chunks_equal_the_library(monkeypatch, bits, least, head):
    """With small chunks and heads nearly every join needs repair."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    for name, value in (("CUT_BITS", bits), ("LEAST", least), ("HEAD", head)):
        monkeypatch.setattr(chunk_bpe, name, value)
    with open(queries.TOKENIZER, encoding="utf-8") as f:
        blob = f.read()
    lib, enc, texts = Tokenizer.from_str(blob), chunk_bpe.ChunkEncoder(blob, P.PATTERN, 1 << 14), odd_texts()
    for _ in range(2):  # the second time from a cache that forgets
        ids, off, n, fixed = enc.encode_column(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == lib.encode(t or "", add_special_tokens=False).ids, t
    assert bits == 10 or sum(fixed) > 100


def test_chunks_are_defined_by_content():
    """A passage falls into the same chunks wherever it stands, but for its ends."""
    from llm.textblocks import buffers

    import pyarrow as pa

    r = random.Random(6)
    passage = " ".join(f"w{r.randrange(10**6)}" for _ in range(3000))
    texts = [passage, "x" * 777 + passage, "é" + passage + " end"]
    raw, off = buffers(pa.array(texts))
    cut = [{raw[a:b].tobytes() for a, b in zip(c, c[1:])} for c in chunk_bpe.cut_points(raw, off)]
    assert len(cut[0]) > 10 and len(cut[0] & cut[1] & cut[2]) >= len(cut[0]) - 3


def test_chunk_query_and_decoding(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.TOKENIZER)
    rows = [(i, t, "k", "c") for i, t in enumerate(odd_texts())] + [(None, "null id", "k", "c"), (3, "z" * 5000, "k", "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string").repartition(3)
    got = chunk_bpe.encode(d, queries.TOKENIZER, P.PATTERN, decoded=True)
    back = {r.doc_id: r for r in chunk_bpe.decode(got.drop("decoded"), queries.TOKENIZER).collect()}
    assert got.count() == len(rows)
    for i, t, *_ in rows:
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert back[i].ids == want and back[i].n_tokens == len(want) and back[i].decoded == lib.decode(want, skip_special_tokens=False)
    assert chunk_bpe.encode(d.limit(0), queries.TOKENIZER, P.PATTERN).count() == 0
    kept = chunk_bpe.encode(d, queries.TOKENIZER, P.PATTERN, keep=("ids", "n_tokens"))
    assert kept.columns == ["doc_id", "ids", "n_tokens", "n_tokens", "ids", "n_chunks", "n_repaired"] and kept.count() == len(rows)


def test_chunk_query_on_documents(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.TOKENIZER)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = queries.op13_chunk_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


def test_decoding_of_broken_bytes(spark):
    """Ids that end inside a character decode as the library does."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.TOKENIZER)
    ids = lib.encode("日本🎉é", add_special_tokens=False).ids
    cut = [ids[:n] for n in range(len(ids) + 1)] + [ids[1:], ids[2:], [50256, *ids[-1:]]]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cut)] + [(99, None)], "k int, ids array<int>")
    got = {r.k: r.decoded for r in chunk_bpe.decode(d, queries.TOKENIZER).collect()}
    assert got.pop(99) is None
    assert [got[i] for i in range(len(cut))] == [lib.decode(c, skip_special_tokens=False) for c in cut]
