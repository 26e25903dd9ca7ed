"""The training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from llm import bpe, components, counts, decontaminate, jaccard, quality, queries, repeats, sharding, simhash, suffix_array, suffix_tree, token_files, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, kept string, id string, ids string"
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    r = random.Random(5)
    words = ["alpha", "beta", "Gamma", "dé", "e", "zeta's", "42", "x,y", "日本"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    a, b = say(60), say(40)
    return [None, "", " ", "one", a, a, f"{b} {a}", f"{say(20)}\n{b}", f"x  {b[:90]}", "ab" * 90, "ab" * 70 + " end", "\n\n  tabs\t\there\n x\n x\n", say(900), f"{say(30)} {a[:51]} {say(30)}", "z" * 3000 + a]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en" if i % 2 else None, "s", 0, "clash", "k", "i", "j") for i, t in enumerate(texts())]
    rows.append((*rows[4][:2], *rows[4][2:]))  # a repeated row
    rows.append((None, texts()[4], "en", "s", 0, "c", "k", "i", "j"))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_base_columns(docs):
    for r in quality.base_columns(docs, keep=("text",)).collect():
        t = r.text or ""
        w = WORD.findall(t)
        tri = list(zip(w, w[1:], w[2:]))
        covered = {i + d for i, x in enumerate(tri) if tri.count(x) > 1 for d in range(3)} if len(tri) < 1500 else None
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert covered is None or r.n_repeat_words == len(covered)


def test_binomial_bound_and_cutoffs(spark):
    from math import comb

    for k, n, p in ((0, 50, 0.1), (3, 90, 0.1), (20, 1000, 0.04)):
        got = spark.sql(f"SELECT {quality.binomial_cdf(str(k), str(n), repr(p) + 'D')} AS c").first().c
        assert abs(got / sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) - 1) < 1e-9
    rows = [(i, 100, 500, 60 if i % 10 == 0 else 0, 0, 0, False, "en") for i in range(20000)]
    m = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lang string")
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1) for i in range(20000)], "doc_id long, quality int")
    assert [(r["rule"], r.cutoff, r.good_hit) for r in quality.fit_cutoffs(m, labels).collect()] == [("symbols", 0.5, 0)]


def brute_repeats(rows, size):
    seen = {}
    for i, s in rows:
        for p in range(len(s) - size + 1):
            w = tuple(s[p : p + size])
            seen[w] = min(seen.get(w, i), i)
    out = {}
    for i, s in rows:
        gone = {p + d for p in range(len(s) - size + 1) if seen[tuple(s[p : p + size])] < i for d in range(size)}
        out[i] = [x for p, x in enumerate(s) if p not in gone], len(gone)
    return out


def judged(rows, size):
    """Kept symbols and their number of each (id, symbols), each row against rows of smaller ids."""
    seen = {}
    for i, s in rows:
        for p in range(len(s) - size + 1):
            w = tuple(s[p : p + size])
            seen[w] = min(seen.get(w, i), i)
    out = []
    for i, s in rows:
        gone = {p + d for p in range(len(s) - size + 1) if seen[tuple(s[p : p + size])] < i for d in range(size)}
        out.append((i, [x for p, x in enumerate(s) if p not in gone], len(gone)))
    return out


def with_ambiguous(docs):
    """docs and ids that stand for different texts, with passages of smaller and of equal ids."""
    r = random.Random(8)
    a = " ".join(f"w{r.randrange(500)}" for _ in range(40))
    more = [(500, "q" * 60), (501, "q" * 60), (501, "other"), (501, None), (502, a), (502, f"x {a}"), (503, f"{a} y"), (503, f"z {a} y")]
    return docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(more, "doc_id long, text string"))


def test_suffix_arrays(docs):
    for d in (docs, with_ambiguous(docs)):
        rows = d.collect()
        want = sorted(judged([(r.doc_id, (r.text or "").encode()) for r in rows if r.doc_id is not None], 50))
        got = suffix_array.repeated_bytes(d).collect()
        assert len(got) == len(rows)
        assert all(r.kept == r.text.encode() for r in got if r.doc_id is None)
        assert sorted((r.doc_id, list(r.kept), sum(x.stop - x.start for x in r.spans)) for r in got if r.doc_id is not None) == want
    assert suffix_array.repeated_bytes(docs.limit(0)).count() == 0


def test_suffix_trees(docs):
    for d in (docs, with_ambiguous(docs)):
        rows = d.collect()
        want = sorted(judged([(r.doc_id, WORD.findall(r.text or "")) for r in rows if r.doc_id is not None], 13))
        got = suffix_tree.repeated_words(d).collect()
        assert len(got) == len(rows)
        assert sorted((r.doc_id, r.kept.split(" ") if r.kept else [], sum(x.stop - x.start for x in r.spans)) for r in got if r.doc_id is not None) == want
    assert suffix_tree.repeated_words(docs.limit(0)).count() == 0


def test_equal_hashes_are_no_repeat(spark):
    """The Thue-Morse word and its complement have one polynomial hash modulo 2**64."""
    t = "a"
    for _ in range(11):
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    common = " ".join(f"common{i}" for i in range(12))
    d = spark.createDataFrame([(1, f"{common} {t}"), (2, f"{common} {u}")], "doc_id long, text string")
    assert [x.spans for x in suffix_tree.repeated_words(d).collect()] == [[], []]
    r = random.Random(2)
    rows = [(i, "".join(r.choice("ab") for _ in range(300)) + (t, u)[i % 2]) for i in range(4)]
    want = sorted(judged([(i, x.encode()) for i, x in rows], 50))
    got = suffix_array.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, list(x.kept), sum(y.stop - y.start for y in x.spans)) for x in got) == want


def test_prefix_groups_keep_equal_suffixes_together():
    r = np.random.default_rng(1)
    words = r.integers(0, 3, 4000).astype(np.uint64)
    starts = np.arange(3900)
    whole = suffix_tree.deep_nodes(words, starts, 8)[0]
    groups = list(suffix_tree.prefix_groups(words, starts, 8, most=200))
    assert sorted(np.concatenate(groups)) == starts.tolist()
    parts = np.concatenate([g[suffix_tree.deep_nodes(words, starts[g], 8)[0]] for g in groups])
    assert sorted(parts) == sorted(whole)


def test_ranges_merge():
    a, b = repeats.merge(np.array([5, 1, 2, 9]), np.array([6, 1, 4, 9]))
    assert (a.tolist(), b.tolist()) == ([1, 9], [6, 9])


def test_simhash_links(spark):
    r = random.Random(7)
    fps = {0}
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(6):
            fps.add(x)
            for b in r.sample(range(64), r.choice((1, 2, 3, 4, 5))):
                x ^= 1 << b
    fps |= {y for n in range(3) for c in itertools.combinations(range(10), n) if (y := sum(1 << b for b in c)) is not None}
    fps = sorted(fps)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            parent[find(a)] = find(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    d = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    root = {x.node: x.root for x in components.components(simhash.links(d)).collect()}
    for a, b in itertools.combinations(fps, 2):
        same = root.get(signed(a), signed(a)) == root.get(signed(b), signed(b))
        assert same == (find(a) == find(b))


def test_simhash_rows(docs, spark):
    import xxhash

    got = {(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    for r in docs.collect():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "").encode().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert any(i == r.doc_id and f == fp for i, f, _ in got)
    assert {c for i, f, c in got if f == 0} == {0}
    # Components of the rows by union over all pairs of fingerprints within four bits.
    rows = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()]
    root = {f: f for _, f, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    least = {}
    for i, f, _ in rows:
        least[find(f)] = min(least.get(find(f), i), i)
    assert all(c == least[find(f)] for _, f, c in rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def shingles(t, n=5):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_near_first(rows):
    """Ids (of id, text) that are the smallest of their component of links of similarity 0.8 or more."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or (min(len(x), len(y)) * 5 >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i for i in sets if find(i) == i}


@pytest.mark.parametrize("short_run", [8, 2])
def test_near_copies_of_similarity(spark, docs, short_run, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT_RUN", short_run)
    monkeypatch.setattr(jaccard, "ROUNDS", (1, 3, 9, 1 << 62) if short_run == 2 else jaccard.ROUNDS)
    r = random.Random(13)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = r.choices(vocabulary, k=60)
    rows = [(x.doc_id, x.text) for x in docs.collect() if x.doc_id is not None]
    for group in range(60):
        base = r.choices(vocabulary, k=r.choice((60, 120, 300)))
        base = base + passage if group % 3 == 0 else base
        for _ in range(r.choice((1, 2, 3))):
            w = list(base)
            for at in r.sample(range(len(w)), r.choice((0, 1, 2, 3))):
                w[at] = r.choice(vocabulary)
            rows.append((1000 + len(rows), " ".join(w)))
    many = r.choices(vocabulary, k=100)
    for i in range(100):
        rows.append((5000 + i, " ".join([*many[:i], "changed", *many[i + 1 :]])))
    other = r.choices(vocabulary, k=100)
    for i in range(60):  # a group with links between some of its pairs only
        w = list(other)
        for at in r.sample(range(100), 4):
            w[at] = r.choice(vocabulary)
        rows.append((7000 + i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id for x in jaccard.keep_first(d).collect()}
    assert got == brute_near_first(rows)
    assert jaccard.keep_first(d.limit(0)).count() == 0


def test_sketches_keep_every_similar_pair():
    r = np.random.default_rng(5)
    dropped = 0
    for n in (0, 1, 5, 31, 32, 300, 4000):
        for part in (0.0, 0.5, 0.79, 0.8, 0.9, 1.0):
            x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
            y = np.union1d(x[: int(part * len(x))], r.integers(0, 1 << 63, n - int(part * n), dtype=np.uint64))
            same = len(np.intersect1d(x, y))
            may = jaccard._may_overlap(jaccard._sketch(x), jaccard._sketch(y))
            assert may or 5 * same < 4 * (len(x) + len(y) - same)
            dropped += not may
    assert dropped > 5
    same_part = np.arange(1, 600, dtype=np.uint64)  # counts of 255 and more say nothing
    crowded = np.zeros(16, np.uint8)
    crowded[3] = 255
    assert jaccard._may_overlap(crowded.tobytes(), jaccard._sketch(same_part))


@pytest.fixture(scope="module")
def tiktoken_ids():
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(queries.RANKS), special_tokens={})
    return enc.encode_ordinary


def test_bpe(docs, spark, tiktoken_ids):
    for d in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        out = bpe.decode(bpe.encode(d.select("doc_id", "text"), queries.RANKS, P.PATTERN, keep=("text",)), queries.RANKS).collect()
        both = bpe.encode(d.select("doc_id", "text"), queries.RANKS, P.PATTERN, keep=("text",), decoded=True)
        assert sorted(both.collect(), key=str) == sorted(out, key=str)
        assert len(out) == d.count()
        for r in out:
            assert np.frombuffer(r.ids, "<u4").tolist() == tiktoken_ids(r.text or "")
            assert r.decoded == (r.text or "").encode()


def test_edits(tiktoken_ids):
    count = lambda ts: [len(tiktoken_ids(t)) for t in ts]
    r = random.Random(11)
    for _ in range(300):
        t = "".join(r.choice(["word", " ", "  ", "\n", "It's", " a", "9", ",", "é"]) for _ in range(r.randrange(120)))
        leaves = counts.leaves_of(t, 4)
        assert "".join(leaves) == t
        tree = counts.build(count(leaves))
        assert counts.total(tree) == len(tiktoken_ids(t))
        cuts = sorted(r.randrange(len(t) + 1) for _ in range(4))
        edits = [{"start": a, "stop": b, "text": r.choice(["", " ", "new text", "\n "])} for a, b in zip(cuts[::2], cuts[1::2])]
        if len(edits) > 1 and edits[0]["stop"] == edits[1]["start"]:
            edits = edits[:1]
        new = t
        for e in reversed(edits):
            new = new[: e["start"]] + e["text"] + new[e["stop"] :]
        got, chars, tree, done = counts.edit(t, [len(x) for x in leaves], tree, edits, count)
        assert (got, sum(chars), counts.total(tree)) == (new, len(new), len(tiktoken_ids(new)))
        assert done <= len(new)


def test_count_query(spark, tiktoken_ids):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op2_token_counts(spark, SF).collect():
        lines, seen = texts[r.doc_id].split("\n"), set()
        new = "\n".join(x for x in lines if not (x and x in seen) and (seen.add(x) or True))
        assert (r.n_before, r.n_tokens) == (len(tiktoken_ids(texts[r.doc_id])), len(tiktoken_ids(new)))


def test_token_files(docs, tiktoken_ids):
    manifest = token_files.write_shards(docs, queries.TOKENIZER, P.PATTERN)
    index = token_files.build_index(manifest)
    found = token_files.lookup(manifest.select("id", "occurrence"), index)
    assert found.count() == docs.count()
    got = token_files.read_ids(found, token_files.shard_table(manifest), 2).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start = 0
    for r, x in zip(rows, sorted(got, key=lambda x: x.start)):
        ids = [*tiktoken_ids(r.text or ""), 0]
        assert (x.id, x.start, np.frombuffer(x.ids, "<u4").tolist()) == (r.doc_id, start, ids)
        start += len(ids)
    other = token_files.lookup(manifest.selectExpr("id + 1 AS id", "occurrence + 7 AS occurrence"), index)
    assert other.count() == 0
    empty = token_files.write_shards(docs.limit(0), queries.TOKENIZER, P.PATTERN)
    assert token_files.lookup(empty.select("id", "occurrence"), token_files.build_index(empty)).count() == 0


def test_token_files_with_added_tokens(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.TOKENIZER)
    texts = ["a b<|endoftext|> c", "a   <|endoftext|>   b", "<|endoftext|>", "<|endoftext| >", "plain  text "]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    manifest = token_files.write_shards(d, queries.TOKENIZER, P.PATTERN)
    found = token_files.lookup(manifest.select("id", "occurrence"), token_files.build_index(manifest))
    got = {x.id: np.frombuffer(x.ids, "<u4").tolist() for x in token_files.read_ids(found, token_files.shard_table(manifest), 2).collect()}
    assert got == {i: [*whole.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert 50256 in got[0]


def test_perfect_hash():
    r = np.random.default_rng(3)
    h1, h2 = (r.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    _, rank = token_files.build_mph(h1, h2)
    assert sorted(rank) == list(range(5000))


def test_warc(spark):
    big = "<p>é" + "x" * 1200
    rows = [(1, "http://a/1", big), (2, None, big), (9, "http://a/\r\n9", big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (8, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" + "y" * 70000), (9, "http://a/\r\n9", big)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = warc.write_archives(d)
    index = warc.build_index(spark, folder)
    got = sorted(tuple(r) for r in warc.resolve(index).collect())
    want = []
    for k, _, t in rows:
        b = (t or "").encode()
        visit = b == big.encode() and k != 9
        want.append((str(k), "revisit" if visit else "response", "9" if visit else None, len(b), hashlib.sha1(b).hexdigest()))
    assert got == sorted(want, key=lambda x: tuple(map(str, x))) or sorted(map(str, got)) == sorted(map(str, want))
    assert warc.read_records(index.where("record_key = '8'")).first().payload == rows[7][2].encode()


def test_sharding_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()

    def best(k, n):
        unit = lambda i: (int(hashlib.md5(f"{k}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 4503599627370496.0
        return max(range(n), key=lambda i: (-1.0 / math.log(unit(i)), -i))

    got = {r.doc_id: r for r in queries.op9_sharding(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, b = got[d.doc_id], (d.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "key", best(d.doc_id, 16), best(d.doc_id, 17))
    for s in range(16):
        slots = sorted(r.slot for r in got.values() if r.shard == s)
        assert slots == list(range(len(slots)))


def test_token_files_query(spark):
    from tokenizers import Tokenizer

    whole, start = Tokenizer.from_file(queries.TOKENIZER), 0
    got = {r.doc_id: r for r in queries.op4_token_files(spark, SF).collect()}
    for d in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d.doc_id):
        ids = np.array([*whole.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_sharding(docs):
    out = sharding.assign(docs, [1.0] * 4, [1.0] * 5, keep=("text",)).collect()
    assert len(out) == docs.count()
    for s in range(4):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 4) for r in out)
    many = docs.sparkSession.range(20000).selectExpr("id AS doc_id")
    n = {r["shard"]: r["count"] for r in sharding.assign(many, [1.0, 2.0, 1.0], id_col="doc_id").groupBy("shard").count().collect()}
    assert abs(n[1] / 20000 - 0.5) < 0.02 and abs(n[0] / 20000 - 0.25) < 0.02


def test_decontaminate(spark, docs):
    item = "Alpha, beta; GAMMA delta one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([("a", item), ("b", "dé 日本"), ("c", ""), (None, "one two three"), ("a", item)], "item_id string, text string")
    rows = [(1, f"x {item.lower()} y"), (2, "one two"), (3, "so DÉ dé 日本 " + "w " * 50), (4, None), (5, "one two three")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.scan(d, bench).collect()}
    assert got == {1: (16, 14, ["a"]), 2: (2, 0, []), 3: (54, 2, ["b"]), 4: (0, 0, []), 5: (3, 3, [])}
    assert {r.doc_id for r in decontaminate.drop_contaminated(d, bench).collect()} == {2, 3, 4}
    assert decontaminate.scan(d, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    for most in (1, 1500, 1 << 20):  # sets of one item, of some, of all
        again = decontaminate.scan(d, bench, most=most).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in again} == got
    clash = d.selectExpr("doc_id", "text", "1 AS n_words", "2 AS n_hit", "3 AS item_ids", "4 AS hit_spans", "5 AS ids", "6 AS row", "7 AS t")
    assert decontaminate.drop_contaminated(clash, bench).columns == clash.columns
    assert decontaminate.scan(clash, bench, keep=("n_hit", "t")).columns == ["doc_id", "n_hit", "t", "n_words", "n_hit", "item_ids", "hit_spans"]
    cut = {r.doc_id: (r.text, r.n_hit) for r in decontaminate.remove_spans(clash, bench).collect()}
    assert cut == {1: ("x  y", 2), 2: ("one two", 2), 3: ("so DÉ " + " " + "w " * 50, 2), 4: (None, 2), 5: ("", 2)}
    assert decontaminate.scan(d.limit(0), bench).count() == 0
    assert bpe.encode(clash.select("doc_id", "text", "ids", "n_hit"), queries.RANKS, P.PATTERN, keep=("ids",)).columns == ["doc_id", "ids", "n_tokens", "ids"]


def test_decontaminate_query_in_sets(spark):
    """Many sets and one set find the same on the smallest tables."""
    tables = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark")]
    one, many = (sorted(map(tuple, decontaminate.scan(*tables, most=m).drop("hit_spans").collect())) for m in (1 << 30, 200_000))
    assert one == many and any(r[2] for r in one)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    left = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        left = stage(spark, left, SF)
        assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert rows and {r.doc_id for r in rows} <= set(docs)
    assert {(r.doc_id, r.text) for r in rows} == {(r.doc_id, r.text) for r in left.collect()}
    assert all(zlib.crc32(r.ids) is not None and r.n_tokens * 4 == len(r.ids) for r in rows)


def test_pipeline_against_brute_force(spark, tmp_path, tiktoken_ids):
    import corpus_pipeline

    r = random.Random(17)
    vocabulary = [f"{a}{b}" for a in ("Lo", "mi", "ra", "sen", "tu", "vel") for b in ("na", "ko", "dis", "pe", "ru", "tam", "go")] + [f"n{i}" for i in range(400)]
    say = lambda n: r.choices(vocabulary, k=n)
    item, passage = say(16), say(30)
    texts = [say(n) for n in (20, 49, 60, 90, 150, 150, 200)]
    texts += [[*say(40), *passage, *say(40)], [*say(60), *passage], [*say(20), *item, *say(60)], [*say(9), *item[:13], *say(400)], say(3) * 40]
    for base, changes in ((4, 1), (4, 2), (5, 3), (6, 5), (6, 0)):
        w = list(texts[base])
        for at in r.sample(range(0, len(w), 6), changes):
            w[at] = "changed"
        texts.append(w)
    rows = [(7 * i + 1, " ".join(w), "en" if i % 3 else "de", "s", len(" ".join(w))) for i, w in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in rows[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", " ".join(item))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def good(t):
        w = t.split()
        tri = list(zip(w, w[1:], w[2:]))
        return len(w) >= 50 and 2 * len({i + d for i, x in enumerate(tri) if tri.count(x) > 1 for d in range(3)}) <= len(w)

    def clean(t):
        w, b = t.lower().split(), [x.lower() for x in item]
        grams = {tuple(b[i : i + 13]) for i in range(len(b) - 12)}
        hit = {i + d for i in range(len(w) - 12) if tuple(w[i : i + 13]) in grams for d in range(13)}
        return not hit or 20 * len(hit) < len(w)

    left = [(i, t) for i, t, *_ in rows if good(t)]
    first = brute_near_first(left)
    left = [(i, t) for i, t in left if i in first]
    cut = brute_repeats([(i, t.encode()) for i, t in left], 50)
    assert len(rows) > len(first) and any(n for _, n in cut.values())
    want = {i: t for i, t in ((i, bytes(cut[i][0]).decode()) for i, _ in left) if clean(t)}
    assert len(want) < len(left)
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: (x.text, x.n_chars) for i, x in got.items()} == {i: (t, len(t)) for i, t in want.items()}
    for x in got.values():
        assert np.frombuffer(x.ids, "<u4").tolist() == tiktoken_ids(x.text)
        assert x.decoded_sha256 == hashlib.sha256(x.text.encode()).hexdigest()
