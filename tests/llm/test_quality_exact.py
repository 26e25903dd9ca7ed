"""Quality rules: clashing hashes, awkward rows, and several certified rules."""

import re

import pytest

from llm import quality
from llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + d for places in at.values() if len(places) > 1 for i in places for d in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(map((t or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered), failed


def test_windows_of_one_hash(spark):
    """Two trigrams that share the 40 bits of their hash that are sorted by, one of them repeated around the other."""
    one, two = "a1535818 b1535818 c1535818", "a5512564 b5512564 c5512564"
    fill = " ".join(f"w{i}" for i in range(50))
    texts = [f"{one} {two} {one} {fill}", f"{one} {fill} {two}", f"{two} {one} {one} {two} {fill}", f"{one} x {two} y {one} z {two} {fill}", None, "", "a b c a b c", "# | \n# |\n\n # |"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.base_columns(d).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in (*quality.BASE, "base_failed")) == brute(t), t
    assert got[0].n_repeat_words == 6


@pytest.mark.parametrize("bits", [61, 58, 2])
def test_short_hashes_and_places(spark, monkeypatch, bits):
    """With few bits of hash left most texts clash; with few bits of place texts are too long for it: both go by the words."""
    import random

    monkeypatch.setattr(quality, "_POSITION_BITS", bits)
    r = random.Random(bits)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(120))) for _ in range(40)] + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.base_columns(d).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in (*quality.BASE, "base_failed")) == brute(t)


def test_certified_rules_of_two_strata(spark):
    """Long words and symbols mark bad documents of one stratum, repeated lines those of the null stratum; each is certified there alone."""
    good = lambda i: " ".join(f"{chr(97 + (i + k) % 26)}{k}x" for k in range(60))
    bad = {0: lambda i: " ".join(f"{'long' * 8}{k}" for k in range(60)), 1: lambda i: good(i).replace("x", "#$"), 2: lambda i: "\n".join([good(i)] + [f"{chr(97 + i % 26)}q"] * 20)}
    rows = []
    for i in range(2600):
        kind = i % 20
        rows.append((i, bad[kind](i) if kind < 2 else good(i), "en", 0 if kind < 2 else 1, "clash", 9))
        rows.append((10_000 + i, bad[2](i) if kind == 0 else good(i), None, 0 if kind == 0 else 1, "clash", 9))
    rows += [rows[0], (77_777, None, "en", None, "k", 1), (77_778, "", None, 1, "k", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, kept string, n_words int")
    d = written(d, "labelled")
    docs, labels = d.drop("quality"), d.select("doc_id", "quality")
    measured = written(quality.base_columns(docs, keep=("lang",)), "measured")
    assert {(r.lang, r["rule"]) for r in quality.fit_cutoffs(measured, labels).collect()} >= {("en", "long_words"), ("en", "symbols"), (None, "dup_lines")}
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs, labels).collect()}
    assert len(got) == len({r[0] for r in rows})
    wrong = [r[0] for r in rows if r[3] is not None and r[1] and got[r[0]] != bool(r[3])]
    assert not wrong and not got[77_777] and not got[77_778]
    left = quality.quality_filter(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(got[r[0]] for r in rows)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_rules(docs, labels).count() == 0 and quality.quality_filter(docs, labels).count() == 0
    one = spark.createDataFrame([(1, " ".join(map(str, range(60))), None)], "doc_id long, text string, lang string")
    assert [r.kept for r in quality.quality_rules(one, labels).collect()] == [True]
