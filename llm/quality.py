"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule is a score; a document is rejected where a score exceeds its cutoff.
Labelled documents are the holdout: for every stratum, rule and candidate cutoff
the exact binomial (Clopper-Pearson) test asks whether the share of good documents
that the cutoff rejects is below `risk / number of rules`, at a level divided by the
number of all tests (Bonferroni).  By the union bound, with probability 1 - `delta`
the selected rules together reject at most a share `risk` of the good documents in
every stratum.  Among certified cutoffs the one with the largest gap between rejected
bad and rejected good documents wins (ties: the looser one); a rule without a
certified, useful cutoff rejects nothing in that stratum.  The grid of candidates is
fixed beforehand, so choosing among them is covered by the correction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, written

#: Rule name, score over the base columns, candidate cutoffs (reject where score > cutoff).
RULES: tuple[tuple[str, str, tuple[float, ...]], ...] = (
    ("long_words", "try_divide(word_chars, n_words)", (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
    ("short_words", "try_divide(n_words, word_chars)", (0.2, 0.22, 0.25, 0.28, 0.33, 0.4, 0.5, 0.7)),
    ("symbols", "try_divide(n_symbols, n_words)", (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)),
    ("dup_lines", "try_divide(n_dup_lines, n_words)", (0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1)),
    ("repeats", "try_divide(n_repeat_words, n_words)", (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.45)),
)
RISK, DELTA = 0.02, 0.05
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SPACE = r" \t\n\u000B\u000C\r"
_POSITION_BITS = 24


def _measured(docs: DataFrame, text: str, p: str) -> DataFrame:
    """docs plus the base columns, each named with the prefix p."""
    low = (1 << _POSITION_BITS) - 1
    q = f"`{text}`"
    step = docs.withColumn(f"{p}t", F.expr(f"coalesce({q}, '')"))
    step = step.withColumn(f"{p}s", F.expr(f"btrim({p}t, '{_SPACE}')"))
    step = step.withColumn(f"{p}w", F.expr(f"CASE WHEN {p}s = '' THEN cast(array() AS array<string>) ELSE split({p}s, '[\\\\x20\\\\x09-\\\\x0D]+') END"))
    # A window's hash in the high bits and its place in the low ones: one primitive sort brings equal windows together.
    step = step.withColumn(
        f"{p}k",
        F.expr(
            f"CASE WHEN size({p}w) < 4 OR size({p}w) > {low} THEN cast(array() AS array<bigint>) ELSE sort_array(transform(sequence(0, size({p}w) - 3), "
            f"i -> (xxhash64({p}w[i], {p}w[i + 1], {p}w[i + 2]) & {~low}) | i)) END"
        ),
    )
    same = lambda a, b: f"coalesce((({a} ^ {b}) & {~low}) = 0, false)"
    at = lambda x: f"cast({x} & {low} AS int)"
    words = lambda a, b: " AND ".join(f"get({p}w, {at(a)} + {d}) = get({p}w, {at(b)} + {d})" for d in range(3))
    prev, after = f"get({p}k, j - 1)", f"get({p}k, j + 1)"
    # Where neighbours of one hash differ in their words (or places need more bits), windows are sorted by the words themselves.
    step = step.withColumn(f"{p}x", F.expr(f"size({p}w) > {low} OR size(filter({p}k, (x, j) -> {same('x', prev)} AND NOT ({words('x', prev)}))) > 0"))
    windows = f"sort_array(transform(sequence(0, size({p}w) - 3), i -> named_struct('g', concat_ws(' ', {p}w[i], {p}w[i + 1], {p}w[i + 2]), 'i', i)))"
    by_words = f"transform(array({windows}), s -> transform(filter(s, (y, j) -> coalesce(y.g = get(s, j - 1).g, false) OR coalesce(y.g = get(s, j + 1).g, false)), y -> cast(y.i AS bigint)))[0]"
    by_hash = f"transform(filter({p}k, (x, j) -> {same('x', prev)} OR {same('x', after)}), x -> x & {low})"
    step = step.withColumn(f"{p}d", F.expr(f"CASE WHEN {p}x THEN {by_words} ELSE {by_hash} END"))
    lines = f"filter(split({p}t, '\\n'), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
    step = step.withColumn(f"{p}l", F.expr(lines))
    out = {
        "n_words": f"cast(size({p}w) AS bigint)",
        "word_chars": f"cast(length(translate({p}t, '{_SPACE}', '')) AS bigint)",
        "n_symbols": f"cast(length({p}t) - length(translate({p}t, '#*$%&|<>', '')) AS bigint)",
        "n_dup_lines": f"cast(size({p}l) - size(array_distinct({p}l)) AS bigint)",
        "n_repeat_words": f"aggregate(sort_array({p}d), named_struct('n', 0L, 'last', -3L), (a, x) -> "
        "named_struct('n', a.n + least(3L, x - a.last), 'last', x), a -> a.n)",
    }
    for name, expr in out.items():
        step = step.withColumn(f"{p}{name}", F.expr(expr))
    return step.drop(*(f"{p}{x}" for x in ("t", "s", "w", "k", "x", "d", "l")))


def base_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """id, `keep` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed per document.

    Whole texts in one narrow pass; a null or empty text has no words and fails the base rule.
    Repeats are exact: hashes that clash are told apart by the words.  Other columns are dropped, so
    their names cannot clash."""
    cols = list(dict.fromkeys((id_col, *keep)))
    q = _measured(docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys((*cols, text_col)))), text_col, "__q_")
    return q.select(*(F.col(f"`{c}`") for c in cols), *(F.col(f"__q_{b}").alias(b) for b in BASE)).withColumn("base_failed", _failed())


def _failed(p: str = "") -> Column:
    return F.expr(f"{p}n_words < 50 OR 100 * {p}n_repeat_words > 50 * {p}n_words")


def _lgamma(x: str) -> str:
    """ln Gamma by Stirling's series at x + 8, brought back by the recurrence; to about 1e-13."""
    y = f"({x} + 8)"
    series = f"(({y} - 0.5) * ln({y}) - {y} + 0.91893853320467274178 + 1 / (12 * {y}) - 1 / (360 * {y} * {y} * {y}) + 1 / (1260 * pow({y}, 5)) - 1 / (1680 * pow({y}, 7)))"
    return f"({series} - ({' + '.join(f'ln({x} + {i})' for i in range(8))}))"


def binomial_cdf(k: str, n: str, p: str) -> str:
    """SQL text of P(Binomial(n, p) <= k) for k below n * p, the only side that a bound needs."""
    k, n = f"cast({k} AS double)", f"cast({n} AS double)"
    top = f"({_lgamma(f'({n} + 1)')} - {_lgamma(f'({k} + 1)')} - {_lgamma(f'({n} - {k} + 1)')} + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"
    many = f"cast(least({k}, 40 * sqrt({n} * {p}) + 200) AS int)"
    total = f"aggregate(sequence(0, {many}), named_struct('t', 1D, 's', 0D), (a, j) -> named_struct('t', a.t * ({k} - j) / ({n} - {k} + j + 1) * (1 - {p}) / {p}, 's', a.s + a.t), a -> a.s)"
    return f"exp({top} + ln({total}))"


def fit_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    strata: Sequence[str] = ("lang",),
    label_col: str = "quality",
    risk: float = RISK,
    delta: float = DELTA,
    rules=RULES,
) -> DataFrame:
    """One row per stratum and rule that has a certified cutoff: the strata, rule, cutoff and its counts.

    Good means every non-null label of the document is 1.  Labels of unknown documents and
    null labels or ids count for nothing.  Only documents that pass the base rule are tested.
    The holdout is all labels; it is joined on the id with the (narrow) measured table."""
    lab = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__y")).where("__id IS NOT NULL AND __y IS NOT NULL").groupBy("__id").agg(F.min("__y").alias("__y"))
    group = [f"__g{i}" for i in range(len(strata))]
    m = measured.where("NOT base_failed").select(F.col(f"`{id_col}`").alias("__id"), *(F.col(f"`{s}`").alias(g) for s, g in zip(strata, group)), *BASE)
    hit = []
    for name, score, cuts in rules:
        rejected = " + ".join(f"int(coalesce({score}, 0) > {c!r})" for c in cuts)
        hit.append(f"named_struct('rule', '{name}', 'n_cut', {rejected})")
    counted = (
        m.join(lab, "__id")
        .select(*group, "__y", F.explode(F.expr(f"array({', '.join(hit)})")).alias("h"))
        .groupBy(*group, "h.rule", "h.n_cut")
        .agg(F.sum(F.expr("int(__y = 1)")).alias("good"), F.sum(F.expr("int(__y <> 1)")).alias("bad"))
    )
    whole = Window.partitionBy(*group, "rule")
    grid = " UNION ALL ".join(f"SELECT '{name}' AS rule, {i + 1} AS i, {c!r}D AS cutoff" for name, _, cuts in rules for i, c in enumerate(cuts))
    tests = (
        counted.join(F.broadcast(measured.sparkSession.sql(grid)), "rule")
        .groupBy(*group, "rule", "i", "cutoff")
        .agg(
            F.sum(F.expr("if(n_cut >= i, good, 0)")).alias("good_hit"),
            F.sum(F.expr("if(n_cut >= i, bad, 0)")).alias("bad_hit"),
            F.sum("good").alias("n_good"),
            F.sum("bad").alias("n_bad"),
        )
    )
    n_rules, n_cuts = len(rules), max(len(c) for _, _, c in rules)
    groups = counted.select(*group).distinct().agg(F.count(F.lit(1)).alias("n_strata"))
    p = repr(risk / n_rules)
    certified = (
        tests.crossJoin(F.broadcast(groups))  # one row
        .withColumn("level", F.expr(f"{delta!r}D / (n_strata * {n_rules} * {n_cuts})"))
        .withColumn("p_value", F.expr(f"CASE WHEN good_hit >= n_good * {p}D THEN 1D ELSE {binomial_cdf('good_hit', 'n_good', p + 'D')} END"))
        .withColumn("gap", F.expr("coalesce(try_divide(bad_hit, n_bad), 0D) - coalesce(try_divide(good_hit, n_good), 0D)"))
        .where("p_value <= level AND gap > 0")
    )
    best = certified.withColumn("__r", F.row_number().over(whole.orderBy(F.desc("gap"), F.desc("cutoff")))).where("__r = 1")
    return best.select(*(F.col(g).alias(s) for s, g in zip(strata, group)), "rule", "cutoff", "good_hit", "n_good", "bad_hit", "n_bad", "p_value", "level")


def _verdict(measured: DataFrame, cutoffs: DataFrame, strata: Sequence[str], p: str, rules=RULES) -> DataFrame:
    """measured plus boolean {p}kept; cutoffs is turned to one row per stratum and broadcast below a counted size."""
    # One row per stratum: a column for each rule, null where it rejects nothing.
    wide = cutoffs.groupBy(*(F.col(f"`{s}`").alias(f"{p}g{i}") for i, s in enumerate(strata))).agg(
        *(F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"{p}c_{name}") for name, _, _ in rules)
    )
    wide = written(wide, "quality-cutoffs")
    on = [measured[f"`{s}`"].eqNullSafe(wide[f"{p}g{i}"]) for i, s in enumerate(strata)]
    joined = measured.join(small_side(wide, wide.count()), on, "left")
    rejects = []
    for name, score, _ in rules:
        for b in BASE:
            score = score.replace(b, f"{p}{b}") if p and b in score else score
        rejects.append(f"coalesce({score} > {p}c_{name}, false)")
    return joined.withColumn(f"{p}kept", F.expr(f"NOT {p}base_failed AND NOT ({' OR '.join(rejects)})"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", strata: Sequence[str] = ("lang",), **fit) -> DataFrame:
    """Per document: id, strata, the base columns, base_failed and kept.

    Texts are measured once; the narrow measured table is written to the shared folder, the
    cutoffs are fitted on its labelled rows and applied to all rows.  Repeated rows are judged
    one by one, null strata form a stratum, an empty table gives an empty result."""
    measured = written(base_columns(docs, id_col, text_col, strata), "quality-measured")
    cutoffs = fit_cutoffs(measured, labels, id_col, strata, **fit)
    return _verdict(measured.withColumnsRenamed({b: f"__q_{b}" for b in (*BASE, "base_failed")}), cutoffs, strata, "__q_").select(
        id_col, *strata, *(F.col(f"__q_{b}").alias(b) for b in (*BASE, "base_failed", "kept"))
    )


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", strata: Sequence[str] = ("lang",), **fit) -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they were.

    Verdicts are made on the narrow measured table; the rejected rows, told apart by id, strata
    and text hash, are then taken out of docs (null ids and texts compare as equal)."""
    mark = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), F.xxhash64(F.col(f"`{text_col}`")).alias("x"), *(F.col(f"`{s}`").alias(f"s{n}") for n, s in enumerate(strata)))
    groups = [f"s{n}" for n in range(len(strata))]
    measured = written(base_columns(mark, "i", "t", ("x", *groups)), "quality-measured")
    lab = labels.withColumnRenamed(id_col, "i")
    cutoffs = fit_cutoffs(measured, lab, "i", groups, **fit)
    named = measured.withColumnsRenamed({b: f"__q_{b}" for b in (*BASE, "base_failed")})
    gone = _verdict(named, cutoffs, groups, "__q_").where("NOT __q_kept").select(F.col("i").alias("__i"), F.col("x").alias("__x"), *(F.col(g).alias(f"__{g}") for g in groups)).distinct()
    gone = written(gone, "quality-rejected")
    on = (docs[f"`{id_col}`"].eqNullSafe(gone["__i"])) & (F.xxhash64(docs[f"`{text_col}`"]) == gone["__x"])
    for g, s in zip(groups, strata):
        on = on & docs[f"`{s}`"].eqNullSafe(gone[f"__{g}"])
    return docs.join(small_side(gone, gone.count()), on, "left_anti")
