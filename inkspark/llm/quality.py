"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base statistics of every whole text decide the base rules.  Beyond them, each
rule rejects a document whose score is above a cutoff, and the cutoffs come from
labelled rows: for every stratum (language), rule and cutoff of a fixed grid,
the good rows that the cutoff would reject are k of n.  A cutoff is admitted if
its false rejection rate is at most ``alpha`` with certainty: the exact binomial
probability of k or fewer rejections at rate alpha, P(Bin(n, alpha) <= k), which
is the p-value against "the rate exceeds alpha" (the Clopper-Pearson bound), must
be at most ``delta`` / number of tests.  The tests are all strata x rules x
cutoffs (Bonferroni), so with probability 1 - delta every admitted cutoff holds
its limit, whichever are then chosen; the rules' limits add up to ``risk`` for
each stratum.  Among a rule's admitted cutoffs the one that rejects most bad rows
is taken, of equals the highest.  A rule without an admitted cutoff, or one
that rejects no bad row, rejects nothing in that stratum.

Defined results: null and empty texts have no words and fail the base rule;
documents of a null or unlabelled language are rejected by the base rules only;
no labels leave the base rules only; rows with the same id each get their own
row, and all of them count as labelled; ids that are labelled twice count once
for each label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

RISK = 0.06
DELTA = 0.1
#: score of a rule and its grid of cutoffs (fixed before any label is seen)
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [i / 100 for i in range(2, 32, 2)]),
    "exclamations": ("n_marks / greatest(n_words, 1)", [i / 20 for i in range(2, 17)]),
    "capitals": ("n_capitals / greatest(word_chars, 1)", [i / 20 for i in range(2, 17)]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [i / 40 for i in range(2, 20)]),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", [i / 40 for i in range(2, 20)]),
    "length": ("word_chars / greatest(n_words, 1)", [float(i) for i in range(8, 24)]),
}
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals", "base_failed", "failed", "kept")
WORD_SPLIT = r"[\\x20\\x09-\\x0D]+"


def bound(value, body):
    """SQL: ``body``, a lambda such as 'x -> ...', of ``value``, which is computed once."""
    return f"transform(array({value}), {body})[0]"


#: words in 3-word windows found twice or more: hashes of the windows with their places, sorted; of the places that share
#: a hash with a neighbour each covers up to its next, three words at most
REPEATED = bound(
    "array_sort_windows",
    "s -> "
    + bound(
        "array_sort(transform(filter(s, (e, j) -> e.h = get(s, j - 1).h OR e.h = get(s, j + 1).h), e -> e.i))",
        "p -> aggregate(transform(p, (q, j) -> least(3, coalesce(get(p, j + 1) - q, 3))), 0L, (n, c) -> n + c)",
    ),
).replace(
    "array_sort_windows",
    "sort_array(transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> struct(xxhash64(x, get(w, i + 1), get(w, i + 2)) AS h, i AS i)))",
)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the statistics of its whole texts; ``text`` itself is not kept, and columns of their names are replaced."""
    docs = docs.select(*[c for c in docs.columns if c not in STATISTICS])
    t = f"coalesce(`{text}`, '')"
    parts = docs.withColumn(
        "__q",
        F.expr(
            bound(
                f"array_remove(split({t}, '{WORD_SPLIT}'), '')",
                "w -> struct("
                "cast(size(w) AS long) AS n_words, "
                "cast(char_length(array_join(w, '')) AS long) AS word_chars, "
                f"{REPEATED} AS n_repeat_words)",
            )
        ),
    )
    lines = bound(
        f"filter(split({t}, '\\\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')",
        "l -> struct(cast(size(l) AS long) AS n_lines, cast(size(l) - size(array_distinct(l)) AS long) AS n_dup_lines)",
    )
    without = lambda chars: f"cast(char_length({t}) - char_length(regexp_replace({t}, '{chars}', '')) AS long)"
    parts = parts.withColumn("__l", F.expr(lines))
    return parts.select(
        *[F.col(c) for c in docs.columns if c != text],
        "__q.n_words",
        "__q.word_chars",
        F.expr(without("[#*$%&|<>]")).alias("n_symbols"),
        "__l.n_dup_lines",
        "__q.n_repeat_words",
        "__l.n_lines",
        F.expr(without("[!?]")).alias("n_marks"),
        F.expr(without("[A-Z]")).alias("n_capitals"),
    )


def base_failed():
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def binomial_tail(k: str, n: str, p: float) -> str:
    """SQL: P(Bin(n, p) <= k), exact up to rounding for k <= n * p, else 1; its loop has k steps at most, which n * p bounds."""
    from math import log

    term = f"x.lp + ln((n - j + 1) / j) + {log(p / (1 - p))!r}D"
    more = f"greatest(x.ls, {term}) + ln(1 + exp(-abs(x.ls - ({term}))))"
    return (
        f"transform(array(struct(cast({k} AS long) AS k, cast({n} AS double) AS n)), v -> CASE WHEN v.k > v.n * {p!r}D THEN 1D ELSE "
        f"exp(aggregate(CASE WHEN v.k >= 1 THEN sequence(1L, v.k) ELSE cast(array() AS array<bigint>) END, "
        f"struct(v.n * {log(1 - p)!r}D AS lp, v.n * {log(1 - p)!r}D AS ls), "
        f"(x, j) -> struct({term} AS lp, {more} AS ls), x -> x.ls)) END)[0]"
    ).replace("(n - j + 1)", "(v.n - j + 1)")


def thresholds(scored: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA, rules: dict = RULES) -> DataFrame:
    """(stratum, rule, cutoff) from labelled rows with statistics and ``quality`` (1 good, 0 bad)."""
    alpha = risk / len(rules)
    marks = scored.where(F.col("quality").isNotNull() & F.col(stratum).isNotNull()).select(
        F.col(stratum).alias("stratum"),
        (F.col("quality") == 1).alias("good"),
        F.explode(
            F.array(
                *[
                    # place: how many cutoffs of the grid reject the row
                    F.struct(F.lit(r).alias("rule"), F.lit(i).alias("number"), F.expr(" + ".join(f"cast({score} > {c!r}D AS int)" for c in grid)).alias("place"))
                    for i, (r, (score, grid)) in enumerate(rules.items())
                ]
            )
        ).alias("m"),
    )
    counts = marks.groupBy("stratum", "m.rule", "m.number", "m.place").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    every = Window.partitionBy("stratum", "rule")  # at most a grid's length of rows
    grids = F.array(*[F.array(*[F.lit(float(c)) for c in grid]) for _, grid in rules.values()])
    totals = counts.withColumn("n", F.sum("good").over(every)).groupBy("stratum", "rule", "number", "n").agg(F.collect_list(F.struct("place", "good", "bad")).alias("rows"))
    tests = totals.select("*", F.posexplode(grids[F.col("number")]).alias("at", "cutoff"))
    above = lambda c: F.aggregate(F.filter("rows", lambda r: r["place"] > F.col("at")), F.lit(0).cast("long"), lambda s, r: s + r[c])
    tests = tests.select("stratum", "rule", "n", "cutoff", above("good").alias("k"), above("bad").alias("bad"))
    m = F.count("*").over(Window.partitionBy(F.lit(0)))  # strata x rules x cutoffs
    tests = tests.withColumn("tests", m).withColumn("p", F.expr(binomial_tail("k", "n", alpha)))
    admitted = tests.where((F.col("p") <= delta / F.col("tests")) & (F.col("bad") > 0))
    return admitted.groupBy("stratum", "rule").agg(F.max(F.struct("bad", "cutoff"))["cutoff"].alias("cutoff"))


def verdicts(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", **options) -> DataFrame:
    """``docs`` without ``text``, with its statistics, ``base_failed``, ``failed`` (rules that reject it) and ``kept``."""
    rules = options.get("rules", RULES)
    scored = stored(statistics(docs, text).withColumn("base_failed", base_failed()), "quality")
    labelled = scored.drop("quality").join(labels.select("doc_id", "quality"), "doc_id")
    # a row for each stratum that has a cutoff; strata are languages, and what is sent is checked all the same
    cutoffs = stored(thresholds(labelled, stratum, **options).groupBy("stratum").pivot("rule", list(rules)).agg(F.first("cutoff")), "cutoffs")
    cutoffs = cutoffs.withColumnsRenamed({r: f"__{r}" for r in rules} | {"stratum": "__stratum"})
    few = cutoffs.count() <= 10_000
    out = scored.join(F.broadcast(cutoffs) if few else cutoffs, F.col(stratum) == F.col("__stratum"), "left").drop("__stratum")
    failed = F.filter(F.array(*[F.when(F.expr(f"({score}) > `__{r}`"), F.lit(r)) for r, (score, _) in rules.items()]), lambda x: x.isNotNull())
    out = out.withColumn("failed", failed).drop(*[f"__{r}" for r in rules])
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    out = verdicts(docs.select("doc_id", "text", "lang"), labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
