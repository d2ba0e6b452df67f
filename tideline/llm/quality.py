"""Quality rules: text statistics and robust multivariate outliers.

The statistics of every document are transformed and, per language and source, compared with a
minimum-covariance-determinant estimate of their centre and scatter. The estimate is made by
concentration steps over *all* rows of a group: distances under the current estimate, their
median per group, then mean and covariance of the nearer half, from several starts; the smallest
determinant counts. Every step is one distributed aggregation of sums over all groups and starts
at once, so one group may hold any share of the rows.

Groups of any size are judged alike: a group's sums count together with PRIOR rows like its
language's, and the language's with PRIOR rows like those of all languages. A large group stands
for itself, a single row is judged by its language, and what is between is weighed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.batches import extend_rows, map_rows
from tideline.storage import materialize, scratch

SYMBOLS = "#*$%&|<>"
BASE = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Names of the transformed statistics.
VECTOR = ["z_words", "z_length", "z_symbols", "z_lines", "z_repeats"]
#: Added to the variances. Symbols, repeated lines and repeated words are 0 in most texts, so the
#: nearer half has no scatter of its own there and the floor is the scale: for symbols the noise of
#: a count in 50 words, 1/4 / 50; lines and repeated words come in larger steps.
FLOORS = (0.005, 0.005, 0.005, 0.1, 0.02)
#: Two statistics vary in the nearer half: squared distances are scaled to the median of chi-square
#: with 2 degrees of freedom. The cutoff is its quantile at 1 - 1e-7, 32.2: texts have long tails.
CHI2_MEDIAN = 2 * math.log(2)
CUTOFF = -2 * math.log(1e-7)
#: Rows like the parent's that count beside a group's own.
PRIOR = 64.0
#: Steps from all starts, then from the best one of each group until no log determinant moves by
#: more than STABLE, but at most so many steps.
FIRST_STEPS, MOST_STEPS, STABLE = 2, 7, 0.01


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes.split cuts at [\x20\x09-\x0D] exactly
    n = len(words)
    spaces = sum(raw.count(c) for c in b" \t\n\v\f\r")
    symbols = sum(raw.count(c) for c in SYMBOLS.encode())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        m = len(number)
        if m < 2_000_000:
            windows = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
        else:  # the product would overflow
            pairs = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1]
            windows = pairs[:-1] * m + ids[2:]
        order = np.sort(windows)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            at = np.searchsorted(twice, windows)
            again = twice[np.minimum(at, len(twice) - 1)] == windows
            inside = np.zeros(n, bool)
            inside[:-2] |= again
            inside[1:-1] |= again
            inside[2:] |= again
            repeats = int(inside.sum())
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeats


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the five base statistics of every whole ``text``; null texts have none (0)."""
    return extend_rows(docs, keep, lambda: lambda texts: [statistics(text) for text in texts], [(n, "bigint") for n in ["n_words", *BASE]])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.log1p(F.col("n_words").cast("double"))).alias("z_words"),  # long texts are no outliers
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words).alias("z_length"),
        F.sqrt(F.col("n_symbols") / words).alias("z_symbols"),
        F.log1p(F.col("n_dup_lines").cast("double")).alias("z_lines"),
        F.sqrt(F.col("n_repeat_words") / words).alias("z_repeats"),
    ]


PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i, len(VECTOR))]
SUMS = [*(f"s{i}" for i in range(len(VECTOR))), *(f"q{i}_{j}" for i, j in PAIRS)]
MEDIANS = [f"c{i}" for i in range(len(VECTOR))]


def _sums() -> list[Column]:
    z = [F.col(c) for c in VECTOR]
    return [F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(z)), *(F.sum(z[i] * z[j]).alias(f"q{i}_{j}") for i, j in PAIRS)]


def with_prior(sums: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Sums per ``fit, parent, grand, start`` with PRIOR rows like the parent's added, which have their
    own PRIOR rows like the grandparent's. ``parent`` and ``grand`` are null where there is none."""
    names = ["n", *SUMS, *(c for c in MEDIANS if c in sums.columns)]
    above = sums.select("fit", "start", *names)
    up, top = (near(above.select(*(F.col(c).alias(f"{c}_{x}") for c in above.columns))) for x in ("u", "t"))
    both = sums.join(up, (F.col("parent") == F.col("fit_u")) & (F.col("start") == F.col("start_u")), "left")
    both = both.join(top, (F.col("grand") == F.col("fit_t")) & (F.col("start") == F.col("start_t")), "left")

    def mean(c: str) -> Column:  # of the parent with its own prior
        if c in MEDIANS:
            return F.col(f"{c}_u")
        top_mean = F.when(F.col("n_t") > 0, F.col(f"{c}_t") / F.col("n_t"))
        return F.coalesce((F.col(f"{c}_u") + PRIOR * top_mean) / (F.col("n_u") + PRIOR), F.col(f"{c}_u") / F.col("n_u"))

    grown = {c: F.coalesce(F.col(c) + PRIOR * mean(c), F.col(c)) for c in SUMS}
    grown |= {c: F.coalesce((F.col("n") * F.col(c) + PRIOR * mean(c)) / (F.col("n") + PRIOR), F.col(c)) for c in MEDIANS if c in names}
    total = F.when(F.col("n_u").isNotNull(), F.col("n") + PRIOR).otherwise(F.col("n"))
    return both.select("fit", "parent", "grand", "start", total.alias("n"), *(x.alias(c) for c, x in grown.items()))


def estimates(rows: DataFrame, first: bool) -> DataFrame:
    """Centre, inverse scatter and log determinant of every ``fit`` and ``start`` from its sums; one
    small row each, batched through numpy on the executors. For the ``first`` ones the starts
    differ: mean and variances, mean and covariance, medians and variances."""
    p = len(VECTOR)

    def work(batch):
        out = []
        for fit, parent, grand, start, n, *v in batch:
            mean = np.array(v[:p]) / n
            cov = np.zeros((p, p))
            cov[np.triu_indices(p)] = np.array(v[p : p + len(PAIRS)]) / n
            cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
            if first and start != 1:
                cov = np.diag(np.diag(cov))
            if first and start == 2:
                mean = np.array(v[p + len(PAIRS) :])
            cov = cov + np.diag(FLOORS)
            inverse = np.linalg.inv(cov)
            out.append((fit, parent, grand, start, float(np.linalg.slogdet(cov)[1]), *mean.tolist(), *inverse[np.triu_indices(p)].tolist()))
        return out

    fields = [("fit", "string"), ("parent", "string"), ("grand", "string"), ("start", "int"), ("logdet", "double")]
    return map_rows(rows, lambda: work, fields + [(f"m{i}", "double") for i in range(p)] + [(f"w{i}_{j}", "double") for i, j in PAIRS])


def _distance() -> Column:
    d = [F.col(c) - F.col(f"m{i}") for i, c in enumerate(VECTOR)]
    return sum(((1 if i == j else 2) * F.col(f"w{i}_{j}") * d[i] * d[j] for i, j in PAIRS), F.lit(0.0))


def _named(c: Column) -> Column:
    """A value of any kind, null included, as a part of a name that no other value gives."""
    return F.concat(F.coalesce(F.char_length(c).cast("string"), F.lit("n")), F.lit(":"), F.coalesce(c, F.lit("")))


def robust_outliers(docs: DataFrame, cutoff: float = CUTOFF, groups_in_memory: int = 20_000) -> DataFrame:
    """Judge every row of ``docs`` (``doc_id, text, lang, source``).

    Returns ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept`` and ``distance`` (null for rows of groups in which no
    row passes the base rules). Every row is judged with its language and source, whatever their size
    (see PRIOR); only rows that pass the base rules make the estimates.
    Null lang or source is a value of its own. Null and empty texts have no words and fail the base
    rules. Repeated rows count as often as they occur; a distance at the cutoff is kept. Other
    columns are ignored. The estimates are broadcast below ``groups_in_memory``
    groups (their number is counted first), and joined by shuffle beyond that.
    """
    with scratch(docs.sparkSession) as keep:
        stats = text_statistics(docs, ["doc_id", "lang", "source"]).withColumn("base_failed", base_failed())
        lang, both = _named(F.col("lang")), F.concat(_named(F.col("lang")), _named(F.col("source")))
        rows = keep(materialize(stats.select("doc_id", "n_words", *BASE, "base_failed", *transformed(), both.alias("own"), lang.alias("of")), "quality-rows"))
        levels = F.array(*(F.struct(fit.alias("fit"), parent.alias("parent"), grand.alias("grand")) for fit, parent, grand in (
            (F.col("own"), F.col("of"), F.lit("all")), (F.col("of"), F.lit("all"), F.lit(None).cast("string")), (F.lit("all"), F.lit(None).cast("string"), F.lit(None).cast("string")))))
        good = rows.where(~F.col("base_failed")).select(*VECTOR, F.explode(levels).alias("level")).select(*VECTOR, "level.*")
        medians = [F.percentile_approx(c, 0.5, 2000).alias(m) for c, m in zip(VECTOR, MEDIANS, strict=True)]
        begin = good.groupBy("fit", "parent", "grand").agg(*_sums(), *medians)
        begin = materialize(begin.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))), "quality-begin")
        small = begin.count() <= 3 * groups_in_memory
        near = F.broadcast if small else (lambda x: x)
        order = ["fit", "parent", "grand", "start", "n", *SUMS]
        fit = materialize(estimates(with_prior(begin, near).select(*order, *MEDIANS), True), "quality-fit")
        plain = good.select(*VECTOR, "fit")
        for step in range(MOST_STEPS):
            measured = plain.join(near(fit), "fit").withColumn("distance", _distance())
            middle = materialize(measured.groupBy("fit", "start").agg(F.percentile_approx("distance", 0.5, 2000).alias("middle")), f"quality-middle{step}")
            half = measured.join(near(middle), ["fit", "start"]).where(F.col("distance") <= F.col("middle"))
            sums = materialize(half.groupBy("fit", "parent", "grand", "start").agg(*_sums()), f"quality-sums{step}")
            before, fit = fit, materialize(estimates(with_prior(sums, near).select(*order), False), f"quality-fit{step}")
            if step == FIRST_STEPS - 1:
                best = fit.groupBy("fit").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
                fit = materialize(fit.join(best, ["fit", "start"]).withColumn("start", F.lit(0)), "quality-best")
            elif step >= FIRST_STEPS:
                was = near(before.select("fit", F.col("logdet").alias("was")))
                if fit.join(was, "fit").where(F.abs(F.col("logdet") - F.col("was")) > STABLE).isEmpty():
                    break
        middle = plain.join(near(fit), "fit").withColumn("distance", _distance()).groupBy("fit", "parent", "grand").agg(F.count(F.lit(1)).alias("n"), F.log(F.greatest(F.percentile_approx("distance", 0.5, 2000), F.lit(0.05))).alias("log"))
        middle = materialize(middle, "quality-scale")
        up, top = (near(middle.select(F.col("fit").alias(f"fit_{x}"), F.col("n").alias(f"n_{x}"), F.col("log").alias(f"log_{x}"))) for x in ("u", "t"))
        above = (F.col("n_u") * F.col("log_u") + PRIOR * F.col("log_t")) / (F.col("n_u") + PRIOR)
        scale = middle.join(up, F.col("parent") == F.col("fit_u")).join(top, F.col("grand") == F.col("fit_t")).select("fit", F.exp((F.col("n") * F.col("log") + PRIOR * above) / (F.col("n") + PRIOR)).alias("scale"))
        judges = keep(materialize(fit.drop("start", "parent", "grand", "logdet").join(scale, "fit").withColumnRenamed("fit", "own"), "quality-judges"))
    judged = rows.join(near(judges), "own", "left").withColumn("distance", _distance() / F.col("scale") * CHI2_MEDIAN)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return judged.select("doc_id", "n_words", *BASE, "base_failed", kept.alias("kept"), "distance")
