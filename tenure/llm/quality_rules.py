"""Quality rules (operator 8), DataFrame functions only: base rules and a robust multivariate outlier test.

Base statistics are counted inside each row, linear in the text but for one sort of the word windows, and
that only for texts in which a window repeats.

The verdict is a minimum-covariance-determinant (MCD) estimate per language and source of the transformed
statistics (log of mean word length, square root of the symbol rate, shares of duplicate lines and of
repeated words). Two starts (classical moments; medians with MAD scales) take ``steps`` concentration
steps each; a step orders a group's rows by Mahalanobis distance and re-estimates location and scatter from
the closest ``share``. The half is cut on a fixed grid of distances, so a step is one aggregate of moments
by (group, distance cell) with map-side sums, then sums over at most a few thousand cells per group; medians and
deviations come from counts of cells alone. A group of any size never meets in one task, and results don't depend on the
partitioning. The start of the smaller determinant counts. Rows beyond the chi-square bound are rejected.

Small groups: each language's estimate is its own, in which the whole table's counts like ``prior`` rows, and each group's its own, in
which its language's counts like ``prior`` rows. So a group of a few rows is judged by its language mostly and a large one
by itself, without a size at which the rule changes. Null language or source is a value like others. Null and
empty texts have no words and fail the base rule. Rows with equal ids are judged each for itself. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.common import materialize, small_side

#: Fixed contract values: white space, symbols, least words, most repeated words of a hundred.
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = r"[^#*$%&|<>]+"
LEAST_WORDS, MOST_REPEATED = 50, 50

FEATURES = ("log_word", "root_symbol", "dup_lines", "repeats")
FLOORS = (0.05, 0.05, 0.05, 0.05)
SHARE, STEPS, PRIOR, CUTOFF = 0.75, 4, 50, 0.99999
#: Cells of a unit, for medians and for the logarithm of distances.
MEDIAN_CELLS, DISTANCE_CELLS = 256, 64


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, all long."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE_CHARS))
    df = docs.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long"))
    df = df.withColumn("n_symbols", F.char_length(F.regexp_replace(t, SYMBOLS, "")).cast("long"))
    df = df.withColumn("n_lines", F.size("_lines").cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    at = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.size("_w") - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_h", F.transform(at, lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    # (hash, place) in order, only where a window repeats
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs))
    twice = F.filter("_s", lambda x, i: (x["h"] == F.get("_s", i - 1)["h"]) | (x["h"] == F.get("_s", i + 1)["h"]))
    df = df.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # windows cover 3 words each, less what the next one covers again
    steps = F.transform("_p", lambda p, i: F.least(F.coalesce(F.get("_p", i + 1) - p, F.lit(3)), F.lit(3)))
    covered = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.drop("_w", "_lines", "_h", "_s", "_p")


def _transformed(df: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return (
        df.withColumn("log_word", F.log(F.greatest(F.col("word_chars") / words, F.lit(1.0))))
        .withColumn("root_symbol", F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))))
        .withColumn("dup_lines", F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))
        .withColumn("repeats", F.col("n_repeat_words") / words)
    )


def consistency(share: float, cutoff: float) -> tuple[float, float]:
    """(factor that makes the scatter of the closest share unbiased for normal rows, chi-square bound), 4 dimensions."""
    cdf4 = lambda x: 1 - math.exp(-x / 2) * (1 + x / 2)
    cdf6 = lambda x: 1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8)

    def quantile(p: float) -> float:
        low, high = 0.0, 1000.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if cdf4(middle) < p else (low, middle)
        return high

    return share / cdf6(quantile(share)), quantile(cutoff)


def _factored(df: DataFrame) -> DataFrame:
    """From covariances c{j}{i} (j <= i): the Cholesky factor l{i}{j} and the log determinant."""
    p = len(FEATURES)
    for i in range(p):
        for j in range(i + 1):
            c = F.col(f"c{j}{i}")
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-12))) if i == j else c / F.col(f"l{j}{j}"))
    return df.withColumn("logdet", sum(F.log(F.col(f"l{i}{i}")) for i in range(p)))


def _scatter(df: DataFrame) -> DataFrame:
    """From sums n, s{i}, s{j}{i}: means m{i}, floored covariances c{j}{i}, their Cholesky factor."""
    p = len(FEATURES)
    df = df.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(p)})
    for i in range(p):
        for j in range(i + 1):
            c = F.col(f"s{j}{i}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
            df = df.withColumn(f"c{j}{i}", F.greatest(c, F.lit(0.0)) + FLOORS[i] ** 2 if i == j else c)
    return _factored(df)


_MOMENTS = [f"m{i}" for i in range(len(FEATURES))] + [f"c{j}{i}" for i in range(len(FEATURES)) for j in range(i + 1)]
_ESTIMATE = [*_MOMENTS, *(f"l{i}{j}" for i in range(len(FEATURES)) for j in range(i + 1)), "logdet"]


def _distance() -> F.Column:
    """Squared Mahalanobis distance of the features under m and l, by forward substitution."""
    solved = []
    for i, f in enumerate(FEATURES):
        y = F.col(f) - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * solved[j]
        solved.append(y / F.col(f"l{i}{i}"))
    return sum(y * y for y in solved)


def _sums() -> list[F.Column]:
    p = range(len(FEATURES))
    one = [F.sum(FEATURES[i]).alias(f"s{i}") for i in p]
    return [F.count("*").alias("n"), *one, *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}{j}") for i in p for j in p if i <= j)]


def _medians(cells: DataFrame) -> DataFrame:
    """(grp, f, med) from counts n of cells (grp, f, x: the cell's middle)."""
    w = Window.partitionBy("grp", "f")
    cells = cells.withColumn("upto", F.sum("n").over(w.orderBy("x"))).withColumn("all", F.sum("n").over(w))
    return cells.where(F.col("upto") * 2 >= F.col("all")).groupBy("grp", "f").agg(F.min("x").alias("med"))


def mcd_estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """(grp, n_rows, m*, l*, logdet) per group of rows (grp, *FEATURES): the better of two concentrated starts."""
    p = range(len(FEATURES))
    groups = rows.groupBy("grp").agg(F.count("*").alias("n_rows"))
    classic = _scatter(rows.groupBy("grp").agg(*_sums())).select("grp", F.lit(0).alias("start"), *_ESTIMATE)
    long = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("x")) for i, f in enumerate(FEATURES)])).alias("v")).select("grp", "v.f", "v.x")
    middle = ((F.floor(F.col("x") * MEDIAN_CELLS) + 0.5) / MEDIAN_CELLS).alias("x")
    cells = materialize(long.groupBy("grp", "f", middle).agg(F.count("*").alias("n")), "mcd-cells")
    med = _medians(cells)
    apart = cells.join(med, ["grp", "f"]).groupBy("grp", "f", F.abs(F.col("x") - F.col("med")).alias("x")).agg(F.sum("n").alias("n"))
    wide = med.join(_medians(apart).withColumnRenamed("med", "mad"), ["grp", "f"])
    wide = wide.groupBy("grp").agg(*(F.max(F.when(F.col("f") == i, F.col(c))).alias(f"{c}{i}") for i in p for c in ("med", "mad")))
    ball = {f"m{i}": F.col(f"med{i}") for i in p}
    ball |= {f"c{j}{i}": (F.col(f"mad{i}") * 1.4826) ** 2 + FLOORS[i] ** 2 if i == j else F.lit(0.0) for i in p for j in range(i + 1)}
    wide = _factored(wide.withColumns(ball)).withColumn("start", F.lit(1)).select("grp", "start", *_ESTIMATE)
    stats = materialize(classic.unionByName(wide), "mcd-start")
    for _ in range(steps):
        near = rows.join(stats, "grp").withColumn("cell", F.floor(F.log1p(_distance()) * DISTANCE_CELLS))
        cells = near.groupBy("grp", "start", "cell").agg(*_sums()).join(groups, "grp")
        w = Window.partitionBy("grp", "start").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        half = cells.where(F.col("before") < F.col("n_rows") * share)
        names = ["n", *(f"s{i}" for i in p), *(f"s{i}{j}" for i in p for j in p if i <= j)]
        stats = _scatter(half.groupBy("grp", "start").agg(*(F.sum(c).alias(c) for c in names))).select("grp", "start", *_ESTIMATE)
        stats = materialize(stats, "mcd-step")
    best = Window.partitionBy("grp").orderBy("logdet", "start")
    return stats.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "start").join(groups, "grp")


def _blended(rows: DataFrame, own: str, upper: str, prior: float) -> DataFrame:
    """The moments of struct ``own`` (with n_rows), in which those of ``upper`` count like ``prior`` rows; without ``own``, those of ``upper``."""
    n = F.coalesce(F.col(f"{own}.n_rows"), F.lit(0))
    mean = lambda c: (n * F.coalesce(F.col(f"{own}.{c}"), F.lit(0.0)) + prior * F.col(f"{upper}.{c}")) / (n + prior)
    return rows.withColumn(own, F.struct(n.alias("n_rows"), *(mean(c).alias(c) for c in _MOMENTS)))


def judge(docs: DataFrame, share: float = SHARE, steps: int = STEPS, prior: float = PRIOR, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept) per row."""
    base = base_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text")
    base = base.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("lang", "source"))
    base = _transformed(base).withColumn("coarse", lang).withColumn("fine", F.concat_ws("\x01", lang, source))
    base = materialize(base.drop("lang", "source"), "rules-base")
    # a row counts for its group, its language and the table; each as a group of its own
    good = base.where("not base_failed").select(*FEATURES, F.explode(F.array("fine", "coarse", F.lit("*"))).alias("grp"))
    factor, bound = consistency(share, cutoff)
    found = materialize(mcd_estimates(good, share, steps), "mcd")
    of = lambda name: found.select(F.col("grp").alias(name), F.struct("n_rows", *_MOMENTS).alias(f"{name}_mcd"))
    groups = base.select("fine", "coarse").distinct().withColumn("top", F.lit("*")).join(of("top"), "top").join(of("coarse"), "coarse", "left").join(of("fine"), "fine", "left")
    groups = _blended(_blended(groups, "coarse_mcd", "top_mcd", prior), "fine_mcd", "coarse_mcd", prior).select("fine", "fine_mcd.*")
    out = base.join(materialize(_factored(groups).select("fine", *_ESTIMATE), "mcd-groups"), "fine", "left").withColumn("distance", _distance() / factor)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= bound)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` whose document has no rejected row; rows of a null doc_id are kept."""
    bad = materialize(judge(docs, **options).where("not kept").select("doc_id").distinct(), "rules-bad")
    return docs.join(small_side(bad), "doc_id", "left_anti")
