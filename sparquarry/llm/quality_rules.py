"""Quality rules: hard limits first, then robust multivariate outliers by language and source.

The statistics of the documents that pass the limits are transformed and, for every
language and source, their minimum-covariance-determinant centre and scatter are found
by concentration steps: the closest half of the rows gives the next estimate. Estimates of
few rows are drawn towards those of their language. Rows too far away by Mahalanobis
distance are rejected. All of it is DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, let, pick, sized, stored, words

#: The statistics, and the least standard deviation that each is given: many documents have none of a thing.
STATISTICS = {"length": 0.25, "word_size": 0.25, "symbols": 0.25, "dup_lines": 0.25, "repeats": 0.1}
D = len(STATISTICS)
#: Values of a statistic or distance fall into bins of this width for quantiles.
BIN = 1 / 64


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution for an odd number of degrees of freedom."""
    p = math.erf(math.sqrt(x / 2))
    for j in range(1, k, 2):
        p -= (x / 2) ** (j / 2) * math.exp(-x / 2) / math.gamma(j / 2 + 1)
    return p


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def repeated_words(w: Column) -> Column:
    """How many words of an array are in a 3-word window that it holds twice or more."""
    none = F.lit(0).cast("long")

    def covered(h: Column) -> Column:
        def count(s: Column) -> Column:
            def twice(i: Column) -> Column:
                own = F.get(s, i)["h"]
                return F.coalesce(own == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(own == F.get(s, i + 1)["h"], F.lit(False))

            at = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), twice), lambda i: F.get(s, i)["i"]))
            start = F.struct(none.alias("n"), F.lit(-1).alias("end"))
            return F.aggregate(at, start, lambda a, i: F.struct((a["n"] + 3 - F.greatest(F.lit(0), a["end"] - i)).alias("n"), (i + 3).alias("end")), lambda a: a["n"])

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(ordered, count))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, none).otherwise(let(windows, covered))


def base_statistics(text: Column) -> Column:
    """A struct of the counts of a text; all 0 for null and blank ones."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return F.struct(own.alias("w"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), dup.alias("n_dup_lines"))


def _statistics() -> dict[str, Column]:
    n = F.greatest(F.col("n_words").cast("double"), F.lit(1.0))
    return {
        "length": F.log(n),
        "word_size": F.log2(F.col("word_chars") / n) * 2,
        "symbols": F.log1p(100 * F.col("n_symbols") / n),
        "dup_lines": F.log1p(F.col("n_dup_lines").cast("double")),
        "repeats": F.asin(F.sqrt(F.col("n_repeat_words") / n)),
    }


def _quantiles(binned: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """By keys, the upper ends of the bins in which the shares of the rows lie. binned: keys, bin, c."""
    w = W.partitionBy(*keys).orderBy("bin")
    run = binned.withColumn("upto", F.sum("c").over(w)).withColumn("all", F.sum("c").over(W.partitionBy(*keys)))
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= share * F.col("all"), (F.col("bin") + 1) * BIN)).alias(name) for name, share in shares.items()])


def _names(letter: str) -> list[str]:
    """Columns of a lower triangle: letter_i_j with i >= j."""
    return [f"{letter}_{i}_{j}" for i in range(D) for j in range(i + 1)]


MEANS = [f"m_{i}" for i in range(D)]


def _with_inverse(params: DataFrame, keys: tuple[str, ...] = ("g",)) -> DataFrame:
    """From means m_i and scatter s_i_j (i >= j), the inverse v_i_j of its Cholesky factor, beside the keys."""
    for j in range(D):
        rest = {i: " - ".join([f"s_{i}_{j}", *(f"l_{i}_{k} * l_{j}_{k}" for k in range(j))]) for i in range(j, D)}
        params = params.selectExpr("*", f"sqrt(greatest({rest[j]}, 1e-12D)) AS l_{j}_{j}")
        params = params.selectExpr("*", f"1 / l_{j}_{j} AS v_{j}_{j}", *[f"({rest[i]}) / l_{j}_{j} AS l_{i}_{j}" for i in range(j + 1, D)])
    for below in range(1, D):
        params = params.selectExpr("*", *[f"-({' + '.join(f'l_{j + below}_{k} * v_{k}_{j}' for k in range(j, j + below))}) / l_{j + below}_{j + below} AS v_{j + below}_{j}" for j in range(D - below)])
    return params.select(*keys, *MEANS, *_names("v"))


#: Squared Mahalanobis distance of x_i under m_i and v_i_j.
DISTANCE = " + ".join("pow(" + " + ".join(f"v_{i}_{j} * (x_{j} - m_{j})" for j in range(i + 1)) + ", 2D)" for i in range(D))
#: The logarithm of the scatter's determinant, from v_i_j.
LOG_DET = "-2 * (" + " + ".join(f"ln(v_{i}_{i})" for i in range(D)) + ")"


def _starts(binned: DataFrame, part: float) -> DataFrame:
    """By group g and start k, centre and inverse factor: each statistic on its own, in three ways.

    Start 0 has the middle and width of the shortest interval that holds part of the rows, 1 the
    median and quartiles, and 2 the median and that width.
    """
    floors, steps = list(STATISTICS.values()), 40
    at = [j / steps for j in range(steps + 1)]
    ends = _quantiles(binned, ["g", "i"], {f"q{j}": a for j, a in enumerate(at)})
    half = round(part * steps)
    spans = F.array(*[F.struct((F.col(f"q{j + half}") - F.col(f"q{j}")).alias("width"), F.col(f"q{j + half // 2}").alias("middle")) for j in range(steps + 1 - half)])
    # Normal data have part of their rows within so many standard deviations.
    wide = 2 * math.sqrt(chi2_quantile(part, 1))
    short = ends.select("g", "i", F.array_min(spans).alias("s"), F.col(f"q{steps // 2}").alias("median"), ((F.col(f"q{steps * 3 // 4}") - F.col(f"q{steps // 4}")) / 1.349).alias("quartiles"))
    ways = [("s.middle", F.col("s.width") / wide), ("median", F.col("quartiles")), ("median", F.col("s.width") / wide)]
    each = short.select("g", "i", F.posexplode(F.array(*[F.struct(F.col(m).alias("m"), d.alias("d")) for m, d in ways])).alias("k", "e"))
    first = each.groupBy("g", "k").agg(*[F.max(F.when(F.col("i") == i, F.col("e.m"))).alias(f"m_{i}") for i in range(D)], *[F.max(F.when(F.col("i") == i, F.pow(F.col("e.d"), F.lit(2.0)) + floors[i] ** 2)).alias(f"s_{i}_{i}") for i in range(D)])
    for i in range(D):
        for j in range(i):
            first = first.withColumn(f"s_{i}_{j}", F.lit(0.0))
    return _with_inverse(first, ("g", "k"))


def _closest(rows: DataFrame, now: DataFrame, part: float, beyond: float, scale: float) -> DataFrame:
    """The next means m_i and scatter s_i_j by g and k, from the rows within beyond times the squared distance that holds part of them.

    Counts and moments are summed by bin of the distance, so that one pass finds limit and moments.
    """
    floors = list(STATISTICS.values())
    pairs = [(i, j) for i in range(D) for j in range(i + 1)]
    # Moments by the last centre, against cancellation.
    away = [f"x_{i} - m_{i} AS y_{i}" for i in range(D)]
    far = rows.join(now, "g").selectExpr("g", "k", f"{DISTANCE} AS d", f"{LOG_DET} AS log_det", *MEANS, *away)
    bins = far.groupBy("g", "k", F.expr(f"floor(ln(d + 1e-9D) / {BIN}D)").alias("bin")).agg(
        F.expr("count(*) AS c"),
        F.expr("first(log_det) AS before"),
        *[F.expr(f"first(m_{i}) AS o_{i}") for i in range(D)],
        *[F.expr(f"sum(y_{i}) AS a_{i}") for i in range(D)],
        *[F.expr(f"sum(y_{i} * y_{j}) AS p_{i}_{j}") for i, j in pairs],
    )
    upto = bins.selectExpr("*", "sum(c) OVER (PARTITION BY g, k ORDER BY bin) AS upto", "sum(c) OVER (PARTITION BY g, k) AS all")
    near = upto.selectExpr("*", f"min(CASE WHEN upto >= {part}D * all THEN bin END) OVER (PARTITION BY g, k) AS most").where(f"bin <= most + {math.floor(math.log(beyond) / BIN)}")
    sums = near.groupBy("g", "k").agg(F.expr("first(before) AS before"), *[F.expr(f"first(o_{i}) AS o_{i}") for i in range(D)], *[F.expr(f"sum(a_{i}) / sum(c) AS a_{i}") for i in range(D)], *[F.expr(f"sum(p_{i}_{j}) / sum(c) AS p_{i}_{j}") for i, j in pairs])
    return sums.selectExpr(
        "g",
        "k",
        "before",
        *[f"o_{i} + a_{i} AS m_{i}" for i in range(D)],
        *[f"{scale}D * (p_{i}_{j} - a_{i} * a_{j}) + {floors[i] ** 2 if i == j else 0.0}D AS s_{i}_{j}" for i, j in pairs],
    )


def robust_estimates(rows: DataFrame, groups: DataFrame, part: float = 0.5, most_steps: int = 30) -> DataFrame:
    """By group g, centre m_i and scatter s_i_j of x_0..x_4: a table of one row a group.

    From three starts, every step takes the rows within the distance that holds part of the
    group, and their mean and covariance, scaled to be right for normal data. After two steps
    the start with the smallest determinant goes on, until no determinant's logarithm falls by
    a bin any more. The rows that normal data would have within the quantile of 0.975, as
    measured by the distance that holds part, then give the final estimate. Bins give the
    quantiles, so that they don't depend on how rows are dealt out; nothing is gathered by
    group but sums and bins. groups is a table with one row for each g; estimates are
    broadcast while it is small.
    """
    inner, outer = chi2_quantile(part, D), chi2_quantile(0.975, D)
    # There are three estimates a group at most.
    few = sized(groups, 10_000) is not groups
    by_k, together = ("g", "k", "before"), 3

    def near(now: DataFrame, beyond: float, scale: float) -> DataFrame:
        return _closest(rows, F.broadcast(now) if few else now, part, beyond, scale)

    def steps(now: DataFrame, n: int) -> DataFrame:
        for _ in range(n):
            now = _with_inverse(near(now, 1.0, part / chi2_cdf(inner, D + 2)), by_k)
        return now

    # Bins of all statistics in one pass.
    long = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(f"x_{i}") / BIN).alias("bin")) for i in range(D)])).alias("e"))
    starts = stored(_starts(long.groupBy("g", "e.i", "e.bin").agg(F.count("*").alias("c")), part), "starts")
    first = stored(steps(starts, 2), "estimates")
    best = first.withColumn("place", F.row_number().over(W.partitionBy("g").orderBy(F.expr(LOG_DET), "k"))).where("place = 1").drop("place")
    now, used = stored(best, "estimates"), [starts, first]
    for _ in range(2, most_steps, together):
        used.append(now)
        now = stored(steps(now, together), "estimates")
        moved = now.agg(F.expr(f"max(before - ({LOG_DET}))")).first()[0]
        if moved is None or moved < BIN:
            break
    out = stored(near(now, outer / inner, 0.975 / chi2_cdf(outer, D + 2)).drop("k", "before"), "estimates")
    discard(*used, now)
    return out


def _moments(by: DataFrame, keys: list[str]) -> DataFrame:
    """By keys, the centre and scatter of groups (n, m_i, s_i_j) put together, and their n."""
    pairs = [(i, j) for i in range(D) for j in range(i + 1)]
    sums = by.groupBy(*keys).agg(F.expr("sum(n) AS n"), *[F.expr(f"sum(n * m_{i}) / sum(n) AS m_{i}") for i in range(D)], *[F.expr(f"sum(n * (s_{i}_{j} + m_{i} * m_{j})) / sum(n) AS q_{i}_{j}") for i, j in pairs])
    return sums.selectExpr(*keys, "n", *MEANS, *[f"q_{i}_{j} - m_{i} * m_{j} AS s_{i}_{j}" for i, j in pairs])


def _drawn(own: DataFrame, to: DataFrame, keys: list[str], prior: float) -> DataFrame:
    """own's centres and scatters, drawn by prior / (n + prior) towards those of its language in to, or of to's only row."""
    names, by_lang = [*MEANS, *_names("s")], "lang" in to.columns
    t = to.selectExpr(*(["lang AS l_"] if by_lang else []), *[f"{c} AS to_{c}" for c in names])
    both = own.join(t, F.col("lang").eqNullSafe(F.col("l_"))) if by_lang else own.join(F.broadcast(t))
    return both.selectExpr(*keys, "n", *[f"({c} * n + to_{c} * {prior}D) / (n + {prior}D) AS {c}" for c in names])


def quality_rules(docs: DataFrame, loss: float = 0.01, prior: float = 50.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: id, the counts, base_failed, distance and kept.

    base_failed: under 50 words, or over half of them in repeated 3-word windows. The
    others are judged by their language's and source's estimates, in which copies of a text
    count once. The estimate of n texts is drawn towards that of the whole language, and this
    one towards that of all languages, by prior / (n + prior), so that a few texts are judged
    mostly as others of their language are, and many as their own group. A row is kept unless
    its squared distance is beyond the chi-squared quantile of 1 - loss / (n + prior), the sum
    rounded up to a power of 2, so that a group of normal data loses no row in all but a share
    loss of cases. Null is a language or source of its own. Null and blank texts have counts
    of 0 and fail. Repeated rows count as often as they occur; a null id changes nothing.
    Other columns aren't read. An empty table gives an empty result.
    """
    read = pick(docs, [id_col, text_col, lang_col, source_col]).toDF("id", "text", "lang", "source")
    counted = read.select("id", "lang", "source", F.xxhash64("text").alias("copy"), base_statistics(F.col("text")).alias("b"))
    counted = counted.select("id", F.to_json(F.struct("lang", "source")).alias("g"), "lang", "copy", F.col("b.w.n_words"), F.col("b.w.word_chars"), F.col("b.n_symbols"), F.col("b.n_dup_lines"), F.col("b.w.n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = stored(counted.withColumn("base_failed", failed), "counts")

    x = [c.alias(f"x_{i}") for i, c in enumerate(_statistics().values())]
    passed = stored(counted.where("not base_failed").drop("id").distinct().select("g", "lang", *x), "statistics")
    groups = stored(passed.groupBy("g").agg(F.count("*").alias("n"), F.first("lang").alias("lang")), "groups")
    own = stored(robust_estimates(passed, groups).join(groups, "g"), "own")
    by_lang = stored(_moments(own, ["lang"]), "by_lang")
    drawn = _drawn(own, _drawn(by_lang, _moments(by_lang, []), ["lang"], prior), ["g"], prior)
    limits = F.array(*[F.lit(chi2_quantile(1 - loss / 2**j, D)) for j in range(41)])
    limit = F.element_at(limits, F.least(F.lit(41), F.ceil(F.log2(F.col("n") + prior)).cast("int") + 1))
    known = stored(_with_inverse(drawn.withColumn("limit", limit), ("g", "limit")), "known")
    judged = counted.join(sized(known), "g", "left")
    judged = judged.select("*", *x).withColumn("distance", F.when(~F.col("base_failed"), F.expr(DISTANCE)))
    kept = ~F.col("base_failed") & (F.col("distance") <= F.col("limit"))
    discard(passed, groups, own, by_lang)
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
