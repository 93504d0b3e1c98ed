"""Quality rules: robust multivariate outliers of document statistics; DataFrame functions only.

Method: documents that pass the base rules are described by five transformed statistics, and for every language and
source a minimum-covariance-determinant estimate is made. From three deterministic starts (medians and quartile
ranges; spatial signs; all rows) concentration steps keep the HALF share of rows nearest to the current estimate, the
last of them in part, and take their mean and covariance, until nothing changes or MAX_STEPS are done; the start that
ends with the smallest determinant wins. A document is rejected if its squared Mahalanobis distance from its group's
estimate exceeds CUT, a quantile of the chi-square distribution.

Regularization: counts are noisy, and most groups have exact zeros in most rows of some statistics, where a plain
estimate is degenerate. So a covariance is the scatter of the rows plus NOISE, the variance that counting alone gives:
one for the square roots of counts (Anscombe), and for the mean word length that of a text of the shortest length that
passes. A group's estimate is further averaged with its language's, which counts as PRIOR rows, and a language's with
the medians and quartile ranges of all rows; so a group of any size has an estimate, and small ones are near their
language's. Nothing here was set by labels.

All steps are grouped sums over bounded histograms, so a source with a third of all rows is summed in partial
aggregates; nothing is collected. Three-word windows are compared by 64-bit hashes.

Null and empty texts have no words and fail the base; very long texts are read whole. Null languages and sources are
groups of their own. Null doc_ids and repeated rows keep a row each; equal distances fall in one bin and are kept in
equal part. An empty table gives no rows. Columns other than doc_id, text, lang and source, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, table, written

WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
#: Share of rows that an estimate keeps, with the factor that makes its covariance consistent for five normal variables.
HALF, CONSISTENCY = 0.6, 1.6848
#: The chi-square quantile of 0.9999 with five degrees of freedom.
CUT = 25.745
MAX_STEPS, PRIOR = 5, 10
STATS = ("s_length", "s_word", "s_symbol", "s_lines", "s_repeat")
#: Variances from counting: word lengths vary by about half their mean, and 50 words pass.
NOISE = (0.0, 0.005, 1.0, 1.0, 1.0)
#: Bins of a statistic's unit; bins of a doubling of one plus the squared distance.
_FINE, _BIN = 256, 32


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once, even where the optimizer moves the expression."""
    return F.transform(F.array(value), then)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the array."""
    three = F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes):
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))

        def positions(p):
            hit = F.transform(p, lambda x, k: F.when(same(x, F.get(p, k - 1)) | same(x, F.get(p, k + 1)), x["i"]))
            return F.sort_array(F.filter(hit, lambda x: x.isNotNull()))

        def total(at):
            return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)

        return _let(_let(placed, positions), total)

    counted = _let(three, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(counted)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, the base statistics, base_failed) of every row."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = docs.select("doc_id", "lang", "source", text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    out = parts.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), _let(F.col("words"), _repeat_words).cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vectors(stats: DataFrame) -> DataFrame:
    n = F.greatest("n_words", F.lit(1))
    root = lambda x: 2 * F.sqrt(x + 0.375)
    values = (F.log1p("n_words"), F.log(F.greatest("word_chars", F.lit(1)) / n), root(100 * F.col("n_symbols") / n), root(F.col("n_dup_lines")), root(100 * F.col("n_repeat_words") / n))
    lang, source = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null")), F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    return stats.select("*", *(v.alias(name) for v, name in zip(values, STATS)), lang.alias("g_lang"), source.alias("g_source"))


_P = range(len(STATS))
_LOW = [(i, j) for i in _P for j in range(i + 1)]
_MEANS, _COVS = [f"m{i}" for i in _P], [f"c{i}{j}" for i, j in _LOW]
_USED = [*_MEANS, *(f"v{i}{j}" for i, j in _LOW)]


def _factored(cov: DataFrame) -> DataFrame:
    """Adds v, the inverse of the covariance's Cholesky factor, and the logarithm of its determinant."""
    out = []
    for j in _P:  # each column of the factor uses those before it
        out.append(f"sqrt(greatest(c{j}{j}{''.join(f' - l{j}{k} * l{j}{k}' for k in range(j))}, 1e-9D)) AS l{j}{j}")
        out += [f"(c{i}{j}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, len(STATS))]
    for i in _P:
        out.append(f"1 / l{i}{i} AS v{i}{i}")
        out += [f"-({' + '.join(f'l{i}{k} * v{k}{j}' for k in range(j, i))}) / l{i}{i} AS v{i}{j}" for j in range(i)]
    return cov.selectExpr("*", *out, f"{' + '.join(f'2 * ln(l{i}{i})' for i in _P)} AS det")


def _distance() -> Column:
    z = [F.col(name) - F.col(f"m{i}") for i, name in enumerate(STATS)]
    terms = [sum((F.col(f"v{i}{j}") * z[j] for j in range(1, i + 1)), F.col(f"v{i}0") * z[0]) for i in _P]
    return sum((t * t for t in terms[1:]), terms[0] * terms[0])


def _quartiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, q0.. medians, r0.. quartile ranges in deviations), in one pass over the rows."""
    flat = rows.select(*keys, F.posexplode(F.array(*(F.floor(F.col(s) * _FINE).cast("long") for s in STATS))).alias("i", "bin"))
    counts = flat.groupBy(*keys, "i", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "i")
    upto = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("bin")))
    each = upto.groupBy(*keys, "i").agg(F.max("total").alias("n"), ((at(0.5) + 0.5) / _FINE).alias("q"), ((at(0.75) - at(0.25)) / _FINE / 1.349).alias("r"))
    return each.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for c in "qr" for i in _P))


def _starts(rows: DataFrame, keys: list[str], quartiles: DataFrame) -> DataFrame:
    """(keys, start, m, c): the estimates to begin with, noise included."""
    z = [F.col(s) - F.col(f"q{i}") for i, s in enumerate(STATS)]
    size = sum((x * x for x in z[1:]), z[0] * z[0])
    sign = F.when(size > 0, 1 / size).otherwise(0.0)
    sums = rows.join(quartiles, keys).groupBy(*keys).agg(*(F.avg(z[i]).alias(f"a{i}") for i in _P), *(F.avg(z[i] * z[j]).alias(f"b{i}{j}") for i, j in _LOW), *((5 * F.avg(z[i] * z[j] * sign)).alias(f"s{i}{j}") for i, j in _LOW))
    own = quartiles.join(sums, keys)
    noise = lambda i, j: NOISE[i] if i == j else 0.0
    axis = [F.col(f"q{i}").alias(f"m{i}") for i in _P] + [((F.col(f"r{i}") * F.col(f"r{i}") + NOISE[i]) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _LOW]
    spatial = [F.col(f"q{i}").alias(f"m{i}") for i in _P] + [(F.col(f"s{i}{j}") + noise(i, j)).alias(f"c{i}{j}") for i, j in _LOW]
    every = [(F.col(f"q{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in _P] + [(F.col(f"b{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}") + noise(i, j)).alias(f"c{i}{j}") for i, j in _LOW]
    options = F.array(*(F.struct(F.lit(k).alias("start"), *x) for k, x in enumerate((axis, spatial, every))))
    return own.select(*keys, "n", F.explode(options).alias("e")).select(*keys, F.col("n").cast("double").alias("n"), "e.*")


def _step(rows: DataFrame, keys: list[str], estimate: DataFrame, prior: DataFrame, by: list[str]) -> DataFrame:
    """One concentration step of every group and start, in one pass over the rows: sums by bins of the distance."""
    binned = rows.join(estimate.select(*keys, "start", "n", F.col("det").alias("was"), *_USED), keys).withColumn("bin", F.floor(F.log2(1 + _distance()) * _BIN))
    moments = [F.sum(s).alias(f"x{i}") for i, s in enumerate(STATS)] + [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"y{i}{j}") for i, j in _LOW]
    sums = binned.groupBy(*keys, "start", "n", "was", "bin").agg(F.count("*").cast("double").alias("k"), *moments)
    before = F.sum("k").over(Window.partitionBy(*keys, "start").orderBy("bin")) - F.col("k")
    part = sums.withColumn("share", F.least(F.lit(1.0), (HALF * F.col("n") - before) / F.col("k"))).where("share > 0")
    names = [f"x{i}" for i in _P] + [f"y{i}{j}" for i, j in _LOW]
    near = part.groupBy(*keys, "start", "n", "was").agg(F.sum(F.col("share") * F.col("k")).alias("h"), *(F.sum(F.col("share") * F.col(c)).alias(c) for c in names))
    mean = [(F.col(f"x{i}") / F.col("h")).alias(f"o{i}") for i in _P]
    near = near.select(*keys, "start", "n", "was", *mean, *((F.col(f"y{i}{j}") / F.col("h")).alias(f"y{i}{j}") for i, j in _LOW))
    own = [(CONSISTENCY * (F.col(f"y{i}{j}") - F.col(f"o{i}") * F.col(f"o{j}")) + (NOISE[i] if i == j else 0.0)).alias(f"d{i}{j}") for i, j in _LOW]
    near = near.select(*keys, "start", "n", "was", *(f"o{i}" for i in _P), *own)
    both = near.join(prior, by) if by else near.crossJoin(prior)  # of one row
    weigh = lambda a, b: (F.col("n") * F.col(a) + PRIOR * F.col(b)) / (F.col("n") + PRIOR)
    return both.select(*keys, "start", "n", "was", *(weigh(f"o{i}", f"pm{i}").alias(f"m{i}") for i in _P), *(weigh(f"d{i}{j}", f"pc{i}{j}").alias(f"c{i}{j}") for i, j in _LOW))


def _as_prior(estimate: DataFrame, by: list[str]) -> DataFrame:
    return estimate.select(*by, *(F.col(c).alias(f"p{c}") for c in (*_MEANS, *_COVS)))


def _estimate(rows: DataFrame, keys: list[str], prior: DataFrame, by: list[str]) -> DataFrame:
    """(keys, n, m, c, v, det), written: every group's estimate, averaged with `prior`, of one row for each value of `by`."""
    quartiles = written(_quartiles(rows, keys), "quartiles")
    now = written(_factored(_starts(rows, keys, quartiles)), "estimate")
    drop_written(quartiles)
    for _ in range(MAX_STEPS):
        after = written(_factored(_step(rows, keys, now, prior, by)), "estimate")
        moved = after.agg(F.max(F.abs(F.col("det") - F.col("was")))).first()[0]
        drop_written(now)
        now = after
        if (moved or 0) < 1e-9:
            break
    best = now.groupBy(*keys).agg(F.min(F.struct(F.round("det", 9).alias("det"), "start", "n", *_USED, *_COVS)).alias("e")).select(*keys, "e.*")
    best = written(best, "best")
    drop_written(now)
    return best


def judge(stats: DataFrame) -> DataFrame:
    """Adds distance (null where the base fails) and kept to a table of statistics."""
    counted = written(stats, "statistics")  # else each use of a statistic would compute it again
    rows = written(_vectors(counted), "vectors")
    drop_written(counted)
    passing = rows.where(~F.col("base_failed"))
    all_rows = _quartiles(passing, []).select(*(F.col(f"q{i}").alias(f"pm{i}") for i in _P), *(((F.col(f"r{i}") * F.col(f"r{i}") + NOISE[i]) if i == j else F.lit(0.0)).alias(f"pc{i}{j}") for i, j in _LOW))
    langs = _estimate(passing, ["g_lang"], F.broadcast(written(all_rows, "all")), [])  # of one row
    groups = _estimate(passing, ["g_lang", "g_source"], _as_prior(langs, ["g_lang"]), ["g_lang"])
    drop_written(langs)
    out = rows.join(groups.select("g_lang", "g_source", *_USED), ["g_lang", "g_source"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT))


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge(statistics(table(spark, sf_dir, "documents"))).select(*names)
