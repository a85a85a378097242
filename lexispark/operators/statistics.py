"""Statistics of repeated runs: summaries, Student intervals, paired contrasts, exact sign flips, Holm, correlations."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@lru_cache(maxsize=4096)
def t_critical(df: int, level: float = 0.95) -> float:
    """The two-sided critical value, by bisection."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 1 - level else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def critical_value(df: pd.Series) -> pd.Series:
    """Two-sided critical values for the degrees of freedom that occur; null below 1."""
    return df.map(lambda d: t_critical(int(d)) if d >= 1 else None).astype(float)


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sd (null for one run), low and high of the 95 % interval, min, max by condition."""
    s = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    half = critical_value(F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    return s.select(*by, "n", "mean", "sd", half.alias("half"), "min", "max").select(*by, "n", "mean", "sd", (F.col("mean") - F.col("half")).alias("low"), (F.col("mean") + F.col("half")).alias("high"), "min", "max")


def paired(rows: DataFrame, by: list[str], key: str, condition: str, baseline: str, value: str) -> DataFrame:
    """Differences from a baseline condition, run by run: by, condition, key, difference."""
    base = rows.where(F.col(condition) == baseline).select(*by, key, F.col(value).alias("__b"))
    return rows.where(F.col(condition) != baseline).join(base, [*by, key]).select(*by, condition, key, (F.col(value) - F.col("__b")).alias("difference"))


def paired_summary(rows: DataFrame, by: list[str], key: str, condition: str, baseline: str, value: str) -> DataFrame:
    """Each condition against the baseline: by, condition, n, left_mean, right_mean, mean, sd, low, high, standardised (mean / sd), p (sign flips).

    Fewer than two pairs are an error.
    """
    base = rows.where(F.col(condition) == baseline).select(*by, key, F.col(value).alias("__b"))
    both = rows.where(F.col(condition) != baseline).join(base, [*by, key])
    d = both.select(*by, condition, key, (F.col(value) - F.col("__b")).alias("difference"))
    group = [*by, condition]
    means = both.groupBy(*group).agg(F.avg(value).alias("left_mean"), F.avg("__b").alias("right_mean"))
    s = summary(d, group, "difference").withColumn("n", F.when(F.col("n") < 2, F.raise_error(F.lit("fewer than two pairs")).cast("long")).otherwise(F.col("n")))
    p = sign_flip(d, group, key, "difference").select(*group, "p")
    return means.join(s, group).join(p, group).select(*group, "n", "left_mean", "right_mean", "mean", "sd", "low", "high", F.when(F.col("sd") != 0, F.col("mean") / F.col("sd")).alias("standardised"), "p")


def by_checkpoint(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with arrays ``checkpoints`` and ``scores`` (structs) as one row a checkpoint: keys, checkpoint and the scores. Unequal lengths are an error."""
    same = F.when(F.size("checkpoints") == F.size("scores"), F.arrays_zip("checkpoints", "scores")).otherwise(F.array(F.raise_error(F.lit("checkpoints and scores differ in number")).cast(runs.select(F.arrays_zip("checkpoints", "scores").alias("z")).schema["z"].dataType.elementType)))
    return runs.select(*keys, F.explode(same).alias("z")).select(*keys, F.col("z.checkpoints").alias("checkpoint"), "z.scores.*")


def family_summaries(rows: DataFrame, by: list[str], seed: str, metrics: list[str], expected: list[int]) -> DataFrame:
    """by, seeds (sorted), and for each metric its mean and SD. A group whose seeds are not the expected ones is an error."""
    s = rows.groupBy(*by).agg(F.sort_array(F.collect_list(seed)).alias("seeds"), *[f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"))])  # a study's seeds
    want = F.array(*[F.lit(x).cast("long") for x in sorted(expected)])
    whole = F.when(F.col("seeds").cast("array<long>") == want, F.col("seeds")).otherwise(F.array(F.raise_error(F.lit("a summary has other seeds")).cast("long")))
    return s.withColumn("seeds", whole)


def array_tolerance(observed: DataFrame, expected: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Arrays ``observed`` and ``expected`` place by place: keys, place, observed, expected, within; a missing side is not within."""
    flat = lambda d, c: d.select(*keys, F.posexplode(c).alias("place", c))
    both = flat(observed, "observed").join(flat(expected, "expected"), [*keys, "place"], "full_outer")
    return both.select(*keys, "place", "observed", "expected", F.coalesce(F.abs(F.col("observed") - F.col("expected")) <= tolerance, F.lit(False)).alias("within"))


def sign_flip(diffs: DataFrame, by: list[str], key: str, value: str, most: int = 24) -> DataFrame:
    """Exact sign-flip p: the share of all 2^n sign vectors whose mean is at least as far from 0. by, n, mean, p, resolution.

    The runs of a group (``most`` at most, more are an error) are cut in two; each half has 2^(n / 2) signed sums. In one order of the sums of the second half and of
    what each sum of the first half needs to reach the observed mean, a running count says how many pairs do: 2^(n / 2 + 1) rows a group, not 2^n.
    The other tail has as many. Sums within the rounding of n additions count as equal.
    """
    numbered = diffs.select(*by, F.col(value).alias("d"), (F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1).alias("k"))  # a study's runs
    group = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("k", "d"))), lambda s: s["d"]).alias("d"))
    group = group.withColumn("n", F.when(F.col("n") > most, F.raise_error(F.lit("too many runs for an exact test")).cast("long")).otherwise(F.col("n")))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    cut = F.floor(F.col("n") / 2).cast("int")
    group = group.select(*by, "n", add(F.col("d")).alias("s"), add(F.transform("d", lambda x: F.abs(x))).alias("all"), F.slice("d", 1, cut).alias("one"), F.slice("d", cut + 1, F.col("n").cast("int")).alias("two"))
    group = group.withColumn("need", F.abs("s") - F.col("n") * 1e-15 - F.col("all") * 4e-15)

    def sums(half: str) -> DataFrame:
        wide = group.withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"shiftleft(1L, size({half})) - 1"))))
        return wide.withColumn("t", F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), F.lit(0.0), lambda acc, k: acc + F.coalesce(F.get(half, k), F.lit(0.0)) * F.when(F.getbit(F.col("m"), k) == 1, 1).otherwise(-1)))

    have = sums("two").select(*by, "n", "s", "need", F.col("t").alias("at"), F.lit(1).cast("long").alias("has"))
    want = sums("one").select(*by, "n", "s", "need", (F.col("need") - F.col("t")).alias("at"), F.lit(0).cast("long").alias("has"))
    so_far = F.sum("has").over(Window.partitionBy(*by).orderBy(F.desc("at"), F.desc("has")).rowsBetween(Window.unboundedPreceding, 0))
    met = have.unionByName(want).withColumn("reach", so_far).where("has = 0").groupBy(*by).agg(F.max("n").alias("n"), F.max("s").alias("s"), F.max("need").alias("need"), F.sum("reach").alias("hits"))
    p = F.when(F.col("need") <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.col("hits") / F.pow(F.lit(2.0), F.col("n"))))
    return met.select(*by, "n", (F.col("s") / F.col("n")).alias("mean"), p.alias("p"), resolution(F.col("n")).alias("resolution"))


def holm(rows: DataFrame, family: list[str], p: str, order: list[str]) -> DataFrame:
    """Adds ``adjusted``: Holm's step-down values within a family."""
    by = Window.partitionBy(*family)
    ranked = rows.withColumn("__r", F.row_number().over(by.orderBy(p, *order))).withColumn("__m", F.count(F.lit(1)).over(by))
    step = F.least(F.lit(1.0), F.col(p) * (F.col("__m") - F.col("__r") + 1))
    return ranked.withColumn("adjusted", F.max(step).over(by.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0))).drop("__r", "__m")


def _octave(value: Column) -> Column:
    """Bucket of a number, which never falls as the number rises: 64 to each doubling of its size."""
    v = value.cast("double")
    far = F.lit(1 << 20) + F.floor(F.log2(F.abs(v)) * 64)
    return F.when(v > 0, far).when(v < 0, -far).otherwise(F.lit(0)).cast("long")


def with_average_rank(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds each value's rank in its group from 1, equal values sharing their mean; distinct values are ranked, bucket by bucket."""
    each = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__k")).withColumn("__o", _octave(F.col("__v")))
    sizes = each.groupBy(*by, "__o").agg(F.sum("__k").alias("__n"))
    starts = sizes.select(*[F.col(c).alias(f"__w{i}") for i, c in enumerate(by)], F.col("__o").alias("__q"), (F.sum("__n").over(Window.partitionBy(*by).orderBy("__o")) - F.col("__n")).alias("__s"))
    same = F.col("__o") == F.col("__q")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__w{i}"))
    inside = F.sum("__k").over(Window.partitionBy(*by, "__o").orderBy("__v")) - F.col("__k")
    ranked = each.withColumn("__i", inside).join(starts, same).select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], "__v", (F.col("__s") + F.col("__i") + (F.col("__k") + 1) / 2).alias(name))
    on = F.col(value) == F.col("__v")
    for i, c in enumerate(by):
        on &= F.col(c).eqNullSafe(F.col(f"__b{i}"))
    return rows.join(ranked, on, "left").select(*rows.columns, name)


def correlations(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """n, pearson and spearman (Pearson of average ranks) by group, each with its two-sided p. Without variation all are null."""
    r = with_average_rank(with_average_rank(rows, by, x, "__x"), by, y, "__y")
    c = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson"), F.corr("__x", "__y").alias("spearman"))
    return c.select(*by, "n", "pearson", correlation_p(F.col("pearson"), F.col("n")).alias("pearson_p"), "spearman", correlation_p(F.col("spearman"), F.col("n")).alias("spearman_p"))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs by Student's t of n - 2 degrees of freedom: its finite series, in column expressions.

    With cos a = sqrt(1 - r^2): 1 - |r| (1 + 1/2 cos^2 a + 1 3 / (2 4) cos^4 a ...) for even degrees, and 1 - 2/pi (a + |r| (cos a + 2/3 cos^3 a ...)) for
    odd ones; the series have as many terms as there are pairs of degrees.
    """
    df, own = n - 2, F.least(F.abs(r), F.lit(1.0))
    cos2 = 1 - own * own
    even = df % 2 == 0
    count = F.when(even, F.floor(df / 2)).otherwise(F.floor((df - 1) / 2)).cast("int")
    # term and sum so far; k from 1: (2k - 1) / 2k for even, 2k / (2k + 1) for odd degrees
    ratio = lambda k: F.when(even, (2 * k - 1) / (2 * k)).otherwise((2 * k) / (2 * k + 1))
    first = F.when(even, F.lit(1.0)).otherwise(F.sqrt(cos2))
    start = F.struct(first.alias("t"), first.alias("s"))
    step = lambda acc, k: F.struct((acc["t"] * ratio(k) * cos2).alias("t"), (acc["s"] + acc["t"] * ratio(k) * cos2).alias("s"))
    steps = F.when(count > 1, F.sequence(F.lit(1), count - 1)).otherwise(F.array().cast("array<int>"))
    total = F.when(count > 0, F.aggregate(steps, start, step, lambda acc: acc["s"])).otherwise(F.lit(0.0))
    inside = F.when(even, own * total).otherwise(2 / math.pi * (F.asin(own) + own * total))
    return F.when(df >= 1, F.greatest(F.lit(0.0), 1 - inside))


def endpoint_contrasts(rows: DataFrame, by: list[str], key: str, level: str, value: str) -> DataFrame:
    """The strongest level against the lowest one, run by run: by, n, mean, sd of the differences."""
    ends = rows.groupBy(*by).agg(F.min(level).alias("__lo"), F.max(level).alias("__hi"))
    r = rows.join(ends, by)
    lo = r.where(F.col(level) == F.col("__lo")).select(*by, key, F.col(value).alias("__a"))
    hi = r.where(F.col(level) == F.col("__hi")).select(*by, key, F.col(value).alias("__b"))
    d = F.col("__b") - F.col("__a")
    return lo.join(hi, [*by, key]).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))


def within_tolerance(observed: DataFrame, expected: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Keys with both values and whether they agree; a missing side does not."""
    both = observed.withColumnRenamed(value, "observed").join(expected.withColumnRenamed(value, "expected"), keys, "full_outer")
    return both.select(*keys, "observed", "expected", F.coalesce(F.abs(F.col("observed") - F.col("expected")) <= tolerance, F.lit(False)).alias("within"))


def resolution(n: Column) -> Column:
    """The smallest two-sided p that n sign flips can give."""
    return F.lit(2.0) / F.pow(F.lit(2.0), n)


def adjacent_contrasts(rows: DataFrame, by: list[str], key: str, level: str, value: str) -> DataFrame:
    """Each level against the one before it, run by run: by, level, n, mean, sd of the differences."""
    d = F.col(value) - F.lag(value).over(Window.partitionBy(*by, key).orderBy(level))
    return rows.withColumn("__d", d).where("__d is not null").groupBy(*by, level).agg(F.count(F.lit(1)).alias("n"), F.avg("__d").alias("mean"), F.stddev_samp("__d").alias("sd"))


def shared_keys(left: DataFrame, right: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """How many run keys two studies share, and how many only one has: by, both, left_only, right_only."""
    both = left.select(*keys).distinct().withColumn("__l", F.lit(1)).join(right.select(*keys).distinct().withColumn("__r", F.lit(1)), keys, "full_outer")
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    l, r = F.col("__l").isNotNull(), F.col("__r").isNotNull()
    return both.groupBy(*by).agg(n(l & r, "both"), n(l & ~r, "left_only"), n(r & ~l, "right_only"))
