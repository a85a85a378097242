"""Likelihood-based keyword recovery: costs, the iterative assignment, metrics, and the fan-out over runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.operators.matching import assignment
from lexispark.operators.numbering import hash_prefix, numbered
from lexispark.session import settled


def initial_cost(count: Column, n: Column, p: Column) -> Column:
    """-c ln p - (N - c) ln(1 - p): the cost of one token for one keyword by frequency alone."""
    return -count * F.ln(p) - (n - count) * F.ln(1 - p)


def _log_terms(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of p and 1 - p. In each column a zero counts as a hundredth of the column's smallest positive value, or 1e-10 if it has none."""
    if (p >= 1).any():
        raise ValueError("a probability of 1 has no finite cost")
    least = np.where(p > 0, p, np.inf).min(axis=0, initial=np.inf)
    p = np.where(p > 0, p, np.where(np.isfinite(least), least / 100, 1e-10))
    return np.log(p), np.log1p(-p)


def cost_matrix(aux: np.ndarray, seen: np.ndarray, n: int, free_kw: np.ndarray, free_tok: np.ndarray, fixed_kw: np.ndarray, fixed_tok: np.ndarray) -> np.ndarray:
    """Cost of each free token (rows) for each free keyword (columns): own term and one for each fixed pair, as two products.

    Zero probabilities are replaced among the free keywords, for their own frequencies and for each fixed keyword apart.
    """
    la, lb = _log_terms(aux[free_kw, free_kw][:, None])
    own = np.diag(seen)[free_tok]
    cost = -np.outer(own, la) - np.outer(n - own, lb)
    if len(fixed_kw):
        la, lb = _log_terms(aux[np.ix_(free_kw, fixed_kw)])
        c = seen[np.ix_(free_tok, fixed_tok)].astype(float)
        cost -= c @ la.T + (n - c) @ lb.T
    return cost


def pair_costs(pairs: DataFrame, fixed: DataFrame, by: list[str]) -> DataFrame:
    """``cost_matrix`` as a plan: by, token, keyword, cost for all that is not fixed.

    ``pairs``: by, i, j, aux, client, n_aux, n_client, both (i, j) and (j, i), the diagonal with all keywords; pairs that never meet may lack.
    ``fixed``: by, keyword, token. K x K x fixed rows at most.
    """
    diag = pairs.where("i = j").select(*by, F.col("i").alias("kw"), "aux", "client", "n_aux", "n_client")
    loose = lambda end, name: diag.join(fixed.select(*by, F.col(end).alias("kw")), [*by, "kw"], "left_anti").withColumnRenamed("kw", name)
    # one term for the own frequency (of = null), one for each fixed keyword; zeros are replaced within a term
    own_p = loose("keyword", "keyword").select(*by, "keyword", F.lit(None).cast("long").alias("of"), (F.col("aux") / F.col("n_aux")).alias("p"))
    own_c = loose("token", "token").select(*by, "token", F.lit(None).cast("long").alias("of"), F.col("client").alias("c"), "n_client")
    ends = fixed.select(*by, F.col("keyword").alias("of"), F.col("token").alias("at"))
    met = pairs.select(*by, F.col("i").alias("x"), F.col("j").alias("y"), (F.col("aux") / F.col("n_aux")).alias("p"), "client")
    fix_p = loose("keyword", "keyword").select(*by, "keyword").join(ends, by).join(met.select(*by, F.col("x").alias("keyword"), F.col("y").alias("of"), "p"), [*by, "keyword", "of"], "left").select(*by, "keyword", "of", F.coalesce("p", F.lit(0.0)).alias("p"))
    fix_c = loose("token", "token").select(*by, "token", "n_client").join(ends, by).join(met.select(*by, F.col("x").alias("token"), F.col("y").alias("at"), "client"), [*by, "token", "at"], "left").select(*by, "token", "of", F.coalesce("client", F.lit(0)).alias("c"), "n_client")
    p = own_p.unionByName(fix_p)
    least = p.groupBy(*by, "of").agg(F.min(F.when(F.col("p") > 0, F.col("p"))).alias("least"))
    same = lambda a, b: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in [*by, "of"]))
    p = p.alias("p").join(least.alias("l"), same("p", "l")).select(*[f"p.{c}" for c in [*by, "of", "keyword"]], F.when(F.col("p") > 0, F.col("p")).otherwise(F.coalesce(F.col("least") / 100, F.lit(1e-10))).alias("p"))
    p = p.withColumn("p", F.when(F.col("p") >= 1, F.raise_error(F.lit("a probability of 1 has no finite cost")).cast("double")).otherwise(F.col("p")))
    c = own_c.unionByName(fix_c)
    both = p.alias("p").join(c.alias("c"), same("p", "c")).select(*[F.col(f"p.{x}").alias(x) for x in by], "token", "keyword", initial_cost(F.col("c"), F.col("n_client"), F.col("p")).alias("cost"))
    return both.groupBy(*by, "token", "keyword").agg(F.sum("cost").alias("cost"))


def recover(aux: np.ndarray, seen: np.ndarray, n: int, steps: int, free: float, seed: int, checkpoints: list[int]) -> dict[int, np.ndarray]:
    """Keyword of each token at the checkpoints: all are assigned by frequency, then a share is freed and assigned anew in every step.

    The keywords' prices go from step to step: where as many keywords as tokens are free, most tokens find theirs again without a search.
    """
    rng = np.random.RandomState(seed)
    k, t = len(aux), len(seen)
    size = int(free * t)
    if size <= 1:
        raise ValueError("too few free tokens")
    every = np.arange(t)
    none = np.zeros(0, int)
    guess = assignment(cost_matrix(aux, seen, n, np.arange(k), every, none, none))
    out = {0: guess.copy()} if 0 in checkpoints else {}
    price = np.zeros(k)
    for step in range(1, steps + 1):
        order = rng.permutation(t)
        loose, held = order[:size], order[size:]
        kws = np.setdiff1d(np.arange(k), guess[held])
        own = price[kws]
        guess[loose] = kws[assignment(cost_matrix(aux, seen, n, kws, loose, guess[held], held), own)]
        price[kws] = own
        if step in checkpoints:
            out[step] = guess.copy()
    return out


#: cells of the unit interval in which draws meet the keywords whose shares lie there
_CELLS = 64


def uniform(*key: Column) -> Column:
    """A number from 0 to below 1 that its key decides, with 52 bits: the first 13 digits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\n", *key), 256), 1, 13), 16, 10).cast("double") / float(2**52)


def drawn_queries(tasks: DataFrame, sizes: DataFrame, multiplier: int = 2) -> DataFrame:
    """dataset, distribution, seed, position, keyword: the queries of each task. ``sizes``: dataset, k (its keywords are 0 to k - 1).

    ``each`` asks once for every keyword, in an order that hashes decide. ``uniform_iid`` and ``zipf_iid`` (probability of a keyword in proportion to
    1 / (its number + 1)) ask k * multiplier times, with replacement: a hash of seed and position as a number from 0 to 1 meets the keyword whose
    cumulated share it falls into. Another distribution is an error.
    """
    known = F.when(F.col("distribution").isin("each", "uniform_iid", "zipf_iid"), F.col("distribution")).otherwise(F.raise_error(F.concat(F.lit("no such distribution: "), "distribution")).cast("string"))
    t = tasks.join(sizes, "dataset").withColumn("distribution", known)
    task = ["dataset", "distribution", "seed"]
    key = [F.col("seed").cast("string"), F.col("distribution")]
    count = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>")))
    each = t.where("distribution = 'each'").withColumn("keyword", count(F.col("k"))).withColumn("u", F.sha2(F.concat_ws("\n", *key, F.col("keyword").cast("string")), 256))
    each = each.select(*task, (F.row_number().over(Window.partitionBy(*task).orderBy("u", "keyword")) - 1).cast("long").alias("position"), "keyword")  # k rows a task
    d = t.where("distribution <> 'each'").withColumn("position", count(F.col("k") * multiplier)).withColumn("u", uniform(*key, F.col("position").cast("string")))
    weight = F.when(F.col("distribution") == "zipf_iid", 1 / (F.col("keyword") + 1)).otherwise(F.lit(1.0))
    w = t.where("distribution <> 'each'").select("dataset", "distribution", "k").distinct().withColumn("keyword", count(F.col("k"))).withColumn("w", weight)
    upto = Window.partitionBy("dataset", "distribution").orderBy("keyword")  # k rows
    w = w.withColumn("high", F.sum("w").over(upto.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("w").over(Window.partitionBy("dataset", "distribution")))
    # the last share ends at 1, whatever the rounding of the sums
    w = w.withColumn("high", F.when(F.col("keyword") == F.col("k") - 1, F.lit(1.0)).otherwise(F.col("high") / F.col("all")))
    w = w.withColumn("low", F.coalesce(F.lag("high").over(upto), F.lit(0.0)))
    w = w.select("dataset", "distribution", "keyword", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * _CELLS), F.floor(F.col("high") * _CELLS))).alias("cell"))
    met = d.withColumn("cell", F.floor(F.col("u") * _CELLS)).join(w, ["dataset", "distribution", "cell"]).where("low <= u and u < high")
    return each.unionByName(met.select(*task, "position", "keyword"))


def metrics(truth: np.ndarray, guess: np.ndarray) -> tuple[float, float]:
    """Share of right queries, and the mean over observed keywords of theirs."""
    right = truth == guess
    return float(right.mean()), float(np.mean([right[truth == q].mean() for q in np.unique(truth)]))


RUN = "dataset string, distribution string, seed long, iteration long, query_weighted_recovery double, distinct_keyword_macro_recovery double, observed_keywords long"


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """One dataset's pair counts as two square matrices."""
    i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
    k = int(max(i.max(), j.max())) + 1
    out = []
    for c in ("aux", "client"):
        m = np.zeros((k, k))
        m[i, j] = m[j, i] = pdf[c].to_numpy()
        out.append(m.tobytes())
    return pd.DataFrame({"dataset": [pdf["dataset"].iat[0]], "k": [k], "am": [out[0]], "cm": [out[1]], "n_aux": [int(pdf["n_aux"].iat[0])], "n_client": [int(pdf["n_client"].iat[0])]})


def recovery_runs(pairs: DataFrame, tasks: DataFrame, steps: int, free: float, checkpoints: list[int], multiplier: int = 2) -> DataFrame:
    """The runs of all tasks (dataset, distribution, seed), each over the pair counts of its dataset, which has as many keywords as they name.

    ``pairs``: dataset, i, j, aux, client (counts of documents with both, i <= j), n_aux, n_client; K^2 / 2 rows at most a dataset, made into matrices once. A task
    has these and its queries, and runs alone; a dataset that has no pairs has no runs.
    """
    data = settled(pairs.groupBy("dataset").applyInPandas(_packed, "dataset string, k long, am binary, cm binary, n_aux long, n_client long"))
    asked = drawn_queries(tasks, data.select("dataset", "k"), multiplier)
    keys = ["dataset", "distribution", "seed"]
    per = asked.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "keyword"))), lambda x: x["keyword"]).alias("q"))  # k * multiplier numbers
    each = settled(per.repartition(max(1, tasks.count()), *keys))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                aux, cli = (np.frombuffer(m).reshape(r.k, r.k) for m in (r.am, r.cm))
                q = np.array(r.q)
                _, at = np.unique(q, return_index=True)
                labels = q[np.sort(at)]  # tokens in the order in which they are first seen
                place = {x: n for n, x in enumerate(labels)}
                got = recover(aux / r.n_aux, cli[np.ix_(labels, labels)], r.n_client, steps, free, int(r.seed), checkpoints)
                rows = [(r.dataset, r.distribution, r.seed, it, *metrics(q, g[[place[x] for x in q]]), len(labels)) for it, g in sorted(got.items())]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RUN.split(", ")])

    return each.join(data, "dataset").repartition(max(1, tasks.count()), *keys).mapInPandas(run, RUN)


def finished_runs(spark: SparkSession, path: str, schema: str = RUN) -> DataFrame:
    """The runs kept at a path; none if nothing was kept there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema + ", digest string")
    return spark.read.schema(schema + ", digest string").parquet(path)


def resume_runs(path: str, digest: str, pairs: DataFrame, tasks: DataFrame, at_once: int | None = None, **options) -> DataFrame:
    """``recovery_runs``, kept at a path: runs found there are not made again. Returns all runs of ``tasks``.

    ``digest`` names the data and settings; runs of others at that path, or of tasks that are not asked for, are an error. Runs are committed ``at_once`` by
    ``at_once`` (as many as there are cores, if not given): a job that is lost loses those it was at, and the next call makes only those that lack.
    """
    keys = ["dataset", "distribution", "seed"]
    spark = tasks.sparkSession
    done = finished_runs(spark, path)
    if done.where(F.col("digest") != digest).head(1):
        raise ValueError("the runs kept there are of other data or settings")
    size = at_once or spark.sparkContext.defaultParallelism
    left = remaining(tasks, done, keys).distinct()
    left = settled(numbered(left.withColumn("__h", F.sha2(F.concat_ws("\n", *keys), 256)), "__n", hash_prefix(F.col("__h")), "__h", *keys).drop("__h"))
    for first in range(0, left.count(), size):
        some = left.where((F.col("__n") >= first) & (F.col("__n") < first + size)).drop("__n")
        recovery_runs(pairs, some, **options).withColumn("digest", F.lit(digest)).write.mode("append").parquet(path)
    return finished_runs(spark, path).drop("digest")


def remaining(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks that are not done. Something done that is no task is an error."""
    extra = done.select(*keys).distinct().join(tasks, keys, "left_anti")
    if first := extra.head(1):
        raise ValueError(f"done, but no task: {first[0].asDict()}")
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def expanded_tasks(families: DataFrame, cache: DataFrame) -> DataFrame:
    """Every run of every family, and whether a cached run of the same data (equal digest) can be taken over; one of other data is made anew.

    ``families``: family, dataset, digest, distributions, seeds; ``cache``: dataset, distribution, seed, digest. Families share cached runs.
    """
    tasks = families.select("family", "dataset", "digest", F.explode("distributions").alias("distribution"), "seeds").select("family", "dataset", "digest", "distribution", F.explode("seeds").alias("seed"))
    known = cache.select("dataset", "distribution", "seed", "digest").distinct().withColumn("__hit", F.lit(True))
    met = tasks.join(known, ["dataset", "distribution", "seed", "digest"], "left")
    return met.select("family", "dataset", "distribution", "seed", F.when(F.col("__hit"), "reuse").otherwise("run").alias("action"))


def family_tasks(data: DataFrame, families: dict[str, dict], seeds: dict[str, list[int]]) -> DataFrame:
    """Tasks of all families of a study: family, partition, language, condition, dataset, digest, distributions, seeds.

    ``data``: one row a dataset with kind, partition, language, condition, dataset, digest, all of the same shape. ``families`` names for each the
    kind of its datasets, its distributions and the name of its seeds in ``seeds``.
    """
    out = None
    for name, f in families.items():
        one = data.where(F.col("kind") == f["kind"]).select(
            F.lit(name).alias("family"), "partition", "language", "condition", "dataset", "digest",
            F.array(*map(F.lit, f["distributions"])).alias("distributions"), F.array(*[F.lit(s).cast("long") for s in seeds[f["seeds"]]]).alias("seeds"),
        )
        out = one if out is None else out.unionByName(one)
    return out
