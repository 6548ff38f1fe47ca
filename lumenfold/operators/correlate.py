"""Composition against performance: cycle choice, correlations, forests and permutation importance."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.operators.ordering import with_ordinal
from lumenfold.session import settled

#: Nodes of the trees that the driver holds at once, at most, unless a single tree has more.
WAVE_NODES = 1 << 18


def latest_cycle(perf: DataFrame, cycle: str = "cycle", ordinal: str = "ordinal", sample: str = "sample",
                 of_interest: int | None = None) -> DataFrame:
    """Row with the highest valid cycle per sample (the first one on ties); without any, the last row.

    A mergeable max_by, so a sample with a huge history is combined before the shuffle.
    """
    if of_interest is not None:
        return perf.filter(F.col(cycle) == of_interest)
    c = F.col(cycle)
    order = F.struct(c.isNotNull().alias("has"), F.coalesce(c, F.lit(0)).alias("c"),
                     F.when(c.isNotNull(), -F.col(ordinal)).otherwise(F.col(ordinal)).alias("o"))
    rest = [x for x in perf.columns if x != sample]
    best = perf.groupBy(sample).agg(F.max_by(F.struct(*rest), order).alias("_b"))
    return best.select(sample, *[F.col("_b")[x].alias(x) for x in rest])


def id_overlap(left: DataFrame, right: DataFrame, key: str = "sample") -> DataFrame:
    """Counts of keys on both sides, only left and only right, from one shuffle."""
    tagged = left.select(key).withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0)).unionByName(
        right.select(key).withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1)))
    per = tagged.groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return per.agg(F.count_if((F.col("_l") == 1) & (F.col("_r") == 1)).alias("n_both"),
                   F.count_if(F.col("_r") == 0).alias("n_left_only"), F.count_if(F.col("_l") == 0).alias("n_right_only"))


def correlation_matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson matrix in long form; all pairs come from a single aggregate."""
    pairs = list(combinations_with_replacement(names, 2))
    one = df.agg(*[F.corr(a, b).alias(f"_{k}") for k, (a, b) in enumerate(pairs)])
    cells = []
    for k, (a, b) in enumerate(pairs):
        for p, q in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(f"_{k}").alias("r")))
    return one.select(F.explode(F.array(*cells)).alias("m")).select("m.a", "m.b", "m.r")


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, r, t statistic, least-squares slope and intercept of one pair."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = both.agg(F.count("*").alias("n"), F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"),
                 F.regr_intercept(y, x).alias("intercept"))
    r = F.col("r")
    return g.withColumn("t", r * F.sqrt((F.col("n") - 2) / (1.0 - r * r)))


def trend_table(df: DataFrame, names: Sequence[str], y: str) -> DataFrame:
    """n, r, slope and intercept of every feature against y, from one aggregate (incomplete pairs are skipped)."""
    def part(x: str) -> list:
        pair = F.col(x).isNotNull() & F.col(y).isNotNull()
        return [F.count_if(pair), F.corr(x, y), F.regr_slope(y, x), F.regr_intercept(y, x)]

    fields = ("n", "r", "slope", "intercept")
    one = df.agg(*[c.alias(f"{f}_{k}") for k, x in enumerate(names) for f, c in zip(fields, part(x))])
    rows = F.array(*[F.struct(F.lit(x).alias("feature"), *[F.col(f"{f}_{k}").alias(f) for f in fields]) for k, x in enumerate(names)])
    return one.select(F.inline(rows))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Simpson integration after x = sin^2."""
    if x <= 0.0 or x >= 1.0:
        return float(min(max(x, 0.0), 1.0))
    top = math.asin(math.sqrt(x))
    n = 4000

    def area(end: float) -> float:
        t = np.linspace(0.0, end, n + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            f = np.sin(t) ** (2 * a - 1) * np.cos(t) ** (2 * b - 1)
        f[~np.isfinite(f)] = 0.0
        return float((f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()) * end / (3 * n))

    return area(top) / area(math.pi / 2)


@F.pandas_udf(T.DoubleType())
def two_sided_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """p-value of a Pearson r with n pairs; runs on the aggregated rows only."""
    out = []
    for rr, nn in zip(r, n):
        df = nn - 2
        out.append(np.nan if df <= 0 or rr is None or np.isnan(rr) else incomplete_beta(df / 2.0, 0.5, 1.0 - rr * rr))
    return pd.Series(out, dtype=float)


def split_by_hash(df: DataFrame, key: str, train: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Repeatable split that does not depend on partitioning."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000))
    cut = int(train * 10_000)
    return df.filter(u < cut), df.filter(u >= cut)


def fit_forest(train: DataFrame, features: Sequence[str], target: str, trees: int = 500, depth: int = 30,
               seed: int = 42) -> RandomForestRegressionModel:
    """Features are the component columns only, never the target or its parts. Depth 30 is the most Spark ML allows."""
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(train).select("features", target)
    return RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth,
                                 seed=seed).fit(data)


def forest_waves(train: DataFrame, features: Sequence[str], target: str, trees: int = 500, depth: int = 30,
                 seed: int = 42) -> Iterator[RandomForestRegressionModel]:
    """The trees of one forest in several models, one after the other: a model's trees are held by the driver.

    A tree has at most two nodes a row. The trees of a wave have their own seed; a forest that fits into one wave is
    that of `fit_forest`. Drop a model before the next one is asked for.
    """
    data = settled(VectorAssembler(inputCols=list(features), outputCol="features").transform(train).select("features", target), "forest")
    size = max(1, min(trees, WAVE_NODES // (2 * max(1, data.count()))))
    for k, begin in enumerate(range(0, trees, size)):
        # what "auto" means for more than one tree
        yield RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=min(size, trees - begin), maxDepth=depth,
                                    featureSubsetStrategy="onethird", seed=seed + k).fit(data)


def predict_in_waves(waves: Iterable[RandomForestRegressionModel], rows: DataFrame) -> DataFrame:
    """`prediction` of the whole forest for rows with `features`: running sums are written to the shared folder after each wave."""
    names, trees = rows.columns, 0
    rows = settled(rows.withColumn("_sum", F.lit(0.0)), "forest")
    for model in waves:
        n = model.getNumTrees
        rows = settled(model.transform(rows).select(*names, (F.col("_sum") + n * F.col("prediction")).alias("_sum")), "forest")
        trees += n
    return rows.select(*names, (F.col("_sum") / trees).alias("prediction"))


def importances_in_waves(waves: Iterable[RandomForestRegressionModel], features: Sequence[str]) -> DataFrame:
    """Feature importances of the whole forest, the mean over its trees, largest first."""
    from pyspark.sql import SparkSession
    total = sum(model.getNumTrees * model.featureImportances.toArray() for model in waves)
    share = total / total.sum() if total.sum() > 0 else total
    rows = sorted(zip(features, share.tolist()), key=lambda r: (-r[1], r[0]))
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def regression_metrics(pred: DataFrame, target: str, groups: Sequence[str] = (), prediction: str = "prediction") -> DataFrame:
    e = F.col(target) - F.col(prediction)
    g = pred.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(e * e).alias("_sse"), F.avg(F.abs(e)).alias("mae"),
                                  (F.var_pop(target) * F.count("*")).alias("_sst"))
    return g.select(*groups, "n", F.when(F.col("_sst") > 0, 1.0 - F.col("_sse") / F.col("_sst")).alias("r2"), "mae",
                    F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"))


def importances(model: RandomForestRegressionModel, features: Sequence[str], top: int | None = None) -> DataFrame:
    """Feature importances, largest first (one row per feature, so already small)."""
    from pyspark.sql import SparkSession
    rows = sorted(zip(features, model.featureImportances.toArray().tolist()), key=lambda r: (-r[1], r[0]))
    return SparkSession.active().createDataFrame(rows[:top], "feature string, importance double")


def permutation_importance(model: RandomForestRegressionModel, test: DataFrame, features: Sequence[str], target: str,
                           key: str = "sample", repeats: int = 10, seed: int = 42) -> DataFrame:
    """Loss of R2 when one feature is permuted, for all features and repeats in one job.

    A permutation is the join of two rankings of the test rows (by key hash, by seeded hash) per repeat.
    """
    return permutation_loss(model.transform(permuted(test, features, target, key, repeats, seed)), features, target)


def permuted(test: DataFrame, features: Sequence[str], target: str, key: str = "sample", repeats: int = 10, seed: int = 42) -> DataFrame:
    """Test rows with one feature permuted, for each feature `_f` and repeat `_rep`, and as they are with `_f` null."""
    rows = test.select(key, target, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    reps = rows.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    own = with_ordinal(reps, "_rep", F.xxhash64(key), [key], out="_o")
    other = with_ordinal(reps.select("_rep", key, F.col("_x").alias("_z")), "_rep",
                         F.xxhash64(F.col(key), F.col("_rep"), F.lit(seed)), [key], out="_o").drop(key)
    mixed = own.join(other, ["_rep", "_o"])
    cells = mixed.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    swapped = F.transform("_x", lambda v, i: F.when(i == F.col("_f"), F.get("_z", i)).otherwise(v))
    none = F.lit(None).cast("int")
    return cells.select("_rep", "_f", target, array_to_vector(swapped).alias("features")).unionByName(
        rows.select(none.alias("_rep"), none.alias("_f"), target, array_to_vector("_x").alias("features")))


def permutation_loss(scored: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Mean and deviation over the repeats of the loss of R2, from predictions of the rows of `permuted`."""
    base_r2 = regression_metrics(scored.where("_f is null"), target).select(F.col("r2").alias("_base"))
    per = regression_metrics(scored.where("_f is not null"), target, ["_f", "_rep"]).crossJoin(F.broadcast(base_r2))  # one row
    drop = F.col("_base") - F.col("r2")
    names = F.array(*[F.lit(f) for f in features])
    return per.groupBy(F.element_at(names, F.col("_f") + 1).alias("feature")).agg(
        F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_std"))
