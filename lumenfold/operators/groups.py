"""Assigning samples to groups; the first rule that matches wins when rules are chained by the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.ordering import with_ordinal
from lumenfold.session import join_stats


def sample_number(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint")


def by_ranges(df: DataFrame, ranges: Sequence[tuple[int, int, str]], sample: str = "sample") -> DataFrame:
    """Number of the sample inside an inclusive range; unmatched samples have no group."""
    n = sample_number(F.col(sample))
    rule = F
    for lo, hi, name in ranges:
        rule = rule.when(n.between(lo, hi), name)
    return df.withColumn("group", rule.otherwise(None))


def by_parity(df: DataFrame, sample: str = "sample") -> DataFrame:
    """Odd or even number; a name without digits is an error at run time."""
    n = sample_number(F.col(sample))
    checked = F.when(n.isNull(), F.raise_error(F.concat(F.lit("sample without digits: "), F.col(sample)))).otherwise(n)
    return df.withColumn("group", F.when(F.pmod(checked, F.lit(2)) == 1, "odd").otherwise("even"))


def first_and_rest(df: DataFrame, k: int, order: Sequence[str], sample: str = "sample") -> DataFrame:
    """The first k samples in the given order against all others; only k keys are picked (distributed top-k)."""
    head = df.select(sample, *order).distinct().orderBy(*order).limit(k).select(sample).withColumn("_first", F.lit(True))
    joined = join_stats(df, head, [sample], "left")
    return joined.withColumn("group", F.when(F.col("_first"), "first").otherwise("rest")).drop("_first")


def every_n(df: DataFrame, n: int, position: Column, sample: str = "sample") -> DataFrame:
    """Blocks of n samples in order: G1, G2, ..."""
    ranked = with_ordinal(df.withColumn("_all", F.lit(0)), "_all", position, [sample], out="_o")
    return ranked.withColumn("group", F.concat(F.lit("G"), (F.floor(F.col("_o") / n) + 1).cast("string"))).drop("_all", "_o")


def by_prefix(df: DataFrame, sample: str = "sample", min_size: int = 1) -> DataFrame:
    """Letters before the first digit, `_` or `-`; groups smaller than min_size are left out."""
    keyed = df.withColumn("group", F.upper(F.regexp_extract(F.col(sample), r"^([A-Za-z]+)", 1)))
    keyed = keyed.filter(F.col("group") != "")
    if min_size <= 1:
        return keyed
    sizes = keyed.groupBy("group").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_size).drop("_n")
    return join_stats(keyed, sizes, ["group"])


def by_lists(df: DataFrame, lists: dict[str, Sequence[str]], sample: str = "sample") -> DataFrame:
    rule = F
    for name, members in lists.items():
        rule = rule.when(F.col(sample).isin(*members), name)
    return df.withColumn("group", rule.otherwise(None))
