"""Parity metrics by module and over whole registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(1.0))


def precision(matched: Column, target: Column) -> Column:
    """Share of the target that is matched; 1 without a target."""
    return _ratio(matched, target)


def recall(matched: Column, base: Column) -> Column:
    """Share of the base that is matched; 1 without a base."""
    return _ratio(matched, base)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))


def jaccard(matched: Column, base: Column, target: Column) -> Column:
    """Matched over the union; 1 if that is empty."""
    return _ratio(matched, base + target - matched)


def with_metrics(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and jaccard to columns base, target and solid."""
    b, t, s = F.col("base"), F.col("target"), F.col("solid")
    out = counts.withColumn("precision", precision(s, t)).withColumn("recall", recall(s, b))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall"))).withColumn("jaccard", jaccard(s, b, t))


def module_summary(matches: DataFrame) -> DataFrame:
    """Counts and metrics by module from the rows of match_features.

    base and target count features before matching and after the remap.
    """
    n = matches.groupBy("module").agg(
        F.count("base_ord").alias("base"),
        F.count("target_ord").alias("target"),
        F.count_if(F.col("kind") == "solid").alias("solid"),
        F.count_if(F.col("kind") == "potential").alias("potential"),
    )
    return with_metrics(n)


def global_summary(modules: DataFrame, base_size: Column | int, target_size: Column | int) -> DataFrame:
    """One row of metrics; the sizes are those of the whole registries, with rows the remap dropped."""
    size = lambda x: F.lit(x) if isinstance(x, int) else x
    total = modules.agg(F.coalesce(F.sum("solid"), F.lit(0)).alias("solid"))
    return with_metrics(total.withColumn("base", size(base_size).cast("long")).withColumn("target", size(target_size).cast("long")))
