"""Accuracy of estimated count series against the exact one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relative_error(estimates: DataFrame, exact: DataFrame, keys: list[str], skip: int = 0) -> DataFrame:
    """(seed, keys..., error): |estimate - exact| / exact at each checkpoint after the first `skip`; null where the exact
    count is 0. `exact` has the keys and `triangles`; checkpoints are matched by number, not by place."""
    return errors_of(estimates.join(exact.select(*keys, "triangles"), keys), keys, skip)


def errors_of(matched: DataFrame, keys: list[str], skip: int = 0) -> DataFrame:
    """As relative_error, of rows (seed, keys..., estimate, triangles) that have their exact count."""
    gold = F.col("triangles").cast("double")
    return matched.where(F.col("cp") > skip).select("seed", *keys, F.when(gold != 0, F.abs(F.col("estimate") - gold) / gold).alias("error"))


def error_by_run(errors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., seed, avg_error, max_error, undefined): checkpoints without an error are left out and counted."""
    return errors.groupBy(*(by or []), "seed").agg(F.avg("error").alias("avg_error"), F.max("error").alias("max_error"), F.count_if(F.col("error").isNull()).alias("undefined"))


def error_summary(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., avg_error, max_error, runs): means over the runs of their averages and of their maxima."""
    return runs.groupBy(*(by or [])).agg(F.avg("avg_error").alias("avg_error"), F.avg("max_error").alias("max_error"), F.count(F.lit(1)).alias("runs"))
