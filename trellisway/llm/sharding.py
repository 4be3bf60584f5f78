"""Sharding by rendezvous hashing: each record goes to the shard with the highest score for its key.

The score of (key, shard) is -weight / ln(u), where u comes from md5(key ':' shard); so a
shard's share follows its weight, and a shard that is added takes records only into itself
(law `key`). Every step is a DataFrame expression; the one shuffle moves narrow rows.

Slots number a shard's records without gaps in the order of md5(key ':slot'), then the tie
columns. A shard may hold a large part of all rows, so it is cut into `splits` ranges of
that digest: ranges are counted, their offsets summed over splits x shards rows, and the
rows of each range numbered by themselves.

Defined results: a null key counts as the empty string and a null text as empty; repeated
rows get slots of their own; an empty table gives an empty result; a column of an added
name raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisway.llm.common import no_clash, shuffle_width

_DIGITS = 12


def _draw(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def shard_score(key: Column, shard: int, weight: float) -> Column:
    u = (_draw(F.concat(key, F.lit(f":{shard}")), _DIGITS) + F.lit(0.5)) / F.lit(float(16**_DIGITS))
    return F.lit(-float(weight)) / F.ln(u)


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard of `key`; ties, which need equal digests, go to the larger number."""
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("at least one shard, and positive weights")
    scored = [F.struct(shard_score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in sorted(weights.items())]
    return (scored[0] if len(scored) == 1 else F.greatest(*scored))["shard"]


def with_shards(records: DataFrame, key_col: str, weights: dict[int, float], grown: dict[int, float] | None = None, prefix: str = "") -> DataFrame:
    """Adds {prefix}shard, and with `grown` (other weights) {prefix}grown_shard."""
    no_clash(records, [f"{prefix}shard", *[f"{prefix}grown_shard"] * bool(grown)])
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    out = records.withColumn(f"{prefix}shard", rendezvous(key, weights))
    return out.withColumn(f"{prefix}grown_shard", rendezvous(key, grown)) if grown else out


def with_slots(records: DataFrame, key_col: str, shard_col: str, ties: list[str], splits: int | None = None, slot_col: str = "slot") -> DataFrame:
    """Adds `slot_col`: 0, 1, ... in each shard, the same for any number of splits."""
    no_clash(records, [slot_col, "_place", "_split", "_shard_at", "_split_at", "_before", "_rank", "_n"])
    splits = splits or 2 * shuffle_width(records.sparkSession)
    place = F.md5(F.concat(F.coalesce(F.col(key_col).cast("string"), F.lit("")), F.lit(":slot")))
    split = F.floor(F.conv(F.substring(place, 1, 8), 16, 10).cast("long") * F.lit(splits) / F.lit(float(16**8))).cast("int")
    rows = records.withColumns({"_place": place, "_split": split})
    counts = rows.groupBy(F.col(shard_col).alias("_shard_at"), F.col("_split").alias("_split_at")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard_at").orderBy("_split_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(shard_col, "_split").orderBy("_place", *ties)
    return (
        rows.withColumn("_rank", F.row_number().over(within))
        .join(offsets, (F.col(shard_col) == F.col("_shard_at")) & (F.col("_split") == F.col("_split_at")))
        .withColumn(slot_col, F.col("_before") + F.col("_rank") - F.lit(1))
        .drop("_place", "_split", "_shard_at", "_split_at", "_before", "_rank")
    )
