"""Per-key results over keys of which a few hold most rows.

``range_split``: rows are range partitioned by (key, secondary order) with sampled quantiles, so a heavy key is spread
over as many partitions as its share of the rows asks for. Each partition reduces every key it holds to one state, and
the states of keys that cross a partition border are stitched together. No task ever holds more than one partition's
share, however heavy a key is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftstone.session import Scratch


def range_split(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """df range partitioned by keys and order; ties of the whole composite key stay together."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys, *order)


def split_counts(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """``(keys..., n)``: rows of each key, rows equal in keys and order counted once.

    Nulls are keys and order values like any other; an empty table gives no rows; other columns are not read.
    """
    ranged = range_split(df.select(*keys, *order), keys, order, partitions)
    once = ranged.groupBy(*keys, *order).agg(F.lit(1).alias("_one"))  # within the partitions, as they hold all ties
    return once.groupBy(*keys).agg(F.count("_one").alias("n"))  # a state per key and partition, then the stitching


def split_aggregate(df: DataFrame, keys: list[str], order: list[str], states: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """One row per key with mergeable aggregates (count, sum, min, max, min_by ...), evaluated as ``split_counts`` does."""
    return range_split(df, keys, order, partitions).groupBy(*keys).agg(*[c.alias(k) for k, c in states.items()])


def split_running(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "running", work: Scratch | None = None, partitions: int | None = None) -> DataFrame:
    """df with the 1-based row number ``<out>_n`` and the running sum ``<out>`` of value within each key, in the given order.

    The order must be total within a key for the row numbers to be determined; ties share a partition and are numbered
    arbitrarily. Null values add nothing. Columns of df keep their names; ``<out>``, ``<out>_n`` and ``_part`` must be free.
    """
    if taken := {out, f"{out}_n", "_part"} & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} already exist")
    work = work or Scratch(df.sparkSession, "running")
    # the written partition number fixes the borders, so that both passes below see the same split
    parted = work.save(range_split(df, keys, order, partitions).withColumn("_part", F.spark_partition_id()), "ranged")
    local = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    states = parted.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # a key has at most one state in each partition: the stitching window is bounded by the number of partitions
    carry = states.select(
        "_part", *[F.col(k).alias(f"_c_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.sum("_s").over(before).alias("_s0"),
    ).where("_n0 > 0")  # only keys that came over a border carry anything in
    here = parted.withColumn("_n", F.count(F.lit(1)).over(local)).withColumn("_s", F.sum(value).over(local))
    on = [here["_part"] == carry["_part"], *[here[k].eqNullSafe(carry[f"_c_{k}"]) for k in keys]]
    joined = here.join(carry, on, "left")
    return joined.select(
        *[here[c] for c in df.columns],
        (F.col("_n") + F.coalesce("_n0", F.lit(0))).alias(f"{out}_n"),
        F.when(F.col("_s").isNull() & F.col("_s0").isNull(), None).otherwise(F.coalesce("_s", F.lit(0)) + F.coalesce("_s0", F.lit(0))).alias(out),
    )


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffle and sort, for sides that grow with the input.

    Estimates come from the bytes of written columns, packed and before any explosion: a table far below the broadcast
    threshold by its estimate may be many times that in rows, and the driver would hold them all.
    """
    return df.hint("merge")


def heavy_keys(counts: DataFrame, key: str, n: str, share: float) -> DataFrame:
    """``(key, n, total)`` of the keys with at least the given share of all rows: at most ``1 / share`` of them."""
    total = counts.agg(F.sum(n).alias("total"))
    return counts.join(F.broadcast(total), F.col(n) >= F.col("total") * share).select(key, n, "total")


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str, heavy: list, how: str = "inner", salts: int = 16) -> DataFrame:
    """``rows`` joined with ``lookup`` (one row per key) on key; rows of the heavy keys are spread over salts.

    ``heavy`` is a bounded list, such as the keys with over a hundredth of all rows. Other keys are joined as they are.
    """
    if not heavy:
        return rows.join(lookup, key, how)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts)).cast("int")
    hot = lambda c: c.isin(heavy)
    left = rows.withColumn("_salt", F.when(hot(F.col(key)), spread).otherwise(F.lit(0)))
    right = lookup.withColumn("_salt", F.explode(F.when(hot(F.col(key)), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")
