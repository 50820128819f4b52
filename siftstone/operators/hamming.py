"""Joins of 64-bit fingerprints within a small Hamming distance, exact at every size.

A fingerprint is cut into ``t + 2`` bands. Two values that differ in at most ``t`` bits agree in at least two of the
bands, so an equality join on every pair of bands meets each close pair. A bucket that holds many values is not
compared as it is and not capped: its free bits are cut into ``t + 1`` parts, one of which must agree as well, and it
is split by those, twice if need be. What is still crowded then has few free bits left (21 of 64 at a distance of three),
so its values are looked up by equality with every way to flip up to ``t`` of these bits. No bucket is ever compared
whole in one task beyond a fixed number of pairs.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.operators.skew import shuffled
from siftstone.session import Scratch

HOT_BUCKET = 512
LEVELS = 2


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of nearly equal parts of the given bit positions, highest bits first."""
    size, extra = divmod(len(bits), parts)
    out, at = [], 0
    for p in range(parts):
        n = size + (p < extra)
        out.append(sum(1 << b for b in bits[at : at + n]))
        at += n
    return out


def base_masks(threshold: int) -> list[int]:
    bands = _cut(list(range(63, -1, -1)), threshold + 2)
    return [a | b for a, b in combinations(bands, 2)]


def split_masks(mask: int, threshold: int) -> list[int]:
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    return [mask | part for part in _cut(free, threshold + 1) if part]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def keyed(df: DataFrame, h: str, masks: list[int]) -> DataFrame:
    """One row of df for each mask: ``m`` the mask's place in masks, ``v`` the value's bits under it.

    Spark's estimate of its size leaves the explosion out, so a join with it must say how it is done (``shuffled``).
    """
    col = F.col(h)
    pairs = [F.struct(F.lit(i).alias("m"), col.bitwiseAND(F.lit(signed(k)).cast("long")).alias("v")) for i, k in enumerate(masks)]
    return df.withColumn("_k", F.explode(F.array(*pairs))).select(*df.columns, "_k.m", "_k.v")


def _first_mask(x: Column, masks: list[int]) -> Column:
    """The first mask under which two values with this xor agree; a pair is reported under that one only."""
    when = F.when(x.bitwiseAND(F.lit(signed(masks[0])).cast("long")) == 0, 0)
    for i, k in enumerate(masks[1:], 1):
        when = when.when(x.bitwiseAND(F.lit(signed(k)).cast("long")) == 0, i)
    return when


def _flips(free: list[int], threshold: int) -> list[int]:
    """Every xor of up to threshold of the free bits, none included."""
    return [signed(sum(1 << b for b in c)) for d in range(threshold + 1) for c in combinations(free, d)]


def _hot(left: DataFrame, right: DataFrame, most: int, same: bool, work: Scratch) -> DataFrame | None:
    """The buckets (m, v) in which more than most**2 pairs would be compared, None if there are none."""
    many = right.groupBy("m", "v").agg(F.count(F.lit(1)).alias("nr"))
    if same:
        many = many.where(F.col("nr") > most).select("m", "v")
    else:
        many = many.join(shuffled(left.groupBy("m", "v").agg(F.count(F.lit(1)).alias("nl"))), ["m", "v"]).where(F.col("nr") * F.col("nl") > most * most).select("m", "v")
    hot = work.save(many, "hot")
    return hot if hot.take(1) else None


def close_keyed(
    left: DataFrame, right: DataFrame, threshold: int, masks: list[int], work: Scratch, hot_bucket: int = HOT_BUCKET, ordered: bool = False, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Pairs (lh, rh) of the keyed tables ``left(m, v, lh)`` and ``right(m, v, rh)`` within the threshold.

    Each pair of rows comes out once; ``extra`` columns of right are kept beside it. With ``ordered`` both sides hold the
    same values, and pairs come out with lh < rh.
    """
    parts: list[DataFrame] = []
    level = 0
    while True:
        free = [[b for b in range(64) if not k >> b & 1] for k in masks]
        flips = max(sum(comb(len(f), d) for d in range(threshold + 1)) for f in free)
        last = level == LEVELS
        # at the last level a value meets its bucket or all its flips, whatever is less
        hot = _hot(left, right, max(hot_bucket, flips) if last else hot_bucket, ordered, work)
        calm = right if hot is None else right.join(hot, ["m", "v"], "left_anti")
        x = F.col("lh").bitwiseXOR(F.col("rh"))
        found = left.join(shuffled(calm), ["m", "v"]).where(F.bit_count(x) <= threshold)
        if level == 0:  # deeper tables lack the rows of calm buckets, so the first mask may be none of theirs
            found = found.where(F.col("m") == _first_mask(x, masks))
        if ordered:
            found = found.where("lh < rh")
        parts.append(found.select("lh", "rh", *extra))
        if hot is None:
            break
        if last:
            parts.append(_by_flips(left, right, hot, free, threshold, ordered, extra))
            break
        deeper = [split_masks(k, threshold) for k in masks]
        flat = sorted({k for ks in deeper for k in ks})
        place = {k: i for i, k in enumerate(flat)}
        to = F.create_map(*[c for i, ks in enumerate(deeper) for c in (F.lit(i), F.array(*[F.struct(F.lit(place[k]).alias("m"), F.lit(signed(k)).cast("long").alias("k")) for k in ks]))])

        def finer(side: DataFrame, h: str, *more: str) -> DataFrame:
            s = side.join(hot, ["m", "v"], "left_semi").select(h, *more, F.explode(to[F.col("m")]).alias("s"))
            return s.select(h, *more, F.col("s.m").alias("m"), F.col(h).bitwiseAND(F.col("s.k")).alias("v")).distinct()

        left, right, masks = work.save(finer(left, "lh"), "finer-left"), work.save(finer(right, "rh", *extra), "finer-right"), flat
        level += 1
    return parts[0] if len(parts) == 1 else reduce(DataFrame.union, parts).distinct()


def _by_flips(left: DataFrame, right: DataFrame, hot: DataFrame, free: list[list[int]], threshold: int, ordered: bool, extra: tuple[str, ...]) -> DataFrame:
    """The close pairs within hot buckets, by equality of values; the masks are joined as a small table."""
    spark = left.sparkSession
    ways = spark.createDataFrame([(m, _flips(f, threshold)) for m, f in enumerate(free)], "m int, flips array<long>")  # a row for each mask
    ours = left.join(hot, ["m", "v"], "left_semi").join(F.broadcast(ways), "m").select("m", "lh", F.explode("flips").alias("_x")).select("m", "lh", F.col("lh").bitwiseXOR(F.col("_x")).alias("rh"))
    theirs = right.join(hot, ["m", "v"], "left_semi").select("m", "rh", *extra)
    found = ours.where("lh < rh") if ordered else ours
    return found.join(shuffled(theirs), ["m", "rh"]).select("lh", "rh", *extra).distinct()


def hamming_pairs(hashes: DataFrame, h: str, threshold: int = 3, work: Scratch | None = None, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Pairs ``(a, b, distance)``, a < b, of different values of column h that differ in at most threshold bits.

    Null values take part in no pair; repeated values count once; an empty table gives no rows; other columns are ignored.
    """
    work = work or Scratch(hashes.sparkSession, "hamming")
    masks = base_masks(threshold)
    k = keyed(hashes.where(F.col(h).isNotNull()).select(F.col(h).alias("lh")).distinct(), "lh", masks)
    out = close_keyed(k, k.withColumnRenamed("lh", "rh"), threshold, masks, work, hot_bucket, ordered=True)
    return out.select(F.col("lh").alias("a"), F.col("rh").alias("b"), distance(F.col("lh"), F.col("rh")).alias("distance"))


def bands16(h: str) -> Column:
    """The four 16-bit bands of a fingerprint, highest first."""
    return F.array(*[F.shiftrightunsigned(F.col(h), 48 - 16 * b).bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int") for b in range(4)])
