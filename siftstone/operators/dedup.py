"""Duplicate groups over the catalogue: scope, perceptual groups, exact groups, keep policy, accounting.

Groups are never gathered. A group's figures and its kept row come from aggregates with map-side combining, and go back
to the members by a lookup join in which the rows of heavy groups are spread over salts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.scalars import best_ts, best_ts_source, glob_regex, has_conflict_marker
from siftstone.operators.components import connected_components
from siftstone.operators.hamming import distance, hamming_pairs
from siftstone.operators.skew import heavy_keys, salted_lookup, shuffled, split_running
from siftstone.schema import SHADOWED, SPARSE, comparable, has_flag, hex64
from siftstone.session import Scratch

MAX_THRESHOLD = 3
SORTS = ("wasted", "count", "newest")


class ScopeError(ValueError):
    """An archive name that matches none, or several."""


@dataclass
class DedupParams:
    exact: bool = True
    near: bool = True
    threshold: int = 3
    kind: str | None = None
    exts: list[str] = field(default_factory=list)
    min_size: int = 1
    path_glob: str | None = None
    archives: list[str] = field(default_factory=list)
    across_only: bool = False
    include_empty: bool = False
    sort: str = "wasted"
    limit_groups: int | None = None


def resolve_scope(archives: DataFrame, names: list[str]) -> DataFrame:
    """The registry rows that the names stand for (id, label or source path); all of them without names."""
    if not names:
        return archives
    ids = []
    for name in names:
        hit = archives.where((F.col("archive_id").cast("string") == name) | (F.col("label") == name) | (F.col("source_path") == name)).select("archive_id").distinct().limit(2).collect()
        if len(hit) != 1:
            raise ScopeError(f"no archive matches {name!r}" if not hit else f"{name!r} is ambiguous; use its id")
        ids.append(hit[0].archive_id)
    return archives.where(F.col("archive_id").isin(ids))


def scope_filter(p: DedupParams) -> Column:
    """Filters of a run, all pushed into the scan."""
    flags = F.coalesce(F.col("flags"), F.lit(0).cast("long"))
    keep = F.col("content_hash").isNotNull() & (F.col("entry_type") != "symlink") & (flags.bitwiseAND(SPARSE) == 0) & (F.col("size") >= p.min_size)
    if not p.include_empty:
        keep &= F.col("kind") != "empty"
    if p.kind:
        keep &= F.col("kind") == p.kind
    if p.path_glob:
        keep &= F.col("path").rlike(glob_regex(p.path_glob))
    exts = ["".join(c for c in e.lower() if c.isascii() and c.isalnum()) for e in p.exts]
    if exts:
        low, any_ = F.lower("path"), F.lit(False)
        for e in exts:
            any_ |= low.endswith("." + e)
        keep &= any_
    return keep


def scoped_rows(files: DataFrame, archives: DataFrame, p: DedupParams) -> DataFrame:
    """What groups and keepers are decided by, of the rows in scope; repeated rows of one key count once.

    Paths, names and dates as such stay behind: only the members of groups get them, at the end (see ``run_dedup``).
    """
    a = resolve_scope(archives, p.archives).dropDuplicates(["archive_id"]).select("archive_id", "indexed_unix")
    rows = files.where(scope_filter(p)).join(a, "archive_id")
    rows = rows.select(
        "archive_id", "file_id", "kind", "size", "content_hash", "phash", "img_w", "img_h", best_ts().alias("ts"), F.coalesce(has_flag(SHADOWED), F.lit(False)).alias("shadowed"),
        F.coalesce(F.col("entry_type") == "hardlink", F.lit(False)).alias("hardlink"), F.coalesce(has_flag(SPARSE), F.lit(False)).alias("sparse"),
        F.coalesce(has_conflict_marker("path"), F.lit(False)).alias("marked"), F.octet_length("path").cast("long").alias("path_length"),
    )
    return rows.dropDuplicates(["archive_id", "file_id"])


def near_labels(rows: DataFrame, threshold: int, work: Scratch) -> DataFrame:
    """``(phash, near)``: the perceptual group of each fingerprint that has one.

    Fingerprints are compared once each, whatever number of pictures bears them, and no bucket is left out.
    """
    prints = rows.where(comparable() & ~F.col("shadowed") & ~F.col("hardlink")).groupBy("phash").agg(F.count(F.lit(1)).alias("n"))
    prints = work.save(prints, "prints")
    pairs = work.save(hamming_pairs(prints, "phash", threshold, work).select("a", "b"), "pairs")
    comp = connected_components(pairs, work=work).select(F.col("v").alias("phash"), F.col("component").alias("near"))
    return prints.join(shuffled(comp), "phash", "left").where(F.col("near").isNotNull() | (F.col("n") > 1)).select("phash", F.coalesce("near", "phash").alias("near"))


def membership(rows: DataFrame, p: DedupParams, work: Scratch) -> DataFrame:
    """rows with their group ``gkind`` and ``gkey``; rows in no candidate group have a null key."""
    rows = work.save(rows, "rows")
    near = F.lit(None).cast("long")
    if p.near:
        labels = work.save(near_labels(rows, p.threshold, work), "labels")
        heavy = _heavy(rows.where("phash is not null"), "phash")
        # rows that can't be in a perceptual group get a key of their own, else they would meet under null
        eligible = comparable() & ~F.col("shadowed") & ~F.col("hardlink")
        probe = rows.withColumn("_probe", F.when(eligible, F.col("phash")).otherwise(F.xxhash64("archive_id", "file_id"))).withColumn("_eligible", F.coalesce(eligible, F.lit(False)))
        rows = salted_lookup(probe, shuffled(labels.withColumnRenamed("phash", "_probe")), "_probe", heavy, "left")
        rows = rows.withColumn("near", F.when(F.col("_eligible"), F.col("near"))).drop("_probe", "_eligible")
        near = F.col("near")
    in_near = near.isNotNull()
    kind = F.when(in_near, "near").otherwise("exact")
    key = F.when(in_near, hex64(near)).otherwise(F.lower(F.hex("content_hash")))
    out = rows.withColumn("gkind", kind).withColumn("gkey", key)
    if "near" in out.columns:
        out = out.drop("near")
    return out if p.exact else out.where("gkind = 'near'")


def _heavy(rows: DataFrame, key: str, share: float = 0.01) -> list:
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in heavy_keys(counts, key, "n", share).select(key).collect()]  # at most 1 / share keys


def group_figures(members: DataFrame, p: DedupParams) -> DataFrame:
    """One row per group that stays: the kept row, why it is kept, and the group's size."""
    ok = ~F.col("shadowed") & ~F.col("hardlink")
    lowest = -(1 << 63)
    ts = F.coalesce("ts", F.lit(lowest + 1).cast("long"))
    near = F.col("gkind") == "near"
    pixels = F.coalesce("img_w", F.lit(0)).cast("long") * F.coalesce("img_h", F.lit(0)).cast("long")
    policy = F.struct(
        F.when(near, -pixels).otherwise(-ts).alias("a"),
        F.when(near, -F.col("size")).otherwise(F.col("marked").cast("long")).alias("b"),
        F.when(near, -ts).otherwise(F.col("path_length")).alias("c"),
        "archive_id", "file_id", F.col("phash").alias("keep_phash"), F.col("img_w").isNotNull().alias("has_dims"), F.col("ts").alias("keep_ts"),
    )
    g = members.groupBy("gkind", "gkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("real"), F.count_if("shadowed").alias("hidden"),
        F.min("archive_id").alias("lo"), F.max("archive_id").alias("hi"),
        F.min(F.when(ok, policy)).alias("keep"),
        F.min(F.when(ok, ts)).alias("ts_lo"), F.max(F.when(ok, ts)).alias("ts_hi"),
        F.min(F.struct("archive_id", "file_id")).alias("first"),
    )
    g = g.where((F.col("gkind") == "near") | (F.col("real") >= 2) | ((F.col("real") >= 1) & (F.col("hidden") >= 1)))
    if p.across_only:
        g = g.where("lo < hi")
    reason = F.when(near, F.when(F.col("keep.has_dims"), "highest-resolution").otherwise("largest")).otherwise(F.when(F.col("ts_lo") < F.col("ts_hi"), "newest").otherwise("clean-path"))
    return g.where("keep is not null").select(
        "gkind", "gkey", "n", F.col("keep.archive_id").alias("keep_archive"), F.col("keep.file_id").alias("keep_file"),
        "keep.keep_phash", "keep.keep_ts", reason.alias("reason"), "first",
    )


@dataclass
class DedupResult:
    """Tables of a run: one row per member, one per group (sorted, limited, numbered), one of totals.

    ``decided`` holds the members without their paths, labels and dates; ``members`` fetches these when it is read.
    """

    members: DataFrame
    decided: DataFrame
    groups: DataFrame
    totals: DataFrame


def run_dedup(files: DataFrame, archives: DataFrame, p: DedupParams | None = None) -> DedupResult:
    """Duplicate groups of the files in scope.

    Null paths, dates, sizes and fingerprints never fail: a null size is out of scope, a null date is older than any,
    a null fingerprint is compared by content only. Empty tables give empty tables and zero totals. Totals are taken
    before ``limit_groups``.
    """
    p = p or DedupParams()
    if not 0 <= p.threshold <= MAX_THRESHOLD:
        raise ValueError(f"the threshold is at most {MAX_THRESHOLD}")
    if p.sort not in SORTS:
        raise ValueError(f"sort by one of {', '.join(SORTS)}")
    scope = resolve_scope(archives, p.archives)
    if p.near and "phash_algo" in scope.columns:
        algos = [r[0] for r in scope.where("phash_algo is not null").select("phash_algo").distinct().limit(5).collect()]
        if len(algos) > 1:
            raise ValueError(f"fingerprints of different kinds can't be compared: {sorted(algos)}; index the older archives again")
    work, steps = (Scratch(files.sparkSession, label, tidy=True) for label in ("dedup", "dedup-steps"))
    rows = scoped_rows(files, archives, p)
    members = work.save(membership(rows, p, steps), "members")
    steps.clear()
    figures = work.save(group_figures(members, p), "figures")
    heavy = [k for k in _heavy(members, "gkey") if k is not None]
    joined = salted_lookup(members, shuffled(figures.drop("gkind", "first")), "gkey", heavy)
    is_keep = (F.col("archive_id") == F.col("keep_archive")) & (F.col("file_id") == F.col("keep_file"))
    hamming = F.when(F.col("gkind") == "near", distance(F.col("phash"), F.col("keep_phash"))).otherwise(0)
    live = ~is_keep & ~F.col("shadowed") & ~F.col("hardlink")
    actionable = live & ((F.col("gkind") == "exact") | F.coalesce(hamming <= p.threshold, F.lit(False)))
    out = joined.select(
        F.col("gkind").alias("match_kind"), "gkey", "archive_id", "file_id", "size", "content_hash", "phash", F.col("img_w").alias("width"), F.col("img_h").alias("height"),
        hamming.alias("hamming_to_keep"), is_keep.alias("keep"), F.when(is_keep, F.col("reason")).alias("keep_reason"), actionable.alias("actionable"), "shadowed", "sparse", "hardlink",
    )
    out = work.save(out, "out")
    work.drop(members)
    labels = scope.dropDuplicates(["archive_id"]).select("archive_id", F.col("label").alias("archive_label"), "indexed_unix")
    wide = files.where(scope_filter(p)).select("archive_id", "file_id", "path", "path_raw", "kind", "mtime_unix", "exif_unix", "exif_src").dropDuplicates(["archive_id", "file_id"])
    wide = wide.join(labels, "archive_id").select(
        "archive_id", "archive_label", "file_id", "path", "path_raw", "kind", "mtime_unix", "exif_unix", best_ts().alias("best_ts_unix"), best_ts_source().alias("best_ts_source")
    )
    full = out.join(shuffled(wide), ["archive_id", "file_id"]).withColumn("hardlink_of", F.when(F.col("hardlink"), F.col("path")))
    review = ~F.col("keep") & ~F.col("shadowed") & ~F.col("hardlink") & ~F.col("actionable")
    sums = out.groupBy("match_kind", "gkey").agg(
        F.max("hamming_to_keep").alias("max_distance"),
        F.sum(F.when(F.col("actionable"), F.col("size")).otherwise(0)).alias("reclaimable_bytes"),
        F.sum(F.when(review, F.col("size")).otherwise(0)).alias("review_only_bytes"),
        F.count_if("actionable").alias("duplicate_files"), F.count_if(review).alias("transitive_only_files"),
        F.sum(F.when(~F.col("keep") & F.col("shadowed"), F.col("size")).otherwise(0)).alias("shadowed_bytes"),
    )
    groups = figures.select(F.col("gkind").alias("match_kind"), "gkey", F.col("n").alias("members"), "keep_ts", F.col("first.archive_id").alias("_fa"), F.col("first.file_id").alias("_ff")).join(shuffled(sums), ["match_kind", "gkey"])
    groups = work.save(groups, "groups")
    work.drop(figures)
    totals = groups.agg(
        F.coalesce(F.sum("duplicate_files"), F.lit(0)).alias("duplicate_files"), F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"),
        F.coalesce(F.sum("transitive_only_files"), F.lit(0)).alias("transitive_only_files"), F.coalesce(F.sum("review_only_bytes"), F.lit(0)).alias("review_only_bytes"),
        F.coalesce(F.sum("shadowed_bytes"), F.lit(0)).alias("intra_archive_shadowed_bytes"), F.count(F.lit(1)).alias("groups_in_all"),
    )
    key = {"wasted": -F.col("reclaimable_bytes"), "count": -F.col("members"), "newest": -F.coalesce("keep_ts", F.lit(-(1 << 63) + 1).cast("long"))}[p.sort]
    ranked = groups.withColumn("_key", key)
    if p.limit_groups is not None:
        ranked = ranked.orderBy("_key", "_fa", "_ff").limit(p.limit_groups)
    numbered = split_running(ranked.withColumn("_one", F.lit(1)), [], ["_key", "_fa", "_ff"], "_one", "group", work)
    numbered = numbered.withColumnRenamed("group_n", "group_id").drop("group", "_one", "_key", "keep_ts", "_fa", "_ff")
    return DedupResult(full.drop("hardlink"), out, numbered, totals)
