"""Rows of one source that refer to each other by path: shadowed rows, latest rows, hard links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.schema import SHADOWED
from siftstone.session import Scratch

ROUNDS = 5  # links to links are followed so many times


def latest_per_path(files: DataFrame) -> DataFrame:
    """``(archive_id, path, last_id)``: the latest entry of each path."""
    return files.groupBy("archive_id", "path").agg(F.max("file_id").alias("last_id"))


def mark_shadowed(files: DataFrame) -> DataFrame:
    """files with the shadowed flag set on all rows of a path but the latest.

    The latest row comes from a combining aggregate, so that a path that occurs very often makes no large window.
    Rows with a null path share the path null.
    """
    last = latest_per_path(files).withColumnRenamed("path", "_p").withColumnRenamed("archive_id", "_a")
    joined = files.join(last, (F.col("archive_id") == F.col("_a")) & F.col("path").eqNullSafe(F.col("_p")))
    flags = F.coalesce("flags", F.lit(0).cast("long"))
    return joined.select(*[(F.when(F.col("file_id") < F.col("last_id"), flags.bitwiseOR(SHADOWED)).otherwise(flags).alias("flags") if c == "flags" else F.col(c)) for c in files.columns])


def resolve_hardlinks(files: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """files with content_hash of hard links taken from the latest row of their target path.

    A target whose latest row has no hash leaves the link without one; chains of links are followed ``rounds`` times.
    Only link rows are followed, through the latest rows of the paths that links name; all other rows pass as they are.
    A link without a target, or to itself, has no hash.
    """
    work = Scratch(files.sparkSession, "links")
    need = F.coalesce((F.col("entry_type") == "hardlink") & F.col("content_hash").isNull(), F.lit(False))
    links = work.save(files.where(need & F.col("link_target").isNotNull()).select("archive_id", "file_id", "link_target").distinct(), "links")
    named = links.select("archive_id", F.col("link_target").alias("path")).distinct()
    ahead = F.struct(F.col("content_hash").alias("hash"), F.when(need, F.col("link_target")).alias("next"))
    latest = files.join(named, ["archive_id", "path"], "left_semi").groupBy("archive_id", "path").agg(F.max_by(ahead, "file_id").alias("to"))
    latest = work.save(latest.select("archive_id", F.col("path").alias("_at"), "to.hash", "to.next"), "latest")
    at = latest
    for k in range(1, rounds):  # a row for each path that a link names, one step further each time
        step = latest.select("archive_id", F.col("_at").alias("next"), F.col("hash").alias("_hash"), F.col("next").alias("_next"))
        at = work.save(at.join(step, ["archive_id", "next"], "left").select("archive_id", "_at", F.coalesce("hash", "_hash").alias("hash"), F.col("_next").alias("next")), f"step{k}")
    found = links.join(at.where("hash is not null").select("archive_id", F.col("_at").alias("link_target"), F.col("hash").alias("_hash")), ["archive_id", "link_target"])
    found = found.select("archive_id", "file_id", "_hash")
    linked = files.where(need).join(found, ["archive_id", "file_id"], "left")
    return files.where(~need).unionByName(linked.select(*[F.col("_hash").alias(c) if c == "content_hash" else F.col(c) for c in files.columns]))


def inspect_path(files: DataFrame, path: str) -> DataFrame:
    """Every row of a path, in order of archive and entry."""
    return files.where(F.col("path") == path).orderBy("archive_id", "file_id")
