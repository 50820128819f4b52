"""The master catalogue: a registry of indexes and a replica of their files, usable while the sources are away.

Plain functions compute states over DataFrames; ``Catalog`` keeps them as Parquet: the registry as one small versioned
table, the files partitioned by archive, so that a replica is replaced by overwriting its partition only.
"""

from __future__ import annotations

import json
import os
import shutil
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftstone.functions.scalars import CONTENT_MODES, content_mode
from siftstone.plans.index import Index, IndexError_, _stat, read_meta, resolve_index
from siftstone.schema import ARCHIVES, FILES, REPLICA_COLUMNS
from siftstone.sources.entries import hash_file, hasher

# States of a registered index.
OK, STALE_INDEX, INDEX_MISSING, SOURCE_MISSING, INCOMPLETE, LIMITED = "ok", "stale-index", "db-missing", "archive-missing", "incomplete", "v2-limited"
FORMAT = "siftstone-catalog"


class CatalogError(ValueError):
    pass


# -- states as expressions, for registries of any size


def fresh_status(version: str = "schema_version", completed: str = "completed") -> Column:
    return F.when(F.col(version) == 2, LIMITED).when(F.coalesce(F.col(completed), F.lit(0)) != 1, INCOMPLETE).otherwise(OK)


def sync_states(registry: DataFrame, found: DataFrame) -> DataFrame:
    """The registry with ``new_status`` and ``action`` against ``found(db_path, index_uuid, completed, schema_version)``.

    An index that is away is db-missing and keeps its rows; one with another identity, or back again, is replicated
    anew; any other state is refreshed, which also clears what verify had found.
    """
    f = found.select("db_path", F.col("index_uuid").alias("_uuid"), F.col("completed").alias("_done"), F.col("schema_version").alias("_version"), F.lit(True).alias("_there"))
    j = registry.join(f, "db_path", "left")
    there = F.coalesce("_there", F.lit(False))
    again = there & (~F.col("_uuid").eqNullSafe(F.col("index_uuid")) | (F.col("status") == INDEX_MISSING))
    action = F.when(~there & (F.col("status") != INDEX_MISSING), "db-missing (rows retained)").when(again, "re-replicated")
    new = F.when(~there, INDEX_MISSING).otherwise(fresh_status("_version", "_done"))
    return j.select(*registry.columns, new.alias("new_status"), action.alias("action"))


def prunable(registry: DataFrame, now: int, days: int) -> DataFrame:
    """Registrations whose index is away and was not synced for so many days, or ever."""
    return registry.where((F.col("status") == INDEX_MISSING) & (F.col("synced_unix").isNull() | (F.col("synced_unix") < now - days * 86_400)))


def verify_states(registry: DataFrame, found: DataFrame, deep: bool = False) -> DataFrame:
    """The registry with ``new_status`` against ``found(source_path, cur_size, cur_mtime[, cur_hash])``.

    What was never stored makes nothing stale; what was stored and can't be read does. Folders have no fingerprint.
    """
    j = registry.join(found.withColumn("_there", F.lit(True)), "source_path", "left")
    differs = lambda a, b: F.col(a).isNotNull() & ~F.col(a).eqNullSafe(F.col(b))
    stale = differs("archive_size", "cur_size") | differs("archive_mtime_unix", "cur_mtime")
    if deep:
        stale = stale | differs("archive_blake3", "cur_hash")
    back = F.col("status").isin(STALE_INDEX, SOURCE_MISSING)
    new = (
        F.when(F.col("status").isin(INDEX_MISSING, LIMITED), F.col("status"))
        .when(F.col("_there").isNull(), SOURCE_MISSING)
        .when(F.col("source_type") == "dir", F.col("status"))
        .when(stale, STALE_INDEX)
        .when(back, F.when(F.col("completed") == 1, OK).otherwise(INCOMPLETE))
        .otherwise(F.col("status"))
    )
    return j.select(*registry.columns, new.alias("new_status"))


def skipped(registry: DataFrame) -> DataFrame:
    """``(archive_id, label, reason)`` of the archives that take no part in comparing contents."""
    reason = F.when(F.col("status") == LIMITED, "index of an old version without hashes; index the source again").when(
        content_mode("content_mode") == "metadata-only", "metadata only, no hashes; index it again in another mode"
    )
    return registry.select("archive_id", "label", reason.alias("reason")).where("reason is not null")


def upsert(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new take the place of registered ones with their identity or their path, and keep their number and date.

    A row that hits one registration by identity and another by path takes the number of the former, and both give way.
    Of two new rows with one identity or path the one with the lower number counts. Rows that hit nothing get numbers
    above the highest, in the order of their own.
    """
    r = registry.select(F.col("archive_id").alias("_id"), F.col("added_unix").alias("_added"), F.col("index_uuid").alias("_uuid"), F.col("db_path").alias("_path"))
    of = lambda c: W.partitionBy(c).orderBy("archive_id")
    once = new.withColumn("_u", F.row_number().over(of(F.coalesce("index_uuid", F.concat(F.lit("\0"), "db_path"))))).where("_u = 1").drop("_u")
    once = once.withColumn("_p", F.row_number().over(of("db_path"))).where("_p = 1").drop("_p")
    keys = once.select("archive_id", "index_uuid", "db_path").withColumnRenamed("archive_id", "_new")
    by_id = keys.join(r, F.col("index_uuid") == F.col("_uuid")).select("_new", "_id", "_added", F.lit(0).alias("_way"))
    by_path = keys.join(r, F.col("db_path") == F.col("_path")).select("_new", "_id", "_added", F.lit(1).alias("_way"))
    hits = by_id.unionByName(by_path)
    place = hits.groupBy("_new").agg(F.min(F.struct("_way", "_id", "_added")).alias("_h")).select("_new", "_h._id", "_h._added")
    # two new rows may hit one registration, by identity and by path: the first keeps its number
    place = place.withColumn("_k", F.row_number().over(W.partitionBy("_id").orderBy("_new"))).where("_k = 1").drop("_k")
    kept = registry.join(hits.select(F.col("_id").alias("archive_id")).distinct(), "archive_id", "left_anti")
    top = registry.agg(F.coalesce(F.max("archive_id"), F.lit(0)).alias("_top"))
    fresh = once.withColumnRenamed("archive_id", "_new").join(place, "_new", "left").join(F.broadcast(top))
    number = F.coalesce("_id", F.col("_top") + F.col("_new"))
    out = fresh.select(*[number.alias(c) if c == "archive_id" else F.coalesce("_added", "added_unix").alias(c) if c == "added_unix" else F.col(c) for c in registry.columns])
    return kept.unionByName(out)


# -- the catalogue on disk


class Catalog:
    """A catalogue folder. Only folders that carry its manifest, or are empty, are ever opened."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, os.path.abspath(at)

    @staticmethod
    def open(spark: SparkSession, at: str, create: bool = True) -> Catalog:
        c = Catalog(spark, at)
        manifest = os.path.join(c.at, "catalog.json")
        if os.path.islink(c.at):
            raise CatalogError(f"{at} is a symbolic link")
        if os.path.exists(manifest):
            with open(manifest) as f:
                if json.load(f).get("format") != FORMAT:
                    raise CatalogError(f"{at} is no catalogue")
        elif os.path.isdir(c.at) and os.listdir(c.at):
            raise CatalogError(f"{at} holds something else")
        elif not create:
            raise CatalogError(f"{at} does not exist")
        else:
            os.makedirs(c.at, exist_ok=True)
            c._save(c.spark.createDataFrame([], ARCHIVES), 0)
        return c

    @staticmethod
    def adhoc(spark: SparkSession, indexes: list[str]) -> tuple[DataFrame, DataFrame]:
        """(registry, files) of a few indexes, kept nowhere."""
        rows, files = [], []
        for i, at in enumerate(indexes, 1):
            rows.append(_identity(resolve_index(at), i))
            files.append(_replica(Index.open(spark, resolve_index(at)), i))
        return spark.createDataFrame(rows, ARCHIVES), reduce(DataFrame.unionByName, files)

    def _version(self) -> int:
        with open(os.path.join(self.at, "catalog.json")) as f:
            return json.load(f)["version"]

    def _save(self, registry: DataFrame, version: int) -> None:
        """Write the next version of the registry, then name it in the manifest: readers see the old or the new one."""
        registry.coalesce(1).write.parquet(os.path.join(self.at, f"archives-{version}"))
        tmp = os.path.join(self.at, ".catalog.json.tmp")
        with open(tmp, "w") as f:
            json.dump({"format": FORMAT, "version": version}, f)
        os.replace(tmp, os.path.join(self.at, "catalog.json"))
        for name in os.listdir(self.at):
            if name.startswith("archives-") and name not in (f"archives-{version}", f"archives-{version - 1}"):
                shutil.rmtree(os.path.join(self.at, name))

    def registry(self) -> DataFrame:
        return self.spark.read.schema(ARCHIVES).parquet(os.path.join(self.at, f"archives-{self._version()}"))

    def files(self) -> DataFrame:
        at = os.path.join(self.at, "files")
        wanted = [FILES[c] for c in REPLICA_COLUMNS]
        if not os.path.isdir(at):
            return self.spark.createDataFrame([], "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in wanted) + ">")
        stored = self.spark.read.parquet(at)
        return stored.select(*[F.col(f.name).cast(f.dataType) if f.name in stored.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])

    def list(self) -> DataFrame:
        return self.registry().orderBy("archive_id")

    def add(self, index_or_source: str) -> tuple[str, int]:
        """Register or refresh an index; returns (label, files)."""
        at = resolve_index(index_or_source)
        new = self.spark.createDataFrame([_identity(at, 1)], ARCHIVES)
        rows = upsert(self.registry(), new).collect()  # the registry is a small table: a row per archive
        mine = next(r for r in rows if r.db_path == os.path.abspath(at))
        replica = _replica(Index.open(self.spark, at), mine.archive_id)
        part = os.path.join(self.at, "files", f"archive_id={mine.archive_id}")
        staged = os.path.join(self.at, f".files-{mine.archive_id}-{time.time_ns()}")
        replica.drop("archive_id").write.parquet(staged)
        n = self.spark.read.parquet(staged).count()
        os.makedirs(os.path.dirname(part), exist_ok=True)
        if os.path.isdir(part):
            shutil.rmtree(part)
        os.rename(staged, part)
        out = [r.asDict() | ({"files_count": n} if r.archive_id == mine.archive_id else {}) for r in rows]
        self._save(self.spark.createDataFrame([tuple(r[f.name] for f in ARCHIVES.fields) for r in out], ARCHIVES), self._version() + 1)
        return mine.label, n

    def _set(self, states: dict[int, dict]) -> None:
        rows = [r.asDict() | states.get(r.archive_id, {}) for r in self.registry().collect()]
        self._save(self.spark.createDataFrame([tuple(r[f.name] for f in ARCHIVES.fields) for r in rows], ARCHIVES), self._version() + 1)

    def sync(self, prune_days: int | None = None) -> list[tuple[str, str]]:
        """Compare the registry with the indexes as they are; returns what was done as (label, action)."""
        now, found = int(time.time()), []
        for r in self.registry().collect():
            try:
                meta = read_meta(r.db_path)
                found.append((r.db_path, _identity(r.db_path, r.archive_id)[1], int(meta.get("completed", "0")), int(meta.get("schema_version", "0"))))
            except IndexError_:
                continue
        seen = self.spark.createDataFrame(found, "db_path string, index_uuid string, completed long, schema_version long")
        states = sync_states(self.registry(), seen).collect()
        changed, actions, again = {}, [], []
        for r in states:
            if r.action:
                actions.append((r.label, r.action))
            if r.action == "re-replicated":
                again.append(r.db_path)
            elif r.new_status == INDEX_MISSING:
                changed[r.archive_id] = {"status": INDEX_MISSING}
            else:
                size, mtime = _stat(r.db_path)
                changed[r.archive_id] = {"status": r.new_status, "db_size": size, "db_mtime_unix": mtime, "synced_unix": now}
        self._set(changed)
        for at in again:
            self.add(at)
        if prune_days is not None:
            for r in prunable(self.registry(), now, prune_days).collect():
                self.rm(str(r.archive_id))
                actions.append((r.label, "pruned"))
        return actions

    def verify(self, deep: bool = False) -> DataFrame:
        """Whether the indexes still describe their sources."""
        found = []
        for r in self.registry().collect():
            if os.path.exists(r.source_path):
                size, mtime = _stat(r.source_path)
                algo = self._algo(r.db_path)
                found.append((r.source_path, size, mtime, hash_file(r.source_path, algo) if deep and r.source_type == "tar" else None))
        seen = self.spark.createDataFrame(found, "source_path string, cur_size long, cur_mtime long, cur_hash string").dropDuplicates(["source_path"])
        states = verify_states(self.registry(), seen, deep).select("archive_id", "new_status").collect()
        self._set({r.archive_id: {"status": r.new_status} for r in states})
        return self.list()

    @staticmethod
    def _algo(index: str) -> str:
        try:
            return read_meta(index).get("hash_algo", "blake3")
        except IndexError_:
            return "blake3"

    def rm(self, key: str) -> None:
        """Forget a registration and its replica; the index itself is never touched."""
        rows = self.registry().collect()
        hits = [r.archive_id for r in rows if key in (str(r.archive_id), r.label, r.db_path, r.source_path)]
        if len(hits) != 1:
            raise CatalogError(f"no registered archive matches {key!r}" if not hits else f"{key!r} is ambiguous: {hits}; use the id")
        shutil.rmtree(os.path.join(self.at, "files", f"archive_id={hits[0]}"), ignore_errors=True)
        self._save(self.spark.createDataFrame([r for r in rows if r.archive_id != hits[0]], ARCHIVES), self._version() + 1)


def _identity(at: str, archive_id: int) -> tuple:
    """The registry row of an index."""
    at = os.path.abspath(at)
    m = read_meta(at)
    num = lambda k: int(m[k]) if m.get(k) else None
    size, mtime = _stat(at)
    now = int(time.time())
    version, completed = num("schema_version") or 0, num("completed") or 0
    mode = m.get("content_mode", "full")
    status = LIMITED if version == 2 else OK if completed else INCOMPLETE
    source = m.get("source", "")
    # indexes of the second version had no identity: it follows from their source and date
    known = m.get("index_uuid") or "v2:" + hasher("blake3", f"{source}|{m.get('created_unix', '')}".encode()).digest().hex()
    return (
        archive_id, known, at, source, m.get("source_type", "tar"), os.path.basename(source) or at, version, num("files_indexed") or 0, completed,
        num("created_unix"), num("archive_size"), num("archive_mtime_unix"), m.get("archive_fingerprint") or None, size, mtime,
        m.get("phash_algo") or None, mode if mode in CONTENT_MODES else "full", status, now, now,
    )


def _replica(index: Index, archive_id: int) -> DataFrame:
    """The metadata rows of an index under its number; columns that an older index lacks are null. An index of the second version has no hashes and replicates no rows."""
    files = index.files()
    if index.meta.get("schema_version") == "2":
        files = files.limit(0)
    cols = [F.col(c) if c in files.columns else F.lit(None).cast(FILES[c].dataType).alias(c) for c in REPLICA_COLUMNS if c != "archive_id"]
    return files.select(F.lit(archive_id).cast("long").alias("archive_id"), *cols)
