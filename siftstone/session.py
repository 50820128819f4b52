"""Sessions, shared scratch tables and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "siftstone") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    A temporary folder stands in only where neither that setting nor a checkpoint folder exists, as in local tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset; a cluster must name a shared folder")
    made = tempfile.mkdtemp(prefix="siftstone-")
    spark.sparkContext.setCheckpointDir("file://" + made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


# Spark's own setting: shuffle files of an execution are removed when it ends
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Named tables in the shared folder. They cut lineage and outlive a lost executor.

    With ``tidy`` the shuffle files of a table go as soon as it is written, not when the driver collects its garbage.
    """

    def __init__(self, spark: SparkSession, label: str, tidy: bool = False):
        self.spark = spark
        self.tidy = tidy
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as read from the written table."""
        at = self.path(name)
        before = self.spark.conf.get(CLEAN_UP)
        if self.tidy:
            self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.parquet(at)
        finally:
            self.spark.conf.set(CLEAN_UP, before)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this scratch that nothing will read again."""
        for t in tables:
            at = getattr(t, "_scratch_path", None)
            if at and at.startswith(self.root):
                self._delete(at)

    def clear(self) -> None:
        """Delete all tables of this scratch."""
        self._delete(self.root)

    def _delete(self, at: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
