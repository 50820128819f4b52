"""Problem 2: values that hold most rows, counted without a hot task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators.skew import split_counts
from siftstone.session import Scratch, table


def value_counts(files: DataFrame) -> DataFrame:
    """``(key_field, key, n)``: distinct file rows for every value of content_hash and of phash.

    Nulls of a field are left out of it, repeated rows of one key count once, other columns are not read. The value is
    kept as bytes: the hash itself, the fingerprint big-endian.
    """
    long_bytes = F.to_binary(F.lpad(F.hex("phash"), 16, "0"), F.lit("hex"))
    fields = F.array(
        F.struct(F.lit("content_hash").alias("key_field"), F.col("content_hash").alias("key")),
        F.struct(F.lit("phash").alias("key_field"), F.when(F.col("phash").isNotNull(), long_bytes).alias("key")),
    )
    rows = files.select("archive_id", "file_id", F.explode(fields).alias("f")).select("f.key_field", "f.key", "archive_id", "file_id").where("key is not null")
    return split_counts(rows, ["key_field", "key"], ["archive_id", "file_id"])


def heavy_values(files: DataFrame, share: float = 0.02) -> DataFrame:
    """``(key_field, key_hex)`` of the values that hold at least the given share of their field's rows."""
    counts = Scratch(files.sparkSession, "heavy").save(value_counts(files), "counts")
    totals = counts.groupBy("key_field").agg(F.sum("n").alias("total"))  # two rows
    return counts.join(F.broadcast(totals), "key_field").where(F.col("n") >= F.col("total") * share).select("key_field", F.lower(F.hex("key")).alias("key_hex"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_values(table(spark, sf_dir, "files"))


P2_SQL = """
WITH rows AS (SELECT DISTINCT archive_id, file_id, content_hash, phash FROM files),
v AS (
  SELECT 'content_hash' AS key_field, lower(hex(content_hash)) AS key_hex FROM rows WHERE content_hash IS NOT NULL
  UNION ALL SELECT 'phash', printf('%016x', phash) FROM rows WHERE phash IS NOT NULL
), n AS (SELECT key_field, key_hex, count(*) AS n FROM v GROUP BY ALL)
SELECT key_field, key_hex FROM n JOIN (SELECT key_field, sum(n) AS total FROM n GROUP BY 1) USING (key_field) WHERE n >= 0.02 * total
"""

P2_SPLIT_SQL = """
WITH rows AS (SELECT DISTINCT archive_id, file_id, content_hash, phash FROM files),
v AS (
  SELECT 'content_hash' AS key_field, lower(hex(content_hash)) AS key_hex FROM rows WHERE content_hash IS NOT NULL
  UNION ALL SELECT 'phash', printf('%016x', phash) FROM rows WHERE phash IS NOT NULL
)
SELECT key_field, key_hex, count(*) AS n FROM v GROUP BY ALL
"""


def p2_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counts(table(spark, sf_dir, "files")).select("key_field", F.lower(F.hex("key")).alias("key_hex"), "n")
