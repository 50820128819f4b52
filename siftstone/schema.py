"""Schemas, flag bits and scope rules of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data model: flag bits of a file row.
FTS_TRUNCATED, IMAGE_OVER_CAP, READ_ERROR, SPARSE, SHADOWED, DECODE_FAILED, PAX_UNPARSED = 1, 2, 4, 8, 16, 32, 64
FLAG_NAMES = {
    FTS_TRUNCATED: "fts-truncated",
    IMAGE_OVER_CAP: "image-over-cap",
    READ_ERROR: "read-error",
    SPARSE: "sparse",
    SHADOWED: "shadowed",
    DECODE_FAILED: "decode-failed",
    PAX_UNPARSED: "pax-unparsed",
}
TEXT_CAP, MEDIA_CAP, PROBE = 16 << 20, 64 << 20, 8 << 10

FILES = T.StructType(
    [
        T.StructField("archive_id", T.LongType(), False),
        T.StructField("file_id", T.LongType(), False),
        T.StructField("path", T.StringType()),
        T.StructField("path_raw", T.BinaryType()),
        T.StructField("entry_type", T.StringType()),
        T.StructField("link_target", T.StringType()),
        T.StructField("link_target_raw", T.BinaryType()),
        T.StructField("kind", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime_unix", T.LongType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("exif_unix", T.LongType()),
        T.StructField("exif_src", T.StringType()),
        T.StructField("content_hash", T.BinaryType()),
        T.StructField("phash", T.LongType()),
        T.StructField("img_w", T.IntegerType()),
        T.StructField("img_h", T.IntegerType()),
        T.StructField("flags", T.LongType()),
    ]
)

REPLICA_COLUMNS = [
    "archive_id", "file_id", "path", "path_raw", "entry_type", "kind", "size", "mtime_unix", "exif_unix", "exif_src",
    "content_hash", "phash", "img_w", "img_h", "flags",
]

ARCHIVES = T.StructType(
    [
        T.StructField("archive_id", T.LongType(), False),
        T.StructField("index_uuid", T.StringType()),
        T.StructField("db_path", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("schema_version", T.LongType()),
        T.StructField("files_count", T.LongType()),
        T.StructField("completed", T.LongType()),
        T.StructField("indexed_unix", T.LongType()),
        T.StructField("archive_size", T.LongType()),
        T.StructField("archive_mtime_unix", T.LongType()),
        T.StructField("archive_blake3", T.StringType()),
        T.StructField("db_size", T.LongType()),
        T.StructField("db_mtime_unix", T.LongType()),
        T.StructField("phash_algo", T.StringType()),
        T.StructField("content_mode", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("added_unix", T.LongType()),
        T.StructField("synced_unix", T.LongType()),
    ]
)


def has_flag(bit: int, flags: str | Column = "flags") -> Column:
    c = F.col(flags) if isinstance(flags, str) else flags
    return c.bitwiseAND(F.lit(bit).cast("long")) != 0


def in_scope() -> Column:
    """Rows that take part in content comparison: hashed, non-empty regular files, neither sparse nor shadowed.

    A null in any tested column puts the row out of scope, but for ``kind`` and ``flags``: a null kind is not
    'empty', and null flags are no flags.
    """
    return (
        (F.col("entry_type") == "file")
        & F.col("content_hash").isNotNull()
        & ~F.col("kind").eqNullSafe("empty")
        & (F.col("size") >= 1)
        & (F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(SPARSE | SHADOWED) == 0)
    )


def comparable(kind: str = "kind", phash: str = "phash") -> Column:
    """Pictures whose fingerprint carries enough structure to compare: 2 to 62 bits set."""
    return (F.col(kind) == "image") & F.bit_count(F.col(phash)).between(2, 62)


def hex64(c: Column) -> Column:
    """16 lower-case digits of the unsigned value; null stays null."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def unsigned_order(c: Column) -> Column:
    """A long whose signed order is the unsigned order of c (its own inverse)."""
    return c.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def distinct_rows(files: DataFrame, *columns: str) -> DataFrame:
    """The named columns, repeated rows of one (archive_id, file_id) counted once."""
    return files.select("archive_id", "file_id", *columns).dropDuplicates(["archive_id", "file_id"])
