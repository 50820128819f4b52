"""Queries over the catalogue tables and the SQL that checks them."""

from __future__ import annotations

import gzip
import io
import os
import tarfile
import tempfile
from collections.abc import Callable
from urllib.parse import urlparse

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftstone.functions import scalars as fn
from siftstone.operators import heavy, search
from siftstone.operators.components import connected_components
from siftstone.operators.dedup import DedupParams, run_dedup, scope_filter
from siftstone.operators.hamming import bands16, hamming_pairs
from siftstone.operators.links import latest_per_path, mark_shadowed, resolve_hardlinks
from siftstone.operators.skew import split_running
from siftstone.operators.words import top_words, word_freq
from siftstone.plans import catalog
from siftstone.plans.report import group_lines, members_json
from siftstone.schema import SHADOWED, comparable, distinct_rows, has_flag, hex64, in_scope
from siftstone.session import Scratch, table
from siftstone.sources.entries import register

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": heavy.p2_found, "p2_value_counts": heavy.p2_value_counts}
ORACLE_SQL: dict[str, str] = {"p2_found": heavy.P2_SQL, "p2_value_counts": heavy.P2_SPLIT_SQL}
DOC_KEYS = ["archive_id", "doc_id"]


def query(sql: str | None = None):
    """Register a query of (files or another table's DataFrame...) under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files")


EXT = r"regexp_extract(lower(path), '[^/]\.([^./]*)/*\z', 1)"
KIND = f"""CASE WHEN {EXT} IN ('jpg','jpeg','png','heic','webp','tif','tiff') THEN 'image'
  WHEN {EXT} IN ('nef','cr2','cr3','arw','dng') THEN 'raw' WHEN {EXT} IN ('mp4','mov','avi','mkv') THEN 'video' END"""
MARKER = r"""regexp_matches(regexp_extract(lower(path), '([^/]+?)(\.[^./]*)?/*\z', 1), 'copy|\([0-9]*\)\z|_[0-9]{1,3}\z')"""
ROWS = """SELECT DISTINCT ON (f.archive_id, f.file_id) f.*, a.label, coalesce(f.exif_unix, f.mtime_unix, a.indexed_unix) AS ts,
  (f.flags & 16) <> 0 AS shadowed, f.entry_type = 'hardlink' AS hardlink
  FROM files f JOIN archives a USING (archive_id)
  WHERE f.content_hash IS NOT NULL AND f.entry_type <> 'symlink' AND (f.flags & 8) = 0 AND f.kind <> 'empty' AND f.size >= 1"""


# -- scans and derived columns


@query(f"SELECT archive_id, file_id, {EXT} AS ext, {KIND} AS media FROM files")
def scan_media_kind(spark, d):
    return files(spark, d).select("archive_id", "file_id", fn.ext_lower("path").alias("ext"), fn.media_kind("path").alias("media"))


@query(f"SELECT archive_id, file_id, CASE WHEN size = 0 THEN 'empty' ELSE coalesce({KIND}, 'binary') END AS kind FROM files")
def scan_metadata_kind(spark, d):
    return files(spark, d).select("archive_id", "file_id", fn.metadata_kind("path", "size").alias("kind"))


@query(f"SELECT archive_id, file_id, {EXT} IN ('jpg','jpeg','png','webp','tif','tiff') AS decodable FROM files")
def decodable_image(spark, d):
    return files(spark, d).select("archive_id", "file_id", fn.is_decodable_image("path").alias("decodable"))


@query(f"SELECT archive_id, file_id, {MARKER} AS marked FROM files")
def conflict_marker(spark, d):
    return files(spark, d).select("archive_id", "file_id", fn.has_conflict_marker("path").alias("marked"))


@query(
    """SELECT archive_id, file_id, coalesce(exif_unix, mtime_unix, indexed_unix) AS best_ts,
  CASE WHEN exif_unix IS NOT NULL THEN coalesce('exif:' || exif_src, 'exif') WHEN mtime_unix IS NOT NULL THEN 'tar-mtime'
    WHEN indexed_unix IS NOT NULL THEN 'archive-date' ELSE 'none' END AS ts_source
  FROM files JOIN archives USING (archive_id)"""
)
def best_timestamp(spark, d):
    j = files(spark, d).join(table(spark, d, "archives").select("archive_id", "indexed_unix"), "archive_id")
    return j.select("archive_id", "file_id", fn.best_ts().alias("best_ts"), fn.best_ts_source().alias("ts_source"))


@query(
    """SELECT archive_id, file_id, array_to_string(list_filter([CASE WHEN flags & 1 <> 0 THEN 'fts-truncated' END, CASE WHEN flags & 2 <> 0 THEN 'image-over-cap' END,
  CASE WHEN flags & 4 <> 0 THEN 'read-error' END, CASE WHEN flags & 8 <> 0 THEN 'sparse' END, CASE WHEN flags & 16 <> 0 THEN 'shadowed' END,
  CASE WHEN flags & 32 <> 0 THEN 'decode-failed' END, CASE WHEN flags & 64 <> 0 THEN 'pax-unparsed' END], lambda x: x IS NOT NULL), ',') AS names FROM files"""
)
def flags_decode(spark, d):
    return files(spark, d).select("archive_id", "file_id", fn.flag_names("flags").alias("names"))


@query(
    """SELECT archive_id, file_id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KiB', size / 1024.0)
  WHEN size < 1073741824 THEN printf('%.1f MiB', size / 1048576.0) ELSE printf('%.1f GiB', size / 1073741824.0) END AS human FROM files"""
)
def human_sizes(spark, d):
    return files(spark, d).select("archive_id", "file_id", fn.human_bytes("size").alias("human"))


@query("SELECT archive_id, file_id, strftime(make_timestamp(mtime_unix * 1000000), '%Y-%m-%d %H:%M') AS at FROM files")
def format_times(spark, d):
    return files(spark, d).select("archive_id", "file_id", fn.fmt_unix("mtime_unix").alias("at"))


@query("SELECT archive_id, format('{:,}', db_size) AS size FROM archives")
def format_counts(spark, d):
    return table(spark, d, "archives").select("archive_id", fn.format_count("db_size").alias("size"))


@query("SELECT archive_id, file_id, CASE WHEN length(path) <= 24 THEN path ELSE '…' || right(path, 23) END AS short FROM files")
def truncate_paths(spark, d):
    return files(spark, d).select("archive_id", "file_id", fn.truncate_path("path", 24).alias("short"))


@query("SELECT doc_id, translate(text, chr(9) || chr(10) || chr(13) || chr(133), '␉␊␍' || chr(65533)) AS clean FROM documents")
def sanitize_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.sanitize("text").alias("clean"))


@query("SELECT archive_id, file_id, exif_unix AS parsed FROM files WHERE exif_unix IS NOT NULL AND exif_unix BETWEEN -62135596800 AND 253402300799")
def exif_dates(spark, d):
    """Dates written in the form that cameras use and read back."""
    f = files(spark, d).where("exif_unix between -62135596800 and 253402300799")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("exif_unix") / 86400).cast("int"))
    s = F.pmod("exif_unix", F.lit(86400))
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    text = F.concat_ws(":", F.concat(F.date_format(day, "yyyy:MM:dd"), F.lit(" "), two(F.floor(s / 3600))), two(F.floor(s % 3600 / 60)), two(s % 60))
    return f.select("archive_id", "file_id", fn.exif_unix(text).alias("parsed"))


@query(
    """SELECT archive_id, file_id, printf('%016x', phash) AS hex, bit_count(phash) BETWEEN 2 AND 62 AS telling,
  (phash >> 48) & 65535 AS b0, (phash >> 32) & 65535 AS b1, (phash >> 16) & 65535 AS b2, phash & 65535 AS b3 FROM files WHERE phash IS NOT NULL"""
)
def hash_bands(spark, d):
    b = bands16("phash")
    bits = F.bit_count("phash").between(2, 62)
    return files(spark, d).where("phash is not null").select("archive_id", "file_id", hex64(F.col("phash")).alias("hex"), bits.alias("telling"), *[b[i].cast("long").alias(f"b{i}") for i in range(4)])


@query("SELECT archive_id, coalesce(nullif(regexp_extract(source_path, '([^/]*)/*\\z', 1), ''), regexp_extract(db_path, '([^/]*)/*\\z', 1)) AS label FROM archives")
def archive_labels(spark, d):
    return table(spark, d, "archives").select("archive_id", fn.archive_label("source_path", "db_path").alias("label"))


@query(
    """SELECT a.archive_id, CASE WHEN max(m.value) IN ('full', 'search-only', 'metadata-only') THEN max(m.value) ELSE 'full' END AS mode
  FROM archives a LEFT JOIN index_meta m ON m.archive_id = a.archive_id AND m.key = 'content_mode' GROUP BY 1"""
)
def content_modes(spark, d):
    m = table(spark, d, "index_meta").where("key = 'content_mode'").groupBy("archive_id").agg(F.max("value").alias("v"))
    return table(spark, d, "archives").select("archive_id").join(m, "archive_id", "left").select("archive_id", fn.content_mode("v").alias("mode"))


@query("SELECT archive_id, max(value) FILTER (key = 'schema_version') AS version, max(value) FILTER (key = 'completed') AS completed, count(DISTINCT key) AS keys FROM index_meta GROUP BY 1")
def meta_lookup(spark, d):
    m = table(spark, d, "index_meta")
    return m.groupBy("archive_id").agg(
        F.max(F.when(F.col("key") == "schema_version", F.col("value"))).alias("version"), F.max(F.when(F.col("key") == "completed", F.col("value"))).alias("completed"), F.countDistinct("key").alias("keys")
    )


# -- filters


@query(
    f"""SELECT archive_id, file_id FROM files WHERE content_hash IS NOT NULL AND entry_type <> 'symlink' AND (flags & 8) = 0 AND size >= 4096 AND kind = 'image'
  AND (lower(path) LIKE '%.jpg' OR lower(path) LIKE '%.png')"""
)
def scope_filters(spark, d):
    p = DedupParams(kind="image", exts=["JPG", ".png"], min_size=4096)
    return files(spark, d).where(scope_filter(p)).select("archive_id", "file_id")


@query("SELECT archive_id, file_id, path FROM files WHERE path GLOB '*/m[0-4]*/*_?*.*'")
def glob_paths(spark, d):
    return files(spark, d).where(F.col("path").rlike(fn.glob_regex("*/m[0-4]*/*_?*.*"))).select("archive_id", "file_id", "path")


@query("SELECT archive_id, file_id FROM files WHERE entry_type = 'file' AND content_hash IS NOT NULL AND kind IS DISTINCT FROM 'empty' AND size >= 1 AND (flags & 24) = 0")
def in_scope_rows(spark, d):
    return files(spark, d).where(in_scope()).select("archive_id", "file_id")


# -- aggregates


@query("SELECT content_hash IS NULL AS unhashed, kind, count(*) AS n, sum(size) AS bytes FROM files GROUP BY ALL")
def kinds(spark, d):
    return files(spark, d).groupBy(F.col("content_hash").isNull().alias("unhashed"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(
    """SELECT archive_id, count(*) AS files, count(*) FILTER (kind = 'text') AS texts, count(*) FILTER (kind IN ('image', 'raw', 'video')) AS media,
  count(*) FILTER (kind = 'link') AS links, count(*) FILTER (flags & 4 <> 0) AS read_errors, count(*) FILTER (flags & 8 <> 0) AS sparse,
  count(*) FILTER (kind = 'image' AND phash IS NULL) AS images_without_phash FROM (SELECT DISTINCT ON (archive_id, file_id) * FROM files) GROUP BY 1"""
)
def index_summary(spark, d):
    f = distinct_rows(files(spark, d), "kind", "flags", "phash")
    k = F.col("kind")
    return f.groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(k == "text").alias("texts"), F.count_if(k.isin("image", "raw", "video")).alias("media"), F.count_if(k == "link").alias("links"),
        F.count_if(has_flag(4)).alias("read_errors"), F.count_if(has_flag(8)).alias("sparse"), F.count_if((k == "image") & F.col("phash").isNull()).alias("images_without_phash"),
    )


@query("SELECT archive_id, path, max(file_id) AS last_id FROM files GROUP BY 1, 2")
def latest_rows(spark, d):
    return latest_per_path(files(spark, d))


@query("SELECT archive_id, file_id FROM (SELECT DISTINCT archive_id, file_id, path FROM files) QUALIFY file_id < max(file_id) OVER (PARTITION BY archive_id, path)")
def shadowed_rows(spark, d):
    return mark_shadowed(files(spark, d).withColumn("flags", F.lit(0).cast("long"))).where(has_flag(SHADOWED)).select("archive_id", "file_id").distinct()


@query("SELECT * FROM (VALUES (1, 1, 'AA'), (1, 2, 'AA'), (1, 3, 'AA'), (1, 4, 'BB'), (1, 5, NULL), (1, 6, NULL), (1, 7, 'BB')) t(archive_id, file_id, hash)")
def hardlink_chain(spark, d):
    """Links to links, and a link whose target's latest row has no hash."""
    rows = [
        (1, 1, "a", "file", None, b"\xaa"), (1, 2, "b", "hardlink", "a", None), (1, 3, "c", "hardlink", "b", None), (1, 4, "d", "file", None, b"\xbb"),
        (1, 5, "d", "file", None, None), (1, 6, "e", "hardlink", "d", None), (1, 7, "f", "file", None, b"\xbb"),
    ]
    f = spark.createDataFrame(rows, "archive_id int, file_id int, path string, entry_type string, link_target string, content_hash binary")
    return resolve_hardlinks(f).select("archive_id", "file_id", F.hex("content_hash").alias("hash"))


@query(
    """WITH RECURSIVE f AS (SELECT DISTINCT archive_id, file_id, path, content_hash FROM files),
  l AS (SELECT f.archive_id, f.file_id, f.path, f.file_id % 3 <> 2 AND p.path IS NOT NULL AS link, p.path AS target, f.content_hash FROM f LEFT JOIN f p ON p.archive_id = f.archive_id AND p.file_id = f.file_id - 1),
  t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY archive_id, path ORDER BY file_id DESC) = 1),
  walk AS (SELECT archive_id, file_id, target AS at, 1 AS hop FROM l WHERE link
    UNION ALL SELECT w.archive_id, w.file_id, t.target, hop + 1 FROM walk w JOIN t ON t.archive_id = w.archive_id AND t.path = w.at WHERE t.link AND hop < 5)
  SELECT w.archive_id, w.file_id, lower(hex(t.content_hash)) AS hash FROM walk w JOIN t ON t.archive_id = w.archive_id AND t.path = w.at WHERE NOT t.link AND t.content_hash IS NOT NULL"""
)
def hardlink_files(spark, d):
    """Two of three rows as links to the path of the row before them: what hash each link gets."""
    f = distinct_rows(files(spark, d), "path", "content_hash")
    before = f.select("archive_id", (F.col("file_id") + 1).alias("file_id"), F.col("path").alias("link_target"))
    f = f.join(before, ["archive_id", "file_id"], "left").withColumn("link", F.col("link_target").isNotNull() & (F.col("file_id") % 3 != 2))
    f = f.withColumn("entry_type", F.when(F.col("link"), "hardlink").otherwise("file")).withColumn("content_hash", F.when(~F.col("link"), F.col("content_hash")))
    return resolve_hardlinks(f).where("link and content_hash is not null").select("archive_id", "file_id", F.lower(F.hex("content_hash")).alias("hash"))


@query(
    f"""WITH r AS ({ROWS}) SELECT lower(hex(content_hash)) AS content_hash, count(*) AS n, count(DISTINCT archive_id) AS archives, sum(size) AS bytes FROM r GROUP BY 1
  HAVING count(*) FILTER (NOT shadowed AND NOT hardlink) >= 2 OR (count(*) FILTER (NOT shadowed AND NOT hardlink) >= 1 AND count(*) FILTER (shadowed) >= 1)"""
)
def exact_groups(spark, d):
    f = files(spark, d).join(table(spark, d, "archives").select("archive_id"), "archive_id", "left_semi").where(scope_filter(DedupParams()))
    r = distinct_rows(f, "content_hash", "size", "flags", "entry_type")
    ok = ~has_flag(SHADOWED) & (F.col("entry_type") != "hardlink")
    g = r.groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("archive_id").alias("archives"), F.sum("size").alias("bytes"), F.count_if(ok).alias("real"), F.count_if(has_flag(SHADOWED)).alias("hidden")
    )
    return g.where("real >= 2 or (real >= 1 and hidden >= 1)").select(F.lower(F.hex("content_hash")).alias("content_hash"), "n", "archives", "bytes")


EXACT = f"""WITH r AS ({ROWS}), g AS (SELECT content_hash FROM r GROUP BY 1
    HAVING count(*) FILTER (NOT shadowed AND NOT hardlink) >= 2 OR (count(*) FILTER (NOT shadowed AND NOT hardlink) >= 1 AND count(*) FILTER (shadowed) >= 1)
), m AS (SELECT r.*, NOT shadowed AND NOT hardlink AS ok, {MARKER} AS marked FROM r JOIN g USING (content_hash)
), k AS (SELECT *, ok AND row_number() OVER (PARTITION BY content_hash ORDER BY ok DESC, ts DESC NULLS LAST, marked, octet_length(encode(path)), archive_id, file_id) = 1 AS keep,
    max(ts) FILTER (ok) OVER (PARTITION BY content_hash) IS DISTINCT FROM min(ts) FILTER (ok) OVER (PARTITION BY content_hash)
      OR (count(*) FILTER (ok) OVER (PARTITION BY content_hash) <> count(ts) FILTER (ok) OVER (PARTITION BY content_hash) AND count(ts) FILTER (ok) OVER (PARTITION BY content_hash) > 0) AS differ
  FROM m)"""


@query(
    EXACT + """ SELECT lower(hex(content_hash)) AS gkey, archive_id, file_id, keep, CASE WHEN keep THEN CASE WHEN differ THEN 'newest' ELSE 'clean-path' END END AS keep_reason,
  NOT keep AND NOT shadowed AND NOT hardlink AS actionable FROM k"""
)
def exact_members_keep(spark, d):
    m = run_dedup(files(spark, d), table(spark, d, "archives"), DedupParams(near=False)).decided
    return m.select("gkey", "archive_id", "file_id", "keep", "keep_reason", "actionable")


@query(
    EXACT + """ SELECT archive_id, coalesce(sum(size) FILTER (NOT keep AND NOT shadowed AND NOT hardlink), 0) AS reclaimable, count(*) AS members FROM k GROUP BY 1"""
)
def reclaimable_by_archive(spark, d):
    m = run_dedup(files(spark, d), table(spark, d, "archives"), DedupParams(near=False)).decided
    return m.groupBy("archive_id").agg(F.sum(F.when(F.col("actionable"), F.col("size")).otherwise(0)).alias("reclaimable"), F.count(F.lit(1)).alias("members"))


GROUPS = (
    EXACT
    + """, s AS (SELECT content_hash, count(*) AS members, min((archive_id, file_id)) AS first, max(ts) FILTER (keep) AS keep_ts,
  coalesce(sum(size) FILTER (NOT keep AND NOT shadowed AND NOT hardlink), 0) AS reclaimable_bytes, count(DISTINCT archive_id) AS archives FROM k GROUP BY 1)"""
)
TOP = " SELECT row_number() OVER (ORDER BY {key} DESC NULLS LAST, first) AS group_id, lower(hex(content_hash)) AS gkey, members, reclaimable_bytes FROM s {where} ORDER BY 1 LIMIT 25"


def _top(spark, d, sort: str, **more):
    g = run_dedup(files(spark, d), table(spark, d, "archives"), DedupParams(near=False, sort=sort, limit_groups=25, **more)).groups
    return g.select("group_id", "gkey", "members", "reclaimable_bytes")


@query(GROUPS + TOP.format(key="reclaimable_bytes", where=""))
def groups_top_wasted(spark, d):
    return _top(spark, d, "wasted")


@query(GROUPS + TOP.format(key="members", where=""))
def groups_top_count(spark, d):
    return _top(spark, d, "count")


@query(GROUPS + TOP.format(key="keep_ts", where=""))
def groups_top_newest(spark, d):
    return _top(spark, d, "newest")


@query(GROUPS + TOP.format(key="reclaimable_bytes", where="WHERE archives >= 2"))
def groups_across_archives(spark, d):
    return _top(spark, d, "wasted", across_only=True)


@query(
    EXACT + """ SELECT count(*) FILTER (NOT keep AND NOT shadowed AND NOT hardlink) AS duplicate_files, coalesce(sum(size) FILTER (NOT keep AND NOT shadowed AND NOT hardlink), 0) AS reclaimable_bytes,
  coalesce(sum(size) FILTER (NOT keep AND shadowed), 0) AS intra_archive_shadowed_bytes, count(DISTINCT content_hash) AS groups_in_all FROM k"""
)
def dedup_totals(spark, d):
    t = run_dedup(files(spark, d), table(spark, d, "archives"), DedupParams(near=False, limit_groups=3)).totals
    return t.select("duplicate_files", F.col("reclaimable_bytes"), "intra_archive_shadowed_bytes", "groups_in_all")


# -- fingerprints

VALS = """SELECT DISTINCT phash AS h FROM files WHERE kind = 'image' AND bit_count(phash) BETWEEN 2 AND 62"""
PAIRS = f"""vals AS ({VALS}), bands AS (SELECT h, b, (h >> (48 - 16 * b)) & 65535 AS v FROM vals, range(4) t(b)),
  links AS MATERIALIZED (SELECT DISTINCT x.h AS a, y.h AS b FROM bands x JOIN bands y ON x.b = y.b AND x.v = y.v AND x.h < y.h AND bit_count(xor(x.h, y.h)) <= 3)"""


def _vals(spark, d):
    return files(spark, d).where(comparable()).select("phash")


for _t in range(4):

    def _pairs(spark, d, t=_t):
        p = hamming_pairs(_vals(spark, d), "phash", t)
        return p.select("a", "b", F.col("distance").cast("long").alias("distance"))

    QUERIES[f"hamming_pairs_t{_t}"] = _pairs
    ORACLE_SQL[f"hamming_pairs_t{_t}"] = f"WITH {PAIRS} SELECT a, b, CAST(bit_count(xor(a, b)) AS BIGINT) AS distance FROM links WHERE bit_count(xor(a, b)) <= {_t}"


@query(f"WITH {PAIRS} SELECT b AS band, v AS value, count(*) AS n FROM bands GROUP BY ALL HAVING count(*) > 1")
def band_bucket_sizes(spark, d):
    v = _vals(spark, d).distinct().select(F.posexplode(bands16("phash")).alias("band", "value"))
    g = v.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.select(F.col("band").cast("long").alias("band"), F.col("value").cast("long").alias("value"), "n")


@query(
    f"""WITH RECURSIVE {PAIRS}, sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach AS (SELECT DISTINCT a, a AS b FROM sym UNION SELECT r.a, l.b FROM reach r JOIN sym l ON r.b = l.a)
  SELECT a AS v, min(b) AS component FROM reach GROUP BY 1"""
)
def near_components(spark, d):
    return connected_components(hamming_pairs(_vals(spark, d), "phash", 3))


NEAR = f"""WITH RECURSIVE r AS ({ROWS}), img AS (SELECT * FROM r WHERE kind = 'image' AND bit_count(phash) BETWEEN 2 AND 62 AND NOT shadowed AND NOT hardlink),
  vals AS (SELECT phash AS h, count(*) AS n FROM img GROUP BY 1), bands AS (SELECT h, b, (h >> (48 - 16 * b)) & 65535 AS v FROM vals, range(4) t(b)),
  links AS MATERIALIZED (SELECT DISTINCT x.h AS a, y.h AS b FROM bands x JOIN bands y ON x.b = y.b AND x.v = y.v AND x.h <> y.h AND bit_count(xor(x.h, y.h)) <= 3),
  reach AS (SELECT h AS a, h AS b FROM vals UNION SELECT r2.a, l.b FROM reach r2 JOIN links l ON r2.b = l.a),
  label AS (SELECT a AS h, min(b) AS low, count(*) AS k FROM reach GROUP BY 1),
  near AS (SELECT img.*, printf('%016x', low) AS gkey FROM img JOIN label ON phash = h JOIN vals USING (h) WHERE k > 1 OR vals.n > 1),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY gkey ORDER BY coalesce(img_w, 0)::BIGINT * coalesce(img_h, 0) DESC, size DESC, ts DESC NULLS LAST, archive_id, file_id) = 1 AS keep FROM near),
  kept AS (SELECT gkey, phash AS keep_phash FROM ranked WHERE keep)"""


@query(
    NEAR + """ SELECT gkey, archive_id, file_id, keep, CAST(bit_count(xor(phash, keep_phash)) AS INTEGER) AS hamming_to_keep,
  NOT keep AND bit_count(xor(phash, keep_phash)) <= 3 AS actionable, CASE WHEN keep THEN CASE WHEN img_w IS NOT NULL THEN 'highest-resolution' ELSE 'largest' END END AS keep_reason
  FROM ranked JOIN kept USING (gkey)"""
)
def near_keep_actionable(spark, d):
    m = run_dedup(files(spark, d), table(spark, d, "archives"), DedupParams(exact=False)).decided
    return m.select("gkey", "archive_id", "file_id", "keep", "hamming_to_keep", "actionable", "keep_reason")


@query(
    NEAR + """, rest AS (SELECT r.* FROM r LEFT JOIN near ON r.archive_id = near.archive_id AND r.file_id = near.file_id WHERE near.gkey IS NULL),
  ex AS (SELECT lower(hex(content_hash)) AS gkey, count(*) AS n FROM rest GROUP BY 1
    HAVING count(*) FILTER (NOT shadowed AND NOT hardlink) >= 2 OR (count(*) FILTER (NOT shadowed AND NOT hardlink) >= 1 AND count(*) FILTER (shadowed) >= 1))
  SELECT 'exact' AS match_kind, gkey, n AS members FROM ex UNION ALL SELECT 'near', gkey, count(*) FROM near GROUP BY 2"""
)
def near_then_exact(spark, d):
    g = run_dedup(files(spark, d), table(spark, d, "archives")).groups
    return g.select("match_kind", "gkey", "members")


# -- words and search

@query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM documents),
  k AS (SELECT doc_id, lower(w) AS word FROM w WHERE length(w) BETWEEN 3 AND 32)
  SELECT word, count(*) AS total_count, count(DISTINCT doc_id) AS doc_count FROM k GROUP BY 1"""
)
def word_freq_ascii(spark, d):
    """Word counts over the words that hold ASCII letters only, on which both engines' classes of letters agree."""
    docs = table(spark, d, "documents").withColumn("text", F.regexp_replace("text", "[^A-Za-z]+", " "))
    return word_freq(docs)


@query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '(?:[^\p{L}\p{M}\p{N}]|[\x{300}-\x{344}\x{346}-\x{36f}\x{93c}\x{94d}\x{951}-\x{954}\x{e47}-\x{e4c}\x{e4e}])+')) AS w FROM documents),
  k AS (SELECT doc_id, lower(w) AS word FROM w WHERE length(w) BETWEEN 3 AND 32 AND octet_length(encode(w)) BETWEEN 3 AND 128)
  SELECT word, count(*) AS total_count, count(DISTINCT doc_id) AS doc_count FROM k GROUP BY 1"""
)
def word_freq_all(spark, d):
    """The words of all scripts. The SQL names the marks that count as letters: all but those in its second class."""
    return word_freq(table(spark, d, "documents"))


@query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM documents),
  k AS (SELECT doc_id, lower(w) AS word FROM w WHERE length(w) BETWEEN 3 AND 32),
  f AS (SELECT word, count(*) AS total_count, count(DISTINCT doc_id) AS doc_count FROM k GROUP BY 1),
  t AS (SELECT *, row_number() OVER (ORDER BY total_count DESC, word) AS rank FROM f QUALIFY rank <= 20)
  SELECT CAST(rank AS INTEGER) AS rank, word, total_count, doc_count, round(100.0 * total_count / sum(total_count) OVER (), 4) AS pct,
    repeat('█', CAST(floor(20.0 * total_count / max(total_count) OVER () + 0.5) AS INTEGER)) AS bar FROM t"""
)
def top_words_20(spark, d):
    return top_words(word_freq_ascii(spark, d), 20)


@query(
    ORACLE_SQL["word_freq_all"].replace("SELECT word, count(*)", ", f AS (SELECT word, count(*)")
    + """), t AS (SELECT *, row_number() OVER (ORDER BY total_count DESC, word) AS rank FROM f QUALIFY rank <= 20)
  SELECT CAST(rank AS INTEGER) AS rank, word, total_count, doc_count, round(100.0 * total_count / sum(total_count) OVER (), 4) AS pct,
    repeat('█', CAST(floor(20.0 * total_count / max(total_count) OVER () + 0.5) AS INTEGER)) AS bar FROM t"""
)
def top_words_all_20(spark, d):
    """The ranking of the words as they are, in all scripts; ``top_words_20`` ranks what its SQL can tell apart."""
    return top_words(word_freq_all(spark, d), 20)


TOKENS = r"""docs AS (SELECT archive_id, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
  tok AS (SELECT archive_id, doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS at FROM docs)"""


def _index(spark, d):
    """Texts are searched with their marks as they stand, so that both engines see the same tokens."""
    docs = table(spark, d, "documents").select(*DOC_KEYS, F.lit("").alias("path"), F.regexp_replace("text", r"\p{M}", " ").alias("content"))
    return search.postings(docs, DOC_KEYS)


def _docs(spark, d, q):
    return search.search(_index(spark, d), q, DOC_KEYS)


TERM = f"WITH {TOKENS.replace('lower(text)', chr(39).join(['lower(regexp_replace(text, ', chr(92) + 'p{M}', ', ', ' ', ', ', 'g', '))']))}"


@query(TERM + " SELECT archive_id, doc_id, count(*) AS matches FROM tok WHERE term = 'notebook' GROUP BY 1, 2")
def search_term(spark, d):
    return _docs(spark, d, "notebook").select(*DOC_KEYS, "matches")


@query(TERM + " SELECT DISTINCT a.archive_id, a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.at = a.at + 1 WHERE a.term = 'reading' AND b.term = 'room'")
def search_phrase(spark, d):
    return _docs(spark, d, '"reading room"').select(*DOC_KEYS)


@query(TERM + " SELECT archive_id, doc_id, count(*) AS matches FROM tok WHERE term LIKE 'relab%' GROUP BY 1, 2")
def search_prefix(spark, d):
    return _docs(spark, d, "relab*").select(*DOC_KEYS, "matches")


@query(
    TERM + """, s AS (SELECT archive_id, doc_id, list(DISTINCT term) AS l FROM tok GROUP BY 1, 2)
  SELECT archive_id, doc_id FROM s WHERE (list_contains(l, 'catalogue') OR list_contains(l, 'inventory')) AND list_contains(l, 'hallway') AND NOT list_contains(l, 'boathouse')"""
)
def search_boolean(spark, d):
    return _docs(spark, d, "(catalogue OR inventory) hallway NOT boathouse").select(*DOC_KEYS)


@query(
    TERM + """ SELECT DISTINCT a.archive_id, a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id
  WHERE a.term = 'restore' AND b.term = 'entry' AND greatest(b.at - a.at - 1, a.at - b.at - 1) <= 3"""
)
def search_near(spark, d):
    return _docs(spark, d, "NEAR(restore entry, 3)").select(*DOC_KEYS)


@query(TERM + " SELECT archive_id, doc_id FROM tok WHERE term = 'notes' AND tok.at = 0")
def search_initial(spark, d):
    return _docs(spark, d, "content : ^notes").select(*DOC_KEYS)


BM25 = (
    TERM
    + """, f AS (SELECT archive_id, doc_id, term, count(*) AS f FROM tok WHERE term IN ('ledger', 'timetable') GROUP BY ALL),
  n AS (SELECT term, count(*) AS df FROM f GROUP BY 1), s AS (SELECT count(*)::DOUBLE AS rows, avg(len(t)) AS average FROM docs),
  r AS (SELECT f.archive_id, f.doc_id, count(*) AS terms, -sum(greatest(1e-6, ln((rows - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / average))) AS rank
    FROM f JOIN n USING (term) JOIN docs ON docs.doc_id = f.doc_id, s GROUP BY 1, 2)"""
)


@query(BM25 + " SELECT archive_id, doc_id, round(rank, 6) AS rank FROM r WHERE terms = 2 ORDER BY r.rank, archive_id, doc_id LIMIT 20")
def search_bm25_top(spark, d):
    return _docs(spark, d, "ledger AND timetable").orderBy("rank", *DOC_KEYS).limit(20).select(*DOC_KEYS, F.round("rank", 6).alias("rank"))


@query(
    TERM
    + """, f AS (SELECT archive_id, doc_id, count(*) AS f FROM tok WHERE term = 'ledger' GROUP BY ALL), n AS (SELECT archive_id, count(*) AS df FROM f GROUP BY 1),
  s AS (SELECT archive_id, count(*)::DOUBLE AS rows, avg(len(t)) AS average FROM docs GROUP BY 1),
  r AS (SELECT f.archive_id, f.doc_id, round(-(greatest(1e-6, ln((rows - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / average))), 9) AS rank
    FROM f JOIN n USING (archive_id) JOIN s USING (archive_id) JOIN docs ON docs.doc_id = f.doc_id)
  SELECT archive_id, doc_id, round(rank, 6) AS rank, row_number() OVER (PARTITION BY archive_id ORDER BY rank, doc_id) AS place FROM r QUALIFY place <= 3"""
)
def search_federated(spark, d):
    keys = DOC_KEYS
    got = search.federated_ranks(_index(spark, d), "ledger", keys, None)
    return search.federated(got.withColumn("rank", F.round("rank", 9)), ["doc_id"], 3).select(*keys, F.round("rank", 6).alias("rank"), F.col("place").cast("long").alias("place"))


@query(
    r"""WITH p AS (SELECT DISTINCT archive_id, file_id, path FROM files),
  x AS (SELECT archive_id, doc_id, regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+') AS c, regexp_split_to_array(lower(strip_accents(path)), '[^\p{L}\p{N}]+') AS p FROM documents JOIN p USING (archive_id, file_id))
  SELECT archive_id, doc_id FROM x WHERE (list_contains(c, 'releve') OR list_contains(c, 'prufung') OR list_contains(p, 'report')) AND NOT (list_contains(p, 'copy') OR list_contains(c, 'cafe'))"""
)
def search_folded(spark, d):
    """Over path and content, case and accents folded, with a column filter."""
    docs = table(spark, d, "documents").join(distinct_rows(files(spark, d), "path"), ["archive_id", "file_id"])
    index = search.postings(docs.select(*DOC_KEYS, "path", F.col("text").alias("content")), DOC_KEYS)
    return search.search(index, "(content : relevé OR content : Prufung OR path : REPORT) NOT (path : copy OR content : café)", DOC_KEYS).select(*DOC_KEYS)


@query(
    TERM + """, m AS (SELECT a.archive_id, a.doc_id, count(*) AS matches FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.at = a.at + 1 WHERE a.term = 'reading' AND b.term = 'room' GROUP BY 1, 2)
  SELECT * FROM m WHERE doc_id NOT IN (SELECT doc_id FROM tok WHERE starts_with(term, 'relab'))"""
)
def search_inverted(spark, d):
    """By an inverted index in the shared folder, of which only the postings of the query's terms are read."""
    at = Scratch(spark, "inverted").path("index")
    search.Inverted.of(_index(spark, d), DOC_KEYS).write(at, DOC_KEYS)
    return search.search(search.Inverted.read(spark, at), '"reading room" NOT relab*', DOC_KEYS).select(*DOC_KEYS, "matches")


@query()
def search_snippets(spark, d):
    hits = _docs(spark, d, '"reading room" OR vault*').orderBy("rank", *DOC_KEYS).limit(20)
    docs = table(spark, d, "documents").select(*DOC_KEYS, F.col("text").alias("content"))
    return search.snippets(hits.join(docs, DOC_KEYS), '"reading room" OR vault*').drop("content")


# -- catalogue


@query("SELECT archive_id, label, status, files_count, completed = 1 AS completed, row_number() OVER (ORDER BY archive_id) AS place FROM archives")
def catalog_list(spark, d):
    a = table(spark, d, "archives").withColumn("one", F.lit(1))
    return split_running(a, [], ["archive_id"], "one", "run").select("archive_id", "label", "status", "files_count", (F.col("completed") == 1).alias("completed"), F.col("run_n").alias("place"))


def _found(spark, d):
    """What a walk over the index folders would find, as the key-value pairs tell it."""
    m = table(spark, d, "index_meta")
    v = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    g = m.groupBy("archive_id").agg(v("index_uuid").alias("index_uuid"), v("completed").cast("long").alias("completed"), v("schema_version").cast("long").alias("schema_version"))
    return g.where("index_uuid is not null").join(table(spark, d, "archives").select("archive_id", "db_path"), "archive_id").drop("archive_id")


@query(
    """WITH m AS (SELECT archive_id, max(value) FILTER (key = 'index_uuid') AS u, max(value) FILTER (key = 'completed') AS c, max(value) FILTER (key = 'schema_version') AS v FROM index_meta GROUP BY 1)
  SELECT a.archive_id, CASE WHEN u IS NULL THEN 'db-missing' WHEN v = '2' THEN 'v2-limited' WHEN coalesce(c, '0') <> '1' THEN 'incomplete' ELSE 'ok' END AS new_status,
    CASE WHEN u IS NULL THEN CASE WHEN status <> 'db-missing' THEN 'db-missing (rows retained)' END WHEN u <> a.index_uuid OR status = 'db-missing' THEN 're-replicated' END AS action
  FROM archives a LEFT JOIN m USING (archive_id)"""
)
def catalog_sync(spark, d):
    return catalog.sync_states(table(spark, d, "archives"), _found(spark, d)).select("archive_id", "new_status", "action")


@query(
    """SELECT archive_id, CASE WHEN status IN ('db-missing', 'v2-limited') THEN status WHEN archive_id % 7 = 0 THEN 'archive-missing' WHEN source_type = 'dir' THEN status
    WHEN archive_size IS NOT NULL AND archive_id % 5 = 0 THEN 'stale-index' WHEN status IN ('stale-index', 'archive-missing') THEN CASE WHEN completed = 1 THEN 'ok' ELSE 'incomplete' END
    ELSE status END AS new_status FROM archives"""
)
def catalog_verify(spark, d):
    """Sources as if every seventh archive were away and every fifth had grown by a byte."""
    a = table(spark, d, "archives")
    grown = F.when(F.col("archive_id") % 5 == 0, F.col("archive_size") + 1).otherwise(F.col("archive_size"))
    found = a.where("archive_id % 7 <> 0").select("source_path", grown.alias("cur_size"), F.col("archive_mtime_unix").alias("cur_mtime"))
    return catalog.verify_states(a, found).select("archive_id", "new_status")


@query("SELECT archive_id FROM archives WHERE status = 'db-missing' AND (synced_unix IS NULL OR synced_unix < 1700000000 - 30 * 86400)")
def catalog_prunable(spark, d):
    return catalog.prunable(table(spark, d, "archives"), 1_700_000_000, 30).select("archive_id")


@query(
    """SELECT archive_id, label, CASE WHEN status = 'v2-limited' THEN 'index of an old version without hashes; index the source again'
    ELSE 'metadata only, no hashes; index it again in another mode' END AS reason FROM archives WHERE status = 'v2-limited' OR content_mode = 'metadata-only'"""
)
def skipped_archives(spark, d):
    return catalog.skipped(table(spark, d, "archives"))


@query("SELECT archive_id, db_path, CASE WHEN archive_id % 2 = 0 THEN 'new-' || archive_id ELSE index_uuid END AS index_uuid FROM archives")
def catalog_upsert(spark, d):
    """Half of the indexes registered again with a new identity: they keep their numbers."""
    a = table(spark, d, "archives")
    again = a.where("archive_id % 2 = 0").withColumn("index_uuid", F.concat(F.lit("new-"), F.col("archive_id").cast("string")))
    return catalog.upsert(a, again).select("archive_id", "db_path", "index_uuid")


# -- archives written from the texts and read again


def _write_texts(spark, d, kind: str) -> str:
    """The texts as files of tar archives (plain, gzip of many members, zstd of many frames) or of a folder; returns the place in the shared folder.

    Each task writes its own archive, under another name until it is complete, so that a repeated task changes nothing.
    """
    root = urlparse(Scratch(spark, kind).path("texts")).path
    os.makedirs(root)

    def write(batches):
        no = TaskContext.get().partitionId()
        if kind == "folder":
            for b in batches:
                for archive, doc, text in zip(b["archive_id"], b["doc_id"], b["text"]):
                    os.makedirs(f"{root}/{archive}", exist_ok=True)
                    with open(f"{root}/{archive}/.{doc}.part", "wb") as f:
                        f.write(text.encode())
                    os.replace(f"{root}/{archive}/.{doc}.part", f"{root}/{archive}/{doc}.txt")
            yield pd.DataFrame({"at": [root]})
            return
        at = f"{root}/{no:05d}"
        with tempfile.NamedTemporaryFile(dir=root, delete=False) as f:
            with tarfile.open(fileobj=f, mode="w") as tar:
                for b in batches:
                    for archive, doc, text in zip(b["archive_id"], b["doc_id"], b["text"]):
                        data = text.encode()
                        m = tarfile.TarInfo(f"{archive}/{doc}.txt")
                        m.size = len(data)
                        tar.addfile(m, io.BytesIO(data))
        pack = (lambda x: x, gzip.compress, zstandard.ZstdCompressor().compress)[no % 3]
        with open(f.name, "rb") as plain, open(f.name + ".packed", "wb") as out:
            while block := plain.read(1 << 18):
                out.write(pack(block))
        os.unlink(f.name)
        os.replace(f.name + ".packed", at)
        yield pd.DataFrame({"at": [at]})

    docs = table(spark, d, "documents").where("text is not null").select("archive_id", "doc_id", "text").repartition(6, "doc_id")
    made = docs.mapInPandas(write, "at string").distinct().collect()  # a name for each of the six tasks
    return "\n".join(sorted(r["at"] for r in made))


TEXT_ENTRIES = """SELECT archive_id || '/' || doc_id || '.txt' AS path, 'file' AS entry_type, CASE WHEN text = '' THEN 'empty' ELSE 'text' END AS kind,
  octet_length(encode(text)) AS size, sha256(text) AS hash, CASE WHEN text <> '' THEN length(replace(text, chr(1), '')) END AS n_chars, 0 AS flags FROM documents WHERE text IS NOT NULL"""


def _read_texts(spark, name: str, at: str) -> DataFrame:
    register(spark)
    rows = spark.read.format(name).option("algo", "sha256").load(at)
    return rows.select("path", "entry_type", "kind", "size", F.lower(F.hex("content_hash")).alias("hash"), F.char_length("content").cast("long").alias("n_chars"), "flags")


@query(TEXT_ENTRIES)
def archive_entries(spark, d):
    """Every entry of tar, gzip and zstd archives with its kind, hash and text."""
    return _read_texts(spark, "tar_entries", _write_texts(spark, d, "tars"))


@query(TEXT_ENTRIES)
def folder_entries(spark, d):
    return _read_texts(spark, "dir_entries", _write_texts(spark, d, "folder"))


# -- running figures over skewed keys


@query("SELECT archive_id, file_id, sum(size) OVER w AS running, row_number() OVER w AS running_n FROM (SELECT DISTINCT archive_id, file_id, size FROM files) WINDOW w AS (PARTITION BY archive_id ORDER BY file_id)")
def running_sizes(spark, d):
    return split_running(distinct_rows(files(spark, d), "size"), ["archive_id"], ["file_id"], "size").select("archive_id", "file_id", "running", "running_n")


@query("SELECT archive_id, file_id, row_number() OVER (PARTITION BY archive_id ORDER BY size DESC, file_id) AS place FROM (SELECT DISTINCT archive_id, file_id, size FROM files) QUALIFY place <= 3")
def largest_per_archive(spark, d):
    w = W.partitionBy("archive_id").orderBy(F.desc("size"), "file_id")
    f = distinct_rows(files(spark, d), "size").withColumn("place", F.row_number().over(w))  # cut in the scan stage by the group limit
    return f.where("place <= 3").select("archive_id", "file_id", F.col("place").cast("long").alias("place"))


# -- reports


@query()
def report_members_json(spark, d):
    r = run_dedup(files(spark, d), table(spark, d, "archives"), DedupParams())
    return members_json(r).select("group_id", "member")


@query()
def report_lines(spark, d):
    return group_lines(run_dedup(files(spark, d), table(spark, d, "archives"), DedupParams()))
