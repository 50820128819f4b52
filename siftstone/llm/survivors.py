"""Problem 4: the best representative of each duplicate group.

Skyline selection. A record has three dimensions: completeness (how many fields it has), trust (of its date's source) and
its place in the keep order (recency, unmarked name, shorter path, lowest key; no two records share a place). It is
dominated by another of its group that is at least as good in all three and better in one. The survivor is the first of
the undominated records by a lexicographic policy, which is an argument. A field that it lacks is filled from the
successive dominance layers: from the first layer that offers a value, and of that layer by the field's own policy.

A group is never gathered: completeness and trust have few levels, so the records of a group fall into at most
``2**3 * 5`` cells, and the first of a cell in keep order dominates the rest of it. The cells are reduced with map-side
combining, and layers are counted over the cells' first records.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.scalars import best_ts, has_conflict_marker
from siftstone.schema import in_scope
from siftstone.session import table

# Sources of a capture date, the most trusted first; anything else, null included, comes last.
TRUST = ["DateTimeOriginal", "DateTimeDigitized", "DateTime"]

#: What a policy may go by, each so that the lesser value is the better one.
CRITERIA = {
    "order": lambda r: r["order"],
    "completeness": lambda r: -r["full"],
    "trust": lambda r: r["trust"],
    "path_length": lambda r: r["order"]["len"],
}
DATES_BY_TRUST = {"exif_unix": ("trust", "order")}
FIELDS = {"mtime_unix": "m", "img_dims": "d", "exif_unix": "e"}


def _dominates(s: Column, r: Column) -> Column:
    no_worse = (s["full"] >= r["full"]) & (s["trust"] <= r["trust"]) & (s["order"] <= r["order"])
    return no_worse & ((s["full"] > r["full"]) | (s["trust"] < r["trust"]) | (s["order"] < r["order"]))


def _having(*names: str) -> Callable[[Column], Column]:
    return lambda x: reduce(lambda c, n: c[n], names, x)


def layered(records: Column, kind: str) -> Column:
    """The records of an array, of that type, with their dominance layer: 0 for the undominated, n for those that only layers below n dominate."""
    # better ones first: whatever dominates a record stands before it
    ordered = F.transform(
        F.array_sort(F.transform(records, lambda r: F.struct((-r["full"]).alias("f"), r["trust"].alias("t"), r["order"].alias("o"), r.alias("r")))), lambda x: x["r"]
    )
    empty = F.array().cast(f"array<struct<layer:int,r:{kind}>>")
    below = lambda acc, r: F.array_max(F.transform(F.filter(acc, lambda s: _dominates(s["r"], r)), lambda s: s["layer"]))
    return F.aggregate(ordered, empty, lambda acc, r: F.concat(acc, F.array(F.struct((F.coalesce(below(acc, r), F.lit(-1)) + 1).alias("layer"), r.alias("r")))))


def survivors(
    files: DataFrame, archives: DataFrame, policy: tuple[str, ...] = ("order",), field_policy: dict[str, tuple[str, ...]] | None = None, layers_of_all: bool = False
) -> DataFrame:
    """``(content_hash, field, archive_id, file_id)`` for every content with two or more different in-scope rows.

    ``policy`` names criteria (see CRITERIA) that decide among the undominated records, ties going by keep order;
    ``field_policy`` the same for single fields, where left out: dates by trust. Fields are filled from the layers among the records that offer them or,
    with ``layers_of_all``, from the layers of the whole group.

    Repeated rows of one key count once; a null date is older than any other; a null path counts as longest and
    unmarked; a field that is null in all rows of its group gives no row; an empty table gives no rows. An archive that
    is missing from the registry has no date of indexing.
    """
    field_policy = DATES_BY_TRUST if field_policy is None else field_policy
    seen = archives.groupBy("archive_id").agg(F.max("indexed_unix").alias("indexed_unix"))
    rows = files.where(in_scope()).select("archive_id", "file_id", "path", "content_hash", "exif_unix", "exif_src", "mtime_unix", F.col("img_w").isNotNull().alias("has_dims"))
    rows = rows.join(seen, "archive_id", "left")
    lowest = F.lit(-(1 << 63)).cast("long")
    trust = F.lit(len(TRUST))
    for k, name in reversed(list(enumerate(TRUST))):
        trust = F.when(F.col("exif_src") == name, k).otherwise(trust)
    has_exif, has_mtime = F.col("exif_unix").isNotNull(), F.col("mtime_unix").isNotNull()
    cell = rows.select(
        "content_hash", has_exif.alias("e"), has_mtime.alias("m"), F.col("has_dims").alias("d"),
        F.when(has_exif, trust).otherwise(len(TRUST) + 1).alias("trust"), "archive_id", "file_id",
        F.struct(
            (-F.coalesce(best_ts(), lowest + 1)).alias("ts"), F.coalesce(has_conflict_marker("path"), F.lit(False)).alias("marked"),
            F.coalesce(F.octet_length("path"), F.lit(2**31 - 1)).alias("len"), "archive_id", "file_id",
        ).alias("order"),
    )
    cells = cell.groupBy("content_hash", "e", "m", "d", "trust").agg(
        F.min("order").alias("order"), *[f(c).alias(f"{w}_{c}") for c in ("archive_id", "file_id") for w, f in (("lo", F.min), ("hi", F.max))]
    )
    full = F.col("e").cast("int") + F.col("m").cast("int") + F.col("d").cast("int")
    group = cells.groupBy("content_hash").agg(
        F.collect_list(F.struct("order", "e", "m", "d", "trust", full.alias("full"))).alias("cells"),
        F.min("lo_archive_id").alias("la"), F.max("hi_archive_id").alias("ha"), F.min("lo_file_id").alias("lf"), F.max("hi_file_id").alias("hf"),
    )
    group = group.where("la < ha or lf < hf")
    kind = group.schema["cells"].dataType.elementType.simpleString()
    group = group.withColumn("layers", layered(F.col("cells"), kind))

    def first(of: Column, by: tuple[str, ...], every_layer: bool) -> Column:
        """The first record of the lowest layer (or of layer 0) by a policy, and in keep order where that leaves ties."""
        if not every_layer:
            of = F.filter(of, lambda x: x["layer"] == 0)
        key = lambda x: F.struct(x["layer"].alias("layer"), *[CRITERIA[c](x["r"]).alias(f"c{i}") for i, c in enumerate(by)], x["r"]["order"].alias("o"))
        best = F.array_min(F.transform(of, key))
        return F.struct(best["o"]["archive_id"].alias("archive_id"), best["o"]["file_id"].alias("file_id"))

    picks = [("record", first(F.col("layers"), policy, False))]
    for name, flag in FIELDS.items():
        by = field_policy.get(name, policy)
        if layers_of_all:
            picks.append((name, first(F.filter("layers", _having("r", flag)), by, True)))
        else:
            # nothing dominates a record that offers the field but lacks what others have: those without the field are left out before layers are counted
            offering, all_offer = F.filter("cells", _having(flag)), F.forall("cells", _having(flag))
            picks.append((name, F.when(all_offer, first(F.col("layers"), by, False)).otherwise(first(layered(offering, kind), by, False))))
    out = group.select(F.lower(F.hex("content_hash")).alias("content_hash"), F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("row")) for n, c in picks])).alias("p"))
    return out.select("content_hash", "p.field", "p.row.archive_id", "p.row.file_id").where("archive_id is not null")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The required order is the keep order, dates by trust before it."""
    return survivors(table(spark, sf_dir, "files"), table(spark, sf_dir, "archives"), policy=("order",), field_policy=DATES_BY_TRUST)


P4_SQL = r"""
WITH rows AS (
  SELECT DISTINCT ON (f.archive_id, f.file_id) f.*, coalesce(f.exif_unix, f.mtime_unix, a.indexed_unix) AS ts,
    regexp_extract(lower(f.path), '([^/]+?)(\.[^./]*)?/*$', 1) AS stem
  FROM files f LEFT JOIN archives a USING (archive_id)
  WHERE f.entry_type = 'file' AND f.content_hash IS NOT NULL AND f.kind IS DISTINCT FROM 'empty' AND f.size >= 1 AND (f.flags & 24) = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY ts DESC NULLS LAST,
      regexp_matches(stem, 'copy|\([0-9]*\)$|_[0-9]{1,3}$'), octet_length(encode(path)), archive_id, file_id) AS k,
    count(*) OVER (PARTITION BY content_hash) AS n,
    CASE exif_src WHEN 'DateTimeOriginal' THEN 0 WHEN 'DateTimeDigitized' THEN 1 WHEN 'DateTime' THEN 2 ELSE 3 END AS trust
  FROM rows
)
SELECT lower(hex(content_hash)) AS content_hash, field, p.archive_id AS archive_id, p.file_id AS file_id FROM (
  SELECT content_hash, 'record' AS field, arg_min({'archive_id': archive_id, 'file_id': file_id}, k) AS p FROM ranked WHERE n > 1 GROUP BY 1
  UNION ALL SELECT content_hash, 'mtime_unix', arg_min({'archive_id': archive_id, 'file_id': file_id}, k) FROM ranked WHERE n > 1 AND mtime_unix IS NOT NULL GROUP BY 1
  UNION ALL SELECT content_hash, 'img_dims', arg_min({'archive_id': archive_id, 'file_id': file_id}, k) FROM ranked WHERE n > 1 AND img_w IS NOT NULL GROUP BY 1
  UNION ALL SELECT content_hash, 'exif_unix', arg_min({'archive_id': archive_id, 'file_id': file_id}, (trust, k)) FROM ranked WHERE n > 1 AND exif_unix IS NOT NULL GROUP BY 1)
"""
