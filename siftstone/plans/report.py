"""Reports: the nested dedup report, search and registry output, text renderings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.scalars import fmt_unix, format_count, human_bytes, sanitize, truncate_path
from siftstone.operators.dedup import DedupParams, DedupResult, resolve_scope
from siftstone.operators.skew import shuffled
from siftstone.plans.catalog import INCOMPLETE, INDEX_MISSING, skipped
from siftstone.schema import hex64

# Fixed values of the report: the rules it was made by.
KEEP_POLICY = "exact:newest-then-clean-path; near:resolution-then-size-then-newest"
ACTIONABLE_RULE = "near:direct-to-keeper-within-threshold; exact:always; shadowed/hardlink:never"


def members_json(result: DedupResult, hash_prefix: str = "b3") -> DataFrame:
    """``(group_id, place, member)``: one JSON object per member, the kept one first, of the numbered groups.

    ``path_bytes`` is left out where the path is complete; every other missing value is an explicit null.
    """
    m = result.members.join(shuffled(result.groups.select("gkey", "match_kind", "group_id")), ["gkey", "match_kind"])
    raw = F.lower(F.hex("path_raw"))
    cols = [
        "archive_id", "archive_label", "file_id", "path", "kind", "size", F.concat(F.lit(hash_prefix + ":"), F.lower(F.hex("content_hash"))).alias("content_hash"),
        hex64(F.col("phash")).alias("phash"), "mtime_unix", "exif_unix", "best_ts_unix", "best_ts_source", "width", "height", "hamming_to_keep", "keep", "keep_reason",
        "actionable", "shadowed", "sparse", "hardlink_of",
    ]
    plain = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    lossy = F.to_json(F.struct(*cols[:4], raw.alias("path_bytes"), *cols[4:]), {"ignoreNullFields": "false"})
    place = F.struct((~F.col("keep")).alias("a"), F.col("archive_id").alias("b"), F.col("file_id").alias("c"))
    return m.select("group_id", place.alias("place"), F.when(F.col("path_raw").isNull(), plain).otherwise(lossy).alias("member"))


def dedup_report(result: DedupResult, archives: DataFrame, files: DataFrame, p: DedupParams) -> dict:
    """The whole report as one object, for a page of groups: run it with ``limit_groups`` where groups are many."""
    scope = resolve_scope(archives, p.archives)
    by_group: dict[int, list] = {}
    for r in members_json(result).orderBy("group_id", "place").toLocalIterator():
        by_group.setdefault(r.group_id, []).append(json.loads(r.member))
    groups = [
        {"group_id": g.group_id, "match_kind": g.match_kind, "max_distance": g.max_distance, "reclaimable_bytes": g.reclaimable_bytes, "review_only_bytes": g.review_only_bytes, "members": by_group.get(g.group_id, [])}
        for g in result.groups.orderBy("group_id").toLocalIterator()
    ]
    t = result.totals.first()
    regs = scope.orderBy("archive_id").collect()
    without = files.join(scope.select("archive_id"), "archive_id", "left_semi").where("kind = 'image' and phash is null").count()
    return {
        "version": 1,
        "params": {
            "exact": p.exact, "near": p.near, "threshold": p.threshold, "min_size": p.min_size, "include_empty": p.include_empty, "across_only": p.across_only,
            "keep_policy": KEEP_POLICY, "actionable_rule": ACTIONABLE_RULE, "images_grouped_perceptually": p.near,
        },
        "archives": [{"archive_id": a.archive_id, "label": a.label, "source": a.source_path, "source_type": a.source_type, "status": a.status, "content_mode": a.content_mode} for a in regs],
        "groups": groups,
        "summary": {
            "groups": len(groups), "duplicate_files": t.duplicate_files, "reclaimable_bytes": t.reclaimable_bytes, "transitive_only_files": t.transitive_only_files,
            "review_only_bytes": t.review_only_bytes, "archives_offline": [a.label for a in regs if a.status == INDEX_MISSING],
            "archives_incomplete": [a.label for a in regs if a.status == INCOMPLETE], "skipped_archives": [[r.label, r.reason] for r in skipped(scope).orderBy("archive_id").collect()],
            "images_without_phash": without, "intra_archive_shadowed_bytes": t.intra_archive_shadowed_bytes, "near_buckets_skipped": 0,
        },
    }


def exit_code(report: dict) -> int:
    """0 when all archives took part, 2 when some were left out."""
    s = report["summary"]
    return 2 if s["skipped_archives"] or s["archives_offline"] or s["archives_incomplete"] else 0


def registry_json(archives: DataFrame) -> list[dict]:
    return [
        {
            "archive_id": a.archive_id, "label": a.label, "source": a.source_path, "source_type": a.source_type, "db_path": a.db_path, "schema_version": a.schema_version,
            "files": a.files_count, "completed": bool(a.completed), "status": a.status, "indexed_unix": a.indexed_unix, "content_mode": a.content_mode,
        }
        for a in archives.orderBy("archive_id").collect()
    ]


def verify_json(archives: DataFrame) -> list[dict]:
    return [{"archive_id": a.archive_id, "label": a.label, "status": a.status, "source": a.source_path} for a in archives.orderBy("archive_id").collect()]


def group_lines(result: DedupResult, width: int = 60) -> DataFrame:
    """``(group_id, line)``: a readable line for each group."""
    keep = result.members.where("keep").select("gkey", "match_kind", "path", "best_ts_unix")
    g = result.groups.join(shuffled(keep), ["gkey", "match_kind"])
    return g.select(
        "group_id",
        F.concat(
            F.lit("#"), F.col("group_id").cast("string"), F.lit(" "), F.col("match_kind"), F.lit(": "), format_count("members"), F.lit(" files, "), human_bytes("reclaimable_bytes"),
            F.lit(" reclaimable; keep "), sanitize(truncate_path("path", width)), F.coalesce(F.concat(F.lit(" of "), fmt_unix("best_ts_unix")), F.lit("")),
        ).alias("line"),
    )


def hit_rows(hits: DataFrame, mode: str) -> list[dict]:
    """JSON objects of a page of hits; counts and snippets only where the contents are kept."""
    out = []
    for r in hits.collect():
        row = {"path": r.path, "matches": r.matches if mode == "full" else None}
        if r.path_raw is not None:
            row["path_bytes"] = bytes(r.path_raw).hex()
        if mode == "full" and "snippet" in hits.columns and r.snippet is not None:
            row["snippet"] = r.snippet
        out.append(row)
    return out




