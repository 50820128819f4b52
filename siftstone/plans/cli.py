"""Command line: ``python -m siftstone index|search|top|master|dedup|inspect``.

Exit codes: 0 done, 1 failed, 2 done but with something left out.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftstone.functions.scalars import flag_names, fmt_unix, human_bytes, parse_size
from siftstone.operators.dedup import DedupParams, run_dedup
from siftstone.operators.links import inspect_path
from siftstone.operators.search import parse, search, snippets
from siftstone.operators.words import top_words
from siftstone.plans.catalog import INCOMPLETE, Catalog
from siftstone.plans.index import Index, IndexError_, build_index, discover
from siftstone.plans.outpath import ProtectedSet, write_new_file
from siftstone.plans.report import dedup_report, exit_code, group_lines, hit_rows, registry_json, verify_json
from siftstone.session import local_session

KEYS = ["archive_id", "file_id"]


def _arguments() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="siftstone")
    sub = a.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index")
    c.add_argument("source")
    c.add_argument("--db")
    c.add_argument("--mode", default="full", choices=["full", "search-only", "metadata-only"])
    c.add_argument("--no-word-stats", action="store_true")
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("source", nargs="?")
    c.add_argument("--db")
    c.add_argument("--all", action="store_true")
    c.add_argument("--master", default="master.catalog")
    c.add_argument("-n", "--limit", type=int, default=20)
    c.add_argument("--json", action="store_true")
    c = sub.add_parser("top")
    c.add_argument("source", nargs="?")
    c.add_argument("--db")
    c.add_argument("-n", "--limit", type=int, default=20)
    c = sub.add_parser("master")
    c.add_argument("action", choices=["add", "list", "sync", "verify", "rm"])
    c.add_argument("what", nargs="*")
    c.add_argument("--master", default="master.catalog")
    c.add_argument("--prune", type=int)
    c.add_argument("--deep", action="store_true")
    c.add_argument("--json", action="store_true")
    c = sub.add_parser("dedup")
    c.add_argument("indexes", nargs="*")
    c.add_argument("--master", default="master.catalog")
    c.add_argument("--exact-only", action="store_true")
    c.add_argument("--near-only", action="store_true")
    c.add_argument("--threshold", type=int, default=3)
    c.add_argument("--kind")
    c.add_argument("--ext", default="")
    c.add_argument("--min-size", type=parse_size, default=1)
    c.add_argument("--path")
    c.add_argument("--archive", action="append", default=[])
    c.add_argument("--across-only", action="store_true")
    c.add_argument("--include-empty", action="store_true")
    c.add_argument("--sort", default="wasted", choices=["wasted", "count", "newest"])
    c.add_argument("--limit-groups", type=int)
    c.add_argument("--json", action="store_true")
    c.add_argument("-o", "--out")
    c = sub.add_parser("inspect")
    c.add_argument("path")
    c.add_argument("source", nargs="?")
    c.add_argument("--db")
    return a


def search_index(index: Index, query: str, limit: int) -> dict:
    """One page of an index's hits, with whether there are more."""
    found = search(index.postings(), query, KEYS).orderBy("rank", *KEYS).limit(limit + 1)
    hits = found.join(index.files().select(*KEYS, "path", "path_raw"), KEYS)
    if index.mode == "full" and (texts := index.table("content")) is not None:
        hits = snippets(hits.join(texts, KEYS, "left"), query)
    rows = hit_rows(hits.orderBy("rank", *KEYS), index.mode)
    return {"mode": index.mode, "truncated": len(rows) > limit, "hits": rows[:limit]}


def search_all(spark: SparkSession, catalog: Catalog, query: str, limit: int) -> dict:
    """Every registered index by itself; what can't be searched is named with the reason."""
    archives, left_out = [], []
    for r in catalog.list().collect():
        try:
            page = search_index(Index.open(spark, r.db_path), query, limit)
        except IndexError_ as e:
            left_out.append({"archive": r.label, "reason": str(e)})
            continue
        if r.status == INCOMPLETE:
            left_out.append({"archive": r.label, "reason": "incomplete index; hits may be missing"})
        if page["hits"]:
            archives.append({"archive": r.label, **page})
    return {"archives": archives, "skipped": left_out}


def run(argv: list[str], spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = _arguments().parse_args(argv)
    spark = spark or local_session(str(os.cpu_count() or 4))
    say = lambda x: print(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, indent=2), file=out)
    try:
        if a.command == "index":
            s = build_index(spark, a.source, a.db, a.mode, not a.no_word_stats)
            say(f"{s.files} entries: {s.text} texts, {s.media} media, {s.binary} binary, {s.empty} empty, {s.links} links; {s.read_errors} could not be read")
            return 2 if s.read_errors else 0
        if a.command == "search":
            if a.all:
                got = search_all(spark, Catalog.open(spark, a.master, create=False), a.query, a.limit)
                say({"query": a.query, **got} if not a.json else got)
                return 2 if got["skipped"] else 0
            page = search_index(Index.open(spark, discover(a.source, a.db)), a.query, a.limit)
            if parse(a.query)[1] and not a.json:
                say("(searched as a phrase)")
            say({"query": a.query, **page})
            return 0
        if a.command == "top":
            freq = Index.open(spark, discover(a.source, a.db)).table("word_freq")
            if freq is None:
                raise IndexError_("this index keeps no word statistics")
            for r in top_words(freq, a.limit).orderBy("rank").collect():
                say(f"{r['rank']:4} {r.word:32} {r.total_count:10,} {r.doc_count:8,} {r.pct:5.1f} % {r.bar}")
            return 0
        if a.command == "master":
            c = Catalog.open(spark, a.master, create=a.action == "add")
            if a.action == "add":
                for w in a.what:
                    label, n = c.add(w)
                    say(f"{label}: {n} files")
            elif a.action == "sync":
                for label, what in c.sync(a.prune):
                    say(f"{label}: {what}")
            elif a.action == "rm":
                for w in a.what:
                    c.rm(w)
            elif a.action == "verify":
                rows = verify_json(c.verify(a.deep))
                say(rows if a.json else "\n".join(f"{r['label']}: {r['status']}" for r in rows))
                return 2 if any(r["status"] != "ok" for r in rows) else 0
            else:
                rows = registry_json(c.list())
                say(rows if a.json else "\n".join(f"{r['archive_id']:4} {r['status']:16} {r['files']:9,} {r['label']}" for r in rows))
            return 0
        if a.command == "dedup":
            p = DedupParams(
                exact=not a.near_only, near=not a.exact_only, threshold=a.threshold, kind=a.kind, exts=[e for e in a.ext.split(",") if e], min_size=a.min_size, path_glob=a.path,
                archives=a.archive, across_only=a.across_only, include_empty=a.include_empty, sort=a.sort, limit_groups=a.limit_groups,
            )
            if a.indexes:
                archives, files = Catalog.adhoc(spark, a.indexes)
            else:
                c = Catalog.open(spark, a.master, create=False)
                archives, files = c.registry(), c.files()
            got = run_dedup(files, archives, p)
            report = dedup_report(got, archives, files, p)
            guard = ProtectedSet()
            for r in archives.select("source_path", "db_path", "source_type").collect():
                (guard.add_tree if r.source_type == "dir" else guard.add_file)(r.source_path)
                guard.add_tree(r.db_path)
            if a.json or a.out:
                data = json.dumps(report, ensure_ascii=False, indent=2)
                if a.out:
                    write_new_file(a.out, data.encode(), guard)
                else:
                    say(data)
            else:
                for r in group_lines(got).orderBy("group_id").collect():
                    say(r.line)
            return exit_code(report)
        files = Index.open(spark, discover(a.source, a.db)).files()
        rows = inspect_path(files, a.path).select("*", flag_names("flags").alias("flag_names"), fmt_unix("mtime_unix").alias("mtime"), human_bytes("size").alias("human"), F.lower(F.hex("content_hash")).alias("hash")).collect()
        for r in rows:
            say({k: v for k, v in r.asDict().items() if not isinstance(v, (bytes, bytearray))})
        return 0 if rows else 1
    except (ValueError, OSError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def main() -> None:
    sys.exit(run(sys.argv[1:]))
