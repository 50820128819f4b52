import pytest
from pyspark.sql import functions as F

from siftstone.operators.dedup import DedupParams, ScopeError, run_dedup
from siftstone.operators.links import mark_shadowed, resolve_hardlinks
from siftstone.plans.report import dedup_report, exit_code


def keep(result):
    return {(r.match_kind, r.archive_id, r.file_id, r.keep_reason) for r in result.members.where("keep").collect()}


def h(x):
    return bytes([x]) * 32


def test_newest_is_kept_and_shadowed_bytes_count(make_files, make_archives):
    f = make_files(
        [
            dict(file_id=1, path="a.txt", kind="text", mtime_unix=1_600_000_000), dict(archive_id=2, file_id=1, path="b.txt", kind="text", mtime_unix=1_700_000_000),
            dict(file_id=2, path="s.bin", kind="binary", content_hash=h(2), flags=16, size=7), dict(archive_id=2, file_id=2, path="t.bin", kind="binary", content_hash=h(2), size=7),
            dict(file_id=3, kind="text", content_hash=h(3)), dict(file_id=4, entry_type="symlink", kind="link"), dict(file_id=5, kind="empty", size=0), dict(file_id=6, content_hash=None),
        ]
    )
    r = run_dedup(f.union(f), make_archives([(1, 5), (2, None)]))
    assert keep(r) == {("exact", 2, 1, "newest"), ("exact", 2, 2, "clean-path")}
    t = r.totals.first()
    assert (t.duplicate_files, t.reclaimable_bytes, t.intra_archive_shadowed_bytes, t.groups_in_all) == (1, 10, 7, 2)


def test_near_chain_is_for_review(make_files, make_archives):
    a, b, c = 0xE94AE84A1FB2B932, 0xE94AE94A1FB29932, 0xE94AE94A1FB39912
    s = lambda x: x - (1 << 64)
    f = make_files(
        [
            dict(file_id=1, phash=s(a), img_w=640, img_h=480, content_hash=h(1)), dict(file_id=2, phash=s(b), img_w=320, img_h=240, content_hash=h(2)),
            dict(archive_id=2, file_id=1, phash=s(c), img_w=320, img_h=240, content_hash=h(3), size=33), dict(file_id=9, phash=0, content_hash=h(4)), dict(file_id=10, phash=0, content_hash=h(5)),
        ]
    )
    arch = make_archives([(1, None), (2, None)])
    r = run_dedup(f, arch)
    rows = {(x.archive_id, x.file_id): (x.keep, x.hamming_to_keep, x.actionable) for x in r.members.collect()}
    assert rows == {(1, 1): (True, 0, False), (1, 2): (False, 2 if (a ^ b).bit_count() == 2 else (a ^ b).bit_count(), True), (2, 1): (False, (a ^ c).bit_count(), False)}
    t = r.totals.first()
    assert (t.transitive_only_files, t.review_only_bytes, t.duplicate_files) == (1, 33, 1)
    report = dedup_report(r, arch, f, DedupParams())
    assert [m["file_id"] for m in report["groups"][0]["members"]] == [1, 2, 1] and report["groups"][0]["max_distance"] == (a ^ c).bit_count()
    assert report["summary"]["images_without_phash"] == 0 and exit_code(report) == 0 and "path_bytes" not in report["groups"][0]["members"][0]


def test_scope_and_errors(make_files, make_archives):
    f = make_files([dict(file_id=i, archive_id=i % 2 + 1, path=f"p{i}.jpg", phash=None) for i in range(6)])
    arch = make_archives([(1, 1), (2, 2)])
    assert run_dedup(f, arch, DedupParams(archives=["label-1"])).totals.first().duplicate_files == 2
    assert run_dedup(f, arch, DedupParams(across_only=True, archives=["2"])).totals.first().groups_in_all == 0
    assert run_dedup(f, arch, DedupParams(path_glob="p[0-2]*")).totals.first().duplicate_files == 2
    for bad in (DedupParams(archives=["nope"]), DedupParams(threshold=4), DedupParams(sort="x")):
        with pytest.raises(ValueError):
            run_dedup(f, arch, bad)
    with pytest.raises(ScopeError):
        run_dedup(f, arch.unionByName(arch.withColumn("archive_id", F.col("archive_id") + 10)), DedupParams(archives=["label-1"]))
    with pytest.raises(ValueError):
        run_dedup(f, arch.withColumn("phash_algo", F.col("label")))


def test_empty_and_null_rows(make_files, make_archives):
    arch = make_archives([(1, None)])
    nulls = make_files([dict.fromkeys(["path", "entry_type", "kind", "size", "flags", "content_hash"]) | dict(file_id=i) for i in range(3)])
    for f in (nulls, nulls.limit(0)):
        r = run_dedup(f, arch)
        assert r.members.count() == 0 and r.groups.count() == 0 and r.totals.first().groups_in_all == 0
    same = make_files([dict(file_id=i, path=None, kind="text") for i in range(3)])
    assert keep(run_dedup(same, arch)) == {("exact", 1, 0, "clean-path")}


def test_group_numbers_follow_the_order(make_files, make_archives):
    f = make_files([dict(file_id=10 * g + k, kind="text", content_hash=h(g), size=5) for g in range(1, 5) for k in range(2)])
    r = run_dedup(f, make_archives([(1, None)]), DedupParams(limit_groups=3))
    assert [(x.group_id, x.gkey[:2]) for x in r.groups.orderBy("group_id").collect()] == [(1, "01"), (2, "02"), (3, "03")]
    assert r.totals.first().groups_in_all == 4


def test_links(spark, make_files):
    f = make_files([dict(file_id=1, path="x"), dict(file_id=2, path="x", flags=None), dict(file_id=3, path=None), dict(file_id=4, path=None)])
    assert {r.file_id for r in mark_shadowed(f).where("flags & 16 <> 0").collect()} == {1, 3}
    rows = [(1, 1, "a", "file", None, h(1)), (1, 2, "l1", "hardlink", "a", None), (1, 3, "l2", "hardlink", "l1", None), (1, 4, "a", "file", None, None), (2, 1, "l", "hardlink", "none", None)]
    g = spark.createDataFrame(rows, "archive_id long, file_id long, path string, entry_type string, link_target string, content_hash binary")
    got = {(r.archive_id, r.file_id): r.content_hash for r in resolve_hardlinks(g).collect()}
    assert got[(1, 2)] is None and got[(1, 3)] is None and got[(2, 1)] is None  # the latest row of the target counts
    assert {bytes(r.content_hash) for r in resolve_hardlinks(g.where("file_id < 4 and archive_id = 1")).collect()} == {h(1)}
