"""Archives and folders as sources, indexes, the catalogue, the command line and streams, on files written here."""

import gzip
import hashlib
import io
import json
import os
import tarfile
import time

import pytest
import zstandard
from pyspark.sql import functions as F

from siftstone import schema as S
from siftstone.operators.links import resolve_hardlinks
from siftstone.plans import catalog, cli, index, outpath
from siftstone.sources import entries, formats
from siftstone.streaming import incremental

TEXT = "alpha ledger \x01Café\n" * 40


def add(tar, name, data=b"", **more):
    m = tarfile.TarInfo(name)
    m.size, m.mtime, m.mode = len(data), 1_600_000_000, 0o640
    for k, v in more.items():
        setattr(m, k, v)
    tar.addfile(m, io.BytesIO(data))


def make_tar(path, pack=lambda b: b):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        add(tar, "d/a.txt", TEXT.encode())
        add(tar, "d/empty.txt")
        add(tar, "d/b.bin", b"x\0y")
        add(tar, "d/photo.png", b"no picture")
        add(tar, "d/film.mp4", b"film")
        add(tar, "d/link", type=tarfile.LNKTYPE, linkname="d/a.txt")
        add(tar, "d/sym", type=tarfile.SYMTYPE, linkname="a.txt")
        add(tar, "d", type=tarfile.DIRTYPE)
        add(tar, "d/a.txt", b"second alpha")
        add(tar, "d/s.img", b"part", pax_headers={"GNU.sparse.major": "1", "GNU.sparse.name": "d/real.img", "GNU.sparse.realsize": "5000"})
    path.write_bytes(pack(out.getvalue()))
    return str(path)


def members(b):
    return gzip.compress(b[:3000]) + gzip.compress(b[3000:])


def frames(b):
    c = zstandard.ZstdCompressor()
    return c.compress(b[:3000]) + c.compress(b[3000:])


@pytest.mark.parametrize("name,pack", [("a.tar", lambda b: b), ("a.tar.gz", members), ("a.tar.zst", frames)])
def test_rows_of_an_archive(tmp_path, name, pack):
    rows = {(r["file_id"], r["path"]): r for r in entries.tar_rows(make_tar(tmp_path / name, pack), 7, entries.Options(algo="sha256"))}
    got = {k: (r["entry_type"], r["kind"], r["size"], r["flags"]) for k, r in rows.items()}
    assert got == {
        (1, "d/a.txt"): ("file", "text", len(TEXT.encode()), 0), (2, "d/empty.txt"): ("file", "empty", 0, 0), (3, "d/b.bin"): ("file", "binary", 3, 0),
        (4, "d/photo.png"): ("file", "image", 10, S.DECODE_FAILED), (5, "d/film.mp4"): ("file", "video", 4, 0), (6, "d/link"): ("hardlink", "link", 0, 0),
        (7, "d/sym"): ("symlink", "link", 0, 0), (8, "d/a.txt"): ("file", "text", 12, 0), (9, "d/real.img"): ("file", "binary", 5000, S.SPARSE),
    }
    a = rows[1, "d/a.txt"]
    assert a["content"] == TEXT.replace("\x01", "") and a["content_hash"] == hashlib.sha256(TEXT.encode()).digest() and (a["mtime_unix"], a["mode"]) == (1_600_000_000, 0o640)
    assert rows[6, "d/link"]["link_target"] == "d/a.txt" and rows[9, "d/real.img"]["content_hash"] is None


def test_caps_modes_and_broken_archives(tmp_path):
    at = make_tar(tmp_path / "a.tar")
    cut = {r["file_id"]: r for r in entries.tar_rows(at, 1, entries.Options(algo="sha256", text_cap=10))}[1]
    assert cut["flags"] == S.FTS_TRUNCATED and len(cut["content"]) == 10 and cut["content_hash"] == hashlib.sha256(TEXT.encode()).digest()
    assert all(r["content_hash"] is None and r["content"] is None for r in entries.tar_rows(at, 1, entries.Options(mode="metadata-only")))
    assert {r["path"]: r["kind"] for r in entries.tar_rows(at, 1, entries.Options(mode="metadata-only"))}["d/photo.png"] == "image"
    data = (tmp_path / "a.tar").read_bytes()
    (tmp_path / "bad.tar").write_bytes(data[:2048] + b"\xff" * 512 + data[2560:])
    with pytest.raises(entries.ArchiveError):
        list(entries.tar_rows(str(tmp_path / "bad.tar"), 1, entries.Options(algo="sha256")))
    for head in (b"\xfd7zXZ\x00", b"BZh9", b"plain text"):
        with pytest.raises(formats.FormatError):
            formats.detect(head)


def test_pax_records_and_sparse_maps(tmp_path):
    """A record that can't be read marks its entry, whose content stays; a sparse map that overlaps is refused."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        add(tar, "PaxHeaders/x", b"99 broken\n", type=tarfile.XHDTYPE)
        add(tar, "x.txt", b"text of x")
        add(tar, "y.txt", b"text of y")
    (tmp_path / "p.tar").write_bytes(out.getvalue())
    rows = {r["path"]: r for r in entries.tar_rows(str(tmp_path / "p.tar"), 1, entries.Options(algo="sha256"))}
    assert rows["x.txt"]["flags"] == S.PAX_UNPARSED and rows["x.txt"]["content"] == "text of x" and rows["y.txt"]["flags"] == 0
    m = tarfile.TarInfo("s")
    m.size, m.sparse = 100, [(0, 10), (50, 50)]
    entries.check_sparse("t", m)
    for bad in ([(0, 60), (50, 10)], [(50, 10), (0, 10)], [(90, 20)]):
        m.sparse = bad
        with pytest.raises(entries.ArchiveError):
            entries.check_sparse("t", m)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """An archive and a folder with their indexes, and a catalogue of both."""
    top = tmp_path_factory.mktemp("built")
    tar = make_tar(top / "one.tar.gz", members)
    folder = top / "two"
    (folder / "sub").mkdir(parents=True)
    (folder / "sub" / "a.txt").write_text(TEXT)
    (folder / "z.txt").write_text("only zeta here")
    os.symlink("z.txt", folder / "ln")
    with open(os.fsencode(str(folder)) + b"/\xff.txt", "wb") as f:
        f.write(b"odd name")
    index.build_index(spark, tar, algo="sha256")
    index.build_index(spark, str(folder), algo="sha256")
    master = catalog.Catalog.open(spark, str(top / "master"))
    for source in (tar, str(folder)):
        master.add(source)
    return top, tar, folder, master


def test_index(spark, built):
    top, tar, folder, _ = built
    one, two = (index.Index.open(spark, x + index.SUFFIX) for x in (tar, str(folder)))
    rows = {(r.file_id, r.path): r for r in one.files().collect()}
    assert rows[1, "d/a.txt"].flags == S.SHADOWED and bytes(rows[6, "d/link"].content_hash) == hashlib.sha256(b"second alpha").digest()
    meta = index.read_meta(tar + index.SUFFIX)
    assert meta["archive_fingerprint"] == hashlib.sha256(open(tar, "rb").read()).hexdigest() and meta["completed"] == "1" and meta["source_type"] == "tar"
    got = {r.path: (r.entry_type, r.kind, r.path_raw and bytes(r.path_raw)) for r in two.files().collect()}
    assert got == {"sub/a.txt": ("file", "text", None), "z.txt": ("file", "text", None), "ln": ("symlink", "link", None), "�.txt": ("file", "text", b"\xff.txt")}
    freq = {r.word: (r.total_count, r.doc_count) for r in one.table("word_freq").collect()}
    assert freq["alpha"] == (41, 2) and freq["ledger"] == (40, 1)
    assert index.discover(tar, None) == tar + index.SUFFIX and index.resolve_index(tar + index.SUFFIX) == tar + index.SUFFIX
    with pytest.raises(index.IndexError_):
        index.read_meta(str(folder))


def test_nothing_is_overwritten_and_no_index_indexes_itself(spark, built, tmp_path):
    top, tar, folder, _ = built
    with pytest.raises(outpath.DestinationError):
        index.build_index(spark, str(folder), str(folder / "sub" / "i.idx"))
    with pytest.raises(outpath.DestinationError):
        index.build_index(spark, str(folder), tar + index.SUFFIX)
    os.symlink(tar, tmp_path / "link.idx")
    with pytest.raises(outpath.DestinationError):
        index.build_index(spark, tar, str(tmp_path / "link.idx"))
    inner = tmp_path / "src"
    (inner / "old.idx" / "files").mkdir(parents=True)
    (inner / "old.idx" / "manifest.json").write_text("{}")
    (inner / "kept.txt").write_text("x")
    assert entries.walk(str(inner))[0] == [("kept.txt", "file")]
    outpath.write_new_file(str(tmp_path / "r.json"), b"1")
    with pytest.raises(outpath.DestinationError):
        outpath.write_new_file(str(tmp_path / "r.json"), b"2")
    guard = outpath.ProtectedSet()
    guard.add_tree(str(folder))
    with pytest.raises(outpath.DestinationError):
        guard.check(str(folder / "sub" / "new"))
    assert open(tmp_path / "r.json").read() == "1" and os.path.exists(folder / "z.txt")


def test_catalogue_and_command_line(spark, built):
    top, tar, folder, master = built
    at = str(top / "master")
    assert [(r.archive_id, r.label, r.status, r.files_count) for r in master.list().collect()] == [(1, "one.tar.gz", "ok", 9), (2, "two", "ok", 4)]

    def run(*argv):
        out = io.StringIO()
        code = cli.run(list(argv), spark, out)
        return code, out.getvalue()

    code, said = run("search", '"only zeta" OR led*', str(folder))
    assert code == 0 and [h["path"] for h in json.loads(said)["hits"]] == ["sub/a.txt", "z.txt"] or json.loads(said)["hits"][0]["path"] in ("sub/a.txt", "z.txt")
    code, said = run("dedup", "--master", at, "--exact-only", "--json")
    report = json.loads(said)
    assert code == 0 and report["summary"]["groups"] == 1 and {m["path"] for m in report["groups"][0]["members"]} == {"d/a.txt", "sub/a.txt"}
    registry, files = catalog.Catalog.adhoc(spark, [tar, str(folder)])
    assert registry.count() == 2 and files.count() == 13
    # a source that changed, an index that went away and came back, a registration that is taken back
    os.utime(tar, (time.time() + 50, time.time() + 50))
    assert {r.label: r.status for r in master.verify().collect()} == {"one.tar.gz": "stale-index", "two": "ok"}
    os.rename(str(folder) + index.SUFFIX, str(top / "away"))
    assert ("two", "db-missing (rows retained)") in master.sync() and master.files().where("archive_id = 2").count() == 4
    os.rename(str(top / "away"), str(folder) + index.SUFFIX)
    assert ("two", "re-replicated") in master.sync()
    with pytest.raises(catalog.CatalogError):
        master.rm("nothing")
    master.rm("two")
    assert [r.label for r in master.list().collect()] == ["one.tar.gz"] and master.files().where("archive_id = 2").count() == 0
    (top / "foreign").mkdir()
    (top / "foreign" / "x").write_text("x")
    with pytest.raises(catalog.CatalogError):
        catalog.Catalog.open(spark, str(top / "foreign"))


def test_upsert_and_old_indexes(spark, tmp_path):
    base = dict.fromkeys(f.name for f in S.ARCHIVES.fields)
    make = lambda *rows: spark.createDataFrame([tuple((base | dict(zip(("archive_id", "index_uuid", "db_path", "added_unix"), r))).values()) for r in rows], S.ARCHIVES)
    registry = make((1, "u1", "/p1", 10), (2, "u2", "/p2", 20), (5, "u5", "/p5", 50))
    # hits 1 by identity and 2 by path; a new one; a repeated one; a new identity at a known path
    new = make((1, "u1", "/p2", 99), (2, "u9", "/p9", 99), (3, "u9", "/p9", 99), (4, "u6", "/p5", 99))
    got = sorted((r.archive_id, r.index_uuid, r.db_path, r.added_unix) for r in catalog.upsert(registry, new).collect())
    assert got == [(1, "u1", "/p2", 10), (5, "u6", "/p5", 50), (7, "u9", "/p9", 99)]
    assert catalog.upsert(registry.limit(0), new.limit(1)).count() == 1
    old = tmp_path / "old.idx"
    old.mkdir()
    (old / "manifest.json").write_text(json.dumps({"format": index.FORMAT, "meta": {"schema_version": "2", "source": "/a/b.tar", "created_unix": "5", "completed": "1"}}))
    spark.createDataFrame([(1, "x", 3)], "file_id long, path string, size long").write.parquet(str(old / "files"))
    master = catalog.Catalog.open(spark, str(tmp_path / "m"))
    master.add(str(old))
    row = master.list().first()
    assert row.status == "v2-limited" and row.index_uuid.startswith("v2:") and row.files_count == 0 and master.files().count() == 0


def test_hard_links_by_brute_force(spark):
    import random

    r = random.Random(6)
    rows = []
    for i in range(200):
        link = r.random() < 0.6
        rows.append((r.randint(1, 2), i, f"p{r.randint(0, 60)}", "hardlink" if link else "file", f"p{r.randint(0, 60)}" if link else None, None if link or r.random() < 0.2 else bytes([i]), 0))
    rows += [(1, 500, None, "file", None, b"z", 0), (1, 501, "q", "hardlink", None, None, 0), (1, 502, "self", "hardlink", "self", None, 0)]
    now = {(a, i): h for a, i, _, _, _, h, _ in rows}
    for _ in range(5):
        last = {}
        for a, i, p, *_ in sorted(rows, key=lambda x: x[1]):
            last[a, p] = now[a, i]
        now = {(a, i): last.get((a, t)) if e == "hardlink" and now[a, i] is None and t is not None else now[a, i] for a, i, _, e, t, _, _ in rows}
    df = spark.createDataFrame(rows, "archive_id int, file_id int, path string, entry_type string, link_target string, content_hash binary, _hash int")
    assert {(x.archive_id, x.file_id): x.content_hash and bytes(x.content_hash) for x in resolve_hardlinks(df.drop("_hash")).collect()} == now


def test_streams(spark, make_files, tmp_path):
    rows = [dict(archive_id=a, file_id=i, content_hash=bytes([i]) * 32) for a in (1, 2) for i in range(3)]
    stamped = make_files(rows + rows[:2]).withColumn("seen", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("archive_id") * 60))
    stamped.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(stamped.schema).parquet(str(tmp_path / "in"))
    incremental.upsert_replica(stream().drop("seen"), str(tmp_path / "files"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "files")).count() == 6
    for name, df, mode in (("first", incremental.first_copies(stream(), "seen"), "append"), ("arrivals", incremental.arrivals(stream(), "seen"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("first").count() == 3
    assert {(r.archive_id, r.files) for r in spark.table("arrivals").collect()} == {(1, 5), (2, 3)}
