"""Entries of tar archives and directories as Spark tables.

``ARCHIVE_ENTRIES`` and ``DIRECTORY_ENTRIES`` are Python data sources: one input partition per archive, or per slice of
a directory's files. Contents are streamed; of a large file no more than its cap is held, while the hash covers it all.
"""

from __future__ import annotations

import hashlib
import os
import stat
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftstone import schema as S
from siftstone.functions.blake3 import Blake3
from siftstone.functions.media import decode_guarded, extract_date, fingerprint, luma, signed64
from siftstone.functions.scalars import CONTENT_MODES, IMAGE_EXT, RAW_EXT, VIDEO_EXT
from siftstone.sources.formats import open_stream

READ = 1 << 18
ENTRIES = T.StructType([*S.FILES.fields, T.StructField("content", T.StringType()), T.StructField("warning", T.StringType())])


class ArchiveError(RuntimeError):
    """A damaged archive: nothing of it may be published."""


def capture(raw: bytes) -> tuple[str, bytes | None]:
    """Text of a path and its bytes, the latter only where the text doesn't carry them."""
    try:
        return raw.decode("utf-8"), None
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace"), raw


def _ext(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2]
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and stem else ""


def media_kind(path: str) -> str | None:
    e = _ext(path)
    return "image" if e in IMAGE_EXT else "raw" if e in RAW_EXT else "video" if e in VIDEO_EXT else None


def hasher(algo: str, data: bytes = b"") -> Any:
    h = Blake3() if algo == "blake3" else hashlib.new(algo)
    h.update(data)
    return h


@dataclass(frozen=True)
class Options:
    mode: str = "full"
    algo: str = "blake3"
    text_cap: int = S.TEXT_CAP
    media_cap: int = S.MEDIA_CAP

    @staticmethod
    def of(options: dict) -> Options:
        mode = options.get("mode", "full")
        if mode not in CONTENT_MODES:
            raise ValueError(f"mode is one of {', '.join(CONTENT_MODES)}")
        return Options(mode, options.get("algo", "blake3"), int(options.get("textcap", S.TEXT_CAP)), int(options.get("mediacap", S.MEDIA_CAP)))


def _blank(archive_id: int, file_id: int) -> dict:
    row = dict.fromkeys(f.name for f in ENTRIES.fields)
    row.update(archive_id=archive_id, file_id=file_id, flags=0)
    return row


def describe(row: dict, stream: BinaryIO | None, size: int, o: Options) -> dict:
    """Fill in kind, hash, picture and date columns, text and flags of a regular file."""
    path, media = row["path"], media_kind(row["path"])
    row.update(entry_type="file", size=size)
    if o.mode == "metadata-only":
        row["kind"] = "empty" if size == 0 else media or "binary"
        return row
    cap = o.media_cap if media else o.text_cap
    h, kept, total, failed = hasher(o.algo), bytearray(), 0, None
    try:
        while block := stream.read(READ):
            h.update(block)
            if len(kept) < cap:
                kept += block[: cap - len(kept)]
            total += len(block)
        if total < size:
            raise OSError(f"{total} of {size} bytes could be read")
    except (OSError, EOFError) as e:
        failed = e
    if failed is not None:
        row.update(kind="binary", flags=row["flags"] | S.READ_ERROR, warning=f"{path}: {failed}")
        return row
    row["content_hash"] = h.digest()
    data, cut = bytes(kept), total > len(kept)
    if total == 0:
        row["kind"] = "empty"
    elif media:
        row["kind"] = media
        if media in ("image", "raw") and (found := extract_date(data)):
            row["exif_unix"], row["exif_src"] = found
        if media == "image" and _ext(path) != "heic":
            if cut:
                row["flags"] |= S.IMAGE_OVER_CAP
            elif (px := decode_guarded(data)) is None:
                row["flags"] |= S.DECODE_FAILED
            else:
                row.update(img_h=px.shape[0], img_w=px.shape[1], phash=signed64(fingerprint(luma(px))))
    elif b"\0" in data[: S.PROBE]:
        row["kind"] = "binary"
    else:
        row["kind"] = "text"
        row["content"] = data.decode("utf-8", "replace").replace("\x01", "")
        if cut:
            row["flags"] |= S.FTS_TRUNCATED
    return row


class _Strict(tarfile.TarInfo):
    """Headers that can't be read end the scan with an error, not silently."""

    @classmethod
    def fromtarfile(cls, tar: tarfile.TarFile) -> tarfile.TarInfo:
        try:
            return super().fromtarfile(tar)
        except (tarfile.InvalidHeaderError, tarfile.TruncatedHeaderError, tarfile.SubsequentHeaderError) as e:
            raise ArchiveError(f"damaged tar header: {e}; the index would be incomplete") from e

    def _proc_pax(self, tar: tarfile.TarFile) -> tarfile.TarInfo:
        """Records that can't be read are left out; the entry that they belong to is marked."""
        try:
            return super()._proc_pax(tar)
        except (tarfile.InvalidHeaderError, ValueError):  # raised once the records have been read from the stream
            if self.type != tarfile.XHDTYPE:
                raise
            m = self.fromtarfile(tar)
            m.offset, m.pax_unparsed = self.offset, True
            return m


def check_sparse(path: str, m: tarfile.TarInfo) -> None:
    """ArchiveError for a sparse map whose parts overlap, run backwards or end beyond the file."""
    at = 0
    for offset, size in m.sparse or ():
        if offset < at or size < 0 or offset + size > m.size:
            raise ArchiveError(f"{path}: damaged sparse map of {m.name}")
        at = offset + size


def _as_bytes(name: str) -> bytes:
    return name.encode("utf-8", "surrogateescape")


def tar_rows(path: str, archive_id: int, o: Options) -> Iterator[dict]:
    """One row for each regular, sparse, continuous, hard-link and symbolic-link entry, in the archive's order."""
    with open(path, "rb") as raw:
        stream = open_stream(path, raw)
        try:
            tar = tarfile.open(fileobj=stream, mode="r|", tarinfo=_Strict, encoding="utf-8", errors="surrogateescape")
        except tarfile.TarError as e:
            raise ArchiveError(f"{path}: {e}") from e
        file_id = 0
        for m in tar:
            link = m.islnk() or m.issym()
            if not link and not (m.isreg() or m.type in (tarfile.GNUTYPE_SPARSE, tarfile.CONTTYPE)):
                continue
            file_id += 1
            row = _blank(archive_id, file_id)
            row["path"], row["path_raw"] = capture(_as_bytes(m.name))
            row.update(mtime_unix=int(m.mtime), mode=m.mode)
            pax = m.pax_headers or {}
            if getattr(m, "pax_unparsed", False):
                row["flags"] |= S.PAX_UNPARSED
            if link:
                row["link_target"], row["link_target_raw"] = capture(_as_bytes(m.linkname))
                row.update(entry_type="hardlink" if m.islnk() else "symlink", size=0, kind="link")
            elif any(k.startswith("GNU.sparse") for k in pax):
                # the condensed fragments of these dialects are not the file: by name only
                size = next((int(pax[k]) for k in ("GNU.sparse.realsize", "GNU.sparse.size") if pax.get(k, "").isdigit()), m.size)
                if "GNU.sparse.name" in pax:
                    row["path"], row["path_raw"] = capture(_as_bytes(pax["GNU.sparse.name"]))
                row.update(entry_type="file", size=size, kind="binary", flags=row["flags"] | S.SPARSE)
            else:
                if m.type == tarfile.GNUTYPE_SPARSE:
                    check_sparse(path, m)
                    row["flags"] |= S.SPARSE
                describe(row, tar.extractfile(m), m.size, o)
            yield row
        while stream.read(READ):
            pass


def own_output(folder: str) -> bool:
    """Whether a folder is an index or a staged one: such are never indexed themselves."""
    return os.path.isfile(os.path.join(folder, "manifest.json")) and os.path.isdir(os.path.join(folder, "files")) or ".staged-" in os.path.basename(folder)


def walk(root: str, skip: frozenset[str] = frozenset()) -> tuple[list[tuple[str, str]], list[str]]:
    """((relative path, 'file' or 'symlink') in order of names, warnings); links are not followed."""
    out, warnings = [], []

    def visit(at: str) -> None:
        try:
            names = sorted(os.scandir(at), key=lambda e: os.fsencode(e.name))
        except OSError as e:
            warnings.append(f"{at}: {e}")
            return
        for e in names:
            if e.is_symlink():
                out.append((os.path.relpath(e.path, root), "symlink"))
            elif e.is_dir(follow_symlinks=False):
                if os.path.abspath(e.path) not in skip and not own_output(e.path):
                    visit(e.path)
            elif e.is_file(follow_symlinks=False) and os.path.abspath(e.path) not in skip:
                out.append((os.path.relpath(e.path, root), "file"))

    visit(root)
    return out, warnings


def directory_row(root: str, rel: str, what: str, archive_id: int, file_id: int, o: Options) -> dict:
    row = _blank(archive_id, file_id)
    row["path"], row["path_raw"] = capture(os.fsencode(rel))
    at = os.path.join(root, rel)
    try:
        st = os.lstat(at)
        row.update(mtime_unix=int(st.st_mtime), mode=stat.S_IMODE(st.st_mode))
        if what == "symlink":
            row["link_target"], row["link_target_raw"] = capture(os.fsencode(os.readlink(at)))
            row.update(entry_type="symlink", size=0, kind="link")
            return row
        with open(at, "rb") as f:
            return describe(row, f, st.st_size, o)
    except OSError as e:
        row.update(entry_type="file", size=row["size"] or 0, kind="binary", flags=S.READ_ERROR, warning=f"{rel}: {e}")
        return row


def _tuples(rows: Iterator[dict]) -> Iterator[tuple]:
    names = [f.name for f in ENTRIES.fields]
    for r in rows:
        yield tuple(r[n] for n in names)


@dataclass
class _Archive(InputPartition):
    path: str
    archive_id: int


@dataclass
class _Slice(InputPartition):
    root: str
    archive_id: int
    first: int
    files: list


class _TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = Options.of(options)
        self.paths = [p for p in options["path"].split("\n") if p]
        self.first = int(options.get("firstarchive", 1))

    def partitions(self) -> list[InputPartition]:
        return [_Archive(p, self.first + i) for i, p in enumerate(self.paths)]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        yield from _tuples(tar_rows(partition.path, partition.archive_id, self.o))


class _DirReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = Options.of(options)
        self.root = options["path"]
        self.archive_id = int(options.get("firstarchive", 1))
        self.slice = int(options.get("slice", 1000))
        self.skip = frozenset(os.path.abspath(p) for p in options.get("skip", "").split("\n") if p)

    def partitions(self) -> list[InputPartition]:
        files, _ = walk(self.root, self.skip)
        return [_Slice(self.root, self.archive_id, i + 1, files[i : i + self.slice]) for i in range(0, len(files), self.slice)] or [_Slice(self.root, self.archive_id, 1, [])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        p = partition
        yield from _tuples(directory_row(p.root, rel, what, p.archive_id, p.first + k, self.o) for k, (rel, what) in enumerate(p.files))


class TarEntries(DataSource):
    """``spark.read.format("tar_entries").load(path)``: options mode, algo, firstArchive; several paths by newline."""

    @classmethod
    def name(cls) -> str:
        return "tar_entries"

    def schema(self) -> T.StructType:
        return ENTRIES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TarReader(dict(self.options))


class DirectoryEntries(DataSource):
    """``spark.read.format("dir_entries").load(path)``: options mode, algo, firstArchive, slice, skip."""

    @classmethod
    def name(cls) -> str:
        return "dir_entries"

    def schema(self) -> T.StructType:
        return ENTRIES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _DirReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarEntries)
    spark.dataSource.register(DirectoryEntries)


def source_type(path: str) -> str:
    return "dir" if os.path.isdir(path) else "tar"


def hash_file(path: str, algo: str = "blake3") -> str:
    """Fingerprint of a whole file as it lies there, compressed or not."""
    h = hasher(algo)
    with open(path, "rb") as f:
        while block := f.read(1 << 22):
            h.update(block)
    return h.digest().hex()
