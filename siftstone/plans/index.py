"""Indexes: what is kept of one source. A folder of Parquet tables, finished by its manifest.

``files`` (metadata), ``content`` (texts, full mode), ``postings`` (token arrays), ``word_freq``, ``meta`` (key and
value). The folder is built under a staging name and moved into place when it is whole, so that a failed run leaves the
last good index as it was.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone import schema as S
from siftstone.functions.media import ALGORITHM
from siftstone.functions.scalars import CONTENT_MODES
from siftstone.operators.links import mark_shadowed, resolve_hardlinks
from siftstone.operators.search import Inverted, postings
from siftstone.operators.words import word_freq
from siftstone.plans.outpath import DestinationError, ProtectedSet, promote, stage_path
from siftstone.schema import has_flag
from siftstone.sources.entries import hash_file, register, source_type

FORMAT = "siftstone-index"
SCHEMA_VERSION = 3
SUFFIX = ".idx"


class IndexError_(ValueError):
    """No index, or one that can't be used for what was asked."""


@dataclass
class IndexSummary:
    files: int = 0
    text: int = 0
    media: int = 0
    binary: int = 0
    empty: int = 0
    links: int = 0
    truncated: int = 0
    read_errors: int = 0
    sparse: int = 0
    pax_unparsed: int = 0
    shadowed: int = 0


def index_name(source: str) -> str:
    return os.path.basename(os.path.abspath(source)) + SUFFIX


def index_path(source: str, explicit: str | None = None) -> str:
    """The named index, else ``<source>.idx`` beside the source, else in the working folder where that can't be written."""
    if explicit:
        return os.path.abspath(explicit)
    folder = os.path.dirname(os.path.abspath(source))
    return os.path.join(folder if os.access(folder, os.W_OK) else os.getcwd(), index_name(source))


def read_meta(index: str) -> dict[str, str]:
    """The key-value pairs of an index; IndexError_ if the folder isn't one."""
    try:
        with open(os.path.join(index, "manifest.json")) as f:
            m = json.load(f)
    except (OSError, ValueError) as e:
        raise IndexError_(f"{index}: no index: {e}") from None
    if m.get("format") != FORMAT:
        raise IndexError_(f"{index}: not an index")
    return m["meta"]


def _stat(path: str) -> tuple[int | None, int | None]:
    try:
        st = os.stat(path)
        return st.st_size, int(st.st_mtime)
    except OSError:
        return None, None


def build_index(
    spark: SparkSession, source: str, dest: str | None = None, mode: str = "full", word_stats: bool = True, algo: str = "blake3", protected: ProtectedSet | None = None
) -> IndexSummary:
    """Index a tar archive or a folder. An existing index is replaced only if it is of the same source."""
    if mode not in CONTENT_MODES:
        raise ValueError(f"mode is one of {', '.join(CONTENT_MODES)}")
    source = os.path.abspath(source)
    kind = source_type(source)
    dest = index_path(source, dest)
    guard = protected or ProtectedSet()
    guard.add_file(source)
    if kind == "dir":
        guard.add_tree(source)
    guard.check(dest)
    if os.path.lexists(dest) and read_meta(dest).get("source") != source:
        raise DestinationError(f"{dest} is the index of another source")
    register(spark)
    staged = stage_path(dest)
    try:
        reader = spark.read.format("tar_entries" if kind == "tar" else "dir_entries").option("mode", mode).option("algo", algo)
        if kind == "dir":
            reader = reader.option("skip", "\n".join([dest, staged]))
        raw = f"{staged}/raw"
        reader.load(source).write.parquet(raw)  # one pass over the source
        entries = spark.read.parquet(raw)
        files = mark_shadowed(resolve_hardlinks(entries.select(*[f.name for f in S.FILES.fields])))
        files.write.parquet(f"{staged}/files")
        if mode != "metadata-only":
            texts = entries.select("archive_id", "file_id", "path", "content")
            keys = ["archive_id", "file_id"]
            postings(texts, keys).write.parquet(f"{staged}/tokens")
            Inverted.of(spark.read.parquet(f"{staged}/tokens"), keys).write(f"{staged}/postings", keys)
            shutil.rmtree(f"{staged}/tokens")
            if mode == "full":
                texts.where("content is not null").select("archive_id", "file_id", "content").write.parquet(f"{staged}/content")
                if word_stats:
                    word_freq(texts, "content").write.parquet(f"{staged}/word_freq")
        shutil.rmtree(raw)
        summary = summarise(spark.read.parquet(f"{staged}/files"))
        size, mtime = _stat(source) if kind == "tar" else (None, None)
        meta = {
            "schema_version": str(SCHEMA_VERSION), "index_uuid": uuid.uuid4().hex, "source": source, "source_type": kind, "hash_algo": algo,
            "phash_algo": ALGORITHM if mode != "metadata-only" else "", "text_cap": str(S.TEXT_CAP), "media_cap": str(S.MEDIA_CAP),
            "created_unix": str(int(time.time())), "word_stats": str(int(word_stats and mode == "full")), "content_mode": mode, "path_raw": "1",
            "archive_size": "" if size is None else str(size), "archive_mtime_unix": "" if mtime is None else str(mtime),
            "archive_fingerprint": hash_file(source, algo) if kind == "tar" else "", "files_indexed": str(summary.files),
            "files_truncated": str(summary.truncated), "completed": "1",
        }
        with open(f"{staged}/manifest.json", "x") as f:  # last of all: an index without it is none
            json.dump({"format": FORMAT, "meta": meta, "summary": asdict(summary)}, f)
        promote(staged, dest)
        return summary
    except BaseException:
        shutil.rmtree(staged, ignore_errors=True)
        raise


def summarise(files: DataFrame) -> IndexSummary:
    """Counters of an index in one pass."""
    k = F.col("kind")
    row = files.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(k == "text").alias("text"), F.count_if(k.isin("image", "raw", "video")).alias("media"),
        F.count_if(k == "binary").alias("binary"), F.count_if(k == "empty").alias("empty"), F.count_if(k == "link").alias("links"),
        F.count_if(has_flag(S.FTS_TRUNCATED)).alias("truncated"), F.count_if(has_flag(S.READ_ERROR)).alias("read_errors"),
        F.count_if(has_flag(S.SPARSE)).alias("sparse"), F.count_if(has_flag(S.PAX_UNPARSED)).alias("pax_unparsed"), F.count_if(has_flag(S.SHADOWED)).alias("shadowed"),
    ).first()
    return IndexSummary(**row.asDict())


@dataclass
class Index:
    """An index open for reading."""

    spark: SparkSession
    at: str
    meta: dict[str, str]

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        return Index(spark, os.path.abspath(path), read_meta(path))

    @property
    def mode(self) -> str:
        m = self.meta.get("content_mode", "")
        return m if m in CONTENT_MODES else "full"

    def table(self, name: str) -> DataFrame | None:
        at = os.path.join(self.at, name)
        return self.spark.read.parquet(at) if os.path.isdir(at) else None

    def files(self) -> DataFrame:
        return self.table("files")

    def postings(self) -> Inverted:
        if self.mode == "metadata-only":
            raise IndexError_(f"{self.at} holds metadata only; index it again with its contents to search it")
        return Inverted.read(self.spark, os.path.join(self.at, "postings"))


def discover(source_or_none: str | None, explicit: str | None, cwd: str = ".") -> str:
    """The index to use: the named one, the one beside the source, the only one in the working folder."""
    if explicit:
        return explicit
    if source_or_none:
        for at in (os.path.abspath(source_or_none) + SUFFIX, os.path.join(cwd, index_name(source_or_none))):
            if os.path.isdir(at):
                return at
    for name in sorted(os.listdir(cwd)):
        if name.endswith(SUFFIX):
            try:
                read_meta(os.path.join(cwd, name))
                return os.path.join(cwd, name)
            except IndexError_:
                continue
    raise IndexError_("no index found; name one, or index a source first")


def resolve_index(arg: str) -> str:
    """An index, or the index beside the source that arg names."""
    if os.path.isdir(arg) and os.path.exists(os.path.join(arg, "manifest.json")):
        return arg
    return discover(arg, None, os.path.dirname(os.path.abspath(arg)))
