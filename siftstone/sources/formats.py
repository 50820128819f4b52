"""Archive formats by their first bytes; names are never trusted."""

from __future__ import annotations

import gzip
import io
from typing import BinaryIO

# Signatures.
ZSTD, GZIP, XZ, BZIP2 = b"\x28\xb5\x2f\xfd", b"\x1f\x8b", b"\xfd7zXZ\x00", b"BZh"
TAR_AT, TAR = 257, b"ustar"


class FormatError(ValueError):
    """Not an archive that can be read."""


def detect(head: bytes) -> str:
    """zstd, gzip or tar; FormatError for anything else, with what to do about the known ones."""
    if head.startswith(ZSTD):
        return "zstd"
    if head.startswith(GZIP):
        return "gzip"
    for magic, name in ((XZ, "xz"), (BZIP2, "bzip2")):
        if head.startswith(magic):
            raise FormatError(f"{name} archives can't be read; compress them again with zstd or gzip")
    if head[TAR_AT : TAR_AT + len(TAR)] == TAR:
        return "tar"
    raise FormatError("no archive format known here; expected .tar, .tar.gz or .tar.zst")


def detect_file(path: str) -> str:
    with open(path, "rb") as f:
        head = f.read(512)
    try:
        return detect(head)
    except FormatError as e:
        raise FormatError(f"{path}: {e}") from None


def open_stream(path: str, raw: BinaryIO) -> BinaryIO:
    """The tar stream behind raw, decompressed as it is read; several gzip members are read on."""
    kind = detect_file(path)
    if kind == "gzip":
        return gzip.GzipFile(fileobj=raw)
    if kind == "zstd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor(max_window_size=1 << 31).stream_reader(raw, read_across_frames=True), 1 << 18)
    return raw
