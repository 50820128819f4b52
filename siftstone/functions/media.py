"""Pictures: fingerprints, decoding, capture dates. Run inside readers and Arrow functions."""

from __future__ import annotations

import re
import struct
import zlib
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALGORITHM = "dct64-v1"
MAX_SIDE, MAX_BYTES = 16_384, 512 << 20
SIDE, BLOCK = 32, 8


def luma(rgb: np.ndarray) -> np.ndarray:
    """8-bit luma of an (h, w, 3 or 4) or (h, w) array, in integers."""
    if rgb.ndim == 2:
        return rgb
    x = rgb[..., :3].astype(np.uint32)
    return ((2126 * x[..., 0] + 7152 * x[..., 1] + 722 * x[..., 2]) // 10_000).astype(np.uint8)


def _lanczos(n: int, out: int) -> np.ndarray:
    """(out, n) weights of a Lanczos resampling with three lobes, widened for shrinking."""
    ratio = np.float32(n) / np.float32(out)
    scale = max(ratio, np.float32(1))
    support = np.float32(3) * scale
    w = np.zeros((out, n), dtype=np.float32)
    for o in range(out):
        centre = (np.float32(o) + np.float32(0.5)) * ratio
        lo = min(max(int(np.floor(centre - support)), 0), n - 1)
        hi = min(max(int(np.ceil(centre + support)), lo + 1), n)
        x = ((np.arange(lo, hi, dtype=np.float32) - (centre - np.float32(0.5))) / scale).astype(np.float32)
        k = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0).astype(np.float32)
        w[o, lo:hi] = k / k.sum(dtype=np.float32)
    return w


def shrink(gray: np.ndarray, side: int = SIDE) -> np.ndarray:
    h, w = gray.shape
    rows = _lanczos(h, side) @ gray.astype(np.float32)
    both = rows @ _lanczos(w, side).T
    return np.clip(both, 0, 255).astype(np.uint8)  # cut off, not rounded


def fingerprint(gray: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint: which low-frequency cosine coefficients lie above their median."""
    small = shrink(gray).astype(np.float64)
    k, n = np.arange(SIDE)[:, None], np.arange(SIDE)[None, :]
    table = np.cos(np.pi / SIDE * (n + 0.5) * k)
    low = (table @ small @ table.T)[:BLOCK, :BLOCK].ravel()
    ordered = np.sort(low)
    median = (ordered[31] + ordered[32]) / 2
    above = low > median + 1e-9 * (np.abs(low).max() + 1)
    return int("".join("1" if b else "0" for b in above), 2)


def signed64(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def decode_png(data: bytes) -> np.ndarray | None:
    """Pixels of a PNG (all colour types and depths, not interlaced); None if it isn't one or is over the limits."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, idat, palette = 8, [], None
    w = h = depth = kind = 0
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", body)
            if lace or not (0 < w <= MAX_SIDE and 0 < h <= MAX_SIDE):
                return None
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            idat.append(body)
        elif name == b"IEND":
            break
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    stride = (w * channels * depth + 7) // 8
    if h * stride > MAX_BYTES:
        return None
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(h, stride + 1)
    step = max(1, channels * depth // 8)
    out = np.zeros((h, stride), np.uint8)
    before = np.zeros(stride, np.uint8)
    for y in range(h):
        line, f = raw[y, 1:].copy(), raw[y, 0]
        if f == 2:
            line += before
        elif f == 1:
            for s in range(step):
                line[s::step] = np.cumsum(line[s::step], dtype=np.uint32).astype(np.uint8)
        elif f in (3, 4):
            a = line.astype(np.int64).tolist()
            up = before.tolist()
            for i in range(stride):
                left = a[i - step] if i >= step else 0
                if f == 3:
                    a[i] = (a[i] + (left + up[i]) // 2) & 255
                else:
                    c = up[i - step] if i >= step else 0
                    p = left + up[i] - c
                    pa, pb, pc = abs(p - left), abs(p - up[i]), abs(p - c)
                    a[i] = (a[i] + (left if pa <= pb and pa <= pc else up[i] if pb <= pc else c)) & 255
            line = np.array(a, np.uint8)
        out[y] = before = line
    if depth == 16:
        out = out.reshape(h, -1, 2)[..., 0]
    elif depth < 8:
        bits = np.unpackbits(out, axis=1).reshape(h, -1, depth)[:, : w * channels]
        out = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)
        if kind != 3:
            out = (out.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    px = out.reshape(h, w, channels)
    if kind == 3:
        return palette[np.minimum(px[..., 0], len(palette) - 1)]
    return px[..., 0] if kind in (0, 4) else px


def decode_bmp_or_tiff(data: bytes) -> np.ndarray | None:
    """Pixels of an uncompressed 24- or 32-bit BMP or an uncompressed 8-bit grey or RGB TIFF; None otherwise."""
    if data[:2] == b"BM":
        off, _, w, h, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
        if packed or bits not in (24, 32) or not (0 < w <= MAX_SIDE and 0 < abs(h) <= MAX_SIDE):
            return None
        stride = (w * bits // 8 + 3) // 4 * 4
        px = np.frombuffer(data, np.uint8, stride * abs(h), off).reshape(abs(h), stride)[:, : w * bits // 8].reshape(abs(h), w, -1)[..., 2::-1]
        return px[::-1] if h > 0 else px
    if data[:4] in (b"II*\0", b"MM\0*"):
        e, tags = _tiff_ifd(data, 0, struct.unpack("<I" if data[:1] == b"I" else ">I", data[4:8])[0])
        del e
        w, h, packed = tags.get(256), tags.get(257), tags.get(259, 1)
        if packed != 1 or not isinstance(w, int) or not isinstance(h, int) or not (0 < w <= MAX_SIDE and 0 < h <= MAX_SIDE):
            return None
        spp = tags.get(277, 1)
        offs, counts = tags.get(273), tags.get(279)
        offs, counts = ([x] if isinstance(x, int) else list(x or []) for x in (offs, counts))
        body = b"".join(data[o : o + c] for o, c in zip(offs, counts))
        if spp not in (1, 3, 4) or len(body) < w * h * spp:
            return None
        px = np.frombuffer(body, np.uint8, w * h * spp).reshape(h, w, spp)
        return px[..., 0] if spp == 1 else px
    return None


def decode_guarded(data: bytes) -> np.ndarray | None:
    """Pixels, or None for anything that can't be decoded within the limits; never raises."""
    try:
        px = decode_png(data)
        return px if px is not None else decode_bmp_or_tiff(data)
    except Exception:  # a damaged picture must not end the scan of its archive
        return None


# -- capture dates


def _tiff_ifd(tiff: bytes, base: int, offset: int) -> tuple[str, dict]:
    e = "<" if tiff[base : base + 1] == b"I" else ">"
    (n,) = struct.unpack(e + "H", tiff[base + offset : base + offset + 2])
    tags = {}
    for k in range(n):
        at = base + offset + 2 + 12 * k
        tag, kind, count = struct.unpack(e + "HHI", tiff[at : at + 8])
        size = {1: 1, 2: 1, 3: 2, 4: 4, 7: 1}.get(kind)
        if size is None:
            continue
        total = size * count
        where = at + 8 if total <= 4 else base + struct.unpack(e + "I", tiff[at + 8 : at + 12])[0]
        raw = tiff[where : where + total]
        if len(raw) < total:
            continue
        if kind in (3, 4):
            vals = struct.unpack(e + ("H" if kind == 3 else "I") * count, raw)
            tags[tag] = vals[0] if count == 1 else vals
        elif kind == 2:
            tags[tag] = raw
    return e, tags


def _tiff_of(data: bytes) -> bytes | None:
    """The TIFF structure that holds the metadata of a JPEG, TIFF, PNG or WebP file."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            marker, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + n]
            if marker == 0xDA:
                return None
            at += 2 + n
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            n, name = struct.unpack(">I4s", data[at : at + 8])
            if name == b"eXIf":
                return data[at + 8 : at + 8 + n]
            at += 12 + n
        return None
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            name, n = struct.unpack("<4sI", data[at : at + 8])
            if name == b"EXIF":
                body = data[at + 8 : at + 8 + n]
                return body[6:] if body[:6] == b"Exif\0\0" else body
            at += 8 + n + n % 2
    return None


def parse_exif_datetime(raw: bytes) -> int | None:
    """Epoch seconds of 'YYYY:MM:DD HH:MM:SS' read as UTC; None for placeholders and anything out of range."""
    try:
        s = raw.decode("utf-8").rstrip("\0").strip()
    except UnicodeDecodeError:
        return None
    m = re.match(r"(\d{4}):(\d{2}):(\d{2})[\s\S](\d{2}):(\d{2}):(\d{2})", s, re.A)
    if not m:
        return None
    y, mo, d, h, mi, sec = map(int, m.groups())
    if not (y and 1 <= mo <= 12 and 1 <= d <= 31 and h <= 23 and mi <= 59 and sec <= 60):
        return None
    days = date(y, mo, 1).toordinal() - date(1970, 1, 1).toordinal() + d - 1
    return days * 86_400 + h * 3600 + mi * 60 + sec


def extract_date(data: bytes) -> tuple[int, str] | None:
    """(epoch seconds, tag) of the most trusted capture date that parses."""
    try:
        tiff = _tiff_of(data)
        if tiff is None:
            return None
        e = "<" if tiff[:1] == b"I" else ">"
        _, main = _tiff_ifd(tiff, 0, struct.unpack(e + "I", tiff[4:8])[0])
        sub = _tiff_ifd(tiff, 0, main[0x8769])[1] if isinstance(main.get(0x8769), int) else {}
    except (struct.error, IndexError):
        return None
    for tags, tag, name in ((sub, 0x9003, "DateTimeOriginal"), (sub, 0x9004, "DateTimeDigitized"), (main, 0x0132, "DateTime")):
        raw = tags.get(tag)
        if isinstance(raw, bytes) and (t := parse_exif_datetime(raw.split(b"\0")[0])) is not None:
            return t, name
    return None


_PICTURE = T.StructType([T.StructField("phash", T.LongType()), T.StructField("img_w", T.IntegerType()), T.StructField("img_h", T.IntegerType())])
_EXIF = T.StructType([T.StructField("exif_unix", T.LongType()), T.StructField("exif_src", T.StringType())])


@F.pandas_udf(_PICTURE)
def picture_udf(content: pd.Series) -> pd.DataFrame:
    """Fingerprint and size of pictures in a binary column; nulls where a picture can't be decoded."""
    rows = []
    for data in content:
        px = None if data is None else decode_guarded(bytes(data))
        rows.append((None, None, None) if px is None else (signed64(fingerprint(luma(px))), px.shape[1], px.shape[0]))
    return pd.DataFrame(rows, columns=["phash", "img_w", "img_h"]).astype({"phash": "Int64", "img_w": "Int32", "img_h": "Int32"})


@F.pandas_udf(_EXIF)
def exif_udf(content: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if data is None else extract_date(bytes(data)) or (None, None) for data in content]
    return pd.DataFrame(rows, columns=["exif_unix", "exif_src"]).astype({"exif_unix": "Int64"})
