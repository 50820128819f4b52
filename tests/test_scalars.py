import pytest
from pyspark.sql import functions as F

from siftstone.functions import scalars as fn
from siftstone.functions.blake3 import Blake3, blake3
from siftstone.functions.media import decode_guarded, extract_date, fingerprint, luma, parse_exif_datetime
from siftstone.schema import hex64


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expr).collect()]


def test_extensions_and_kinds(spark):
    paths = ["a/b.JPG", ".hidden", "x.tar.gz", "dir.d/file", "c.nef", "v.MKV/", None, ""]
    assert column(spark, paths, "string", fn.ext_lower("x")) == ["jpg", "", "gz", "", "nef", "mkv", None, ""]
    assert column(spark, paths, "string", fn.media_kind("x")) == ["image", None, None, None, "raw", "video", None, None]


def test_conflict_marker(spark):
    paths = ["IMG (1).jpg", "img_2.jpg", "My Copy.txt", "IMG_0142.jpg", "plain.txt", "a().x", "x_1234.png", "copy/x.png", None]
    assert column(spark, paths, "string", fn.has_conflict_marker("x")) == [True, True, True, False, False, True, False, False, None]


def test_renders(spark):
    assert column(spark, [0, 1023, 4 * 1024**2 + 100 * 1024, 85248, None], "long", fn.human_bytes("x")) == ["0 B", "1023 B", "4.1 MiB", "83.2 KiB", None]
    assert column(spark, [1_688_498_553, -1, None], "long", fn.fmt_unix("x")) == ["2023-07-04 19:22", "1969-12-31 23:59", None]
    assert column(spark, [1234567], "long", fn.format_count("x")) == ["1,234,567"]
    assert column(spark, ["abcdef", "abc"], "string", fn.truncate_path("x", 4)) == ["…def", "abc"]
    assert column(spark, [-1, 1, None], "long", hex64(F.col("x"))) == ["f" * 16, "0" * 15 + "1", None]


def test_sanitize_and_marker(spark):
    assert column(spark, ["a\x1b[31m\x00\x7f\x85", None], "string", fn.sanitize("x")) == ["a␛[31m␀␡�", None]
    assert column(spark, ["\x01hit\x01"], "string", fn.strip_marker("x")) == ["hit"]


def test_exif_dates(spark):
    texts = ["2023:07:04 19:22:33", "2020:02:31 00:00:60", "0000:00:00 00:00:00", "2020:13:01 00:00:00", "garbage", None]
    got = column(spark, texts, "string", fn.exif_unix("x"))
    assert got == [parse_exif_datetime((t or "").encode()) for t in texts]
    assert got[:2] == [1_688_498_553, 1_583_107_260]


def test_glob(spark):
    paths = ["a/b/c.txt", "a/b.txt", "x[1].txt", "Q.TXT"]
    assert column(spark, paths, "string", F.col("x").rlike(fn.glob_regex("a*.txt"))) == [True, True, False, False]
    assert column(spark, paths, "string", F.col("x").rlike(fn.glob_regex("?[[]1].txt"))) == [False, False, True, False]
    assert column(spark, paths, "string", F.col("x").rlike(fn.glob_regex("[^a]*"))) == [False, False, True, True]


def test_parse_size():
    assert [fn.parse_size(x) for x in ("7", "2K", "3m", "1G")] == [7, 2048, 3 << 20, 1 << 30]
    for bad in ("", "x", "-1", "99999999999999999999G", "1.5M"):
        with pytest.raises(ValueError):
            fn.parse_size(bad)


def test_capture_text(spark):
    df = spark.createDataFrame([(bytearray(b"caf\xe9"),), (bytearray("é".encode()),)], "x binary")
    text, raw = fn.capture_text("x")
    rows = df.select(text.alias("t"), raw.alias("r")).collect()
    assert (rows[0].t, bytes(rows[0].r), rows[1].t, rows[1].r) == ("caf�", b"caf\xe9", "é", None)


def test_blake3():
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    buf = bytearray(1 << 20)
    for i in range(4096):
        buf[i], buf[(512 << 10) + i] = i % 251, ((i * 7) % 249) | 1
    assert blake3(bytes(buf)).hex() == "9a1162419f4485df0e17b63e2268124eb28c4f4448418a4f5fbe4a0159e3f4ee"
    data = bytes(i * 31 % 256 for i in range(3_000_001))
    h = Blake3()
    for i in range(0, len(data), 70_001):
        h.update(data[i : i + 70_001])
    assert h.digest() == blake3(data)


def test_fingerprint_of_known_images():
    import numpy as np

    def image(seed, w, h):
        y, x = np.mgrid[0:h, 0:w].astype(np.uint64)
        b = np.where((x // 16 + y // 16 + seed) % 2 == 0, 200, 40)
        return np.stack([(x * 7 + y * 3 + seed * 11) % 256, (x * x // max(w // 4, 1) + y * 2 + seed * 5) % 256, b], -1).astype(np.uint8)

    assert fingerprint(luma(image(1, 320, 240))) == 0xF103F1033EFCFC01
    assert fingerprint(luma(image(7, 512, 384))) == 0xDDE055C057C003FF


def png(px):
    import struct
    import zlib

    h, w = px.shape[:2]
    raw = b"".join(b"\0" + px[y].tobytes() for y in range(h))
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    kind = 2 if px.ndim == 3 else 0
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tiff_with_date(text):
    import struct

    raw = text.encode() + b"\0"
    sub = 8 + 2 + 12 + 4
    return (
        b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8769, 4, 1, sub) + struct.pack("<I", 0)
        + struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, len(raw), sub + 18) + struct.pack("<I", 0) + raw
    )


def test_decoding_and_dates():
    import numpy as np

    px = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (decode_guarded(png(px)) == px).all()
    assert decode_guarded(b"\x89PNG\r\n\x1a\nbroken") is None and decode_guarded(b"") is None
    assert extract_date(tiff_with_date("2020:06:15 08:30:00")) == (1_592_209_800, "DateTimeOriginal")
    assert extract_date(b"II*\0\xff\xff\xff\xff") is None and extract_date(b"") is None
