"""Column functions of the catalogue. All are built-in expressions; nulls in give null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftstone.schema import FLAG_NAMES

# Media kinds by extension.
IMAGE_EXT = ["jpg", "jpeg", "png", "heic", "webp", "tif", "tiff"]
RAW_EXT = ["nef", "cr2", "cr3", "arw", "dng"]
VIDEO_EXT = ["mp4", "mov", "avi", "mkv"]
CONTENT_MODES = ["full", "search-only", "metadata-only"]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def file_stem(path: str | Column) -> Column:
    """The last path part without its extension; a leading dot begins no extension."""
    return F.regexp_extract(_c(path), r"([^/]+?)(\.[^./]*)?/*\z", 1)


def ext_lower(path: str | Column) -> Column:
    """Lower-case extension of the last path part, empty if it has none."""
    return F.regexp_extract(F.lower(_c(path)), r"[^/]\.([^./]*)/*\z", 1)


def media_kind(path: str | Column) -> Column:
    """image, raw or video by extension, else null."""
    e = ext_lower(path)
    return F.when(e.isin(IMAGE_EXT), "image").when(e.isin(RAW_EXT), "raw").when(e.isin(VIDEO_EXT), "video")


def is_decodable_image(path: str | Column) -> Column:
    return ext_lower(path).isin([e for e in IMAGE_EXT if e != "heic"])


def metadata_kind(path: str | Column, size: str | Column) -> Column:
    """Kind of an entry whose content was never read."""
    return F.when(_c(size) == 0, "empty").otherwise(F.coalesce(media_kind(path), F.lit("binary")))


def content_kind(path: str | Column, content: str | Column, probe: int = 8192) -> Column:
    """Kind of an entry from its bytes: empty, then media by name, then binary if the first bytes hold a NUL, else text."""
    head = F.substring(_c(content), 1, probe)
    return (
        F.when(F.octet_length(_c(content)) == 0, "empty")
        .when(media_kind(path).isNotNull(), media_kind(path))
        .when(F.hex(head).rlike("^(..)*00"), "binary")
        .otherwise("text")
    )


def has_conflict_marker(path: str | Column) -> Column:
    """Names that look like copies: 'copy' in the stem, '(digits)' or '_' and one to three digits at its end."""
    return F.lower(file_stem(path)).rlike(r"copy|\([0-9]*\)\z|_[0-9]{1,3}\z")


def best_ts(exif: str = "exif_unix", mtime: str = "mtime_unix", indexed: str = "indexed_unix") -> Column:
    return F.coalesce(exif, mtime, indexed)


def best_ts_source(exif: str = "exif_unix", src: str = "exif_src", mtime: str = "mtime_unix", indexed: str = "indexed_unix") -> Column:
    """Where best_ts comes from; never null."""
    return (
        F.when(F.col(exif).isNotNull(), F.coalesce(F.concat(F.lit("exif:"), F.col(src)), F.lit("exif")))
        .when(F.col(mtime).isNotNull(), "tar-mtime")
        .when(F.col(indexed).isNotNull(), "archive-date")
        .otherwise("none")
    )


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(_c(path), "/+$", ""), "/"), -1)


def archive_label(source_path: str | Column, db_path: str | Column) -> Column:
    """File name of the source, or else of the index."""
    return F.coalesce(F.nullif(base_name(source_path), F.lit("")), base_name(db_path))


def prefixed_hash(h: str | Column, prefix: str = "b3") -> Column:
    return F.concat(F.lit(prefix + ":"), F.lower(F.hex(_c(h))))


def capture_text(raw: str | Column) -> tuple[Column, Column]:
    """(text, raw bytes kept): bytes that are no UTF-8 give replacement characters and are kept, others are not."""
    b = _c(raw)
    ok = F.is_valid_utf8(b.cast("string"))
    return F.make_valid_utf8(b.cast("string")), F.when(ok, None).otherwise(b)


def strip_marker(text: str | Column) -> Column:
    """Without U+0001, which delimits highlights."""
    return F.translate(_c(text), "\u0001", "")


def sanitize(text: str | Column) -> Column:
    """Control characters made visible: C0 as control pictures, DEL as U+2421, C1 as U+FFFD."""
    c0 = "".join(map(chr, range(0x20)))
    c1 = "".join(map(chr, range(0x80, 0xA0)))
    pictures = "".join(chr(0x2400 + i) for i in range(0x20))
    # translate() takes U+0000 in its map as a deletion, so that one is replaced first
    no_nul = F.replace(_c(text), F.lit("\u0000"), F.lit("␀"))
    return F.translate(no_nul, c0[1:] + "\x7f" + c1, pictures[1:] + "␡" + "�" * len(c1))


def flag_names(flags: str | Column) -> Column:
    names = [F.when(_c(flags).bitwiseAND(F.lit(bit).cast("long")) != 0, F.lit(name)) for bit, name in FLAG_NAMES.items()]
    return F.array_join(F.array_compact(F.array(*names)), ",")


def human_bytes(n: str | Column) -> Column:
    """Bytes with 1024 units up to TiB, one decimal; below 1 KiB the plain number."""
    x = _c(n).cast("double")
    out = F.when(x < 1024, F.concat(_c(n).cast("long").cast("string"), F.lit(" B")))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        scaled = F.concat(F.format_string("%.1f", F.bround(x / float(1024**power), 1)), F.lit(" " + unit))
        out = out.otherwise(scaled) if unit == "TiB" else out.when(x < float(1024 ** (power + 1)), scaled)
    return F.when(x.isNotNull(), out)


def fmt_unix(t: str | Column) -> Column:
    """UTC minutes; built from days and seconds, so that the session's time zone doesn't matter."""
    s = _c(t).cast("long")
    day = F.floor(s / F.lit(86400)).cast("int")
    left = F.pmod(s, F.lit(86400))
    return F.concat(
        F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd"), F.lit(" "),
        F.lpad(F.floor(left / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(left % 3600 / 60).cast("string"), 2, "0"),
    )


def format_count(n: str | Column) -> Column:
    return F.format_number(_c(n), 0)


def truncate_path(path: str | Column, most: int) -> Column:
    """At most that many characters, the end kept behind an ellipsis."""
    p = _c(path)
    return F.when(F.char_length(p) <= most, p).otherwise(F.concat(F.lit("…"), F.right(p, F.lit(most - 1))))


def share_bar(n: str | Column, top: str | Column, cells: int = 20) -> Column:
    return F.repeat(F.lit("█"), F.floor(_c(n) * cells / _c(top) + 0.5).cast("int"))


def content_mode(mode: str | Column) -> Column:
    """Unknown or missing modes read as full."""
    return F.when(_c(mode).isin(CONTENT_MODES), _c(mode)).otherwise("full")


def exif_unix(text: str | Column) -> Column:
    """Epoch seconds of 'YYYY:MM:DD HH:MM:SS' as UTC, null for anything else.

    Month 1 to 12, day 1 to 31 in every month, hour to 23, minute to 59, second to 60; the year 0 gives null.
    """
    s = _c(text)
    got = F.regexp_extract(s, r"(?s)\A(\d{4}):(\d{2}):(\d{2}).(\d{2}):(\d{2}):(\d{2})", 0) != ""
    part = lambda at, n: F.try_to_number(F.substring(s, at, n), F.lit("9" * n)).cast("int")
    y, mo, d, h, mi, se = part(1, 4), part(6, 2), part(9, 2), part(12, 2), part(15, 2), part(18, 2)
    ok = got & (y > 0) & mo.between(1, 12) & d.between(1, 31) & (h <= 23) & (mi <= 59) & (se <= 60)
    first = F.make_date(F.when(ok, y), F.when(ok, mo), F.lit(1))
    return F.when(ok, (F.unix_date(first).cast("long") + d - 1) * 86400 + h * 3600 + mi * 60 + se)


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a case-sensitive glob in which * also crosses '/'."""
    import re

    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + 1 + (glob[i + 1 : i + 2] == "^")
            end = glob.find("]", j + (glob[j : j + 1] == "]"))
            if end < 0:
                return "(?!)"  # an unclosed class matches nothing
            body = glob[i + 1 : end]
            neg = body.startswith("^")
            cls = re.sub(r"([\\\[\]&^])", r"\\\1", body[neg:])
            out.append("[" + "^" * neg + cls + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)\\A" + "".join(out) + "\\z"


def parse_size(text: str) -> int:
    """'10', '4K', '2M', '1G' in bytes; ValueError for anything else or beyond 64 bits."""
    t = text.strip()
    unit = {"k": 10, "m": 20, "g": 30}.get(t[-1:].lower(), 0)
    digits = t[:-1] if unit else t
    if not digits.isascii() or not digits.isdigit():
        raise ValueError(f"invalid size: {text}")
    n = int(digits) << unit
    if n >= 1 << 64:
        raise ValueError(f"size is too large: {text}")
    return n
