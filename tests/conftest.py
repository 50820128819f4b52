import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siftstone.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "tests")
    s.sparkContext.setLogLevel("OFF")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


FILES = (
    "archive_id long, file_id long, path string, path_raw binary, entry_type string, kind string, size long, mtime_unix long, exif_unix long, "
    "exif_src string, content_hash binary, phash long, img_w int, img_h int, flags long"
)


@pytest.fixture(scope="session")
def make_files(spark):
    """Rows of files from partial dicts; what is left out has a plain value."""

    def make(rows):
        base = dict(
            archive_id=1, file_id=1, path="a.jpg", path_raw=None, entry_type="file", kind="image", size=10, mtime_unix=None, exif_unix=None,
            exif_src=None, content_hash=b"\x01" * 32, phash=None, img_w=None, img_h=None, flags=0,
        )
        return spark.createDataFrame([tuple((base | r).values()) for r in rows], FILES)

    return make


@pytest.fixture(scope="session")
def make_archives(spark):
    def make(rows):
        return spark.createDataFrame(
            [(i, f"label-{i}", f"/src/{i}", "tar", t, "ok", "full", "dct64-v1") for i, t in rows],
            "archive_id long, label string, source_path string, source_type string, indexed_unix long, status string, content_mode string, phash_algo string",
        )

    return make
