"""Guards for what is written beside the user's own files: nothing is overwritten, no source is ever a destination."""

from __future__ import annotations

import os
import shutil
import uuid


class DestinationError(ValueError):
    """A destination that must not be written."""


class ProtectedSet:
    """Files and trees, known by device and inode, that no output may replace or land in."""

    def __init__(self) -> None:
        self._ids: dict[tuple[int, int], str] = {}
        self._trees: list[str] = []

    def add_file(self, path: str) -> None:
        try:
            st = os.stat(path)
            self._ids[(st.st_dev, st.st_ino)] = path
        except OSError:
            pass

    def add_tree(self, path: str) -> None:
        self._trees.append(os.path.realpath(path))
        self.add_file(path)

    def check(self, dest: str) -> None:
        """DestinationError if dest is a link, a protected file, or inside a protected tree."""
        if os.path.islink(dest):
            raise DestinationError(f"{dest} is a symbolic link")
        if os.path.lexists(dest):
            st = os.stat(dest)
            if hit := self._ids.get((st.st_dev, st.st_ino)):
                raise DestinationError(f"{dest} is {hit} itself")
        real = os.path.realpath(dest)
        for tree in self._trees:
            if real == tree or real.startswith(tree.rstrip("/") + "/"):
                raise DestinationError(f"{dest} lies inside {tree}")


def stage_path(dest: str) -> str:
    folder, name = os.path.split(os.path.abspath(dest))
    return os.path.join(folder, f".{name}.staged-{uuid.uuid4().hex[:12]}")


def write_new_file(dest: str, data: bytes, protected: ProtectedSet | None = None) -> None:
    """Publish a report under a name that must not exist yet; never a half-written file."""
    if protected:
        protected.check(dest)
    tmp = stage_path(dest)
    try:
        with open(tmp, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.link(tmp, dest)  # fails if dest exists
    except FileExistsError:
        raise DestinationError(f"{dest} already exists") from None
    finally:
        if os.path.lexists(tmp):
            os.unlink(tmp)


def promote(staged: str, dest: str) -> None:
    """Put a finished folder in the place of an older one; the old one goes only when the new one stands."""
    old = stage_path(dest) + "-old" if os.path.lexists(dest) else None
    if old:
        os.rename(dest, old)
    try:
        os.rename(staged, dest)
    except OSError:
        if old:
            os.rename(old, dest)
        raise
    if old:
        shutil.rmtree(old)
