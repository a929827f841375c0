"""Byte ranges of files, for sources that Spark's own readers would give as one row."""

from __future__ import annotations

from typing import TYPE_CHECKING
from urllib.parse import unquote, urlparse

if TYPE_CHECKING:
    from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path on it."""
    from pyarrow import fs  # tens of megabytes that workers on other tasks don't need

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), unquote(urlparse(path).path) if path.startswith("file:") else path


def files_at(path: str) -> list[tuple[str, int]]:
    """Files and sizes at a path: itself, or what lies in the folder, but for hidden names and marks."""
    from pyarrow import fs

    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [f for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    return sorted((f"{path.rstrip('/')}/{f.base_name}", f.size) for f in found)


def after_line(f, at: int) -> int:
    """The place behind the first line end at or after `at`, or the file's end."""
    while data := f.read_at(1 << 16, at):
        end = data.find(b"\n")
        if end >= 0:
            return at + end + 1
        at += len(data)
    return at
