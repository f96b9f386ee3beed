"""Files by path or URI, opened on executors."""

from __future__ import annotations

import bz2
import fnmatch
import gzip
import io
import os
from typing import BinaryIO

GLOB = "*?["


def _fs(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def listing(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files that a path, folder or pattern names, in order of names."""
    from pyarrow import fs

    f, p = _fs(path)
    prefix = path[: len(path) - len(p)] if "://" in path and path.endswith(p) else ""
    if any(c in p for c in GLOB):
        base = p.rsplit("/", 1)[0]
        found = [x for x in f.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.File and fnmatch.fnmatch(x.path, p)]
    else:
        info = f.get_file_info(p)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else [x for x in f.get_file_info(fs.FileSelector(p)) if x.type == fs.FileType.File and not os.path.basename(x.path).startswith(("_", "."))]
    return sorted((prefix + x.path, x.size) for x in found)


def open_raw(path: str) -> BinaryIO:
    f, p = _fs(path)
    return f.open_input_file(p)


def open_plain(path: str) -> BinaryIO:
    """The file's bytes after undoing gzip or bzip2, told by the first bytes; nested compression too."""
    raw: BinaryIO = io.BufferedReader(open_raw(path), 1 << 20)
    while True:
        magic = raw.peek(4)[:4]
        if magic[:2] == b"\x1f\x8b":
            raw = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)
        elif magic[:3] == b"BZh":
            raw = io.BufferedReader(bz2.BZ2File(raw), 1 << 20)
        else:
            return raw


def compressed(path: str) -> bool:
    with open_raw(path) as f:
        head = f.read(3)
    return head[:2] == b"\x1f\x8b" or head == b"BZh"
