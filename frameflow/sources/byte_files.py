"""Byte ranges of files, for readers that split one file among tasks.

Files are opened by their address through Arrow's file systems: local paths, s3:// (s3a:// means the same), gs:// and
hdfs://. Every task opens its file itself and reads just its range.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import NativeFile, fs


def _file_system(address: str) -> tuple[fs.FileSystem, str]:
    if "://" not in address:
        return fs.LocalFileSystem(), os.path.abspath(address.removeprefix("file:"))
    scheme, rest = address.split("://", 1)
    return fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{rest}")


def listed(pattern: str, within: str = "*") -> list[tuple[str, int]]:
    """(address, bytes) of the files that a path names, in order: the path itself, the files of a folder whose names fit
    `within`, or those that fit a pattern in the last part of the path. None is an error."""
    system, path = _file_system(pattern)
    prefix = pattern[: -len(path)] if "://" in pattern and pattern.endswith(path) else ""
    if "://" in pattern and not prefix:
        prefix = pattern.split("://", 1)[0] + "://"
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        found = [info]
    else:
        folder, name = (path, within) if info.type == fs.FileType.Directory else os.path.split(path)
        found = [f for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File and fnmatch.fnmatch(os.path.basename(f.path), name)]
    if not found:
        raise FileNotFoundError(pattern)
    return sorted((prefix + f.path, f.size) for f in found)


@dataclass(frozen=True)
class Range:
    """Bytes start..end-1 of a file of `size` bytes."""

    path: str
    start: int
    end: int
    size: int


def ranges(pattern: str, split_bytes: int, within: str = "*") -> list[Range]:
    """The files in ranges of split_bytes; an empty file is one empty range."""
    if split_bytes < 1:
        raise ValueError("ranges have at least one byte")
    return [Range(path, at, min(size, at + split_bytes), size) for path, size in listed(pattern, within) for at in range(0, max(size, 1), split_bytes)]


def opened(address: str) -> NativeFile:
    system, path = _file_system(address)
    return system.open_input_file(path)


def created(address: str) -> NativeFile:
    """A new file, with the folders above it."""
    system, path = _file_system(address)
    system.create_dir(os.path.dirname(path))
    return system.open_output_stream(path)


def exists(address: str) -> bool:
    system, path = _file_system(address)
    return system.get_file_info(path).type != fs.FileType.NotFound


def move(source: str, target: str) -> None:
    system, path = _file_system(source)
    system.move(path, _file_system(target)[1])


def remove(address: str) -> None:
    system, path = _file_system(address)
    system.delete_file(path)


class Window:
    """A file as bytes by offset, read ahead in blocks; what lies before `keep` is let go."""

    def __init__(self, path: str, block: int = 1 << 20):
        self.file, self.block = opened(path), block
        self.start, self.data = 0, b""

    def __enter__(self) -> Window:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def at(self, offset: int, n: int) -> bytes:
        """n bytes from offset, fewer at the end of the file."""
        if not self.start <= offset <= offset + n <= self.start + len(self.data):
            have = self.data[offset - self.start :] if self.start <= offset <= self.start + len(self.data) else b""
            self.file.seek(offset + len(have))
            self.start, self.data = offset, have + self.file.read(max(n - len(have), self.block))
        return self.data[offset - self.start : offset - self.start + n]


def blocks(path: str, start: int, end: int, block: int = 1 << 20) -> Iterator[bytes]:
    """Bytes start..end-1 of a file, block by block."""
    with opened(path) as file:
        file.seek(start)
        while start < end and (got := file.read(min(block, end - start))):
            yield got
            start += len(got)
