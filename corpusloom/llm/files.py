"""Opening files of the shared store from Python workers, by URI."""

from __future__ import annotations

import pyarrow.fs as pafs


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def make_folder(uri: str) -> None:
    system, path = _at(uri)
    system.create_dir(path, recursive=True)


def open_output(uri: str):
    system, path = _at(uri)
    return system.open_output_stream(path)


def open_input(uri: str):
    """A file that can be read at any offset."""
    system, path = _at(uri)
    return system.open_input_file(path)


def read_all(uri: str) -> bytes:
    with open_input(uri) as f:
        return f.read()


class RangeReader:
    """Reads (offset, length) ranges in ascending order, by requests of a few megabytes that several share."""

    def __init__(self, f, ahead: int = 2 << 20):
        self.f, self.ahead, self.start, self.data = f, ahead, 0, b""
        self.size = f.size()

    def read(self, offset: int, length: int) -> bytes:
        if offset < self.start or offset + length > self.start + len(self.data):
            self.f.seek(offset)
            self.start, self.data = offset, self.f.read(min(max(length, self.ahead), self.size - offset))
        low = offset - self.start
        return self.data[low : low + length]
