"""Scanned pages as a data source: ``spark.read.format("scans").option("path", ...)``.

Files lie in any store that Arrow's file systems know. Planning lists them and reads the directories of large multi-page files only, from their headers; a
task then gets some small files, or a range of pages of a large one, of which it reads no other bytes. Rows are pages, in grey; a file or page that can't be read is a row with its problem.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.udfs import to_gray

SCHEMA = "path string, page int, width int, height int, gray binary, problem string"
KINDS = (".tif", ".tiff", ".pgm", ".ppm", ".pnm")
#: Files of more bytes are split by pages; smaller ones share a task up to as many bytes.
TASK_BYTES = 8 << 20
#: Pixels of a page at most: what a header says isn't trusted beyond it.
MOST_PIXELS = 1 << 28
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4}


class Piece(NamedTuple):
    """A file, or the pages ``first``.. of one that begin at ``offsets``."""

    path: str
    offsets: tuple[int, ...] = ()
    first: int = 1


class Task(InputPartition):
    def __init__(self, pieces: list[Piece]) -> None:
        self.pieces = pieces


def _order(head: bytes) -> str:
    if head[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("no page file")
    return "<" if head[:2] == b"II" else ">"


def page_offsets(file) -> list[int]:
    """Where the directories of a multi-page file's pages begin; reads a few bytes of each."""
    file.seek(0)
    head = file.read(8)
    order = _order(head)
    at, found = struct.unpack(order + "I", head[4:8])[0], []
    while at:
        if at in found:
            raise ValueError("pages go round")
        found.append(at)
        file.seek(at)
        entries = struct.unpack(order + "H", file.read(2))[0]
        file.seek(at + 2 + 12 * entries)
        at = struct.unpack(order + "I", file.read(4))[0]
    return found


def _fields(file, order: str, at: int) -> dict[int, list[int]]:
    """The whole-number fields of a page's directory."""
    file.seek(at)
    count = struct.unpack(order + "H", file.read(2))[0]
    raw, out = file.read(12 * count), {}
    for k in range(count):
        tag, kind, n = struct.unpack(order + "HHI", raw[12 * k : 12 * k + 8])
        if kind in _SIZES and n < 1 << 20:
            value, size = raw[12 * k + 8 : 12 * k + 12], _SIZES[kind] * n
            if size > 4:
                file.seek(struct.unpack(order + "I", value)[0])
                value = file.read(size)
            out[tag] = list(struct.unpack(order + f"{n}{ {1: 'B', 2: 'B', 3: 'H', 4: 'I'}[kind] }", value[:size]))
    return out


def _unpacked(raw: bytes) -> bytes:
    """Byte runs: a count, then bytes as they are or one to repeat."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += raw[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def tiff_page(file, at: int) -> np.ndarray:
    """A page of 8-bit grey or colours, plain, deflated or in byte runs."""
    file.seek(0)
    order = _order(file.read(8))
    f = _fields(file, order, at)
    one = lambda tag, usual: f.get(tag, [usual])[0]
    width, height, samples, packing = one(256, 0), one(257, 0), one(277, 1), one(259, 1)
    if not 0 < width * height <= MOST_PIXELS or set(f.get(258, [1])) != {8} or samples not in (1, 3, 4) or packing not in (1, 8, 32946, 32773) or one(284, 1) != 1:
        raise ValueError("kind of page")
    size, data = width * height * samples, bytearray()
    for start, n in zip(f.get(273, []), f.get(279, [])):
        file.seek(start)
        raw = file.read(n)
        data += raw if packing == 1 else _unpacked(raw) if packing == 32773 else zlib.decompressobj().decompress(raw, size - len(data) + 1)
    if len(data) < size:
        raise ValueError("page too short")
    pixels = np.frombuffer(bytes(data[:size]), np.uint8).reshape(height, width, samples)
    if one(317, 1) == 2:
        pixels = np.cumsum(pixels, axis=1, dtype=np.uint8)
    gray = to_gray(pixels if samples > 1 else pixels[..., 0])
    return 255 - gray if one(262, 1) == 0 else gray


def plain_page(raw: bytes) -> np.ndarray:
    """A page of the plain formats: P5 grey, P6 colours."""
    words, at = [], 0
    while len(words) < 4:
        while at < len(raw) and raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.find(b"\n", at) % (len(raw) + 1)
            continue
        end = at
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("no page file")
        words.append(raw[at:end])
        at = end
    samples = {b"P5": 1, b"P6": 3}.get(words[0])
    if samples is None or words[3] != b"255":
        raise ValueError("kind of page")
    width, height = int(words[1]), int(words[2])
    data = raw[at + 1 : at + 1 + width * height * samples]
    if not 0 < width * height <= MOST_PIXELS or len(data) < width * height * samples:
        raise ValueError("page too short")
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, samples)
    return to_gray(pixels if samples == 3 else pixels[..., 0])


def pages_of(file, piece: Piece) -> Iterator[tuple]:
    """The rows of a piece."""
    row = lambda page, gray: (piece.path, page, gray.shape[1], gray.shape[0], gray.tobytes(), None)
    try:
        file.seek(0)
        if file.read(2) in (b"II", b"MM"):
            offsets = piece.offsets or tuple(page_offsets(file))
        else:
            file.seek(0)
            yield row(1, plain_page(file.read()))
            return
    except (ValueError, struct.error, OSError) as e:
        yield piece.path, None, None, None, None, str(e)[:200]
        return
    for k, at in enumerate(offsets):
        try:
            yield row(piece.first + k, tiff_page(file, at))
        except (ValueError, struct.error, OSError, zlib.error) as e:
            yield piece.path, piece.first + k, None, None, None, str(e)[:200]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        self.task_pages = int(options.get("taskPages", 16))

    def partitions(self) -> list[Task]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(root)
        every = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        tasks, some, size = [], [], 0
        for f in sorted((f for f in every if f.type == fs.FileType.File and f.path.lower().endswith(KINDS)), key=lambda f: f.path):
            if f.size > self.task_bytes and f.path.lower().endswith((".tif", ".tiff")):
                try:
                    with store.open_input_file(f.path) as file:
                        offsets = page_offsets(file)
                except (ValueError, struct.error, OSError):
                    offsets = []  # the task will tell
                if len(offsets) > self.task_pages:
                    tasks += [Task([Piece(f.path, tuple(offsets[k : k + self.task_pages]), k + 1)]) for k in range(0, len(offsets), self.task_pages)]
                    continue
            if some and size + f.size > self.task_bytes:
                tasks.append(Task(some))
                some, size = [], 0
            some.append(Piece(f.path))
            size += f.size
        return [*tasks, Task(some)] if some else tasks

    def read(self, partition: Task) -> Iterator[tuple]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for piece in partition.pieces:
            try:
                with store.open_input_file(piece.path) as file:
                    yield from pages_of(file, piece)
            except OSError as e:
                yield piece.path, None, None, None, None, str(e)[:200]


class Scans(DataSource):
    """Options: path (a file or folder), taskBytes, taskPages."""

    @classmethod
    def name(cls) -> str:
        return "scans"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Scans)
