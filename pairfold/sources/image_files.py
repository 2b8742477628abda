"""A Spark data source of image files: listing in parallel, sizes from headers, and the structure of each file's body.

Files are read by ranges.  A PNG is walked chunk by chunk to its end, a JPEG segment by segment to its first scan, so a file
that is cut off or whose parts don't fit together is found without its pixels being read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, height int, width int, n_channels int, problem string, size long, bytes_read long"
#: Chunks of more bytes are passed over by their length alone unless the whole file is checked.
SMALL_CHUNK = 4096
#: Samples a pixel of PNG colour types, and what a decoder gives of them (grey with alpha is widened).
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PNG_CHANNELS = {0: 1, 2: 3, 3: 3, 4: 4, 6: 4}
PNG_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: First column and row, and steps, of the seven passes of an interlaced PNG.
PNG_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
#: JPEG frame headers (other markers of C0..CF are tables), and markers without a length.
JPEG_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
JPEG_BARE = {0x01, *range(0xD0, 0xD8)}


class Broken(ValueError):
    """A file that no decoder would read."""


class Ranges:
    """A file that is read by ranges, and how many bytes were."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.read = file, file.size(), 0

    def at(self, offset: int, n: int) -> bytes:
        got = self.file.read_at(n, offset) if offset < self.size else b""
        self.read += len(got)
        if len(got) < n:
            raise Broken("the file is cut off")
        return got


class _Pixels:
    """Checks the pixel data of a PNG as it comes: it must inflate to the rows that the header says, with filters 0 to 4."""

    def __init__(self, width: int, height: int, bits: int, interlaced: bool) -> None:
        passes = PNG_PASSES if interlaced else [(0, 0, 1, 1)]
        sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes if x < width and y < height]
        self.rows = ((w * bits + 7) // 8 for w, h in sizes for _ in range(h))
        self.inflate, self.left = zlib.decompressobj(), 0

    def add(self, data: bytes) -> None:
        while data:
            try:
                out = self.inflate.decompress(data, 1 << 20)
            except zlib.error as e:
                raise Broken("the pixel data does not inflate") from e
            data = self.inflate.unconsumed_tail
            at = 0
            while at < len(out):
                if not self.left:
                    row = next(self.rows, None)
                    if row is None or out[at] > 4:
                        raise Broken("the pixel data has other rows")
                    self.left, at = row, at + 1
                step = min(self.left, len(out) - at)
                self.left, at = self.left - step, at + step
            if self.inflate.eof:
                break

    def end(self) -> None:
        if not self.inflate.eof or self.left or next(self.rows, None) is not None:
            raise Broken("the pixel data ends early")


def png(file: Ranges, whole: bool = False) -> tuple[int, int, int]:
    """Height, width and channels; Broken if its chunks are not those of a complete image.

    The header, small chunks and, with ``whole``, all chunks are held against their checksums; ``whole`` also inflates the
    pixel data, in pieces of a MB.
    """
    if file.at(0, 8) != b"\x89PNG\r\n\x1a\n":
        raise Broken("not a PNG")
    at, pixels, palette, alpha, header = 8, None, False, False, None
    data_state = 0  # 0: none yet, 1: in the run of data chunks, 2: after it
    while True:
        length, kind = struct.unpack(">I4s", file.at(at, 8))
        if length >= 1 << 31 or not kind.isalpha():
            raise Broken("a chunk has no proper head")
        end = at + 12 + length
        if end > file.size:
            raise Broken("the file is cut off")
        if (header is None) != (kind == b"IHDR"):
            raise Broken("the header is not the first chunk")
        if length <= SMALL_CHUNK or whole:
            crc, place, body = zlib.crc32(kind), at + 8, b""
            while place < end - 4:
                body = file.at(place, min(1 << 20, end - 4 - place))
                crc, place = zlib.crc32(body, crc), place + len(body)
                if pixels and kind == b"IDAT":
                    pixels.add(body)
            if crc != struct.unpack(">I", file.at(end - 4, 4))[0]:
                raise Broken("a chunk fails its checksum")
        if kind == b"IHDR":
            if length != 13:
                raise Broken("the header has another length")
            width, height, depth, colour, method, filters, laced = header = struct.unpack(">IIBBBBB", body)
            if not (0 < width < 1 << 31 and 0 < height < 1 << 31 and depth in PNG_DEPTHS.get(colour, ()) and not method and not filters and laced < 2):
                raise Broken("the header has values that no image has")
            pixels = _Pixels(width, height, depth * PNG_SAMPLES[colour], bool(laced)) if whole else None
        elif kind == b"PLTE":
            if length % 3 or not 0 < length <= 768 or palette or data_state:
                raise Broken("the palette is out of place")
            palette = True
        elif kind == b"tRNS":
            alpha = True
        elif kind == b"IDAT":
            if data_state == 2 or colour == 3 and not palette:
                raise Broken("pixel data is out of place")
            data_state = 1
        elif kind == b"IEND":
            if not data_state:
                raise Broken("there is no pixel data")
            if pixels:
                pixels.end()
            return height, width, 4 if colour == 3 and alpha else PNG_CHANNELS[colour]
        elif not kind[0] & 32:
            raise Broken("a chunk is critical and not known")
        if data_state == 1 and kind != b"IDAT":
            data_state = 2
        at = end


def jpeg(file: Ranges, whole: bool = False) -> tuple[int, int, int]:
    """Height, width and channels; Broken if its segments don't lead to a scan or nothing ends the image.

    Segments are passed over by their lengths; the end is looked for in the last bytes, with ``whole`` in all of them.
    """
    if file.at(0, 2) != b"\xff\xd8":
        raise Broken("not a JPEG")
    at, frame = 2, None
    while True:
        mark, kind = file.at(at, 2)
        if mark != 0xFF:
            raise Broken("a segment has no marker")
        if kind == 0xFF:  # padding
            at += 1
            continue
        if kind in JPEG_BARE:
            at += 2
            continue
        if kind == 0xD9:
            raise Broken("there is no scan")
        length = struct.unpack(">H", file.at(at + 2, 2))[0]
        if length < 2 or at + 2 + length > file.size:
            raise Broken("the file is cut off")
        if kind in JPEG_FRAMES:
            depth, height, width, parts = struct.unpack(">BHHB", file.at(at + 4, 6))
            if depth not in (8, 12, 16) or not width or not height or parts not in (1, 3, 4) or length != 8 + 3 * parts:
                raise Broken("the frame has values that no image has")
            frame = height, width, parts
        at += 2 + length
        if kind == 0xDA:
            break
    if frame is None:
        raise Broken("there is no frame")
    tail = at if whole else max(at, file.size - 1024)
    before = b""
    while tail < file.size:
        part = file.at(tail, min(1 << 20, file.size - tail))
        if b"\xff\xd9" in before + part:
            return frame
        before, tail = part[-1:], tail + len(part)
    raise Broken("nothing ends the image")


def probe(file: Ranges, whole: bool = False) -> tuple[int, int, int]:
    """Height, width and channels of a PNG or a JPEG, told apart by their first bytes, whatever the file's name."""
    head = file.at(0, min(8, max(file.size, 2)))
    if head[:2] == b"\xff\xd8":
        return jpeg(file, whole)
    return png(file, whole)


def file_system(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's file system of a URI and the path in it; ArrowInvalid if Arrow has none for its scheme."""
    if uri.startswith(("file:", "/")):
        path = uri.removeprefix("file:")
        return arrow_fs.LocalFileSystem(), "/" + path.lstrip("/")
    return arrow_fs.FileSystem.from_uri(uri)


def entries(fs: arrow_fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder) of the files and folders in a folder; those of a local one come as they are read, never as a list."""
    if isinstance(fs, arrow_fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if (is_folder := e.is_dir()) or e.is_file():
                    yield f"{folder.rstrip('/')}/{e.name}", is_folder
    else:
        for info in fs.get_file_info(arrow_fs.FileSelector(folder)):
            if info.type in (arrow_fs.FileType.Directory, arrow_fs.FileType.File):
                yield info.path, info.type == arrow_fs.FileType.Directory


def look(fs: arrow_fs.FileSystem, base: str, paths: Iterable[str], whole: bool) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA for files under a folder, which are read one after the other."""
    base, rows = base.rstrip("/") + "/", []
    for path in paths:
        height = width = channels = problem = None
        with fs.open_input_file(path) as opened:
            file = Ranges(opened)
            try:
                height, width, channels = probe(file, whole)
            except Broken as e:
                problem = str(e)
            rows.append((path.removeprefix(base), height, width, channels, problem, file.size, file.read))
        if len(rows) >= 5000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


@dataclass
class Part(InputPartition):
    """Files to read, folders whose files, at any depth, are to be found first, and folders of which only the files right in them are."""

    files: list[str]
    folders: list[str]
    flat: list[str]

    def __init__(self, files: list[str], folders: list[str], flat: list[str] | None = None) -> None:
        self.files, self.folders, self.flat = files, folders, flat or []


class ImageReader(DataSourceReader):
    """The driver lists folders, the widest first, only until there are enough of them, or ``names`` names, for tasks to go on with.

    It holds at most ``names`` names: files of a folder with more are found by a task, and folders with more subfolders are left to one.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.uri = options["path"]
        self.suffixes = tuple(f".{x}" for x in options.get("extensions", "png").split(","))
        self.folders, self.per_part = int(options.get("folders", "512")), int(options.get("filesPerPartition", "2000"))
        self.names = int(options.get("names", "50000"))
        self.whole, self.listed = options.get("check", "structure") == "whole", options.get("check") == "none"

    def partitions(self) -> list[Part]:
        fs, base = file_system(self.uri)
        waiting, files, deep, flat, seen = [base], [], [], [], 0
        while waiting and len(waiting) < self.folders and seen <= self.names:
            level, waiting = waiting, []
            for k, folder in enumerate(level):
                if seen > self.names:
                    waiting += level[k:]
                    break
                own, inner, room = [], [], self.names - len(files) - len(waiting) - len(level)
                for path, is_folder in entries(fs, folder):
                    seen += 1
                    if is_folder:
                        inner.append(path)
                    elif own is not None and path.endswith(self.suffixes):
                        own.append(path)
                    if own is not None and len(own) + len(inner) > room:
                        own = None
                    if len(inner) > max(room, 0):
                        break
                if len(inner) > max(room, 0):
                    deep.append(folder)
                    continue
                waiting += inner
                files += own or []
                flat += [folder] if own is None else []
        parts = [Part(files[a : a + self.per_part], []) for a in range(0, len(files), self.per_part)]
        deep += waiting
        some = max(1, -(-len(deep) // (8 * self.folders)))
        return parts + [Part([], deep[a : a + some]) for a in range(0, len(deep), some)] + [Part([], [], [f]) for f in flat] or [Part([], [])]

    def _files(self, fs: arrow_fs.FileSystem, part: Part) -> Iterator[str]:
        yield from part.files
        waiting = [(f, True) for f in part.folders] + [(f, False) for f in part.flat]
        while waiting:
            folder, deep = waiting.pop()
            for path, is_folder in entries(fs, folder):
                if not is_folder and path.endswith(self.suffixes):
                    yield path
                elif is_folder and deep:
                    waiting.append((path, True))

    def read(self, partition: Any) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(self.uri)
        if not self.listed:
            yield from look(fs, base, self._files(fs, partition), self.whole)
            return
        found, start = self._files(fs, partition), len(base.rstrip("/")) + 1
        while names := list(islice(found, 5000)):
            yield _batch([(path[start:], None, None, None, None, None, None) for path in names])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


class ImageFiles(DataSource):
    """``image_files``: one row for each file under ``path`` whose name ends with one of ``extensions`` (comma-separated).

    Files and folders of any name are read, those with a leading "_" or "." too.  ``problem`` says why a file can't be read as
    an image; its sizes are null then.  ``check`` is ``structure`` or ``whole``, or ``none`` for the paths alone, with nulls; ``folders`` is
    how many folders, and ``names`` how many names, the driver lists at most before tasks take over, ``filesPerPartition`` how many
    files it gives to a task.  A file that goes away while the scan runs is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ImageReader:
        return ImageReader({k: self.options[k] for k in ("path", "extensions", "folders", "filesPerPartition", "names", "check") if k in self.options})
