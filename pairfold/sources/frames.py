"""Framed records: what is read of a file that was cut off or damaged is everything before the first bad record.

A file is a run of records: length and CRC-32 of the payload (little-endian, 4 bytes each), then the payload.  Executors write
one as soon as a piece of work is done, so what an executor had done is not lost with it.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pairfold.sources.image_files import file_system

_HEAD = struct.Struct("<II")
#: Payloads are at most this long, so a damaged length is known as such without reading on.
LONGEST = 1 << 30
SUFFIX = ".frames"


def frame(payload: bytes) -> bytes:
    if len(payload) > LONGEST:
        raise ValueError("the record is too long")
    return _HEAD.pack(len(payload), zlib.crc32(payload)) + payload


def records(file: pa.NativeFile) -> Iterator[bytes]:
    """Payloads up to the first record that is cut off or fails its checksum; one at a time is held."""
    while len(head := file.read(_HEAD.size)) == _HEAD.size:
        length, crc = _HEAD.unpack(head)
        payload = file.read(length) if length <= LONGEST else b""
        if len(payload) != length or zlib.crc32(payload) != crc:
            return
        yield payload


def write_record(uri: str, name: str, payload: bytes) -> None:
    """Put a file with one record in place at once; a file of that name is replaced."""
    fs, folder = file_system(uri)
    fs.create_dir(folder, recursive=True)
    own = f"{folder}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(frame(payload))
    fs.move(own, f"{folder}/{name}{SUFFIX}")


def claim(uri: str, name: str, owner: str, seconds: float) -> bool:
    """Whether a name is the owner's for some seconds: nobody has it, the owner has it, or who had it let the time go by.

    On a local or mounted file system two owners never get a free name at once; elsewhere they may, and then both do the work.
    """
    fs, folder = file_system(uri)
    fs.create_dir(folder, recursive=True)
    at, own = f"{folder}/{name}", f"{folder}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(owner.encode())
    age = fs.get_file_info(own).mtime_ns
    try:
        info = fs.get_file_info(at)
        if info.type == arrow_fs.FileType.NotFound and isinstance(fs, arrow_fs.LocalFileSystem):
            try:
                os.link(own, at)
                return True
            except FileExistsError:
                return False
        if info.type != arrow_fs.FileType.NotFound:
            with fs.open_input_stream(at) as f:
                if f.read().decode() != owner and age - info.mtime_ns < seconds * 1e9:
                    return False
        fs.move(own, at)
        return True
    finally:
        if fs.get_file_info(own).type != arrow_fs.FileType.NotFound:
            fs.delete_file(own)


def delete(uri: str, names: list[str]) -> None:
    """Delete the files of these names, as far as they are there."""
    fs, folder = file_system(uri)
    for info in fs.get_file_info([f"{folder}/{n}{SUFFIX}" for n in names]):
        if info.type == arrow_fs.FileType.File:
            fs.delete_file(info.path)


class _File(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class FramesReader(DataSourceReader):
    def __init__(self, uri: str, per_part: int) -> None:
        self.uri, self.per_part = uri, per_part

    def partitions(self) -> list[_File]:
        fs, folder = file_system(self.uri)
        found = fs.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True))
        paths = sorted(f.path for f in found if f.type == arrow_fs.FileType.File and f.base_name.endswith(SUFFIX) and not f.base_name.startswith("."))
        return [_File(paths[a : a + self.per_part]) for a in range(0, len(paths), self.per_part)] or [_File([])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.uri)
        for path in partition.paths:
            with fs.open_input_stream(path) as file:
                for k, payload in enumerate(records(file)):
                    yield pa.record_batch([[path.rsplit("/", 1)[1]], pa.array([k], pa.int64()), pa.array([payload], pa.binary())], ["file", "place", "payload"])


class Frames(DataSource):
    """``frames``: (file, place, payload) of all sound records of the files in the folder ``path``; none if it isn't there."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "file string, place long, payload binary"

    def reader(self, schema) -> FramesReader:
        return FramesReader(self.options["path"], int(self.options.get("filesPerPartition", "64")))


def read_frames(spark: SparkSession, uri: str, files_per_partition: int = 64) -> DataFrame:
    spark.dataSource.register(Frames)
    return spark.read.format("frames").options(path=uri, filesPerPartition=str(files_per_partition)).load()
