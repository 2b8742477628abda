"""Image files made from parts: real PNG and JPEG files of several kinds, sound and broken, for the scan to read."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairfold.session import spread
from pairfold.sources.image_files import PNG_SAMPLES, file_system

#: What a part's key modulo their number makes of it.
KINDS = ["rgba", "palette", "palette with transparency", "grey", "cut off", "bad checksum", "jpeg", "jpeg without an end", "no image", "rgb"]
_COLOUR = {"rgba": 6, "palette": 3, "palette with transparency": 3, "grey": 0}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_bytes(width: int, height: int, colour: int = 2, transparent: bool = False, laced: int = 0, pixels: bytes | None = None) -> bytes:
    """A PNG of one colour, 8 bits a sample."""
    rows = pixels if pixels is not None else (b"\0" + b"\x40" * width * PNG_SAMPLES[colour]) * height
    parts = [_chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, laced))]
    parts += [_chunk(b"PLTE", bytes(768))] if colour == 3 else []
    parts += [_chunk(b"tRNS", b"\0")] if transparent else []
    return b"".join([b"\x89PNG\r\n\x1a\n", *parts, _chunk(b"IDAT", zlib.compress(rows)), _chunk(b"IEND", b"")])


def jpeg_bytes(width: int, height: int, parts: int = 3) -> bytes:
    """The segments of a JPEG with an empty scan: all that a scan of the structure looks at."""
    frame = struct.pack(">BHHB", 8, height, width, parts) + b"".join(struct.pack(">BBB", i + 1, 0x11, 0) for i in range(parts))
    start = struct.pack(">B", parts) + b"".join(struct.pack(">BB", i + 1, 0) for i in range(parts)) + b"\0\x3f\0"
    segment = lambda kind, data: b"\xff" + bytes([kind]) + struct.pack(">H", len(data) + 2) + data
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xC0, frame) + segment(0xDA, start) + b"\x12\x34" + b"\xff\xd9"


def contents(kind: str, width: int, height: int) -> bytes:
    if kind == "no image":
        return b"no image at all"
    if kind.startswith("jpeg"):
        return jpeg_bytes(width, height)[: None if kind == "jpeg" else -2]
    made = png_bytes(width, height, _COLOUR.get(kind, 2), kind == "palette with transparency")
    if kind == "cut off":
        return made[:-5]
    return made[:29] + bytes([made[29] ^ 1]) + made[30:] if kind == "bad checksum" else made


def write_pictures(parts: DataFrame, folder: str) -> int:
    """Write a file for each part under ``folder``, from the tasks; gives their number.  A task that runs again writes the same files."""
    key = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(key, F.lit(len(KINDS))) + 1).cast("int"))
    name = F.concat(F.when(key % 7 == 0, "_").otherwise(""), F.col("p_name"), F.lit(" "), key.cast("string"), F.when(kind.startswith("jpeg"), ".jpg").otherwise(".png"))
    path = F.concat_ws("/", "p_brand", F.when(key % 5 == 0, "_new"), name)
    rows = parts.select(path.alias("path"), kind.alias("kind"), F.col("p_size").alias("width"), (key % 50 + 1).cast("int").alias("height"))

    def run(batches):
        fs, base = file_system(folder)
        for b in batches:
            for path, kind, width, height in zip(*(b[c].to_pylist() for c in ("path", "kind", "width", "height")), strict=True):
                fs.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{base}/{path}") as out:
                    out.write(contents(kind, width, height))
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"])

    # one task may read a table of a few MB, which has names for very many files
    rows = rows.repartition(spread(parts.sparkSession), "path")
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
