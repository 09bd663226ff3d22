"""Image files as a table: binaryFile, type by magic bytes, hash, size from the header."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..operators.lookup import duplicates

# First bytes of the accepted formats.
MAGIC = {"jpg": "FFD8FF", "png": "89504E470D0A1A0A"}


def image_type(content: Column) -> Column:
    """jpg, png or null. Weaker than decoding the file: it looks at the first bytes alone."""
    return F.when(F.hex(F.substring(content, 1, 3)) == MAGIC["jpg"], "jpg").when(F.hex(F.substring(content, 1, 8)) == MAGIC["png"], "png")


def dimensions(raw: bytes | None) -> tuple[int | None, int | None]:
    """Width and height in a PNG's or JPEG's header; none of a broken file."""
    if raw and raw[:8] == bytes.fromhex(MAGIC["png"]) and len(raw) >= 24:
        return struct.unpack(">II", raw[16:24])
    at = 2
    while raw and raw[:2] == b"\xff\xd8" and at + 9 <= len(raw):
        if raw[at] != 0xFF:
            break
        if raw[at + 1] in range(0xC0, 0xD0) and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
            return w, h
        at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    return None, None


@pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def size_of(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dimensions(x) for x in s], columns=["width", "height"], dtype="Int32")


def png_whole(raw: bytes) -> bool:
    """Whether a PNG's chunks follow each other from IHDR to IEND, each with its checksum, with image data among them."""
    at, kinds = 8, []
    while at + 12 <= len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        if at + 12 + n > len(raw) or zlib.crc32(raw[at + 4 : at + 8 + n]) != struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0]:
            return False
        kinds.append(kind)
        at += 12 + n
        if kind == b"IEND":
            break
    return len(kinds) > 2 and kinds[0] == b"IHDR" and kinds[-1] == b"IEND" and b"IDAT" in kinds


def segments(raw: bytes) -> list[tuple[int, int, int]]:
    """(marker, begin, end) of a JPEG's segments before its image data; none if one is cut off or out of place."""
    at, found = 2, []
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        marker, n = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
        if n < 2 or at + 2 + n > len(raw):
            return []
        found.append((marker, at + 4, at + 2 + n))
        if marker == 0xDA:
            return found
        at += 2 + n
    return []


def jpeg_whole(raw: bytes) -> bool:
    """Whether a JPEG's segments lead to image data, a frame is among them, and an end marker comes behind the data."""
    found = segments(raw)
    frame = any(m in range(0xC0, 0xD0) and m not in (0xC4, 0xC8, 0xCC) for m, _, _ in found)
    return bool(found) and frame and raw.find(b"\xff\xd9", found[-1][2]) >= 0


def orientation(raw: bytes) -> int:
    """The orientation, 1 to 8, that a JPEG's EXIF segment tells; 1 where there is none or it is broken."""
    for marker, begin, end in segments(raw):
        body = raw[begin:end]
        if marker != 0xE1 or body[:6] != b"Exif\0\0" or body[6:8] not in (b"II", b"MM") or len(body) < 14:
            continue
        order, tiff = "<" if body[6:8] == b"II" else ">", body[6:]
        at = struct.unpack(f"{order}I", tiff[4:8])[0]
        if at + 2 > len(tiff):
            continue
        for k in range(struct.unpack(f"{order}H", tiff[at : at + 2])[0]):
            entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) == 12 and struct.unpack(f"{order}H", entry[:2])[0] == 0x0112:
                value = struct.unpack(f"{order}H", entry[8:10])[0]
                return value if 1 <= value <= 8 else 1
    return 1


def inspected(raw: bytes | None) -> tuple[bool, int | None, int | None, int | None]:
    """(whole, width, height, orientation) of a file: sizes as it is shown, so orientations 5 to 8 swap them."""
    raw = bytes(raw or b"")
    png, jpeg = raw[:8] == bytes.fromhex(MAGIC["png"]), raw[:3] == bytes.fromhex(MAGIC["jpg"])
    if not (png and png_whole(raw) or jpeg and jpeg_whole(raw)):
        return False, None, None, None
    turn, (w, h) = orientation(raw) if jpeg else 1, dimensions(raw)
    return (True, h, w, turn) if turn >= 5 else (True, w, h, turn)


@pandas_udf(StructType([StructField("whole", BooleanType()), *[StructField(n, IntegerType()) for n in ("width", "height", "orientation")]]))
def inspection(s: pd.Series) -> pd.DataFrame:
    """inspected() of a column of contents."""
    out = pd.DataFrame([inspected(x) for x in s], columns=["whole", "width", "height", "orientation"])
    return out.astype({"whole": bool, "width": "Int32", "height": "Int32", "orientation": "Int32"})


def read(spark: SparkSession, path: str, max_bytes: int = 20 << 20) -> DataFrame:
    """(path, name, sha256, type, width, height, file_size, modificationTime) of the accepted images. Larger files are never
    loaded: the limit on length is applied before the content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= max_bytes)
    kept = files.withColumn("type", image_type(F.col("content"))).where("type is not null")
    sized = kept.withColumn("_size", size_of("content"))
    return sized.select("path", F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("sha256"), "type", "_size.width", "_size.height", F.col("length").alias("file_size"), "modificationTime")


def new_files(found: DataFrame, images: DataFrame, owner: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new, repeated): files whose content no card holds, one of each content, and the others with that card."""
    held = duplicates(found, images, owner=owner).withColumnRenamed("sha256", "_sha")
    first = found.groupBy("sha256").agg(F.min("path").alias("path"))
    met = found.join(first, ["sha256", "path"], "left_semi").join(held, F.col("sha256") == F.col("_sha"), "left").drop("_sha")
    return met.where("card_id is null").drop("card_id"), met.where("card_id is not null")


def stored_name(side: Column, kind: Column) -> Column:
    return F.concat(F.when(side == "back", "back_").otherwise(""), F.lit("original."), F.when(kind == "png", "png").otherwise("jpg"))
