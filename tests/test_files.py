"""Structure of image files: whole, cut off and damaged ones, and the orientation of EXIF."""

import struct
import zlib

from pyspark.sql import functions as F

from inkfold.sources import images as M
from inkfold.streaming.uploads import FILES, judged


def png(width=3, height=2):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return bytes.fromhex(M.MAGIC["png"]) + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(bytes((width + 1) * height))) + chunk(b"IEND", b"")


def jpeg(width=4, height=9, turn=None, order="<"):
    part = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    exif = b""
    if turn is not None:
        entry = struct.pack(f"{order}HHIHH", 0x0112, 3, 1, turn, 0)
        exif = part(0xE1, b"Exif\0\0" + (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HIH", 42, 8, 1) + entry + bytes(4))
    return b"\xff\xd8" + exif + part(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes(3)) + part(0xDA, bytes(6)) + b"data\xff\x00data" + b"\xff\xd9"


def test_every_cut_and_every_damaged_byte_of_a_png():
    raw = png()
    assert M.inspected(raw) == (True, 3, 2, 1)
    assert all(M.inspected(raw[:n]) == (False, None, None, None) for n in range(len(raw)))
    for k in range(len(raw)):
        assert M.inspected(raw[:k] + bytes([raw[k] ^ 0x55]) + raw[k + 1 :])[0] is False


def test_every_cut_of_a_jpeg():
    for raw in (jpeg(), jpeg(turn=6), jpeg(turn=3, order=">")):
        assert M.inspected(raw)[0] and not any(M.inspected(raw[:n])[0] for n in range(len(raw)))


def test_orientation_swaps_sizes():
    for order in "<>":
        for turn in range(1, 9):
            assert M.inspected(jpeg(turn=turn, order=order)) == (True, *((9, 4) if turn >= 5 else (4, 9)), turn)
    assert M.inspected(jpeg(turn=77))[3] == 1 and M.inspected(jpeg())[3] == 1
    assert M.inspected(b"") == M.inspected(None) == M.inspected(b"\xff\xd8\xff\xff") == (False, None, None, None)


def test_as_a_column_and_in_uploads(spark):
    rows = [("a.png", png()), ("b.jpg", jpeg(turn=8)), ("c.png", png()[:-5]), ("d.txt", b"text"), ("e.jpg", jpeg()[:-2])]
    df = spark.createDataFrame([(p, None, len(c), bytearray(c)) for p, c in rows], FILES)
    got = {r.path: tuple(r.x) for r in df.select("path", M.inspection("content").alias("x")).collect()}
    assert got == {p: M.inspected(c) for p, c in rows}
    refused = {r.path: r.refused for r in judged(df, 1000, structure=True).collect()}
    assert refused == {"a.png": None, "b.jpg": None, "c.png": "damaged", "d.txt": "no image", "e.jpg": "damaged"}
    assert judged(df, 1000).where(F.col("refused").isNull()).count() == 4 and judged(df, 10, True).where("refused = 'too large'").count() == 4
