"""PNG images: headers read by column functions alone, pixels by a small numpy codec."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the PNG format: signature, and channels by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, header columns) of the .png files under a folder; content is only read where it is used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content", header(F.col("content")).alias("header"))


def header(content: Column) -> Column:
    """struct(width, height, depth, colour) from the first 26 bytes, null if they are no PNG header."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("int")
    fields = F.struct(number(17, 4).alias("width"), number(21, 4).alias("height"), number(25, 1).alias("depth"), number(26, 1).alias("colour"))
    return F.when(F.substring(F.hex(content), 1, 16) == SIGNATURE.hex().upper(), fields)


def encoded(px: np.ndarray) -> bytes:
    """A gray (h, w), RGB or RGBA (h, w, c) raster of 8 or 16 bits, lossless."""
    px = px[:, :, None] if px.ndim == 2 else px
    h, w, c = px.shape
    colour = {n: k for k, n in CHANNELS.items()}[c]
    rows = px.astype(">u2" if px.dtype.itemsize == 2 else "u1").reshape(h, -1).view(np.uint8)
    data = zlib.compress(np.concatenate([np.zeros((h, 1), np.uint8), rows], 1).tobytes(), 6)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8 * px.dtype.itemsize, colour, 0, 0, 0)) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros((rows.shape[0], rows.shape[1] - 1), np.uint8)
    before = np.zeros(rows.shape[1] - 1, np.uint8)
    for y, (kind, line) in enumerate(zip(rows[:, 0], rows[:, 1:], strict=True)):
        cur = line.copy()
        if kind == 2:
            cur += before
        elif kind:
            for x in range(len(cur)):
                a = int(cur[x - step]) if x >= step else 0
                b, c = int(before[x]), int(before[x - step]) if x >= step else 0
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((a, b, c), key=lambda v: abs(a + b - c - v))
                cur[x] = (int(cur[x]) + guess) & 255
        out[y] = before = cur
    return out


def decoded(data: bytes) -> np.ndarray:
    """The raster of a PNG of 8 or 16 bits without palette or interlacing; anything else raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, body = 8, b""
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    if colour not in CHANNELS or depth not in (8, 16) or interlaced:
        raise ValueError("palette, interlaced and low-depth images are not read")
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body += data[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += size + 12
    step = CHANNELS[colour] * depth // 8
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * step)
    flat = _unfiltered(rows, step)
    px = flat.view(">u2").astype(np.uint16) if depth == 16 else flat
    return px.reshape(h, w) if colour == 0 else px.reshape(h, w, CHANNELS[colour])
