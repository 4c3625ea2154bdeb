"""Images and raw matrices as pixel tables: scene_id, idx (row * width + column), values.

Files are read by Spark; a small decoder unpacks PNG (8 and 16 bits, grey or RGB, not
interlaced), since Spark's image source drops the low byte of 16-bit pixels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelflow.functions.codec import rgb_to_lab, rgb_to_segment_id
from voxelflow.sources.config import colors_to_labels

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """[row, column, channel] of a PNG."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, packed, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    width, height, depth, color, _, _, interlace = head
    if depth not in (8, 16) or color not in _CHANNELS or interlace:
        raise ValueError("PNG kind not supported")
    step = _CHANNELS[color] * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step)
    kinds, coded = raw[:, 0], raw[:, 1:].reshape(height, width, step).astype(np.int32)
    found = np.zeros((height + 1, width + 1, step), np.int32)  # with a border of zeros
    for d in range(height + width - 1):  # a pixel needs those left, above and above left: the pixels of a diagonal go together
        y = np.arange(max(0, d - width + 1), min(height - 1, d) + 1)
        x, kind = d - y, kinds[y, None]
        left, above, corner = found[y + 1, x], found[y, x + 1], found[y, x]
        far = [np.abs(left + above - corner - v) for v in (left, above, corner)]
        nearest = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) // 2, nearest], 0)
        found[y + 1, x + 1] = (coded[y, x] + guess) & 255
    pixels = found[1:, 1:].astype(np.uint8)
    return pixels.reshape(height, width, -1, 2).astype(np.int32) @ np.array([256, 1]) if depth == 16 else pixels.astype(np.int32)


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of [row, column(, 3)] values of 8 or 16 unsigned bits."""
    height, width = pixels.shape[:2]
    color, depth = (2 if pixels.ndim == 3 else 0), 8 * pixels.dtype.itemsize
    rows = pixels.astype(pixels.dtype.newbyteorder(">")).reshape(height, -1).view(np.uint8).reshape(height, -1)
    raw = np.hstack([np.zeros((height, 1), np.uint8), rows]).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("scene_id"), "content")


def pixels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """scene_id, idx, width, height, values (array<int>) of PNG files; one file is one task's row."""

    def of(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            for scene, data in zip(batch["scene_id"], batch["content"], strict=True):
                image = decode_png(data)
                height, width = image.shape[:2]
                for start in range(0, height, 64):  # bounded frames, whatever the image
                    part = image[start : start + 64].reshape(-1, image.shape[2])
                    yield pd.DataFrame({"scene_id": scene, "idx": np.arange(start * width, start * width + len(part)), "width": width, "height": height, "values": list(part)})

    return _files(spark, path).mapInPandas(of, "scene_id string, idx long, width int, height int, values array<int>")


def _rgb(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return pixels(spark, path).select("scene_id", "idx", "width", "height", *[F.get("values", F.lit(i)).alias(c) for i, c in enumerate("rgb")])


def load_color(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Colours as Lab in the slots b (L), g (a), r (b)."""
    rows = _rgb(spark, path)
    light, a, b = rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return rows.select("scene_id", "idx", "width", "height", b.alias("r"), a.alias("g"), light.alias("b"))


def load_depth(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return pixels(spark, path).select("scene_id", "idx", "width", "height", F.get("values", F.lit(0)).alias("d"))


def load_label(spark: SparkSession, path: str | list[str], taxonomy: DataFrame) -> DataFrame:
    return colors_to_labels(_rgb(spark, path), taxonomy).select("scene_id", "idx", "label")


def load_voxel(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Supervoxel ids; 0 means none."""
    return _rgb(spark, path).select("scene_id", "idx", rgb_to_segment_id(F.col("r"), F.col("g"), F.col("b")).alias("vid"))


def members(voxels: DataFrame) -> DataFrame:
    """Memberships of an id image."""
    return voxels.where("vid > 0")


def write_png(rows: DataFrame, column: str = "rgb") -> DataFrame:
    """scene_id, content (PNG) of pixels scene_id, idx, width, height and ``column`` (array of 3, or a
    number of 16 bits). Each image is one row of the result, so it is built in one task."""

    def of(image: pd.DataFrame) -> pd.DataFrame:
        image = image.sort_values("idx")
        shape = int(image["height"].iloc[0]), int(image["width"].iloc[0])
        values = np.stack(image[column].to_numpy()) if isinstance(image[column].iloc[0], (list, np.ndarray)) else image[column].to_numpy()
        kind = np.uint8 if values.ndim == 2 else np.uint16
        return pd.DataFrame({"scene_id": [image["scene_id"].iloc[0]], "content": [encode_png(values.astype(kind).reshape(*shape, *values.shape[1:]))]})

    return rows.groupBy("scene_id").applyInPandas(of, "scene_id string, content binary")


#: Element types of raw matrices by number.
_ELEMENTS = (np.uint8, np.int8, np.uint16, np.int16, np.int32, np.float32, np.float64)


def encode_matrix(values: np.ndarray) -> bytes:
    """Header cols, rows, channels, bytes per element, type (native ints), then the data."""
    if values.size == 0 or not values.flags["C_CONTIGUOUS"]:
        raise ValueError("matrices must be contiguous and not empty")
    rows, cols = values.shape[:2]
    channels = values.shape[2] if values.ndim == 3 else 1
    kind = _ELEMENTS.index(values.dtype.type) + 8 * (channels - 1)
    return struct.pack("=5i", cols, rows, channels, values.dtype.itemsize * channels, kind) + values.tobytes()


def decode_matrix(data: bytes) -> np.ndarray:
    cols, rows, channels, _, kind = struct.unpack("=5i", data[:20])
    return np.frombuffer(data, _ELEMENTS[kind % 8], cols * rows * channels, 20).reshape(rows, cols, channels)


def decode_matrix_rows(head: bytes, data: bytes, rows: int) -> np.ndarray:
    """[row, column, channel] of some rows of a matrix, from its header and their bytes."""
    cols, _, channels, _, kind = struct.unpack("=5i", head)
    return np.frombuffer(data, _ELEMENTS[kind % 8], cols * rows * channels).reshape(rows, cols, channels)


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    """scene_id, idx, values (array<double>) of raw matrices."""

    def of(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            for scene, data in zip(batch["scene_id"], batch["content"], strict=True):
                flat = decode_matrix(data)
                flat = flat.reshape(-1, flat.shape[2]).astype(float)
                yield pd.DataFrame({"scene_id": scene, "idx": np.arange(len(flat)), "values": list(flat)})

    return _files(spark, path).mapInPandas(of, "scene_id string, idx long, values array<double>")
