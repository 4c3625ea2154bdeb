"""Image and matrix files as a data source: ``spark.read.format("voxelflow_image")`` and ``.write``.

One row a pixel: scene_id (the file's name), idx (row * width + column), width, height, values. Option
``kind``: ``png`` (values array<int>; 8 bits with 1, 2, 3 or 4 channels, 16 bits with one) or
``matrix`` (raw arrays, values array<double>). Paths go through Arrow's file systems.

A PNG is decoded from its first row on, so a file is a partition; raw matrices are cut into ranges of
rows, and a range reads its own bytes only. Writing builds an image from the rows of one task: deal
rows with ``by_scene`` first. Tasks write below a folder of the job, and only when all have ended are
the files moved into place; a job that fails takes its folder with it and leaves nothing. A part of an
image that is missing, pixels outside it or a scene in two tasks are errors."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from voxelflow.functions.codec import segment_id_to_rgb
from voxelflow.sources import images
from voxelflow.sources.config import labels_to_colors

NAME = "voxelflow_image"
ENDINGS = {"png": ".png", "matrix": ".bin"}
RANGE_BYTES = 16 << 20
_HEADER = 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def _listed(path: str, ending: str) -> list[fs.FileInfo]:
    system, where = _place(path)
    found = system.get_file_info(where)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(where))
    return sorted((f for f in files if f.type == fs.FileType.File and f.base_name.endswith(ending)), key=lambda f: f.path)


@dataclass
class Part(InputPartition):
    path: str
    start: int = 0  # rows
    stop: int | None = None

    def __hash__(self):
        return hash((self.path, self.start))


def _pixels(scene: str, block: np.ndarray, first: int, width: int, height: int, kind: pa.DataType) -> pa.RecordBatch:
    n, channels = len(block), block.shape[1]
    values = pa.ListArray.from_arrays(pa.array(np.arange(0, n * channels + 1, channels, dtype=np.int32)), pa.array(np.ascontiguousarray(block).reshape(-1)).cast(kind))
    columns = [pa.array([scene] * n), pa.array(np.arange(first, first + n)), pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, height, np.int32)), values]
    return pa.RecordBatch.from_arrays(columns, names=["scene_id", "idx", "width", "height", "values"])


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self) -> list[InputPartition]:
        system, _ = _place(self.path)
        parts = []
        for file in _listed(self.path, ENDINGS[self.kind]):
            if self.kind == "png" or file.size <= RANGE_BYTES:
                parts.append(Part(file.path))
                continue
            with system.open_input_file(file.path) as f:
                width, height, _, size, _ = np.frombuffer(f.read(_HEADER), "<i4").tolist()
            step = max(1, RANGE_BYTES // (width * size))
            parts += [Part(file.path, k, min(k + step, height)) for k in range(0, height, step)]
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.path)
        scene = posixpath.splitext(posixpath.basename(part.path))[0]
        with system.open_input_file(part.path) as f:
            if self.kind == "png":
                image, first, kind = images.decode_png(f.read()), 0, pa.int32()
                height, width = image.shape[:2]
            else:
                head = f.read(_HEADER)
                width, height, _, size, _ = np.frombuffer(head, "<i4").tolist()
                first, stop = part.start, height if part.stop is None else part.stop
                f.seek(_HEADER + first * width * size)
                image, kind = images.decode_matrix_rows(head, f.read((stop - first) * width * size), stop - first), pa.float64()
        for k in range(0, len(image), 64):
            block = image[k : k + 64]
            yield _pixels(scene, block.reshape(-1, image.shape[2]), (first + k) * width, width, height, kind)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, overwrite: bool, depth: int):
        self.path, self.kind, self.overwrite, self.depth = path, kind, overwrite, depth
        self.job = f"_temporary/{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, where = _place(self.path)
        mine = f"{where}/{self.job}/{uuid.uuid4().hex}"  # of this attempt
        files, now, rows = [], None, []

        def flush() -> None:
            idx = np.concatenate([r[0] for r in rows])
            width, height = rows[0][1], rows[0][2]
            if len(idx) != width * height or (np.sort(idx) != np.arange(width * height)).any():
                raise ValueError(f"scene {now}: {len(idx)} pixels do not fill {width} x {height}")
            values = np.concatenate([r[3] for r in rows])[np.argsort(idx)].reshape(height, width, -1)
            data = images.encode_matrix(np.ascontiguousarray(values.astype(np.float64))) if self.kind == "matrix" else images.encode_png((values[..., 0] if values.shape[2] == 1 else values).astype(np.uint16 if self.depth == 16 else np.uint8))
            system.create_dir(mine, recursive=True)
            with system.open_output_stream(f"{mine}/{now}{ENDINGS[self.kind]}") as f:
                f.write(data)
            files.append(f"{mine}/{now}{ENDINGS[self.kind]}")

        for batch in batches:
            scenes = np.array([str(s) for s in batch.column("scene_id").to_pylist()], object)
            edges = [0, *(np.flatnonzero(scenes[1:] != scenes[:-1]) + 1).tolist(), len(scenes)] if len(scenes) else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                if rows and scenes[a] != now:
                    flush()
                    rows = []
                now, part = scenes[a], batch.slice(a, b - a)
                values = part.column("values")
                flat = values.flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                rows.append((part.column("idx").to_numpy(zero_copy_only=False), part.column("width")[0].as_py(), part.column("height")[0].as_py(), flat))
        if rows:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, where = _place(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [posixpath.basename(f) for f in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a scene was written by two tasks: deal the rows with by_scene")
        system.create_dir(where, recursive=True)
        if self.overwrite:
            for old in _listed(self.path, ENDINGS[self.kind]):
                system.delete_file(old.path)
        for f, name in zip(files, names, strict=True):
            system.move(f, f"{where}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, where = _place(self.path)
        for folder in (f"{where}/{self.job}", f"{where}/_temporary"):
            if system.get_file_info(folder).type == fs.FileType.Directory and (folder.endswith(self.job) or not system.get_file_info(fs.FileSelector(folder))):
                system.delete_dir(folder)


class ImageSource(DataSource):
    """Options: path, kind (png, matrix), depth (8 or 16, of written PNG files)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _kind(self) -> str:
        kind = self.options.get("kind", "png")
        if kind not in ENDINGS:
            raise ValueError(f"kind must be one of {sorted(ENDINGS)}, not {kind}")
        return kind

    def schema(self) -> str:
        return f"scene_id string, idx long, width int, height int, values array<{'int' if self._kind() == 'png' else 'double'}>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._kind())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self._kind(), overwrite, int(self.options.get("depth", "8")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageSource)


def by_scene(rows: DataFrame) -> DataFrame:
    """Each scene's pixels in one task, one scene after another."""
    return rows.select("scene_id", "idx", "width", "height", "values").repartition("scene_id").sortWithinPartitions("scene_id", "idx")


def read_images(spark: SparkSession, path: str, kind: str = "png") -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("kind", kind).load(path)


def write_images(rows: DataFrame, path: str, kind: str = "png", depth: int = 8, mode: str = "append") -> None:
    """Writes scene_id, idx, width, height, values, one file for each scene."""
    register(rows.sparkSession)
    by_scene(rows).write.format(NAME).option("kind", kind).option("depth", depth).mode(mode).save(path)


def id_images(grid: DataFrame, members: DataFrame) -> DataFrame:
    """Pixel rows of supervoxel-id images: grid (scene_id, idx, width, height), members (scene_id, idx,
    vid); pixels without a supervoxel hold 0."""
    placed = grid.join(members.select("scene_id", "idx", "vid"), ["scene_id", "idx"], "left").withColumn("vid", F.coalesce("vid", F.lit(0)).cast("int"))
    return placed.select("scene_id", "idx", "width", "height", F.array(*[c.cast("int") for c in segment_id_to_rgb(F.col("vid"))]).alias("values"))


def label_images(grid: DataFrame, labels: DataFrame, taxonomy: DataFrame, missing: int = -1) -> DataFrame:
    """Pixel rows of label images in the taxonomy's colours; pixels without a label have that of ``missing``."""
    placed = grid.join(labels.select("scene_id", "idx", "label"), ["scene_id", "idx"], "left").withColumn("label", F.coalesce("label", F.lit(missing)))
    return labels_to_colors(placed, taxonomy).select("scene_id", "idx", "width", "height", F.array("r", "g", "b").cast("array<int>").alias("values"))
