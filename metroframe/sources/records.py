"""Files of fixed-size binary records: read by byte ranges, written with a commit.

A file is a header of little-endian u32 words, the first of which is the record count, and the records.  Reading
cuts files into ranges of whole records and packs small ones together, so neither the largest file nor the number of
small files decides how many tasks there are.  Writing goes to names of the attempt; only the files of committed tasks
are moved to their final names, so a lost executor or a second attempt leaves nothing behind.  Paths may be local or
URIs that ``pyarrow.fs`` opens; on a cluster they must be shared, which the commit on the driver finds out.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("a", "u1")])
VERTEX = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4")])
CELL = np.dtype([("y", "<f4")])
#: Bytes of a task, and of a batch within it.
SPLIT, BATCH = 64 << 20, 4 << 20
#: Records of a written file; a longer chunk goes on in another file.
FILE_RECORDS = 1_000_000


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system of a path or URI, and the path within it."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def fixed_part(path: str) -> str:
    """A path up to its first part with a wildcard."""
    wild = min([path.index(c) for c in "*?[" if c in path], default=-1)
    return path if wild < 0 else path[: path.rindex("/", 0, wild)] or "/"


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of the visible files of a folder, or of those that a pattern matches, by name."""
    base = fixed_part(path)
    fs, root = open_fs(base)
    root = root.rstrip("/") or "/"
    if base == path:
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [(root, info.size)]
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
    rest = path[len(base) :].lstrip("/")
    found = fs.get_file_info(pafs.FileSelector(root, recursive="/" in rest))
    shown = [i for i in found if i.type == pafs.FileType.File and not i.base_name.startswith(("_", ".")) and i.extension != "json"]
    if rest:
        shown = [i for i in shown if _matches(i.path[len(root) :].lstrip("/"), rest)]
    return sorted((i.path, i.size) for i in shown)


def _matches(name: str, pattern: str) -> bool:
    """Part by part, as a shell does: a star does not reach over a slash."""
    a, b = name.split("/"), pattern.split("/")
    return len(a) == len(b) and all(map(fnmatch.fnmatchcase, a, b))


@dataclass
class Ranges(InputPartition):
    """Pieces (path, size, first record, end) of one task."""

    pieces: list[tuple[str, int, int, int]]


def packed(files: list[tuple[str, int]], header: int, width: int, split: int, whole: bool = False) -> list[Ranges]:
    """Record ranges of at most ``split`` bytes, small ones together; ``whole`` leaves files uncut."""
    out: list[Ranges] = []
    held, size = [], 0
    each = max(1, split // width)
    for path, length in files:
        n = max(0, length - header) // width
        cuts = [0, n] if whole or n <= each else [*range(0, n, each), n]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            piece = (hi - lo) * width + header
            if held and size + piece > split:
                out.append(Ranges(held))
                held, size = [], 0
            held.append((path, length, lo, hi))
            size += piece
    return out + [Ranges(held)] if held else out


class _Reader(DataSourceReader):
    header, dtype, whole = 4, POINT, False

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.options = options

    def partitions(self) -> list[Ranges]:
        return packed(listed(self.path), self.header, self.dtype.itemsize, self.split, self.whole)

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        fs, _ = open_fs(fixed_part(self.path))
        for path, size, lo, hi in partition.pieces:
            with fs.open_input_file(path) as f:
                yield from self.piece(f, path, size, lo, hi)

    def piece(self, f: pa.NativeFile, path: str, size: int, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        width = self.dtype.itemsize
        if self.header:
            n = int.from_bytes(f.read_at(4, 0), "little") if size >= self.header else -1
            if n < 0 or size < self.header + n * width:
                raise ValueError(f"truncated file: {path}")
            hi = min(hi, n)
        step = max(1, BATCH // width)
        for at in range(lo, hi, step):
            k = min(step, hi - at)
            yield self.batch(path, at, np.frombuffer(f.read_at(k * width, self.header + at * width), self.dtype, k))

    def batch(self, path: str, at: int, rec: np.ndarray) -> pa.RecordBatch:
        raise NotImplementedError


class _PointReader(_Reader):
    def batch(self, path, at, rec):
        cols = [np.ascontiguousarray(rec[c]).astype("f4" if c in "xyz" else "i2") for c in POINT.names]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rec)), *map(pa.array, cols)], ["path", *POINT.names])


class _VertexReader(_Reader):
    header, dtype = 8, VERTEX

    def batch(self, path, at, rec):
        cols = [pa.array(np.ascontiguousarray(rec[c])) for c in VERTEX.names]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rec)), pa.array(np.arange(at, at + len(rec))), *cols], ["path", "i", *VERTEX.names])


class _CellReader(_Reader):
    """Cells of a row-major raster of nx columns and nz rows; gaps (NaN) are left out."""

    header, dtype = 0, CELL

    def piece(self, f, path, size, lo, hi):
        nx, nz = int(self.options["nx"]), int(self.options["nz"])
        if size < nx * nz * 4:
            raise ValueError(f"truncated file: {path}")
        yield from super().piece(f, path, size, lo, min(hi, nx * nz))

    def batch(self, path, at, rec):
        y = rec["y"].astype("f8")
        some = np.flatnonzero(np.isfinite(y))
        iz, ix = np.divmod(at + some, int(self.options["nx"]))
        return pa.RecordBatch.from_arrays([pa.array(ix), pa.array(iz), pa.array(y[some])], ["ix", "iz", "y"])


class _RingReader(_Reader):
    """One row for each extruded body: the lower half of its vertices.  Short files give none; the rest of a file is not read."""

    header, dtype, whole = 8, VERTEX, True

    def piece(self, f, path, size, lo, hi):
        if size < 8:
            return
        vc, ic = (int(v) for v in np.frombuffer(f.read_at(8, 0), "<u4", 2))
        if vc < 7 or size < 8 + vc * 12 + ic * 4:
            return
        base = np.frombuffer(f.read_at((vc - 1) // 2 * 12, 8), VERTEX)
        ox, oy = float(self.options["origin_x"]), float(self.options["origin_y"])
        x, z = ((base[c].astype("f8") - o) / 100.0 for c, o in (("x", ox), ("y", oy)))
        ring = pa.StructArray.from_arrays([pa.array(x), pa.array(z)], ["x", "z"])
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ring)], ["path", "ring"])


@dataclass
class _Written(WriterCommitMessage):
    """(file of the attempt, final name, records) of one task."""

    files: list[tuple[str, str, int]]


class _Writer(DataSourceArrowWriter):
    """One file per chunk, rows in the order given; rows of a chunk must be in one task, side by side."""

    def __init__(self, options: dict, header: int, dtype: np.dtype):
        self.path, self.header, self.dtype = options["path"].rstrip("/"), header, dtype
        self.most = int(options.get("records", FILE_RECORDS))
        self.folder = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = open_fs(self.path)
        folder = posixpath.join(root, self.folder)
        fs.create_dir(folder, recursive=True)
        written: list[tuple[str, str, int]] = []
        chunk, part, held, size = None, 0, [], 0

        def flush() -> None:
            nonlocal held, size
            if not held:
                return
            rec = np.concatenate(held)
            name = f"chunk_{chunk:03d}{f'-{part}' if part else ''}.bin"
            temporary = posixpath.join(folder, uuid.uuid4().hex)
            with fs.open_output_stream(temporary) as f:
                f.write(np.uint32(len(rec)).tobytes().ljust(self.header, b"\0"))
                f.write(rec.tobytes())
            written.append((temporary, name, len(rec)))
            held, size = [], 0

        for b in iterator:
            keys = b.column("chunk").to_numpy(zero_copy_only=False)
            rec = np.empty(len(keys), self.dtype)
            for c in self.dtype.names:
                rec[c] = b.column(c).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if int(keys[lo]) != chunk:
                    flush()
                    chunk, part = int(keys[lo]), 0
                while lo < hi:
                    take = min(hi - lo, self.most - size)
                    held.append(rec[lo : lo + take])
                    size, lo = size + take, lo + take
                    if size == self.most:
                        flush()
                        part += 1
        flush()
        return _Written(written)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = open_fs(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        fs.create_dir(root, recursive=True)
        for temporary, name, _ in files:
            fs.move(temporary, posixpath.join(root, name))
        with fs.open_output_stream(posixpath.join(root, "files.json")) as f:
            f.write("".join(json.dumps({"file": posixpath.join(self.path, name), "count": n}) + "\n" for _, name, n in files).encode())
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = open_fs(self.path)
        folder = posixpath.join(root, self.folder)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class PointFiles(DataSource):
    """Point chunks: a count and 16-byte records.  A truncated file is an error."""

    @classmethod
    def name(cls) -> str:
        return "metroframe_points"

    def schema(self) -> str:
        return "path string, x float, y float, z float, r short, g short, b short, a short"

    def reader(self, schema) -> DataSourceReader:
        return _PointReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, 4, POINT)


class VertexFiles(PointFiles):
    """Meshes: two counts and 12-byte positions; what follows is not read."""

    @classmethod
    def name(cls) -> str:
        return "metroframe_vertices"

    def schema(self) -> str:
        return "path string, i long, x float, y float, z float"

    def reader(self, schema) -> DataSourceReader:
        return _VertexReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, 8, VERTEX)


class RingFiles(DataSource):
    """Base rings of extruded bodies, in metres from ``origin_x``, ``origin_y`` (cm)."""

    @classmethod
    def name(cls) -> str:
        return "metroframe_rings"

    def schema(self) -> str:
        return "path string, ring array<struct<x: double, z: double>>"

    def reader(self, schema) -> DataSourceReader:
        return _RingReader(self.options)


class CellFiles(DataSource):
    """Row-major float32 rasters of ``nx`` by ``nz`` cells."""

    @classmethod
    def name(cls) -> str:
        return "metroframe_cells"

    def schema(self) -> str:
        return "ix long, iz long, y double"

    def reader(self, schema) -> DataSourceReader:
        return _CellReader(self.options)


def register(spark) -> None:
    for source in (PointFiles, VertexFiles, RingFiles, CellFiles):
        spark.dataSource.register(source)
