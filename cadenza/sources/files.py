"""Audio files as rows: from bytes that Spark has read, or by walking a folder with the `tags` data source; and plans written back.

Every file is a track or a failure, none is lost. Reading from bytes works on any store that Spark reads, but Spark's own listing leaves out
names that begin with `_` or `.`, and a file has to fit into a row. The data source lists what a walk would, reads only the ranges that hold
tags, whatever a file's size, and needs the folder on every executor.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import codecs

TRACK = "path string, format string, title string, artist string, albumArtist string, album string, genre string, lyrics string, trackNo int, discNo int, year int, compilation boolean, hasSort boolean, legacyTag boolean, tagBytes bigint, hasLyrics boolean, duration double, seconds int, error string"
NAMES = [c.split()[0] for c in TRACK.split(", ")]
#: Folders that a walk leaves out, on a computer and on a phone. Backups and unfinished files have endings that no format has.
SKIPPED = {"desktop": {".git", "node_modules", "$RECYCLE.BIN", "System Volume Information"}, "phone": {"Android", "LOST.DIR"}}


def row_of(path: str, load) -> dict:
    """A track's row, or its path and why it can't be read."""
    try:
        return codecs.read(path, load()) | {"error": None}
    except (codecs.BadFile, OSError, ValueError, IndexError) as e:
        return dict.fromkeys(NAMES) | {"path": path, "error": f"{type(e).__name__}: {e}"}


def read_files(files: DataFrame) -> DataFrame:
    """TRACK of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row_of(p, d.as_py) for p, d in zip(batch.column(0).to_pylist(), batch.column(1))]
            yield pa.RecordBatch.from_pylist(rows, schema=batch_schema())

    known = F.lower(F.regexp_extract("path", r"(\.[^./]*)\z", 1)).isin(*codecs.FORMATS)
    return files.select("path", "content").filter(known).mapInArrow(run, TRACK)


def batch_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in TRACK.split(", ")])


def scan(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """TRACK of a folder's files, by Spark's reader of binary files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return read_files(files.select("path", "content"))


def tracks(scanned: DataFrame) -> DataFrame:
    return scanned.filter("error is null").drop("error")


def failures(scanned: DataFrame) -> DataFrame:
    return scanned.filter("error is not null").select("path", F.col("error").alias("reason"))


def walk(root: str, profile: str = "desktop") -> list[str]:
    """Supported files under a folder in order; unreadable and skipped folders are left out, the root never."""
    out = []
    for folder, inner, names in os.walk(root):
        inner[:] = [d for d in inner if not d.startswith(".") and d not in SKIPPED[profile]]
        out += [os.path.join(folder, n) for n in names if codecs.format_of(n)]
    return sorted(out)


class Ranged:
    """A file as the codecs see bytes, of which only the slices that they ask for are read."""

    def __init__(self, path: str):
        self.path, self.size, self.file = path, os.path.getsize(path), None

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, key):
        if isinstance(key, int):
            return self[key : key + 1][0] if key >= 0 else self[self.size + key : self.size + key + 1][0]
        start, stop, _ = key.indices(self.size)
        self.file.seek(start)
        return self.file.read(max(0, stop - start))

    def __enter__(self) -> Ranged:
        self.file = open(self.path, "rb")
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


class Slice(InputPartition):
    """Files, and a folder that the task walks itself."""

    def __init__(self, paths: list[str], folder: str | None = None):
        self.paths, self.folder = paths, folder


class TagReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.profile = options["path"], options.get("profile", "desktop")
        self.per_task = int(options.get("filesPerTask", "500"))

    def partitions(self) -> list[Slice]:
        """The driver lists the folder itself only; a task walks each folder in it."""
        paths, folders = [], []
        for e in sorted(os.scandir(self.root), key=lambda e: e.path):
            if not e.is_dir():
                paths += [e.path] if codecs.format_of(e.name) else []
            elif not e.is_symlink() and not e.name.startswith(".") and e.name not in SKIPPED[self.profile]:
                folders.append(e.path)
        return [Slice(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)] + [Slice([], f) for f in folders] or [Slice([])]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for path in partition.paths or (walk(partition.folder, self.profile) if partition.folder else ()):
            row = ranged_row(path)
            yield tuple(row[n] for n in NAMES)


def ranged_row(path: str) -> dict:
    try:
        with Ranged(path) as data:
            return row_of(path, lambda: data)
    except OSError as e:
        return dict.fromkeys(NAMES) | {"path": path, "error": f"{type(e).__name__}: {e}"}


class TagSource(DataSource):
    """spark.read.format("tags").option("profile", "desktop" or "phone").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "tags"

    def schema(self) -> str:
        return TRACK

    def reader(self, schema) -> TagReader:
        return TagReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TagSource)


def write_one(path: str, edit: dict) -> None:
    """One file's edit: a backup that is never replaced, a file beside it, then a swap; the time of change stays. Idempotent."""
    if codecs.is_empty(edit):
        return
    before = os.stat(path)
    with open(path, "rb") as f:
        data = f.read()
    if edit.get("backup") and not os.path.exists(path + ".bak"):
        with open(path + ".part", "wb") as f:
            f.write(data)
        os.replace(path + ".part", path + ".bak")
    new = codecs.write(path, data, edit)
    if new != data:
        with open(path + ".part", "wb") as f:
            f.write(new)
        os.replace(path + ".part", path)
    os.utime(path, ns=(before.st_atime_ns, before.st_mtime_ns))


def apply_plan(changes: DataFrame) -> DataFrame:
    """Writes the edits of a plan (path, edit) and gives (path, error), '' where all went well. A task that is tried again changes nothing more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            paths = batch.column(0).to_pylist()
            for path, edit in zip(paths, batch.column(1).to_pylist()):
                try:
                    write_one(path, edit)
                    errors.append("")
                except (codecs.BadFile, OSError, ValueError, IndexError) as e:
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(errors, pa.string())], names=["path", "error"])

    return changes.select("path", "edit").mapInArrow(run, "path string, error string")


def save_playlists(written: DataFrame, folder: str) -> DataFrame:
    """Writes (file_name, content) to a folder and gives (file_name, status): equal files are left, an old one is kept beside as .bak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, status = batch.column(0).to_pylist(), []
            for name, text in zip(names, batch.column(1).to_pylist()):
                path, data = os.path.join(folder, name), text.encode()
                old = open(path, "rb").read() if os.path.exists(path) else None
                if old == data:
                    status.append("same")
                    continue
                with open(path + ".part", "wb") as f:
                    f.write(data)
                if old is not None:
                    os.replace(path, path + ".bak")
                os.replace(path + ".part", path)
                status.append("new" if old is None else "replaced")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(status, pa.string())], names=["file_name", "status"])

    return written.select("file_name", "content").mapInArrow(run, "file_name string, status string")
