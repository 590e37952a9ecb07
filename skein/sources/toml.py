"""The TOML lock as a Spark data source: ``spark.read.format("scene-lock")``, ``df.write.format("scene-lock")``.

A file is a unit, ``<root>/<canticle>/NN.toml``. Reading: a partition is a run of files of about ``SPLIT`` bytes. Writing: a task writes its
units beside the root and names them in its message; the driver only renames what the messages name, and a failed job's
drafts are deleted, so nothing of it is seen. Files are reached through Arrow's file systems, by the path's scheme.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .layers import LOCK_LISTS, LOCK_SCHEMA
from .sinks import lock_toml

NAME = "scene-lock"
SPLIT = 16 << 20
_DRAFTS = ".drafts-"


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path's scheme, none being local, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Drafted(WriterCommitMessage):
    files: list[tuple[str, str]]  # (draft, place), both below the root


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        fs, root = _at(self.path)
        found = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".toml") and _DRAFTS not in f.path)
        out: list[Files] = [Files([])]
        size = 0
        for name, n in found:
            if out[-1].names and size + n > SPLIT:
                out.append(Files([]))
                size = 0
            out[-1].names.append(name)
            size += n
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        import tomllib

        fs, _ = _at(self.path)
        for name in partition.names:
            with fs.open_input_stream(name) as f:
                doc = tomllib.loads(f.read().decode())
            for i, scene in enumerate(doc.get("scene", [])):
                lists = {n: scene.get(n, []) for n in LOCK_LISTS}
                yield (doc["canticle"], doc["canto"], i, *(scene.get(n) for n in ("lines", "title", "location", "region")), *lists.values(), scene.get("basis"))


class Writer(DataSourceArrowWriter):
    """Rows are whole units (canticle, canto, toml)."""

    def __init__(self, path: str):
        self.path, self.run = path, f"{_DRAFTS}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Drafted:
        fs, root = _at(self.path)
        made: list[tuple[str, str]] = []
        own = f"{self.run}/{uuid.uuid4().hex}"  # an attempt's own folder
        for batch in iterator:
            for row in batch.to_pylist():
                place = f"{row['canticle']}/{row['canto']:02d}.toml"
                draft = f"{own}/{place}"
                fs.create_dir(posixpath.dirname(f"{root}/{draft}"), recursive=True)
                with fs.open_output_stream(f"{root}/{draft}") as f:
                    f.write(row["toml"].encode())
                made.append((draft, place))
        return Drafted(made)

    def commit(self, messages: list[Drafted | None]) -> None:
        fs, root = _at(self.path)
        files = [x for m in messages if m is not None for x in m.files]
        if not files:
            return
        # what is to be renamed is named first: a driver that is lost here leaves a list to finish by
        with fs.open_output_stream(f"{root}/{self.run}/files.json") as f:
            f.write(json.dumps(files).encode())
        finish(fs, root, self.run)

    def abort(self, messages: list[Drafted | None]) -> None:
        fs, root = _at(self.path)
        if fs.get_file_info(f"{root}/{self.run}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.run}")


def finish(fs: pafs.FileSystem, root: str, run: str) -> None:
    """Take the drafts that a run names to their places, those that are there already left alone; then the drafts go."""
    listed = f"{root}/{run}/files.json"
    if fs.get_file_info(listed).type == pafs.FileType.NotFound:
        return
    with fs.open_input_stream(listed) as f:
        files = json.loads(f.read())
    for draft, place in files:
        if fs.get_file_info(f"{root}/{draft}").type != pafs.FileType.NotFound:
            fs.create_dir(posixpath.dirname(f"{root}/{place}"), recursive=True)
            fs.move(f"{root}/{draft}", f"{root}/{place}")
    fs.delete_dir(f"{root}/{run}")


class SceneLock(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LOCK_SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(SceneLock)
    return spark


def read_locks(spark: SparkSession, root: str) -> DataFrame:
    """One row a scene of all locks under ``root``."""
    return _registered(spark).read.format(NAME).load(root)


def write_locks(locks: DataFrame, root: str) -> None:
    """A file a unit, in place of the one there, other files left alone; all units or, where a task fails for good, none."""
    _registered(locks.sparkSession)
    lock_toml(locks).select("canticle", F.col("canto").cast("int").alias("canto"), "toml").write.format(NAME).mode("append").save(root)


def resume_commits(root: str) -> int:
    """Finish the commits of drivers that were lost while renaming, delete other drafts; how many were finished. Not beside a running write."""
    fs, at = _at(root)
    done = 0
    for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
        if f.type == pafs.FileType.Directory and posixpath.basename(f.path).startswith(_DRAFTS):
            run = posixpath.basename(f.path)
            whole = fs.get_file_info(f"{f.path}/files.json").type != pafs.FileType.NotFound
            finish(fs, at, run)
            done += whole
            if not whole:
                fs.delete_dir(f.path)
    return done
