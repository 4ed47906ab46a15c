"""A sink with Spark's two-phase commit: files of a job appear together, or none of a failed one.

Tasks stage their files in folders of their own below ``<target>/_jobs/<job>`` and report the folder.
Spark hands the reports of the attempts that count to ``commit``, so files of failed, killed or
speculative attempts stay where nobody looks. The commit first writes down which folders belong to the job
(a marker that is created whole and never replaced), then moves each file to its name. From the marker
on the job can only go forward: ``recover`` finishes the moves of a driver that died. Before it nothing is
visible, and ``abort`` removes what was staged.

Names that are taken already fail the job before its marker, unless it overwrites. Two rows with one
name also fail the job (``publish`` looks for them with Spark among the names that were staged, so rows are
computed once; the sink alone keeps the file that comes first and fails afterwards). Moves are hard links on local file systems, which never replace a file,
and moves through pyarrow elsewhere. ``publish`` runs them, and the look for taken names before, as Spark
tasks, one for each staged folder; the sink alone and ``recover`` run them in threads of the driver.

Rows are (path, data): a name below the target without ``..`` and its bytes; null data is left out.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass

from pyarrow import RecordBatch, array, string
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import prepare

JOBS = "_jobs"
THREADS = 32
FEW = 10  # names of a folder that an error counts


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri.removeprefix("file:")))


def _exists(files: pafs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != pafs.FileType.NotFound


def _write(files: pafs.FileSystem, path: str, data: bytes) -> None:
    with files.open_output_stream(path) as f:
        f.write(data)


def _read(files: pafs.FileSystem, path: str) -> bytes:
    with files.open_input_stream(path) as f:
        return f.read()


def _moved(files: pafs.FileSystem, staged: str, path: str, overwrite: bool) -> bool:
    """Puts a staged file in its place; True where it is there, also from an earlier try."""
    if not _exists(files, staged):
        return _exists(files, path)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    if overwrite:
        files.move(staged, path)
        return True
    if isinstance(files, pafs.LocalFileSystem):
        try:
            os.link(staged, path)
        except FileExistsError:
            return os.path.samefile(staged, path)
    elif _exists(files, path):
        return False
    else:
        files.move(staged, path)
    return True


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int


def _names(files: pafs.FileSystem, folder: str) -> list[str]:
    return json.loads(_read(files, f"{folder}/names.json"))


def _finish(files: pafs.FileSystem, target: str, job: str) -> list[str]:
    """Moves the files of a job that has its marker; names that another file has. May be run again."""
    plan = json.loads(_read(files, f"{target}/{JOBS}/{job}.json"))
    lost = []
    with ThreadPoolExecutor(THREADS) as pool:
        for folder in plan["folders"]:  # a task's names at a time
            names = _names(files, folder)
            done = pool.map(lambda x: _moved(files, f"{folder}/{x[0]}", f"{target}/{x[1]}", plan["overwrite"]), enumerate(names))  # noqa: B023
            lost += [n for n, ok in zip(names, done, strict=True) if not ok]
    _write(files, f"{target}/{JOBS}/{job}.done", json.dumps({"taken": lost}).encode())
    with suppress(FileNotFoundError, OSError):
        files.delete_dir(f"{target}/{JOBS}/{job}")
    return lost


def _by_folder(spark: SparkSession, target: str, folders: list[str], work) -> DataFrame:
    """The names that ``work(files, folder)`` gives, run as one task for each folder."""

    def run(batches: Iterator[RecordBatch]) -> Iterator[RecordBatch]:
        files, _ = _opened(target)
        for b in batches:
            for folder in b.column(0).to_pylist():
                yield RecordBatch.from_arrays([array(work(files, folder), string())], ["name"])

    return spark.sparkContext.parallelize([(f,) for f in folders], max(1, len(folders))).toDF("folder string").mapInArrow(run, "name string")


def _in_tasks(spark: SparkSession, target: str, folders: list[str], work) -> list[str]:
    """The names that ``work`` gives, at most a few of each folder."""
    return [r.name for r in _by_folder(spark, target, folders, lambda files, folder: work(files, folder)[:FEW]).collect()] if folders else []


def _twice(spark: SparkSession, target: str, folders: list[str]) -> str | None:
    """A name that two staged files have."""
    found = _by_folder(spark, target, folders, _names).groupBy("name").count().filter("count > 1").head(1) if folders else []
    return found[0][0] if found else None


def _taken(target: str):
    def work(files: pafs.FileSystem, folder: str) -> list[str]:
        with ThreadPoolExecutor(THREADS) as pool:
            names = _names(files, folder)
            return [n for n, there in zip(names, pool.map(lambda n: _exists(files, f"{target}/{n}"), names), strict=True) if there]

    return work


def _placed(target: str, overwrite: bool):
    def work(files: pafs.FileSystem, folder: str) -> list[str]:
        with ThreadPoolExecutor(THREADS) as pool:
            names = _names(files, folder)
            done = pool.map(lambda x: _moved(files, f"{folder}/{x[0]}", f"{target}/{x[1]}", overwrite), enumerate(names))
            return [n for n, ok in zip(names, done, strict=True) if not ok]

    return work


def _dropped(files: pafs.FileSystem, folder: str) -> list[str]:
    with suppress(FileNotFoundError, OSError):
        files.delete_dir(folder)
    return []


class _Writer(DataSourceArrowWriter):
    def __init__(self, target: str, overwrite: bool, job: str | None = None):
        self.target, self.overwrite, self.later, self.job = target.rstrip("/"), overwrite, job is not None, job or uuid.uuid4().hex

    def write(self, iterator: Iterator[RecordBatch]) -> Staged:
        files, target = _opened(self.target)
        folder = f"{target}/{JOBS}/{self.job}/{uuid.uuid4().hex}"  # of this attempt alone
        files.create_dir(folder, recursive=True)
        names: list[str] = []
        for b in iterator:
            for path, data in zip(b.column("path").to_pylist(), b.column("data"), strict=True):
                if not data.is_valid:
                    continue
                if not path or path.startswith(("/", "_")) or any(p in ("", ".", "..") for p in path.split("/")):
                    raise ValueError(f"not a name below the target: {path!r}")
                _write(files, f"{folder}/{len(names)}", data.as_buffer())
                names.append(path)
        _write(files, f"{folder}/names.json", json.dumps(names).encode())
        return Staged(folder, len(names))

    def commit(self, messages: list[Staged | None]) -> None:
        files, target = _opened(self.target)
        folders = [m.folder for m in messages if m is not None and m.files]
        if self.later:  # ``publish`` goes on from here
            files.create_dir(f"{target}/{JOBS}", recursive=True)
            _write(files, f"{target}/{JOBS}/{self.job}.staged", json.dumps(folders).encode())
            return
        if not self.overwrite:
            with ThreadPoolExecutor(THREADS) as pool:
                for folder in folders:
                    names = _names(files, folder)
                    taken = [n for n, there in zip(names, pool.map(lambda n: _exists(files, f"{target}/{n}"), names), strict=True) if there]
                    if taken:
                        raise FileExistsError(f"{len(taken)} names are taken, {taken[0]!r} among them")
        files.create_dir(f"{target}/{JOBS}", recursive=True)
        part = f"{target}/{JOBS}/{self.job}.part"
        _write(files, part, json.dumps({"folders": folders, "overwrite": self.overwrite}).encode())
        files.move(part, f"{target}/{JOBS}/{self.job}.json")  # the job's name is its own
        lost = _finish(files, target, self.job)
        if lost:
            raise FileExistsError(f"{len(lost)} names were taken meanwhile, {lost[0]!r} among them")

    def abort(self, messages: list[Staged | None]) -> None:
        files, target = _opened(self.target)
        if not _exists(files, f"{target}/{JOBS}/{self.job}.json"):  # a job with its marker goes forward
            with suppress(FileNotFoundError, OSError):
                files.delete_dir(f"{target}/{JOBS}/{self.job}")


class PublishedFiles(DataSource):
    """``df.write.format("tracewipe_files").mode("append").save(target)`` for rows of (path, data)."""

    @classmethod
    def name(cls) -> str:
        return "tracewipe_files"

    def schema(self) -> str:
        return "path string, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if not {"path", "data"} <= set(schema.names):
            raise ValueError("rows need a path and data")
        return _Writer(self.options["path"], overwrite, self.options.get("job"))


def recover(target: str) -> list[str]:
    """Finishes the jobs below ``target`` whose driver died after their marker; their names."""
    files, at = _opened(target)
    folder = f"{at}/{JOBS}"
    if not _exists(files, folder):
        return []
    names = {i.base_name for i in files.get_file_info(pafs.FileSelector(folder))}
    jobs = sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and n.removesuffix(".json") + ".done" not in names)
    for job in jobs:
        _finish(files, at, job)
    return jobs


def publish(rows: DataFrame, target: str, overwrite: bool = False) -> None:
    """Writes ``data`` of each row to ``path`` below ``target``, all or none; names that occur twice are an error."""
    spark: SparkSession = prepare(rows.sparkSession)
    spark.dataSource.register(PublishedFiles)
    job = uuid.uuid4().hex
    rows.select(F.col("path"), F.col("data")).write.format("tracewipe_files").option("job", job).mode("overwrite" if overwrite else "append").save(target)
    files, at = _opened(target.rstrip("/"))
    staged = f"{at}/{JOBS}/{job}.staged"
    folders = json.loads(_read(files, staged))
    twice = _twice(spark, target, folders)
    taken = [] if overwrite or twice else _in_tasks(spark, target, folders, _taken(at))
    if not taken and not twice:
        _write(files, f"{at}/{JOBS}/{job}.part", json.dumps({"folders": folders, "overwrite": overwrite}).encode())
        files.move(f"{at}/{JOBS}/{job}.part", f"{at}/{JOBS}/{job}.json")  # from here on the job goes forward
        lost = _in_tasks(spark, target, folders, _placed(at, overwrite))
        _write(files, f"{at}/{JOBS}/{job}.done", json.dumps({"taken": lost}).encode())
    _in_tasks(spark, target, folders, _dropped)
    _dropped(files, f"{at}/{JOBS}/{job}")
    files.delete_file(staged)
    if twice:
        raise ValueError(f"two files are named {twice!r}")
    if taken:
        raise FileExistsError(f"names are taken, {taken[0]!r} among them")
    if lost:
        raise FileExistsError(f"names were taken meanwhile, {lost[0]!r} among them")
