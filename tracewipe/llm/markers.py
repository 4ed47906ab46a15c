"""Small files on the shared file system that commit what was written before them.

A marker is written under a name of its own and then moved to its place without overwriting, so it is
never seen half written, and of several writers one wins. The move is a hard link on local file systems
and Hadoop's rename without overwrite elsewhere, which is atomic on HDFS; an object store needs a
committer of its own for that.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

from .common import filesystem


def read_marker(spark: SparkSession, path: str) -> str:
    """A marker's text; empty where there is none."""
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        return ""
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder, without hidden ones; none where it is not there."""
    fs, p = filesystem(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in found if not n.startswith((".", "_")))


def drop(spark: SparkSession, path: str) -> bool:
    """Removes a folder; True where it is gone."""
    fs, p = filesystem(spark, path)
    fs.delete(p, True)
    return not fs.exists(p)


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a marker with ``text`` at ``path``; False where another one is there."""
    folder, _, name = path.rpartition("/")
    fs, target = filesystem(spark, path)
    if fs.exists(target):
        return False
    fs, part = filesystem(spark, f"{folder}/_{name}-{uuid.uuid4().hex}")
    stream = fs.create(part, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        return _moved(spark, fs, part, target)
    finally:
        fs.delete(part, False)


def _moved(spark: SparkSession, fs, part, target) -> bool:
    if fs.getUri().getScheme() == "file":
        places = [unquote(urlparse(p.toUri().toString()).path) for p in (part, target)]
        try:
            os.link(*places)
        except FileExistsError:
            return False
        return True
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE
    try:
        context.rename(part, target, options)
    except Exception:
        if fs.exists(target):  # another writer was first
            return False
        raise
    return True
