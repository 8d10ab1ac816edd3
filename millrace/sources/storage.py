"""Folders that driver and executors share, and small files in them that are made at once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import SparkSession


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session without it gets a temporary folder, which goes with
    the process; on a cluster that would be a folder of the driver alone, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


_own: str | None = None


_inside: ContextVar[Scope | None] = ContextVar("millrace_scope", default=None)


class Scope:
    """Folders of one run, below one folder in the shared place; ``close`` deletes them and nothing else.

    Inside ``with Scope(spark):`` whatever operators of this thread write for themselves lies in that scope
    and goes with it. Results are read from these folders, so they are to be written elsewhere before.
    """

    def __init__(self, spark: SparkSession, name: str = "run") -> None:
        self.spark, outer = spark, _inside.get()
        self.root = f"{outer.root if outer else shared_base(spark)}/millrace-{name}-{uuid.uuid4().hex}"

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def close(self) -> bool:
        return delete(self.spark, self.root)

    def __enter__(self) -> Scope:
        self._outer = _inside.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _inside.reset(self._outer)
        self.close()


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.delete(p, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, in order; none if it is missing."""
    p, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file that is whole as soon as it is seen; False if there is one of that name already.

    It is written aside and renamed, which doesn't replace a file: of two writers one succeeds (on file
    systems whose rename is one step; local ones look first).
    """
    fs_ = spark._jvm.org.apache.hadoop.fs
    p, fs = _path(spark, path)
    aside = fs_.Path(p.getParent(), f"_{uuid.uuid4().hex}.tmp")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    plain = spark._sc._gateway.new_array(fs_.Options.Rename, 0)
    qualified = fs.makeQualified(p)
    try:
        fs_.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), qualified, plain)
    except Exception as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" not in str(e):
            raise
        return False
    return True
