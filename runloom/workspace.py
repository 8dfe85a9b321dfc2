"""Paths and small files on the file system that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names; a temporary one only if that is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="runloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    """The few operations on any Hadoop file system that a manifest needs; run on the driver."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm = spark.sparkContext._jvm

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        where, fs = self._at(path)
        return fs.exists(where)

    def names(self, path: str) -> list[str]:
        where, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def create(self, path: str, text: str) -> None:
        """Write a new file; raises if there is one, so that of two writers one wins.

        The text is written under another name first: readers never see a part of it. It gets its own name by a
        hard link on a local disk and else by a rename that doesn't overwrite; both fail if the name is taken.
        A store of objects without such a rename needs one writer at a time.
        """
        where, fs = self._at(path)
        part, _ = self._at(f"{path}.{uuid.uuid4().hex}.part")
        out = fs.create(part, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if fs.getScheme() == "file":
                os.link(part.toUri().getPath(), where.toUri().getPath())
                fs.delete(part, False)
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
                context.rename(part, where, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(part, False)
            if isinstance(e, FileExistsError) or "FileAlreadyExists" in str(e):
                raise FileExistsError(path) from e
            raise

    def read(self, path: str) -> str:
        where, fs = self._at(path)
        source = fs.open(where)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def delete(self, path: str) -> None:
        where, fs = self._at(path)
        fs.delete(where, True)
