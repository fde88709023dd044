"""Files that appear whole, under a name that was free, or not at all."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    at, fs = hadoop(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def last_number(spark: SparkSession, folder: str, prefix: str, known: int = 0) -> int:
    """The largest number under which something with this prefix is published, 0 if nothing is. Numbers are taken one after
    another, so from a ``known`` one on a look at the next suffices; the folder is listed once."""
    if not known:
        return max((int(n.removeprefix(prefix)) for n in names(spark, folder) if n.startswith(prefix)), default=0)
    while True:
        at, fs = hadoop(spark, f"{folder}/{prefix}{known + 1:012d}")
        if not fs.exists(at):
            return known
        known += 1


def read_bytes(spark: SparkSession, path: str) -> bytes:
    at, fs = hadoop(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, data: bytes) -> bool:
    """Whether ``data`` now stands under ``path``; False if the name was taken. Of two writers of one name one succeeds.

    The draft beside it is linked (local and mounted folders) or renamed without overwriting (HDFS); both refuse a
    name that is taken in one step. An object store without such a rename needs one writer at a time.
    """
    final, fs = hadoop(spark, path)
    draft = final.getParent().suffix(f"/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    jvm = spark._jvm
    try:
        if fs.getUri().getScheme() == "file":
            jvm.java.nio.file.Files.createLink(*[jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, draft)])
        else:
            once = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            once[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, once)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        if fs.exists(draft):
            fs.delete(draft, False)
    return True
