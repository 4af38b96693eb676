"""The folder that driver and executors share, and small files in any store that Spark reaches."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, qualified with its store. Only a local session may be without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return qualified(spark, f"{folder or tempfile.mkdtemp(prefix='sightline-shared-')}/{name}-{uuid.uuid4().hex}")


def _path(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    path, store = _path(spark, path)
    return store.makeQualified(path).toString()


def open_store(uri: str):
    """The pyarrow file system of a qualified path, and the path there: for tasks."""
    import pyarrow.fs

    local = re.match("file:/+", uri)
    if local or "://" not in uri:
        return pyarrow.fs.LocalFileSystem(), "/" + uri[local.end() :] if local else uri
    return pyarrow.fs.FileSystem.from_uri(uri)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names of a folder's files; none if it isn't there."""
    path, store = _path(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file in one step, unless it is there already (then False): the way in which Spark's streaming log does."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, store = _path(spark, path)
    store.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = store.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.makeQualified(target).toUri(), conf)
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(store.makeQualified(draft), store.makeQualified(target), none)
        return True
    except Py4JJavaError as error:
        store.delete(draft, False)
        if "FileAlreadyExistsException" not in str(error.java_exception):
            raise
        return False
