"""Small files in the shared folder, written so that a reader sees the old or the new one."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, name: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    p, fs = _path(spark, name)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder; nothing where there is none."""
    p, fs = _path(spark, folder)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    """The data files of a folder and their bytes."""
    p, fs = _path(spark, folder)
    return {x.getPath().getName(): x.getLen() for x in fs.listStatus(p) if not x.getPath().getName().startswith(("_", "."))}


def read_json(spark: SparkSession, name: str) -> dict | None:
    p, fs = _path(spark, name)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _renamed(spark: SparkSession, name: str, value: dict, mode: str) -> None:
    jvm = spark.sparkContext._jvm
    tmp, fs = _path(spark, f"{name}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, mode)
    target, _ = _path(spark, name)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, target, options)
    finally:
        if fs.exists(tmp):
            fs.delete(tmp, False)


def write_json(spark: SparkSession, name: str, value: dict) -> None:
    _renamed(spark, name, value, "OVERWRITE")


def create_json(spark: SparkSession, name: str, value: dict) -> bool:
    """Write a file that must not exist yet; False where it does."""
    if exists(spark, name):
        return False
    try:
        _renamed(spark, name, value, "NONE")
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
