"""Small JSON files on the shared file system of which the first writer wins."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def create_new(spark: SparkSession, path: str, body: dict) -> bool:
    """Create the file with ``body`` unless it exists; of several callers, in any process, one gets True.

    On file: paths a whole file is linked to its name, which fails where the name is taken (Hadoop's local file system only looks
    before it writes).  Elsewhere the file system's own exclusive create decides.
    """
    text, name = json.dumps(body, sort_keys=True), urlparse(path)
    if name.scheme in ("", "file"):
        local = unquote(name.path)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        # Hadoop takes names that begin with a dot or an underscore for hidden ones.
        part = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
        with open(part, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(part, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        return True
    fs, at = _at(spark, path)
    try:
        out = fs.create(at, False)
    except Py4JJavaError:
        if fs.exists(at):
            return False
        raise
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def read(spark: SparkSession, path: str) -> dict | None:
    """The body of a file; None where there is none, or where its writer has not finished."""
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) if text.endswith("}") else None


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted, without hidden ones; none where it does not exist."""
    fs, at = _at(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in found if n[0] not in "._")


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)
