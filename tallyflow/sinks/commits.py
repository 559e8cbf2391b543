"""Which folders make up a set of tables: one small file for each load, written after all its data.

A load writes folders that nobody reads, then a numbered file that names the folders that are valid from
now on. Files are written aside and renamed without overwriting, so that a load is there as a whole or
not at all, and of two loads that began together the second fails and can be run again. What a failed
load left behind is never read.

Files are reached through Hadoop's file systems in the driver's JVM; a Connect session has none.
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

FOLDER = "_loads"


def _hadoop(spark: SparkSession):
    return spark._jvm.org.apache.hadoop.fs


def _open(spark: SparkSession, path: str):
    """(file system, path) of a name."""
    where = _hadoop(spark).Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _open(spark, path)
    return fs.exists(where)


def paths(spark: SparkSession, pattern: str) -> list[str]:
    """Full paths of the files and folders that match; however many, they come in one answer."""
    fs, where = _open(spark, pattern)
    found = _hadoop(spark).FileUtil.stat2Paths(fs.globStatus(where))
    if not found:
        return []
    # {a,b,c}: a comma inside a name is not followed by a scheme
    text = spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(found)[1:-1]
    return sorted(re.split(",(?=[a-z][a-z0-9+.-]*:/)", text))


def names(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the files and folders that match."""
    return sorted(p.rsplit("/", 1)[-1] for p in paths(spark, pattern))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no current reader needs."""
    fs, where = _open(spark, path)
    fs.delete(where, True)


def _rename(spark: SparkSession, source: str, target: str, *options: str) -> None:
    fs = _hadoop(spark)
    kind = getattr(fs, "Options$Rename")
    given = spark.sparkContext._gateway.new_array(kind, len(options))
    for i, option in enumerate(options):
        given[i] = getattr(kind, option)
    context = fs.FileContext.getFileContext(fs.Path(target).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.Path(source), fs.Path(target), given)


@functools.lru_cache(maxsize=16)
def _files(context: SparkContext, folder: str) -> tuple:
    """(Path, file system, whether it is the local one) of a folder, looked up once for any number of files."""
    path = context._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(context._jsc.hadoopConfiguration())
    return path, fs, fs.getScheme() == "file"


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Give a file its final name; False when the name is taken."""
    try:
        _rename(spark, source, target)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            return False
        raise
    return True


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Give a file a name that an older file may have.

    A plain rename is tried first, which other file systems than the local one refuse when the name is taken.
    ``FileContext`` asks a local one for links, in processes of their own for each file.
    """
    path, fs, local = _files(spark.sparkContext, target.rsplit("/", 1)[0])
    if local:
        replace_local(plain_path(source), plain_path(target))
    elif not fs.rename(path(source), path(target)):
        _rename(spark, source, target, "OVERWRITE")


def is_local(spark: SparkSession, folder: str) -> bool:
    """Whether a folder lies on file systems that driver and tasks reach as files of their own."""
    return _files(spark.sparkContext, folder)[2]


def plain_path(name: str) -> str:
    """A local name without the scheme."""
    return re.sub("^file:/+", "/", name)


def replace_local(source: str, target: str) -> None:
    """A file with its checksum, in the order in which Hadoop renames them."""
    os.replace(source, target)
    sums = [os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc") for name in (source, target)]
    if os.path.exists(sums[0]):
        os.replace(*sums)
    elif os.path.exists(sums[1]):
        os.remove(sums[1])


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _open(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _open(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the newest commit; (-1, {}) when there is none."""
    found = [int(n) for n in names(spark, f"{root}/{FOLDER}/*") if n.isdigit()]
    if not found:
        return -1, {}
    return max(found), json.loads(read_text(spark, f"{root}/{FOLDER}/{max(found):08d}"))


def commit(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """Make ``content`` the newest state; fails when another load took the number meanwhile."""
    aside = f"{root}/{FOLDER}/.{uuid.uuid4().hex}"
    write_text(spark, aside, json.dumps(content))
    if not rename(spark, aside, f"{root}/{FOLDER}/{number:08d}"):
        remove(spark, aside)
        raise RuntimeError(f"another load of {root} came first; run this one again")


def new_folder(number: int) -> str:
    """A folder name that no other attempt uses."""
    return f"load-{number:08d}-{uuid.uuid4().hex}"
