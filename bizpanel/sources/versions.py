"""Tables that are replaced as a whole: each snapshot is a folder, and one small file says which one counts.

A snapshot is written beside the one it was made from. Only when all its files are there does a numbered entry in
``_versions`` name it, by one rename that fails if the number is taken. So a reader sees the old snapshot or the
new one, a write that fails changes nothing, and of two writers that started from the same snapshot one gets an error
instead of undoing the other's work. Entries carry properties, such as up to which year a table is closed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ENTRIES = "_versions"
_DIGITS = 12


class WriteConflict(RuntimeError):
    """Another snapshot was published after the one that this one was made from."""


@dataclass(frozen=True)
class Version:
    """One published snapshot of a table."""

    number: int
    folder: str
    properties: Mapping[str, object] = field(default_factory=dict)


def _path(spark: SparkSession, path: str) -> JavaObject:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str) -> JavaObject:
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    files = _files(spark, path)
    if not files.exists(_path(spark, path)):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(_path(spark, path)))


def _rename_to_new(spark: SparkSession, source: str, target: str) -> None:
    """One step; an error if the target is there."""
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    none = spark.sparkContext._gateway.new_array(kind, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _files(spark, target).getUri(), spark._jsc.hadoopConfiguration()
    )
    files = _files(spark, target)
    context.rename(files.makeQualified(_path(spark, source)), files.makeQualified(_path(spark, target)), none)


def versions(spark: SparkSession, path: str) -> list[Version]:
    """The published snapshots of a table, oldest first."""
    entries = [n for n in _names(spark, f"{path}/{ENTRIES}") if n.isdigit()]
    found = []
    for name in entries:
        stream = _files(spark, path).open(_path(spark, f"{path}/{ENTRIES}/{name}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        entry = json.loads(text)
        found.append(Version(int(name), f"{path}/{entry['folder']}", entry["properties"]))
    return found


def current(spark: SparkSession, path: str) -> Version | None:
    """The snapshot that counts; None for a table that was never published."""
    found = versions(spark, path)
    return found[-1] if found else None


def read(
    spark: SparkSession, path: str, schema: str | StructType | None = None, number: int | None = None
) -> DataFrame:
    """The current snapshot or an earlier one; a table that was never published is read as it lies."""
    found = versions(spark, path)
    if number is not None:
        found = [v for v in found if v.number == number]
        if not found:
            raise ValueError(f"{path} has no version {number}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(found[-1].folder if found else path)


def publish(
    df: DataFrame,
    path: str,
    properties: Mapping[str, object] | None = None,
    made_from: int | None = None,
) -> Version:
    """Write a snapshot and make it the current one.

    ``made_from`` is the number of the snapshot that ``df`` was made from (0: none); without it that is the
    current one when the write begins. If another one is current by the end, the new files go and ``WriteConflict``
    is raised.
    """
    spark = df.sparkSession
    if made_from is None:
        before = current(spark, path)
        made_from = before.number if before else 0
    number = made_from + 1
    name = f"v{number:0{_DIGITS}d}-{uuid.uuid4().hex}"
    files = _files(spark, path)
    entry, draft = f"{path}/{ENTRIES}/{number:0{_DIGITS}d}", f"{path}/{ENTRIES}/.{name}"
    try:
        df.write.parquet(f"{path}/{name}")
        stream = files.create(_path(spark, draft), False)
        try:
            stream.write(bytearray(json.dumps({"folder": name, "properties": dict(properties or {})}).encode()))
        finally:
            stream.close()
        try:
            _rename_to_new(spark, draft, entry)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise WriteConflict(f"{path} has a version {number} already") from error
            raise
    except BaseException:
        files.delete(_path(spark, draft), False)
        files.delete(_path(spark, f"{path}/{name}"), True)
        raise
    return Version(number, f"{path}/{name}", dict(properties or {}))


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the last ``keep`` snapshots; names of the deleted folders.

    Not while a report still reads an older one. Folders of writes that never ended go too if their number is taken.
    """
    if keep < 1:
        raise ValueError("the current snapshot must be kept")
    found = versions(spark, path)
    files = _files(spark, path)
    kept = {v.folder.rpartition("/")[2] for v in found[-keep:]}
    for v in found[:-keep]:
        files.delete(_path(spark, f"{path}/{ENTRIES}/{v.number:0{_DIGITS}d}"), False)
    last = found[-1].number if found else 0
    gone = [
        name
        for name in _names(spark, path)
        if name[:1] == "v" and name[1 : 1 + _DIGITS].isdigit() and name not in kept and int(name[1 : 1 + _DIGITS]) <= last
    ]
    for name in gone:
        files.delete(_path(spark, f"{path}/{name}"), True)
    return gone
