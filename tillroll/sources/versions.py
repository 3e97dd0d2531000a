"""Stored tables that change in one step: folders of data and a numbered pointer to the live ones.

Below a table's folder lie data folders, which never change once written, and
``_versions``, with one small file per version that lists the data folders in use. A reader
takes the highest version whose file is complete. So a new version shows when its file is
closed, whole or not at all, and readers of an older one keep its files until it is
released. Files directly in the folder, as Spark writes them, count as version 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tillroll.session import file_system

_POINTERS = "_versions"
_END = "end"
# How the names of data folders start; the second is for loads kept by month.
_DATA = ("version-", "load=")


class VersionConflict(RuntimeError):
    """Another writer has published since the version this one is based on."""


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, path = file_system(spark, folder)
    if not files.exists(path):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(path))


def _pointer(target: str, version: int) -> str:
    return f"{target}/{_POINTERS}/{version:012d}"


def _folders(spark: SparkSession, target: str, version: int) -> list[str] | None:
    """What a pointer lists, or None where it is missing or was never finished."""
    files, path = file_system(spark, _pointer(target, version))
    if not files.exists(path):
        return None
    stream = files.open(path)
    lines = []
    try:
        while (line := stream.readLine()) is not None:
            lines.append(line)
    finally:
        stream.close()
    return lines[:-1] if lines and lines[-1] == _END else None


def _numbers(spark: SparkSession, target: str) -> list[int]:
    return [int(n) for n in _names(spark, f"{target}/{_POINTERS}") if n.isdigit()]


def _plain_files(spark: SparkSession, target: str) -> list[str]:
    """Data directly in the folder, outside any version."""
    hidden = ("_", ".", *_DATA)
    return [n for n in _names(spark, target) if not n.startswith(hidden)]


def versions(spark: SparkSession, target: str) -> list[int]:
    """The versions that can be read, in ascending order."""
    target = target.rstrip("/")
    found = [n for n in _numbers(spark, target) if _folders(spark, target, n) is not None]
    return ([0] if _plain_files(spark, target) else []) + sorted(found)


def current_version(spark: SparkSession, target: str) -> int | None:
    """The version a reader gets now; None where nothing is stored."""
    target = target.rstrip("/")
    for number in sorted(_numbers(spark, target), reverse=True):
        if _folders(spark, target, number) is not None:
            return number
    return 0 if _plain_files(spark, target) else None


def version_folders(spark: SparkSession, target: str, version: int | None = None) -> list[str]:
    """The data folders of a version, by default the current one."""
    target = target.rstrip("/")
    if version is None:
        version = current_version(spark, target)
    if version == 0:
        return [target]
    listed = None if version is None else _folders(spark, target, version)
    if listed is None:
        raise FileNotFoundError(f"no version {version or ''} of a table in {target}")
    return [f"{target}/{name}" for name in listed]


def new_folder(target: str, start: str = _DATA[0]) -> str:
    """A data folder, below the table's, that no other writer has been given."""
    return f"{target.rstrip('/')}/{start}{uuid.uuid4().hex}"


def point_to(
    spark: SparkSession, target: str, folders: Sequence[str], based_on: int | None = None
) -> int:
    """Make these data folders the table, in one step, and return the version.

    ``based_on`` is the version the folders were made from, where they were: if another
    one is current by now nothing is changed and ``VersionConflict`` is raised. So it is if
    two writers reach for the same number, on file systems that refuse to create a file twice.
    """
    target = target.rstrip("/")
    current = current_version(spark, target)
    if based_on is not None and current != based_on:
        raise VersionConflict(f"{target} is at version {current}, not {based_on}")
    version = max([0, *_numbers(spark, target)]) + 1
    files, path = file_system(spark, _pointer(target, version))
    names = [f.removeprefix(f"{target}/") for f in folders]
    try:
        stream = files.create(path, False)
    except Exception as error:
        if files.exists(path):
            raise VersionConflict(f"{target}: version {version} was taken") from error
        raise
    try:
        stream.write(bytearray("".join(f"{n}\n" for n in [*names, _END]).encode()))
    finally:
        stream.close()
    return version


def publish_tables(
    spark: SparkSession,
    target: str,
    write: Callable[[str], Sequence[str]],
    based_on: int | None = None,
    start: str = _DATA[0],
) -> int:
    """Have ``write`` fill a new data folder and make the folders it returns the table.

    If it fails, what it wrote is removed and the table is as it was.
    """
    folder = new_folder(target, start)
    try:
        return point_to(spark, target, write(folder), based_on)
    except Exception:
        files, path = file_system(spark, folder)
        files.delete(path, True)
        raise


def publish_version(df: DataFrame, target: str, based_on: int | None = None) -> int:
    """Store ``df`` as the next version of the table; it may be read from the table itself."""

    def write(folder: str) -> Sequence[str]:
        df.write.parquet(folder)
        return [folder]

    return publish_tables(df.sparkSession, target, write, based_on)


def publish_together(
    tables: Mapping[str, DataFrame], target: str, based_on: int | None = None
) -> int:
    """Store several tables that belong together; readers see all of one version."""
    spark = next(iter(tables.values())).sparkSession

    def write(folder: str) -> Sequence[str]:
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        return [folder]

    return publish_tables(spark, target, write, based_on)


def release_versions(spark: SparkSession, target: str, keep: int = 1) -> list[int]:
    """Delete all but the last ``keep`` versions; their readers must be done.

    A data folder goes when no version left lists it. Folders that no version lists, those
    of writers still at work or killed, are left alone. Returns the versions deleted.
    """
    if keep < 1:
        raise ValueError("the current version cannot be released")
    target = target.rstrip("/")
    known = versions(spark, target)
    gone, kept = known[:-keep], known[-keep:]
    files, _ = file_system(spark, target)

    def delete(name: str) -> None:
        files.delete(file_system(spark, name)[1], True)

    live = {f for v in kept for f in version_folders(spark, target, v)}
    for version in gone:
        if version == 0:
            for name in _plain_files(spark, target):
                delete(f"{target}/{name}")
            continue
        folders = version_folders(spark, target, version)
        delete(_pointer(target, version))
        for folder in folders:
            if folder not in live:
                delete(folder)
    return gone
