"""Questions about paths, asked through Hadoop so that any file system works."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def ensure_folder(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _file_system(spark, path)
    fs.mkdirs(hadoop_path)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none if it does not exist."""
    fs, hadoop_path = _file_system(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return [status.getPath().getName() for status in fs.listStatus(hadoop_path)]


def numbers(spark: SparkSession, path: str, pattern: str) -> list[int]:
    """The numbers that ``pattern``'s first group finds in the child names, ascending."""
    found = (re.fullmatch(pattern, name) for name in child_names(spark, path))
    return sorted(int(match.group(1)) for match in found if match)


def highest_number(spark: SparkSession, path: str, pattern: str) -> int | None:
    """The largest of those numbers."""
    return max(numbers(spark, path, pattern), default=None)


def finished(spark: SparkSession, path: str, pattern: str) -> list[int]:
    """The numbers of those child folders that a write has filled to its end, ascending."""
    names = {n: name for name in child_names(spark, path) if (n := re.fullmatch(pattern, name))}
    whole = [n for n, name in names.items() if path_exists(spark, f"{path}/{name}/_SUCCESS")]
    return sorted(int(n.group(1)) for n in whole)


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if there is none."""
    fs, hadoop_path = _file_system(spark, path)
    if not fs.exists(hadoop_path):
        return None
    stream = fs.open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    fs, hadoop_path = _file_system(spark, path)
    stream = fs.create(hadoop_path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def replace_small(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in the place of another in one rename, so that readers see one of them."""
    draft = f"{path}.{uuid.uuid4().hex}"
    write_small(spark, draft, text)
    fs, target = _file_system(spark, path)
    _, source = _file_system(spark, draft)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    # Only this interface replaces a file; FileSystem.rename may refuse to.
    files = hadoop.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf)
    files.rename(fs.makeQualified(source), fs.makeQualified(target), overwrite)


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _file_system(spark, path)
    fs.delete(hadoop_path, True)


def make_older(spark: SparkSession, path: str, by_ms: int) -> None:
    """Set a file's modification time back."""
    fs, hadoop_path = _file_system(spark, path)
    now = fs.getFileStatus(hadoop_path).getModificationTime()
    fs.setTimes(hadoop_path, now - by_ms, -1)


def folder_bytes(spark: SparkSession, path: str) -> int:
    fs, hadoop_path = _file_system(spark, path)
    return fs.getContentSummary(hadoop_path).getLength()


def files_below(spark: SparkSession, path: str) -> list[str]:
    """Paths of visible files, relative to ``path``, folders included."""
    found = []
    for name in child_names(spark, path):
        if name[0] in "_.":
            continue
        fs, hadoop_path = _file_system(spark, f"{path}/{name}")
        if fs.getFileStatus(hadoop_path).isDirectory():
            found += [f"{name}/{file}" for file in files_below(spark, f"{path}/{name}")]
        else:
            found.append(name)
    return found


def move_file(spark: SparkSession, source: str, target: str) -> None:
    """Move a file, replacing one that is there; its folder is made if need be."""
    fs, source_path = _file_system(spark, source)
    _, target_path = _file_system(spark, target)
    fs.mkdirs(target_path.getParent())
    fs.delete(target_path, False)
    if not fs.rename(source_path, target_path):
        raise OSError(f"{source} could not be moved to {target}")
