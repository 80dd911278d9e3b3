"""Folders through the Hadoop file system of their path, and what a frame's
file scans know about themselves (location, partition columns).

Only names and metadata are handled here; data moves through Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The fully qualified form Spark reports for ``path`` (e.g. file:/...)."""
    p, fs = _path(spark, path)
    return fs.makeQualified(p).toString().rstrip("/")


def from_uri(spark: SparkSession, uri: str) -> str:
    """A path from its URL-encoded form (``_metadata.file_path``)."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri)).toString()


def has_entries(spark: SparkSession, path: str) -> bool:
    """Whether a path is there and, if a folder, holds anything visible."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return False
    return any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p)) or \
        not fs.getFileStatus(p).isDirectory()


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.exists(p))


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    p, fs = _path(spark, path)
    fs.create(p, True).close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of text."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if it is not there."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def delete_path(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def delete_empty_parents(spark: SparkSession, path: str, root: str) -> None:
    """Remove the folders between ``root`` and ``path`` that are left empty."""
    folder = parent(path)
    while folder.startswith(f"{root}/"):
        p, fs = _path(spark, folder)
        if not fs.exists(p) or any(not s.getPath().getName().startswith((".", "_SUCCESS")) for s in fs.listStatus(p)):
            return
        fs.delete(p, True)
        folder = parent(folder)


def move(spark: SparkSession, src: str, dst: str) -> None:
    """Rename a folder, making the parents of its new name."""
    p, fs = _path(spark, src)
    to, _ = _path(spark, dst)
    fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        raise OSError(f"cannot move {src} to {dst}")


def leaf_folders(spark: SparkSession, root: str) -> list[str]:
    """Folders under ``root`` that hold visible files, relative to it."""
    p, fs = _path(spark, root)
    found, todo = [], [(p, "")]
    while todo:
        folder, rel = todo.pop()
        entries = [s for s in fs.listStatus(folder) if not s.getPath().getName().startswith(("_", "."))]
        if any(s.isFile() for s in entries):
            found.append(rel)
        todo += [(s.getPath(), f"{rel}/{s.getPath().getName()}".lstrip("/")) for s in entries if s.isDirectory()]
    return sorted(found)


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the visible files of a folder."""
    p, fs = _path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isFile()]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def parent(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[0]


def _relations(df: DataFrame) -> list:
    """The file relations that a frame scans (JVM objects)."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and \
                leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            found.append(leaf.relation())
    return found


def scan_roots(df: DataFrame) -> list[str]:
    """Root folders of the file scans of a frame; their files are not listed."""
    roots = []
    for relation in _relations(df):
        paths = relation.location().rootPaths()
        roots += [paths.apply(i).toString().rstrip("/") for i in range(paths.size())]
    return roots


def partition_columns(df: DataFrame) -> list[str]:
    """The partition columns of the one file scan behind a frame."""
    relations = _relations(df)
    if len(relations) != 1:
        raise ValueError("not a table or folder of files")
    return list(relations[0].partitionSchema().fieldNames())
