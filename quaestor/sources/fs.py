"""File-system calls on the driver: existence, listing, rename and removal of paths."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _resolve(spark, path)
    return fs.exists(p)


def is_dir(spark: SparkSession, path: str) -> bool:
    fs, p = _resolve(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _resolve(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, src = _resolve(spark, source)
    _, dst = _resolve(spark, target)
    fs.mkdirs(dst.getParent())
    if not fs.rename(src, dst):
        raise OSError(f"cannot rename {source} to {target}")


def listing(spark: SparkSession, path: str) -> list[str]:
    """``path|length|modified`` of each file below ``path``."""
    fs, p = _resolve(spark, path)
    files = fs.listFiles(p, True)
    out = []
    while files.hasNext():
        status = files.next()
        out.append(f"{status.getPath()}|{status.getLen()}|{status.getModificationTime()}")
    return sorted(out)


def last_modified_ms(spark: SparkSession, path: str) -> int:
    """Newest modification time below ``path`` in milliseconds since 1970."""
    return max((int(entry.rsplit("|", 1)[1]) for entry in listing(spark, path)), default=0)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``; none if it does not exist."""
    fs, p = _resolve(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small new file; fails if it exists."""
    fs, p = _resolve(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """All of a small file."""
    fs, p = _resolve(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename, unless the target exists; only one of several writers succeeds on a file system with atomic renames."""
    jvm = spark._jvm
    _, src = _resolve(spark, source)
    fs, dst = _resolve(spark, target)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(src, dst, options)
    except Exception:
        if fs.exists(dst):
            return False
        raise
    return True
