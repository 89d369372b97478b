"""Tables and checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where unset, a fresh one of our own is set.

    An unset folder means a single machine, as in tests: a local temporary
    folder is then visible to all executors.
    """
    setting = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if setting:
        return setting.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Folders written by this application; they go when it ends.
_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of the shared store that lives as long as the application."""
    if not _written:
        atexit.register(_remove_written)
    _written.append(f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def _remove_written() -> None:
    spark = SparkSession.getActiveSession()
    for path in _written:
        # the session may be gone, or the store: what is left then is for the store's own clean-up
        with contextlib.suppress(Exception):
            if spark is not None and spark.sparkContext._jsc is not None:
                remove(spark, path)
            elif "://" not in path or path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What is written to the shared folder inside goes at the end of the block; results that are to stay have their ``new_path`` before it."""
    before = len(_written)
    try:
        yield
    finally:
        gone = _written[before:]
        del _written[before:]
        for path in gone:
            remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    files, where = _at(spark, path)
    files.delete(where, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no folder."""
    files, where = _at(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that must not be there yet; False where it is. The store decides between two writers."""
    files, where = _at(spark, path)
    try:
        out = files.create(where, False)
    except Py4JJavaError as e:
        if not files.exists(where):
            raise e
        return False
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file under another name and gives it its own in one step; False where that is taken.

    So a file is whole as soon as it is there, and of two writers one gets the
    name. On a local disk the step is a hard link, elsewhere the store's rename,
    which must not replace a file (as HDFS has it).
    """
    files, where = _at(spark, path)
    if files.exists(where):
        return False
    draft = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.draft"
    create(spark, draft, text)
    _, source = _at(spark, draft)
    try:
        if files.getScheme() != "file":
            return bool(files.rename(source, where))
        try:
            os.link(source.toUri().getPath(), where.toUri().getPath())
        except FileExistsError:
            return False
        return True
    finally:
        files.delete(source, False)


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole and puts it in the place of what was there; readers see the one or the other."""
    files, where = _at(spark, path)
    if files.getScheme() == "file":
        local = where.toUri().getPath()
        folder, name = os.path.split(local)
        os.makedirs(folder, exist_ok=True)
        draft = f"{local}.{uuid.uuid4().hex}.draft"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
        # a checksum of the former file would not fit the new one
        with contextlib.suppress(FileNotFoundError):
            os.remove(f"{folder}/.{name}.crc")
        os.replace(draft, local)
        return
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    create(spark, draft, text)
    _, source = _at(spark, draft)
    overwrite = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, where, overwrite)


def qualified(spark: SparkSession, path: str) -> str:
    """The full path of a folder, as Spark names the files in it."""
    files, where = _at(spark, path.rstrip("/"))
    return files.makeQualified(where).toString()


def age(spark: SparkSession, path: str) -> float:
    """Seconds since a file or folder was last changed."""
    files, where = _at(spark, path)
    return time.time() - files.getFileStatus(where).getModificationTime() / 1000


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files below a folder."""
    files, where = _at(spark, path)
    return files.getContentSummary(where).getLength()


def small_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file, read by the driver; None where there is none."""
    files, where = _at(spark, path)
    if not files.exists(where):
        return None
    into = files.open(where)
    try:
        return bytes(into.readAllBytes())
    finally:
        into.close()


def small_text(spark: SparkSession, path: str) -> str:
    """A small file's text; the empty text where there is no file."""
    return (small_bytes(spark, path) or b"").decode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
