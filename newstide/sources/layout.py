"""Where data may be put, and how a scan is laid out."""

import atexit
import os
import shutil
import sysconfig
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from urllib.parse import urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_TABLES: dict[str, SparkSession] = {}
_SHIPPED: set[str] = set()
# Tables of the innermost ``scratch`` block of this thread.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or what was given to
    ``SparkContext.setCheckpointDir``. Without one there is no place for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return named


def ship_package(spark: SparkSession) -> bool:
    """Send this package to the Python workers of a session, once; False if they have it already.

    Workers import what a Python function of a query names. They find the package where it is
    installed or on ``PYTHONPATH``; else the driver's own copy is sent as one archive.
    """
    context, top = spark.sparkContext, Path(__file__).resolve().parent.parent
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *sysconfig.get_paths().values()]
    if str(top.parent) in known or context.applicationId in _SHIPPED:
        return False
    folder = tempfile.mkdtemp(prefix="newstide-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    # Spark's driver serves the file to the executors as long as the session lives
    context.addPyFile(shutil.make_archive(f"{folder}/{top.name}", "zip", top.parent, top.name))
    _SHIPPED.add(context.applicationId)
    return True


def ensure_shared_dir(spark: SparkSession) -> None:
    """Give a session what registered queries need in any session: this package on its workers, and,
    on one machine, a folder for intermediate tables where none is set."""
    ship_package(spark)
    context = spark.sparkContext
    local = context.master == "local" or context.master.startswith("local[")
    if local and not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="newstide-"))


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path for a table of this session; what is written there goes when Python ends."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    if not _TABLES:
        atexit.register(remove_tables)
    _TABLES[path] = spark
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return path


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose intermediate tables are removed at its end, but for those of the written tables
    that are given to the function it yields. What else was read from them is void then."""
    outer, tables, kept = _SCOPE.get(), [], set()

    def keep(df: DataFrame) -> DataFrame:
        found = {os.path.dirname(one) for one in df.inputFiles()}
        kept.update(path for path in tables if any(urlsplit(one).path == urlsplit(path).path
                                                   for one in found))
        return df

    token = _SCOPE.set(tables)
    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        for path in tables:
            if path in kept:
                if outer is not None:
                    outer.append(path)
            elif path in _TABLES:
                remove_table(_TABLES[path], path)


def _fs(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in ``folder``, in order; none if there is no such folder."""
    fs, where = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file appear as a whole, or not at all: False if there is one of that name."""
    fs, where = _fs(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}")
    fs.mkdirs(where.getParent())
    stream = fs.create(draft, False)
    stream.write(text.encode())
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.FileContext.getFileContext(where.toUri(), fs.getConf())
    try:
        files.rename(draft, where, spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Py4JJavaError as failure:
        fs.delete(draft, False)
        if "FileAlreadyExists" in failure.java_exception.getClass().getName():
            return False
        raise
    return True


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table; what was to be read from it is void."""
    fs, where = _fs(spark, path)
    fs.delete(where, True)
    for known in [one for one in _TABLES if urlsplit(one).path == urlsplit(path).path]:
        del _TABLES[known]


def remove_tables() -> None:
    """Delete all intermediate tables of this session."""
    for path, spark in list(_TABLES.items()):
        try:
            remove_table(spark, path)
        except Exception:  # at the end the JVM may be gone, and with it the way to the folder
            pass
        _TABLES.pop(path, None)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to a new table in the shared folder and continue from that table.

    Cuts the lineage: later stages, and tasks repeated after the loss of an executor, read the
    rows that were written and evaluate nothing again.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Deal the rows of a narrow scan over ``parts`` tasks before costly per-row work.

    For a table of few files with one row group each, which few tasks read whatever its size. The
    caller knows its files; nothing is moved unless this is called.
    """
    return scan.repartition(parts, *keys)
