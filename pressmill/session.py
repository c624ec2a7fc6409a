"""Session helpers: the shared scratch folder and tables written to cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}
_SHIPPED: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Where it is unset and all runs in one JVM (tests on one machine) a folder of this process is used; on a cluster a
    missing setting is an error, since no folder of one machine is seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"pressmill-{os.getpid()}")


def materialize(df: DataFrame, tag: str, **options: object) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The written files survive the loss of executors, so nothing before this point is computed again. They are
    removed when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pressmill-{tag}-{uuid.uuid4().hex}"
    keep(spark, path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_NARROW = ("Relation", "Project", "Filter", "Union", "LocalRelation", "LogicalRDD")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt over all cores by ``key`` where its files give less than half as many partitions as there are cores.

    For stages that spend much time on every row. With data in many files, as at any scale that matters, nothing is
    moved; inputs that are more than scans are left alone, since they have been shuffled by what made them.
    """
    execution = df._jdf.queryExecution()
    names = [line.strip(" :+-!'").split(" ", 1)[0] for line in execution.optimizedPlan().toString().split("\n") if line.strip()]
    if not all(n.startswith(_NARROW) for n in names):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if execution.toRdd().getNumPartitions() * 2 <= cores else df


def keep(spark: SparkSession, path: str) -> None:
    """Note a folder of the shared one for removal when the process, or its session, ends."""
    if not _WRITTEN:
        atexit.register(_forget)
    _WRITTEN[path] = spark


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one."""
    at, system = _file_system(spark, path)
    system.delete(at, True)
    _WRITTEN.pop(path, None)


def files_of(spark: SparkSession, path: str, done: bool = False) -> list[str]:
    """Data files anywhere below a folder, sorted, as URIs; with ``done`` the marks of complete tables instead. None for a missing folder."""
    at, system = _file_system(spark, path)
    if not system.exists(at):
        return []
    out, listed = [], system.listFiles(at, True)
    while listed.hasNext():
        uri = listed.next().getPath().toUri().toString()
        name = uri.rpartition("/")[2]
        if (name == "_SUCCESS") if done else not name.startswith(("_", ".")):
            out.append(_plain_uri(uri))
    return sorted(out)


def make_folder(spark: SparkSession, path: str) -> str:
    """Make a folder of the shared one that tasks write into; its URI."""
    at, system = _file_system(spark, path)
    system.mkdirs(at)
    return _plain_uri(system.makeQualified(at).toUri().toString())


def mark_done(spark: SparkSession, path: str) -> None:
    """Mark a folder that tasks have written into as complete."""
    at, system = _file_system(spark, f"{path}/_SUCCESS")
    system.create(at, True).close()


def _plain_uri(uri: str) -> str:
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def release(df: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` wrote. What still reads it must have run before."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/pressmill-" in folder:
            remove(df.sparkSession, folder)


def _forget() -> None:
    for path, spark in list(_WRITTEN.items()):
        try:
            remove(spark, path)
        except Exception:  # the session has ended before: what lies on this machine can still go
            if path.startswith(("file:", "/")):
                shutil.rmtree(re.sub("^file:/*", "/", path), ignore_errors=True)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per session, unless ``PYTHONPATH`` already leads them to it."""
    root = Path(__file__).resolve().parent.parent
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or _SHIPPED.get("to") == spark.sparkContext.applicationId:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="pressmill-"), "pressmill.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted((root / "pressmill").rglob("*.py")):
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED["to"] = spark.sparkContext.applicationId


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pressmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
