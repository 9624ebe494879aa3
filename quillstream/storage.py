"""Shared-folder storage: staged tables that cut lineage, and versioned tables published by one rename.

Everything lives under ``spark.checkpoint.dir``, which all executors share.  Only a local session that leaves
that unset (tests, a laptop) gets a temporary folder of this machine; on a cluster the setting is required.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as the session names it."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "own" not in _own:
        folder = tempfile.mkdtemp(prefix="quillstream-")
        atexit.register(shutil.rmtree, folder, True)
        _own["own"] = f"file://{folder}"
    return _own["own"]


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path and the path as its object."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def run_dir(spark: SparkSession) -> str:
    """A folder of this application alone; removed when the interpreter ends."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"{shared_dir(spark)}/quillstream/{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _own[app])
    return _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, target = filesystem(spark, path)
        fs.delete(target, True)
    except Exception:  # noqa: BLE001 - the session has ended before the interpreter
        pass


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.option("compression", "zstd").options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_text_atomically(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text file in place by one rename, replacing what was there."""
    fs, target = filesystem(spark, path)
    jvm = spark.sparkContext._jvm
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    stream = fs.create(temporary, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temporary, target, options)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small text file, or None where there is none."""
    fs, target = filesystem(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


#: Versions of a table that stay, the current one included: readers of the one before can finish.
KEEP = 3


def publish(df: DataFrame, table: str, keep: int = KEEP) -> DataFrame:
    """Write a complete new version of ``table`` and make it current by renaming one pointer file.

    Readers see the old version or the whole new one.  A failed write leaves the pointer alone.  Of the versions
    before, the newest stay, ``keep`` in all.
    """
    publish_all(df.sparkSession, {"": df}, table, keep=keep)
    return current(df.sparkSession, table)


def publish_all(spark: SparkSession, parts: dict[str, DataFrame], table: str, texts: dict[str, str] | None = None, keep: int = KEEP) -> str:
    """Several tables and small text files as one version, current all at once; the version's folder. Nothing is visible before everything is written."""
    version = f"v-{uuid.uuid4().hex[:12]}"
    for name, df in parts.items():
        df.write.option("compression", "zstd").parquet(f"{table}/{version}/{name}".rstrip("/"))
    for name, text in (texts or {}).items():
        write_text_atomically(spark, f"{table}/{version}/{name}", text)
    point(spark, table, version, keep=keep)
    return f"{table}/{version}"


def point(spark: SparkSession, table: str, version: str, needed: set[str] = frozenset(), keep: int = KEEP) -> None:
    """Make a version current by one rename; then remove older ones that aren't ``needed``."""
    before = read_text(spark, f"{table}/CURRENT")
    write_text_atomically(spark, f"{table}/CURRENT", version)
    _retain(spark, table, {version, before, *needed}, keep)


def _retain(spark: SparkSession, table: str, needed: set[str | None], keep: int) -> None:
    """Remove all but the newest ``keep`` versions; those in ``needed`` stay in any case."""
    fs, target = filesystem(spark, table)
    old = sorted((f.getModificationTime(), f.getPath().getName(), f) for f in fs.listStatus(target) if f.isDirectory() and f.getPath().getName().startswith("v-"))
    for _, name, f in old[: max(0, len(old) - keep)]:
        if name not in needed:
            fs.delete(f.getPath(), True)


def current_folder(spark: SparkSession, table: str) -> str:
    """The folder of the published version."""
    version = read_text(spark, f"{table}/CURRENT")
    if version is None:
        raise FileNotFoundError(f"{table} has no published version")
    return f"{table}/{version}"


def current(spark: SparkSession, table: str, part: str = "") -> DataFrame:
    """The published version of a table, or of one of the tables that were published together."""
    return spark.read.parquet(f"{current_folder(spark, table)}/{part}".rstrip("/"))
