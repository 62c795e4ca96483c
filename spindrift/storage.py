"""What is kept between queries: the shared folder, small files in it, and tables bucketed by their keys.

A bucketed table is written once, one file a bucket, sorted. A join on its keys then shuffles only the other side. The layout is kept beside the
files, so that another session can open the folder again.
"""

from __future__ import annotations

import atexit
import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a query are removed when it has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; one of our own only on a local master where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "/tmp/spindrift-shared"
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{root.rstrip('/')}/spindrift-tables-{app}"
        atexit.register(_forget, spark, _folders[app])
    return _folders[app]


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        remove(spark, folder)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def _path(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def remove(spark: SparkSession, path: str) -> None:
    system, own = _path(spark, path)
    system.delete(own, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, own = _path(spark, path)
    return system.exists(own)


def names(spark: SparkSession, path: str) -> list[str]:
    system, own = _path(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(own)) if system.exists(own) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    system, own = _path(spark, path)
    out = system.create(own, True)
    out.write(bytearray(text.encode()))
    out.close()


def get_text(spark: SparkSession, path: str) -> str:
    system, own = _path(spark, path)
    source = system.open(own)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """False if the new name is taken."""
    system, own = _path(spark, old)
    target = _path(spark, new)[1]
    return not system.exists(target) and system.rename(own, target)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is written within are removed with its end, not when the driver happens to collect its garbage."""
    was = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if was is None else spark.conf.set(SHUFFLES_GO, was)


def write_bucketed(frame: DataFrame, path: str, by: list[str], sort: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Writes the rows to path, bucketed by the columns `by`, sorted by them and then `sort`."""
    spark = frame.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*by, *(sort or [])]
    name = f"spindrift_{uuid.uuid4().hex}"
    rows = frame.repartition(buckets, *by)
    with shuffles_go(spark):
        rows.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, *by).sortBy(*order).saveAsTable(name)
    put_text(spark, f"{path}/_layout", json.dumps({"by": by, "sort": order, "buckets": buckets, "columns": [[f.name, f.dataType.simpleString()] for f in frame.schema]}))
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """What write_bucketed() wrote to path."""
    layout = json.loads(get_text(spark, f"{path}/_layout"))
    quoted = lambda columns: ", ".join(f"`{c}`" for c in columns)
    name = f"spindrift_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{c}` {kind}" for c, kind in layout["columns"])
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({quoted(layout['by'])}) SORTED BY ({quoted(layout['sort'])}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def kept(frame: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: a loop's next round starts from here, also on another executor.
    rows_per_file: for whole texts, so that a large file isn't one task of its readers."""
    path = fresh(frame.sparkSession, label)
    with shuffles_go(frame.sparkSession):
        frame.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def freed(*frames: DataFrame) -> None:
    """Removes what kept() wrote for frames that nothing reads any more."""
    for frame in frames:
        for path in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            remove(frame.sparkSession, path)
