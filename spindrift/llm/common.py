"""What several operators of this folder share: words, shared storage, tables that are not there yet."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space between words: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Whether the shuffle files of a query are removed when it has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_opened: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Characters beyond ASCII that lower() may change.
CASED = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; lower() is much faster than translate() where it does just that."""
    return F.when(text.rlike(CASED), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def space_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; one of our own only on a local master where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "/tmp/spindrift-shared"
    app = spark.sparkContext.applicationId
    if app not in _opened:
        _opened[app] = f"{root.rstrip('/')}/spindrift-{app}"
        atexit.register(_drop, spark, _opened[app])
    return _opened[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stored(frame: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """Writes the rows to the shared folder and reads them back. A lost executor costs no recomputation from
    further back than this. rows_per_file: for rows of megabytes, since readers take thousands of a file at once. The shuffles
    of the write are removed with its end, not when the driver happens to collect its garbage."""
    path, conf = fresh_path(frame.sparkSession, label), frame.sparkSession.conf
    was = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        frame.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    finally:
        conf.unset(SHUFFLES_GO) if was is None else conf.set(SHUFFLES_GO, was)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def freed(*frames: DataFrame) -> None:
    """Removes what stored() wrote for frames that nothing reads any more."""
    for frame in frames:
        for path in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            hadoop = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def joined_if_small(left: DataFrame, right: DataFrame, keys, how: str, rows: int, bound: int) -> DataFrame:
    """A join that broadcasts `right` only when its counted rows are within `bound`, else shuffles."""
    return left.join(F.broadcast(right) if rows <= bound else right, keys, how)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts: the usual 10,000 rows of them take much of a worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
