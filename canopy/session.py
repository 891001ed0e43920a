"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# settings the jobs are written against (AQE re-plans joins / partition counts
# at run time; skew join splits hot join keys; UTC keeps timestamps engine-neutral)
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "canopy") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("CANOPY_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all machines share, as ``spark.checkpoint.dir`` names it.

    Only a local master without that setting gets a scratch folder of its own, once per
    session; on a cluster its absence is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="canopy-shared-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Folders that ``stored`` has written and nobody has deleted yet.
_FOLDERS: dict[str, None] = {}


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: lineage ends at files that
    outlive executors, and later steps read the same rows.

    The folder stays until ``discard`` or ``discard_all``, as results may still read it."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _FOLDERS[path] = None
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of ``stored`` results that nothing reads any more."""
    for df in frames:
        _FOLDERS.pop(df._stored_path, None)
        delete_folder(df.sparkSession, df._stored_path)


def discard_all(spark: SparkSession) -> int:
    """Delete all folders that this process has stored, once the results that read them are
    written or collected; the number of folders."""
    paths = list(_FOLDERS)
    for path in paths:
        _FOLDERS.pop(path, None)
        delete_folder(spark, path)
    return len(paths)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """What is stored inside is deleted at the end: for work that is written out whole, such as
    a stream's micro-batch."""
    before = set(_FOLDERS)
    try:
        yield
    finally:
        for path in [p for p in _FOLDERS if p not in before]:
            _FOLDERS.pop(path, None)
            delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete through the Hadoop file system, which all machines share."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Session setting: deal every given table to so many partitions.  Unset (the default) tables
#: keep the partitions of their file splits; single-file test data needs it to use all cores.
SCAN_PARTITIONS = "canopy.scan.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df
