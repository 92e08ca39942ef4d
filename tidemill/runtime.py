"""Session, shared workspace and table access used by every operator."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def session(app: str = "tidemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, ANSI, AQE with skew-join splitting.

    ``master`` is only for local work; on a cluster the submit command names it. Keyword arguments use ``__`` for
    dots: ``spark__sql__shuffle__partitions="8"``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context, so that it needn't be installed there."""
    context = spark.sparkContext
    if getattr(context, "_tidemill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # not when it already runs from such an archive
        path = f"{tempfile.mkdtemp(prefix='tidemill-')}/tidemill.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        context.addPyFile(path)
    context._tidemill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir`` (any path Spark can read)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temp views over the tables, for SQL users."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (as in tests) a temporary folder is made and set; on a cluster the
    executors couldn't read one another's files in it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
        where = where.rsplit("/", 1)[0] if where else None
    if not where:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone at interpreter exit
        pass


_written: dict[str, SparkSession] = {}


@atexit.register
def _delete_written() -> None:
    for path, spark in _written.items():
        _delete(spark, path)


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors. With ``by`` the
    values of that column lie in folders of their own, so that a filter on it reads no others.

    The files live until ``discard`` or until the driver exits, because lazily evaluated results still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemill/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _written[path] = spark
    return spark.read.schema(schema).parquet(path)


def materialize_in_passes(df: DataFrame, label: str, column: str, passes: int, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``materialize(shape(df))`` a hash class of ``column`` at a time, each with shuffle files of its own that go before
    the next, so that they take a share of the disk. ``shape`` may combine rows of one value of ``column`` only;
    ``df`` is evaluated once a pass and must give the same rows each time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemill/{label}-{uuid.uuid4().hex}"
    schema = shape(df).schema
    _written[path] = spark
    for at in range(passes):
        # not the hash that deals rows out: a class would fall into a few partitions
        some = df.filter(F.pmod(F.xxhash64(column), F.lit(passes)) == at) if passes > 1 else df
        shape(some).write.mode("append").parquet(path)
        del some
        collect_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    spark = df.sparkSession
    for name in {re.sub(r"(.*/tidemill/[^/]+)/.*", r"\1", f) for f in df.inputFiles()}:
        if "/tidemill/" in name:
            _delete(spark, name)
            for path in [p for p in _written if p.rsplit("/", 1)[-1] == name.rsplit("/", 1)[-1]]:
                del _written[path]


def collect_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing holds any more; else they stay until the driver's next full
    collection. The last plan is only let go of by the second one, as the first comes before Python's handles are gone."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
