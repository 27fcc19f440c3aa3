"""Session settings and the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "skein", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own settings."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset a local session, whose executors share this machine,
    gets one of its own; on a cluster it is an error, for no folder of one machine would be seen by all."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if found is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or os.path.join(tempfile.gettempdir(), "skein-checkpoints"))
    return found or jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder, so that later uses neither recompute nor lose it.

    ``spark.cleaner.referenceTracking.cleanCheckpoints`` (set by ``build_session``) removes it when nothing uses it.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application's written tables lie in."""
    return f"{shared_dir(spark).rstrip('/')}/skein-{spark.sparkContext.applicationId}"


_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_dropping: list[str | None] = []
_lock = threading.Lock()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a table written inside is removed as soon as that table is there.

    Else it stays until the driver happens to collect its garbage, and the shuffles of all steps add up on disk. Blocks
    may be nested or run side by side; the session's setting comes back with the last one.
    """
    with _lock:
        _dropping.append(spark.conf.get(_SETTING, None))
        spark.conf.set(_SETTING, "true")
    try:
        yield
    finally:
        with _lock:
            before = _dropping[0]
            _dropping.pop()
            if not _dropping:
                spark.conf.unset(_SETTING) if before is None else spark.conf.set(_SETTING, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``cut`` as a compressed Parquet table: for wide intermediate results that are read in part or several times.

    ``release`` removes these tables; the driver does so when it ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "snappy").parquet(path)
    if spark.sparkContext.applicationId not in _scratch:
        _scratch.add(spark.sparkContext.applicationId)
        atexit.register(release, spark)
    return spark.read.schema(df.schema).parquet(path)


_scratch: set[str] = set()


def release(spark: SparkSession) -> None:
    """Remove all tables that ``written`` made in this application. A session that has ended is left alone."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 the gateway may be gone at exit
        pass


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``, without running it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def buckets_for(df: DataFrame, mb_each: int = 24) -> int:
    """How many hash buckets keep each one's share of ``df`` near ``mb_each``; grows with the input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-plan_bytes(df) // (mb_each << 20)))


def block_pairs(data: DataFrame, ask: DataFrame, sized: list[str], limit: int = 64 << 20) -> DataFrame:
    """Every row of ``data`` beside every row of ``ask``; both are blocks of thousands of rows, not single ones.

    The blocks asked are written once; they go to every task if they are known to be small, else Spark pairs partitions.
    """
    ask = cut(ask)
    weight = ask.select(F.sum(sum(F.octet_length(c) if t == "binary" else F.size(c) * 24 for c, t in ask.dtypes if c in sized))).first()[0] or 0
    # each partition of the blocks asked makes the others' blocks anew
    return data.crossJoin(F.broadcast(ask) if weight <= limit else ask.coalesce(-(-weight // limit)))
