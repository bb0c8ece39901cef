"""Session-level plumbing: table access, the shared folder and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparrowdex")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only where the session names none and runs in one process (tests, a laptop) is
    a temporary one set; on a cluster a folder of one machine would lose rows, so
    there the setting is required.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparrowdex-"))
    return named or sc.getCheckpointDir()


#: Tables this process wrote to the shared folder, which go when it ends.
_TABLES: dict[str, SparkSession] = {}


@atexit.register
def _clear() -> None:
    for path, spark in list(_TABLES.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended already
            return


@contextmanager
def scratch() -> Iterator[None]:
    """Delete at its end all tables written inside: for long sessions, around a query and the use of its result."""
    before = set(_TABLES)
    try:
        yield
    finally:
        for path in set(_TABLES) - before:
            _delete(_TABLES[path], path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _TABLES.pop(path, None)


def written(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cut lineage through a table in the shared folder, which outlives executors.

    Unlike a checkpoint the table carries no constraints of the plan it came
    from, which loops would pile up, and keeps its true size, so that later joins
    can choose their strategy by it and column pruning reaches the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Delete a written table that nothing reads any more; others stay as they are."""
    path = getattr(df, "_written_to", None)
    if path:
        _delete(df.sparkSession, path)


def cut(df: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """written(), then drop the table of the round before, if given."""
    out = written(df)
    dropped(old)
    return out


def partitions_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def guarded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only if the counted rows stay under a stated limit."""
    return F.broadcast(df) if rows <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer parts than cores to all cores; larger scans stay as they are.

    A client that cannot see the parts leaves the scan as it is.
    """
    try:
        cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - a remote session has no parts to count
        return df
    return df.repartition(cores) if parts < cores else df
