"""Session helpers: a local session for tests, durable checkpoints, checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session on ``local[cores]`` with UTC time, for tests and ``bench.py``."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "100k")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only where none is set in a local session (tests). On a
    cluster a machine's own folder would not be seen by the others, so it is an error there."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        got = spark.sparkContext.getCheckpointDir()
        if not got and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = got or tempfile.mkdtemp(prefix="readlake-checkpoint-")
    return there


_written: list = []


def remove_written() -> None:
    """Deletes the tables that durable wrote; results that read them must have been taken. Runs when the driver ends, as far as it still can."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone
            return


def durable(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut, several readers share one computation, and the loss
    of an executor loses nothing."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/readlake-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(remove_written)
    _written.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes a core below which a table that is about to be expanded is spread first.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table (by the planner's estimate, less than SPREAD_BYTES a core) dealt out over all cores, as it may be a single file; a larger one
    comes in many splits and stays as it is. For work that is heavy for each row, before rows multiply."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def collect_bounded(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table that is small by definition; an error rather than a full driver where it is not."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows")
    return rows


def clean_genome(c):
    """Genome name in clean form: surrounding blanks cut, lower case, a final '.dna' removed."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\.dna$", "")


def clean_sequence(c):
    """Sequence name with surrounding blanks and tabs cut."""
    return F.btrim(c, F.lit(" \t"))
