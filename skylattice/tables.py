"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one on a local master;
    a cluster must name one."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(base)
    return base


#: Rows of a task after ``spread``.
SPREAD = 50_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to tasks of at most some SPREAD rows: for costly work on rows of small files,
    which few tasks would read. Their number grows with the rows."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD)))


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder. For loops: a checkpointed frame keeps the
    constraints of its plan, which multiply from turn to turn; a table has none."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def together(*jobs: Callable[[], object]) -> list:
    """What the jobs give, run side by side: a job's last tasks leave cores to the others."""
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]
