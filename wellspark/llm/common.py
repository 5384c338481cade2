"""Session helpers of the operators: checkpoints, fixed columns, bounded samples."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for a while."""
    was = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names.

    ``spark.checkpoint.dir`` decides; only where it is unset and no folder was set on the
    context, a local session (as in tests) takes a temporary folder; a cluster raises an error.

    A checkpoint also hands on its plan's constraints and size estimate.  The estimate of a join
    is a product, so over the rounds of an iteration its digits double and the driver drowns in
    them; the rows are therefore wrapped anew, without either.  That takes the session's internal
    constructor, here alone.
    """
    shared_folder(df.sparkSession)
    spark = df.sparkSession
    done = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def checkpointed_by(df: DataFrame, key: str, least: int = 1) -> DataFrame:
    """A checkpoint that stays dealt by ``key``, so that joins on it move the other side only.

    It has the session's number of shuffle partitions, or ``least`` if that is more.

    A checkpoint keeps its plan's partitioning if that plan isn't adaptive, so adaptive execution
    is off while this one plan is made.
    """
    n = max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    with setting(df.sparkSession, "spark.sql.adaptive.enabled", "false"):
        shared_folder(df.sparkSession)
        return df.repartition(n, key).checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the context, set if it wasn't."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """Written as Parquet to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made and nothing needs any more."""
    spark = df.sparkSession
    own = f"/{shared_folder(spark).rstrip('/').rsplit('/', 1)[-1]}/written-"  # the context's own folder has a random name
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles() if own in f}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id counts as empty text (true)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def text_bytes(df: DataFrame) -> int:
    """The bytes of all texts (one cheap scan)."""
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
