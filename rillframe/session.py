"""Session construction and the few settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", app: str = "rillframe", **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow on; further settings as keywords with '_' for '.'."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    On a cluster it is the shared folder named in ``spark.checkpoint.dir``, without which this raises
    ValueError: a machine's own folder would be lost to the others. Only where all runs on one machine (tests,
    local runs) a temporary folder is set.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY, None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        configured = os.path.join(tempfile.gettempdir(), "rillframe-checkpoints")
    sc.setCheckpointDir(configured)
    return configured


def make_importable(spark: SparkSession) -> None:
    """Lets Python workers that see the same file system import this package, wherever the driver was started.

    On a cluster without one, send it along with ``--py-files``.
    """
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parent.parent)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


#: Rows of a row group: where rows take next to nothing, their bytes don't end it.
GROUP_ROWS = 1 << 24


def write_steps_small(spark: SparkSession, columns: Sequence[str]) -> None:
    """Lets the Parquet files this session writes hold numbers by their differences, and columns of these names never by a dictionary.

    What rises by equal steps then takes next to nothing. The values are the same. It holds for the session from
    here on; what is set already, and options of a writer, come first.
    """
    have = spark._jsparkSession.sessionState().newHadoopConf()
    for k, v in {"parquet.writer.version": "PARQUET_2_0", "parquet.block.row.count.limit": str(GROUP_ROWS), **{f"parquet.enable.dictionary#{c}": "false" for c in columns}}.items():
        if have.get(k) is None:
            spark.conf.set(k, v)


#: A table with less than this for every core may lie in too few pieces.
SMALL_PIECE = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for costly work on each row of a table that may lie in few pieces.

    Judged by the optimizer's estimate of its size, so nothing is run. A large table is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= cores * SMALL_PIECE else df.repartition(cores)
