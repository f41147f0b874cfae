"""Session helpers: defaults for local runs, the package on executors, the scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import wiretrace


def local_session(cores: str = "8", app: str = "wiretrace", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make the Arrow functions of this package loadable on executors.

    They are pickled by value, so executors need no copy of the package.
    """
    cloudpickle.register_pickle_by_value(wiretrace)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local session without one gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if not current:
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="wiretrace-checkpoint-")
        context.setCheckpointDir(named)
        current = context.getCheckpointDir()
    return named or current


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder as Parquet and read it again: what is made while
    reading, such as positions, then holds in every later pass."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
