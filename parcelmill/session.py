"""Session settings, the shared checkpoint folder and shipping of the package to workers."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "parcelmill", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with UTC time, AQE and skew handling on.

    Cluster settings given by spark-submit win; nothing here fixes a master or
    a partition count unless the caller asks for it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    ship_package()
    return session


def ship_package() -> None:
    """Send this package's functions to Python workers by value.

    Workers then need neither the repository folder on their path nor an
    installed copy, wherever the driver was started.
    """
    package = sys.modules[__package__]
    if __package__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(package)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a local session without that setting gets a private temporary folder;
    a cluster without it is refused.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            found = tempfile.mkdtemp(prefix="parcelmill-checkpoint-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder and continue from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Runtime settings (dots as double underscores) for the actions of a block; the old values come back."""
    names = {key.replace("__", "."): value for key, value in conf.items()}
    before = {key: spark.conf.get(key, None) for key in names}
    try:
        for key, value in names.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    Like `cut_lineage`, but columnar and compressed, with column pruning and
    filters when it is read again. The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
