"""Session settings the library relies on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# UTC makes NTZ <-> instant conversion (needed for watermarks) the identity.
# AQE splits skewed sort-merge joins and picks broadcast joins from real sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # State with timers needs this store.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def build_session(app: str = "tidelog", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above. On a cluster leave ``master`` unset.

    Shuffle parallelism is left to the deployment: AQE merges small shuffle
    partitions, so a cluster sets ``spark.sql.shuffle.partitions`` high once.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables and checkpoints, shared by driver and executors.

    ``spark.checkpoint.dir`` names it. Where that is unset, it lies in the warehouse,
    which Spark requires to be shared as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_tidelog_scratch"


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table the optimizer knows the size of (so it can be broadcast).

    ``schema`` is a DDL text of primitive types; rows made from plain Python
    lists would be planned as an RDD of unknown, hence huge, size.
    """
    struct = StructType.fromDDL(schema)
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(struct.fields)]
    return spark.createDataFrame(pa.table(columns, names=struct.fieldNames()), struct)
