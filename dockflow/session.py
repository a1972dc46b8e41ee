"""Session settings the engine expects on a cluster; every one is plain Spark configuration."""

import uuid

from pyspark.sql import SparkSession

from dockflow.schemas import CITY_ZONE

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Generated methods above the JIT's 8,000-byte limit would stay interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A task that writes few partitions keeps their files open instead of sorting its rows.
    "spark.sql.maxConcurrentOutputFileWriters": "16",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app="dockflow", master=None, time_zone=CITY_ZONE, **conf):
    """A session with the recommended settings; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", time_zone)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark, fallback=None):
    """The cluster's shared checkpoint folder; `fallback` applies only where none is set (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if fallback is None:
        raise ValueError("spark.checkpoint.dir is not set on this session")
    return fallback


def staged(df, name):
    """`df` written once to the shared folder, under this application's own, and read back."""
    spark = df.sparkSession
    root = checkpoint_root(spark, spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged")
    path = f"{root}/dockflow-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
