"""Session helpers: local sessions, shipping the package to executors, shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested with."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexmill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lexmill-ship-")) / "lexmill_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path(root.name) / path.relative_to(root))
    spark.sparkContext.addPyFile(os.fspath(target))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master, which has no other
    machines, may do without it and gets a temporary folder."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(path)
        return path
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lexmill-checkpoint-"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def stash(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. What
    was written goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexmill-{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Write df to the shared folder in sorted buckets of `key` and read it back: tables of as many
    buckets join on the key without a shuffle. What was written goes when the driver ends."""
    spark = df.sparkSession
    known = f"lexmill_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{known}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.bucketBy(buckets, key).sortBy(key).options(path=path, compression="zstd").saveAsTable(known)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    found = spark.table(known)
    _ = found.schema  # resolved to its files; the name can go
    spark.sql(f"DROP TABLE {known}")
    return found


def partitions(spark: SparkSession) -> int:
    """Number of partitions for what is dealt by key: that of shuffles, which the cluster sizes for the data."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted for helper columns, none of which df has in any case."""
    held, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
