"""Session construction and lineage cutting.

Iterative operators (connected components, Boruvka MST, mini-batch K-Means,
agglomerative rounds) cut their lineage with tables written to the shared folder
the cluster names in ``spark.checkpoint.dir``. A private folder is only created
when the session runs in local mode and no folder is configured (tests, the
bench). The tables of a finished job are removed with ``drop_tables``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "clusterloom", cpus: int | str | None = None,
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    master = f"local[{cpus}]" if cpus else "local[*]"
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, configuring a private one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative operators need a shared "
            "checkpoint folder on a cluster")
    folder = tempfile.mkdtemp(prefix="clusterloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return folder


def table_path(spark: SparkSession) -> str:
    """A new path for a table of this application under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and read it back.

    The result is a plain file scan: the plan is truncated completely (iterative
    loops that reuse a frame on both sides of a join do not grow their plans),
    the data survives executor loss, and later reads get column pruning.
    """
    spark = df.sparkSession
    path = table_path(spark)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # the schema is known: no job that reads it from the files


def number_rows(df: DataFrame, name: str = "position") -> DataFrame:
    """1-based position of every row in the order of the partitions and of the rows in them.

    Rows are numbered inside their partition and written once; the counts of the
    partitions (one number each) give the offsets.
    """
    numbered = cut_lineage(
        df.withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = dict(numbered.groupBy("_part").count().collect())
    before = [0]
    for p in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(p, 0))
    offset = F.element_at(F.lit(before).cast("array<long>"), F.col("_part") + 1)
    return numbered.withColumn(name, offset + F.col("_at") + 1).drop("_part", "_at")


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables that ``cut_lineage`` wrote for this application; call it when their readers are done."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``clusterloom`` importable in every Python worker (like ``--py-files``).

    Arrow/pandas tasks reference functions of this package, so executors need
    it on their path. The package is zipped once per SparkContext on the driver
    and handed to ``addPyFile``, which serves it to every executor.
    """
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="clusterloom-code-")) / "clusterloom.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in pkg.rglob("*.py"):
            z.write(f, str(f.relative_to(pkg.parent)))
    sc.addPyFile(str(out))
    _SHIPPED.add(key)
