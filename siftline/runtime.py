"""Session helpers shared by all operators: cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that is ever sent to every executor on purpose.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    In a local session without that setting a temporary folder is used; on a cluster the
    setting is required, as a machine-local folder would not be seen by the executors.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = getattr(spark.sparkContext, "_siftline_dir", None)
    if path is None:
        path = "file://" + tempfile.mkdtemp(prefix="siftline-")
        spark.sparkContext._siftline_dir = path
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back.

    Cuts the lineage like a checkpoint, but compressed and columnar. The table survives the
    loss of executors and is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of ``df`` if it holds at most ``rows`` rows; else leave the join to Spark.

    The check reads at most ``rows + 1`` rows.
    """
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner", hot: int = 100_000, salts: int = 64) -> DataFrame:
    """Join ``many`` with ``one``, which has one row a ``key``; keys with over ``hot`` rows go to ``salts`` tasks each, by the hash of ``by``."""
    crowd = small(cut(many.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(key, F.lit(salts).cast("bigint").alias("_s"))))
    own = many.join(crowd, key, "left").withColumn("_salt", F.when(F.col("_s").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_s")))).drop("_s")
    each = one.join(crowd, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_s"), F.lit(1)) - 1))).drop("_s")
    return own.join(each, [key, "_salt"], how).drop("_salt")


def collect_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> list:
    """Collect a table whose size is bounded by the problem; refuse a larger one."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"expected at most {rows} rows in a lookup table")
    return got


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
