"""Cut points: tables written where the driver and all executors can read them, for operators that go round by round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode a temporary one where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="seqpack-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table that lasts until the driver's JVM ends; what made it is not computed again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a part, about: what a task sorts or groups at once.
ROWS = 1 << 18


def parts(rows: int) -> int:
    """So many parts that none has much more than ROWS rows, whatever the session's number of shuffle partitions is."""
    return max(1, -(-rows // ROWS))


def dealt(df: DataFrame, sized: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to parts of about ROWS rows of sized; a task's memory does not grow with the table. Parquet counts by its footers."""
    return df.repartition(parts(sized.count()), *keys)


def dense_ranks(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the dense rank of each row among all rows by order, from 0, without a task that holds them all.

    Rows are dealt to ranges of the order, so that equal ones share a range; a range's ranks follow from its own order and the
    number of different rows in the ranges before it.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = df.select(*order).groupBy(*order).agg(F.count("*").alias("_size"))
    placed = written(each.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, inner = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.sum("_size").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, as many as the setting says
    ends = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranks = placed.withColumn("_part", part).join(F.broadcast(ends), "_part").select(*order, "_size", (F.col("_before") + inner).cast("long").alias(name))
    return df.join(ranks, order)
