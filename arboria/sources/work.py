"""Intermediate tables: written and read again, which cuts plans short and outlives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def keeper(folder: str):
    """keep(df, name): df as a Parquet table in a shared folder."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        out._kept = path
        return out

    return keep


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a single-machine session may do without that."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="arboria-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared(spark: SparkSession):
    """A keeper in the folder that driver and executors share."""
    return keeper(_folder(spark))


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder that driver and executors share."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def forget(kept: DataFrame) -> None:
    """Deletes a kept table that nothing reads any more."""
    path = kept.sparkSession._jvm.org.apache.hadoop.fs.Path(kept._kept)
    path.getFileSystem(kept.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def of_driver(spark: SparkSession, rows: list[tuple], schema: StructType | str) -> DataFrame:
    """Rows of the driver as a table, through Arrow: from a list, Spark would start Python workers for it on executors."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], kinds), schema)


def summed_before(rows: DataFrame, name: str, weight: str, *order) -> DataFrame:
    """rows with the sum of `weight` over all rows before them in a total order: tasks add up ranges of it, the driver gets a sum a task."""
    dealt = shared(rows.sparkSession)(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "dealt")
    before, offsets = 0, []
    for r in sorted(dealt.groupBy("_p").agg(F.sum(weight)).collect(), key=lambda r: r[0]):
        offsets.append((r[0], before))
        before += r[1]
    offsets = of_driver(rows.sparkSession, offsets, "_p int, _before long")
    here = F.sum(weight).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.join(F.broadcast(offsets), "_p").withColumn(name, F.coalesce(here, F.lit(0)) + F.col("_before")).drop("_p", "_before")


def numbered(rows: DataFrame, name: str, *order) -> DataFrame:
    """rows with their number (from 1) in an order: tasks count ranges of it, and the driver gets a count a task."""
    dealt = shared(rows.sparkSession)(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "dealt")
    before, offsets = 0, []
    for r in sorted(dealt.groupBy("_p").count().collect(), key=lambda r: r[0]):
        offsets.append((r[0], before))
        before += r[1]
    offsets = of_driver(rows.sparkSession, offsets, "_p int, _before long")
    here = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "_p").withColumn(name, here + F.col("_before")).drop("_p", "_before")
