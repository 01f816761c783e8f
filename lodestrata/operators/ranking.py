"""Row numbers over a whole table without a task that holds it all."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(df: DataFrame) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of this machine only where that is unset, as in tests."""
    spark = df.sparkSession
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "file:/tmp/lodestrata-shared"


def materialised(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives the loss of executors."""
    return Rounds(df).keep(df, what)


class Rounds:
    """Tables of a loop: keep() writes one and deletes the one of the same name of the round before last, which nothing reads any
    more; what the loop returns stays."""

    def __init__(self, df: DataFrame):
        self.spark, self.at, self.had = df.sparkSession, shared_dir(df), {}

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        at = f"{self.at}/{what}-{uuid.uuid4().hex}"
        df.write.parquet(at)
        had = self.had.setdefault(what, [])
        had.append(at)
        if len(had) > 2:
            self.drop(had.pop(0))
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def end(self, *but: str) -> None:
        """Deletes all tables but the last of these names."""
        for what, had in self.had.items():
            for at in had[:-1] if what in but else had:
                self.drop(at)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with `name`, 1..n by `order`, which has to be total. Rows are range-partitioned and sorted; a row's number is its
    place in its partition plus the sizes of those before, of which there are as many as partitions."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = materialised(ranged.withColumn("__part", F.shiftright("__at", 33)), "ranked")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.col("__at").bitwiseAND((1 << 33) - 1) + F.col("__before") + 1
    return ranged.join(sizes, "__part").withColumn(name, place).drop("__at", "__part", "__before")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows: each task keeps k, and they are merged."""
    return df.orderBy(*order).limit(k)
