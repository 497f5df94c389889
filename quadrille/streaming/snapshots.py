"""A feed of harvested columns as a stream (an extension: the batch operators are the core).

Each micro-batch carries the columns of new snapshots; the registry of column
histories is updated and the changes against the latest known columns are
appended, with the same comparison as the batch difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadrille.functions.xsd import for_diff

FEED = "database_name string, schema_name string, extracted_at timestamp, table_name string, column_name string, data_type string, nullable boolean, max_length int"
KEY = ["database_name", "schema_name", "table_name", "column_name"]


def read_feed(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).json(folder)


def column_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Columns added, dropped or altered in the schemas that `current` describes; each input has one row per column."""
    touched = current.select("database_name", "schema_name").distinct()
    known = previous.join(touched, ["database_name", "schema_name"], "left_semi")
    old, new = known.select(*KEY, F.struct("data_type", "nullable", "max_length").alias("o")), current.select(*KEY, F.struct("data_type", "nullable", "max_length").alias("n"))
    both = old.join(new, KEY, "full_outer")
    kind = (
        F.when(F.col("o").isNull(), "COLUMN_ADDED").when(F.col("n").isNull(), "COLUMN_DROPPED")
        .when(for_diff(F.col("o.data_type")) != for_diff(F.col("n.data_type")), "COLUMN_TYPE_CHANGED")
        .when(F.col("o.nullable") != F.col("n.nullable"), "COLUMN_NULLABILITY_CHANGED")
        .when(~F.col("o.max_length").eqNullSafe(F.col("n.max_length")), "COLUMN_LENGTH_CHANGED")
    )
    return both.select(*KEY, kind.alias("change_type")).where("change_type is not null")


def follow(feed: DataFrame, state: str, changes: str, checkpoint: str) -> StreamingQuery:
    """Append to `changes` what each micro-batch alters, and keep the latest columns in `state`, a folder per batch."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.withColumn("_top", F.max("extracted_at").over(Window.partitionBy("database_name", "schema_name"))).where("extracted_at = _top").drop("_top").dropDuplicates(KEY)
        previous = spark.read.schema(FEED).parquet(f"{state}/{number - 1}") if number else spark.createDataFrame([], FEED)
        column_changes(previous, latest).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{changes}/batch={number}")
        untouched = previous.join(latest.select("database_name", "schema_name").distinct(), ["database_name", "schema_name"], "left_anti")
        untouched.unionByName(latest).write.mode("overwrite").parquet(f"{state}/{number}")  # a replayed batch writes the same folder again

    return feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
