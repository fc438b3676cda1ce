"""Points that arrive as files: indicators of each new group, and running statistics by time."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.vegetation import cell_indicators


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_indicators(points: DataFrame, out: str, checkpoint: str, resolution: float):
    """A query that appends the indicators of every micro-batch's groups below out. A group must arrive in one file; a
    batch that is run again replaces its own part, so that each counts once."""

    def each(batch: DataFrame, number: int) -> None:
        found, _ = cell_indicators(batch, resolution)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return points.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def heights_by_time(points: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """n, mean and greatest height by group and time window; rows later than `late` behind the newest are dropped."""
    return points.withWatermark(time, late).groupBy(F.window(time, width), "group_id").agg(F.count(F.lit(1)).alias("n"), F.avg("hag").alias("mean"), F.max("hag").alias("greatest"))
