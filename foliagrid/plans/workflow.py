"""Steps with dependencies in one session, with a status table that makes a rerun skip what is done."""

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Step:
    """name, what it does with (spark, config), the steps it needs, and whether it runs when none are named."""

    name: str
    action: Callable[[SparkSession, dict], None]
    needs: tuple[str, ...] = ()
    enabled: bool = True
    config: dict = field(default_factory=dict)


class Workflow:
    def __init__(self, spark: SparkSession, steps: list[Step], continue_on_error: bool = False):
        self.spark, self.steps, self.continue_on_error = spark, {s.name: s for s in steps}, continue_on_error
        self.seconds: dict[str, float] = {}
        self.errors: dict[str, str] = {}
        for s in steps:
            for need in s.needs:
                if need not in self.steps:
                    raise ValueError(f"{s.name} needs {need}, which isn't there")

    def listing(self) -> list[tuple[str, bool, tuple[str, ...]]]:
        return [(s.name, s.enabled, s.needs) for s in self.steps.values()]

    def run(self, names: list[str] | None = None, done: set[str] = frozenset()) -> bool:
        """Run the enabled steps, or the named ones, in order. A step runs if what it needs ran now or is in done."""
        chosen = [s for s in self.steps.values() if (s.name in names if names else s.enabled)]
        for s in chosen:
            missing = [n for n in s.needs if n not in self.seconds and n not in done]
            try:
                if missing:
                    raise RuntimeError(f"{s.name} needs {', '.join(missing)}")
                began = time.monotonic()
                s.action(self.spark, s.config)
                self.seconds[s.name] = time.monotonic() - began
            except Exception as error:
                self.errors[s.name] = str(error)
                if not self.continue_on_error:
                    return False
        return not self.errors


class Status:
    """Which groups are processed or failed: an append-only table, whose latest row for a group counts. Records of one
    time go by their sequence, in nanoseconds of the driver's clock."""

    SCHEMA = "group_id string, state string, at timestamp, sequence long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, groups: DataFrame, state: str) -> None:
        groups.select("group_id", F.lit(state).alias("state"), F.current_timestamp().alias("at"), F.lit(time.time_ns()).alias("sequence")).write.mode("append").parquet(self.path)

    def latest(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.SCHEMA).select("group_id", "state")
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return rows.groupBy("group_id").agg(F.max_by("state", F.struct("at", F.coalesce("sequence", F.lit(0).cast("long")))).alias("state"))

    def remaining(self, groups: DataFrame) -> DataFrame:
        """Groups that aren't processed; failed ones come again."""
        return groups.join(self.latest().filter("state = 'processed'").select("group_id"), "group_id", "left_anti")
