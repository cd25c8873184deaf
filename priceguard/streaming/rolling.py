"""The rolling test on a stream: the flags of the batch operator, in event-time order.

A micro-batch joins the rows that wait, and those that the watermark has passed are judged by
the batch operator over units of a bounded number of rows, after the last rows of each category
that were judged before.  The state is three small tables in a folder of their own for every
micro-batch: what waits, the last 119 judged rows of each category, and the clock.  Keyed state
would take a category, and so maybe a third of all rows, through one task.

A replayed micro-batch reads the state of the one before and overwrites its own output, so every
row is written once.  A category waits until it has ten rows, as fewer are never flagged.  Rows
that come after the watermark has passed them, and rows without a time, are written with a null
flag.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import TUNED, Settings
from ..functions.clean import true
from ..operators.stats import rolling_deviations
from ..sources.scratch import deleted

LEAST = 10  # rows of a category
SLIM = ["event_id", "timestamp", "category", "final_price"]


class RollingStream:
    """State and output of one query, below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, delay: str = "1 hour", settings: Settings = TUNED):
        self.spark, self.folder, self.delay, self.settings = spark, folder, delay, settings
        self.schema: StructType | None = None

    def start(self, events: DataFrame):
        """The started query over what there is; ``finish`` judges what still waits after it."""
        slim = events.select(*SLIM)
        self.schema = slim.schema
        return slim.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()

    def flags(self) -> DataFrame:
        """event_id, timestamp, category, stat_rolling of all rows judged so far."""
        return self.spark.read.schema("event_id long, timestamp timestamp_ntz, category string, stat_rolling boolean").parquet(f"{self.folder}/flags/batch=*")

    def _state(self, batch: int):
        at = f"{self.folder}/state/{batch}"
        if batch < 0:
            none = self.spark.createDataFrame([], self.schema)
            return none, none, None
        clock = self.spark.read.parquet(f"{at}/clock").first()["clock"]
        return self.spark.read.schema(self.schema).parquet(f"{at}/waiting"), self.spark.read.schema(self.schema).parquet(f"{at}/last"), clock

    def step(self, new: DataFrame, batch: int) -> None:
        """One micro-batch."""
        waiting, last, passed = self._state(batch - 1)
        newest = new.agg(F.max("timestamp").cast("string")).first()[0]  # one row
        late = F.col("timestamp").isNull() if passed is None else F.col("timestamp").isNull() | (F.col("timestamp") <= F.lit(passed).cast("timestamp_ntz"))
        clock = passed
        if newest is not None:
            mark = self.spark.range(1).select((F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {self.delay}")).cast("string").alias("m")).first()["m"]
            clock = mark if passed is None or mark > passed else passed
        rows = waiting.unionByName(new.filter(~late))
        done = F.col("timestamp") <= F.lit(clock).cast("timestamp_ntz")
        self._judge(rows, last, F.coalesce(done, F.lit(False)), new.filter(late), batch, clock)

    def finish(self) -> None:
        """Judge the rows that wait for the watermark; for the end of a stream."""
        batch = max(int(p.getPath().getName()) for p in self._listed(f"{self.folder}/state"))
        waiting, last, clock = self._state(batch)
        self._judge(waiting, last, F.lit(True), None, batch + 1, clock, end=True)

    def _listed(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(target)

    def _judge(self, rows: DataFrame, last: DataFrame, done, late: DataFrame | None, batch: int, clock, end: bool = False) -> None:
        known = last.select("category").distinct().withColumn("known", F.lit(True)).withColumnRenamed("category", "c")
        counts = rows.groupBy("category").agg(F.count_if(done).alias("ready")).withColumnRenamed("category", "rc")
        open_ = counts.join(known, F.col("rc").eqNullSafe(F.col("c")), "left").filter(F.col("known") | (F.col("ready") >= LEAST)).select("rc")
        marked = rows.join(open_, F.col("category").eqNullSafe(F.col("rc")), "left").withColumn("go", done & (F.lit(end) | F.col("rc").isNotNull()))
        go = marked.filter("go").select(*SLIM, F.lit(True).alias("mine")).unionByName(last.select(*SLIM, F.lit(False).alias("mine")))
        judged = rolling_deviations(go, self.settings).filter("mine").select("event_id", "timestamp", "category", true(F.col("roll_dev") > self.settings.zscore_threshold).alias("stat_rolling"))
        if late is not None:
            judged = judged.unionByName(late.select("event_id", "timestamp", "category", F.lit(None).cast("boolean").alias("stat_rolling")))
        judged.write.mode("overwrite").parquet(f"{self.folder}/flags/batch={batch}")
        keep = max(self.settings.rolling_rows) - 1
        place = F.row_number().over(W.partitionBy("category").orderBy(F.col("timestamp").desc(), F.col("event_id").desc()))
        tail = go.withColumn("place", place).filter(F.col("place") <= keep)  # the group limit acts before the shuffle
        at = f"{self.folder}/state/{batch}"
        tail.select(*SLIM).write.mode("overwrite").parquet(f"{at}/last")
        marked.filter("not go").select(*SLIM).write.mode("overwrite").parquet(f"{at}/waiting")
        self.spark.range(1).select(F.lit(clock).cast("string").alias("clock")).write.mode("overwrite").parquet(f"{at}/clock")
        if batch > 1:
            deleted(self.spark, f"{self.folder}/state/{batch - 2}")
