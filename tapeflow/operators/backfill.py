"""Labels that come with later rows: rows wait across runs until their horizon is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def directions(rows: DataFrame, horizon: int, threshold: float, by: str = "symbol", time: str = "ts", price: str = "close") -> DataFrame:
    """``rows`` with ``ready`` (whether the row ``horizon`` on is there) and ``label_direction``: 1 if the price rises by more than
    ``threshold`` up to that row, -1 if it falls by more, else 0; null where one of both prices is not positive."""
    line = Window.partitionBy(by).orderBy(time)
    ahead = F.lead(F.struct(F.col(price).alias("p")), horizon).over(line)
    change = F.when((F.col(price) > 0) & (F.col("_ahead.p") > 0), F.col("_ahead.p") / F.col(price) - 1)
    label = F.when(change > threshold, 1).when(change < -threshold, -1).when(change.isNotNull(), 0)
    return rows.withColumn("_ahead", ahead).withColumns({"ready": F.col("_ahead").isNotNull(), "label_direction": label}).drop("_ahead")


class Backfill:
    """A table of labelled rows below ``root`` that grows by runs, beside the rows that still wait.

    Run k reads what run k - 1 left waiting, adds its new rows, writes those whose horizon is reached to
    ``labelled/run=k`` and the others to ``waiting/run=k``. Both replace what an earlier try of the same run wrote, so a run
    may be repeated. New rows that repeat a time, or are not newer than the newest row of their symbol, are left out: their labels
    are given out. Rows without symbol or time are left out too."""

    def __init__(self, root: str, horizon: int = 15, threshold: float = 0.002, by: str = "symbol", time: str = "ts", price: str = "close"):
        self.root, self.horizon, self.threshold = root, horizon, threshold
        self.by, self.time, self.price = by, time, price

    def run(self, new: DataFrame, number: int) -> None:
        spark, key = new.sparkSession, [self.by, self.time]
        rows = new.dropna(subset=key)
        rest = [c for c in new.columns if c not in key]
        # Of rows of one time the same one is kept, in whatever order they come.
        rows = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, *(F.col(f"_r.`{c}`").alias(c) for c in rest)).select(*new.columns)
        if number > 0:
            before = spark.read.schema(new.schema).parquet(f"{self.root}/waiting/run={number - 1}")
            newest = before.groupBy(self.by).agg(F.max(self.time).alias("_newest"))
            rows = rows.join(newest, self.by, "left").where(F.col("_newest").isNull() | (F.col(self.time) > F.col("_newest"))).select(*new.columns)
            rows = before.union(rows)
        found = directions(rows, self.horizon, self.threshold, self.by, self.time, self.price)
        found.where("ready").drop("ready").write.mode("overwrite").parquet(f"{self.root}/labelled/run={number}")
        found.where("NOT ready").select(*new.columns).write.mode("overwrite").parquet(f"{self.root}/waiting/run={number}")

    def labelled(self, spark: SparkSession, runs: int) -> DataFrame:
        """All labelled rows of the first ``runs`` runs."""
        return spark.read.parquet(*(f"{self.root}/labelled/run={k}" for k in range(runs)))

    def stats(self, spark: SparkSession, runs: int) -> DataFrame:
        """Rows and share of each label, and whether there are enough: 500 rows and 15 % of the rarest of the three."""
        counts = self.labelled(spark, runs).where("label_direction IS NOT NULL").agg(
            F.count(F.lit(1)).alias("total"), *(F.count(F.when(F.col("label_direction") == k, 1)).alias(n) for k, n in ((-1, "down"), (0, "flat"), (1, "up")))
        )
        rarest = F.coalesce(F.try_divide(F.least("down", "flat", "up"), "total"), F.lit(0.0))
        return counts.withColumn("rarest", rarest).withColumn("ready", (F.col("total") >= 500) & (F.col("rarest") >= 0.15))

    def follow(self, stream: DataFrame, checkpoint: str):
        """Starts labelling a stream: each micro-batch is the run of its number."""
        return stream.writeStream.foreachBatch(self.run).option("checkpointLocation", checkpoint)
