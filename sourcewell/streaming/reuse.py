"""Reuse by content in a stream: which media were transcribed before, against a growing index of content hashes.

The index lies in folders by bucket of the hash and by epoch, with Bloom filters in its files. A batch reads the buckets that
its hashes fall into, and within them the row groups that may hold one; it adds a folder for its own epoch and reads earlier
ones only, so a batch that is run again sees what it saw and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.storage import written

BUCKETS = 64
_INDEX = "content_hash string, __row long, bucket int, epoch long"


def _put(rows: DataFrame, path: str, by: tuple[str, ...]) -> None:
    """Write rows in place of the folders that they fall into."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    writer.option("parquet.bloom.filter.enabled#content_hash", "true").parquet(path)


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(path)


def reuse_batch(media: DataFrame, epoch: int, index: str, out: str, order: list[str]) -> None:
    """Write media (content_hash and any columns) to out, one folder an epoch, with reused: true where an earlier epoch or
    an earlier row of this one, in order's order, has the same hash. Rows without a hash are never reused nor kept in the index."""
    spark = media.sparkSession
    # Numbers tell equal rows apart; they are written, as another run of the same plan might give others.
    rows = written(media.withColumns({"__row": F.monotonically_increasing_id(), "bucket": F.pmod(F.xxhash64("content_hash"), F.lit(BUCKETS)).cast("int")}))
    hashed = rows.where("content_hash is not null")
    first = hashed.groupBy("bucket", "content_hash").agg(F.min_by("__row", F.struct(*order, "__row")).alias("__row"))
    touched = [r.bucket for r in hashed.select("bucket").distinct().collect()]  # BUCKETS at most
    known = _index(spark, index).where(F.col("bucket").isin(touched) & (F.col("epoch") < epoch)) if touched else _index(spark, index).limit(0)
    new = first.join(known.select("bucket", "content_hash"), ["bucket", "content_hash"], "left_anti")
    _put(new.withColumn("epoch", F.lit(epoch).cast("long")).repartition("bucket"), index, ("bucket", "epoch"))
    # Row numbers are all different, so a hash of very many rows isn't a join key here.
    fresh = _index(spark, index).where(F.col("epoch") == epoch).select("__row", F.lit(False).alias("__reused"))
    told = rows.join(fresh, "__row", "left").withColumn("reused", F.coalesce("__reused", F.col("content_hash").isNotNull()))
    _put(told.drop("__row", "__reused", "bucket").withColumn("epoch", F.lit(epoch).cast("long")), out, ("epoch",))


def reuse(media: DataFrame, index: str, out: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Follow a stream of media to its end for now: reuse_batch() for each batch. index goes with the checkpoint."""
    spark = media.sparkSession
    spark.createDataFrame([], _INDEX).write.mode("append").partitionBy("bucket", "epoch").parquet(index)  # makes the folder

    def one(batch: DataFrame, epoch: int) -> None:
        reuse_batch(batch, epoch, index, out, order)

    return media.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
