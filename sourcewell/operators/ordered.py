"""Numbers and running values along an order, where one key may have any share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "sequence", running: dict[str, str] | None = None, ranges: int | None = None) -> DataFrame:
    """df with each row's number, from 1, in its key's order, and running maxima {new column: column}.

    Rows are sorted into ranges of (key, order), so a huge key reaches over many tasks; each range numbers its own rows,
    and a scan over the ranges' counts and maxima tells what goes before. Only the first key of a range can begin in an
    earlier one, so what is joined back is one row a range at most. Rows equal in all of `order` are numbered in any
    order, and are in one task. Nulls come first and are a key like others; maxima leave nulls out. The ranges are
    written to the shared folder once, as their bounds come from a sample that another run need not repeat.
    """
    running = running or {}
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *by, *order).withColumn("__range", F.spark_partition_id()))
    own = Window.partitionBy("__range", *by).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("__n", F.row_number().over(own))
    for i, column in enumerate(running.values()):
        local = local.withColumn(f"__m{i}", F.max(column).over(upto))
    totals = rows.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"), *(F.max(c).alias(f"__m{i}") for i, c in enumerate(running.values())))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        F.col("__range").alias("__at"), F.struct(*by).alias("__key"), F.sum("__n").over(earlier).alias("__before"), *(F.max(f"__m{i}").over(earlier).alias(f"__b{i}") for i in range(len(running)))
    ).where("__before is not null")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__key.{c}")) for c in by))
    out = local.join(F.broadcast(before), (F.col("__range") == F.col("__at")) & same, "left")
    more = [F.greatest(f"__m{i}", f"__b{i}").alias(new) for i, new in enumerate(running)]
    return out.select(*df.columns, (F.col("__n") + F.coalesce("__before", F.lit(0))).alias(name), *more)
