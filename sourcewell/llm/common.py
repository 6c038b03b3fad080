"""Shared helpers of the training-data operators: table reads, Arrow row mapping, checkpoints."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch are worked on in slices of at most this many text bytes, or one row.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder, by any path that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of the documents table; nothing else is read."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds at most SLICE_BYTES of the column's bytes, or one row."""
    texts = batch.column(column)
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > start and size + (n or 0) > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def releasing(run: Callable[[Iterator], Iterator], done: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """run, giving what it freed back to the system when a partition ends: Arrow's pool and the C library keep about 100 MB
    otherwise, in each of the workers that wait for their next task. done, if given, empties tables first."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        if done:
            done()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)

    return wrapped


def map_texts(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, column: str = "text", done: Callable[[], None] | None = None) -> DataFrame:
    """Map row slices in Python: fn gets and returns a dict of equal-length lists, by column name.

    fn's result may have another number of rows. Rows never leave their partition, so nothing is shuffled. done runs
    when a partition ends; it can free tables that a worker would otherwise keep for its next task.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = fn(part.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(releasing(run, done), schema)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of SLICE_BYTES for the Python workers of what is run meanwhile: a batch is held by the JVM, outside of its heap, and
    by the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(SLICE_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new temporary one where it is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = getattr(spark, "_sourcewell_shared", None)
        if not where:
            where = tempfile.mkdtemp(prefix="spark-")
            spark._sourcewell_shared = where
    return where


def shared_file(spark: SparkSession, name: str, data: bytes) -> None:
    """Write a small file to the shared folder and hand it to all executors, later ones too; SparkFiles finds it by name."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(data)
    out.close()
    context.addFile(path.toString())


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def learns(doc_id: str = "doc_id"):
    """True for documents that models may learn from: crc32 of the id's text mod 4 is not 2."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 != 2


def stored(df: DataFrame, by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Write a DataFrame as a table in the shared folder (in folders by some columns, with the writer's options) and read it again:
    its rows are made once, in columns."""
    import uuid

    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.options(**options).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A hot key's rows are dealt over so many tasks in joins; at most 64, the bits of a mask.
DEALS = 64


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """rows with a deal, by the hash of a column."""
    return rows.withColumn("deal", F.pmod(F.xxhash64(by), F.lit(DEALS)).cast("int"))


def deal_mask():
    """The deals that a group has, as the bits of one number, so that Spark can add them up before a shuffle."""
    return F.bit_or(F.expr("shiftleft(1L, deal)")).alias("mask")


def deals(groups: DataFrame, *columns: str) -> DataFrame:
    """One row for each deal of a group, so that a hot group's rows meet it in as many tasks as it has deals."""
    bits = F.expr(f"filter(sequence(0, {DEALS - 1}), d -> shiftrightunsigned(mask, d) & 1 = 1)")
    return groups.select(*columns, F.explode(bits).alias("deal"))


def dealt_join(rows: DataFrame, ones: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with ones, which has one row for each key: rows of a hot key, however many, meet it in several tasks."""
    own = dealt(rows, by)
    return own.join(ones.join(deals(own.groupBy(key).agg(deal_mask()), key), key), [key, "deal"]).drop("deal")


#: Bits of a bitmap of ids: its size, 2 MB, doesn't depend on the data.
BITMAP_BITS = 24


def _place():
    return F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITMAP_BITS)


def bitmap(ids: DataFrame) -> DataFrame:
    """A bitmap that has the hash of every doc_id of ids: at most 2 ** (BITMAP_BITS - 5) rows of 32 bits."""
    place = ids.select(_place().alias("p"))
    return place.groupBy(F.shiftright("p", 5).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("__bits"))


def maybe_in(docs: DataFrame, ids: DataFrame, bits: DataFrame | None = None, inside: bool = True) -> DataFrame:
    """Rows of docs whose doc_id the bitmap of ids has; or, with inside false, those it doesn't have.

    Rows that aren't inside are surely not in ids, so they need no shuffled join and don't travel; how many of the
    others there are falls with the share of ids, and is never less than right. The bitmap's size is bounded, so it
    is broadcast whatever the tables' sizes.
    """
    place, word, held = (_fresh(name, docs.columns) for name in ("__place", "__word", "__bits"))
    words = F.broadcast((bitmap(ids) if bits is None else bits).toDF(word, held))
    has = F.coalesce(F.expr(f"`{held}` & shiftleft(1L, cast(`{place}` & 31 as int))"), F.lit(0)) != 0
    rows = docs.withColumn(place, _place()).withColumn(word, F.shiftright(place, 5))
    return rows.join(words, word, "left").where(has == inside).select(*(F.col(f"`{c}`") for c in docs.columns))


def _fresh(name: str, columns: list[str]) -> str:
    """A column's name that isn't taken."""
    while name in columns:
        name += "_"
    return name
