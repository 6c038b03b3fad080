"""Keyed tables in relational databases: a Spark data source over any Python database module (DB-API 2).

    register(spark)
    df.write.format("relational").option("database", path).option("table", "notes").option("keys", "note_id").mode("append").save()
    spark.read.format("relational").schema(s).option("database", path).option("table", "notes").option("split", "note_id").load()

Options: module (default sqlite3), database (what its connect() takes), table, keys (comma-separated), modified (a column; of
rows with one key the one modified last wins, the written one among equals), epoch (a name for the batch), split and parts (an
integer column and the number of tasks that read), batch (rows a statement batch).
"""

from __future__ import annotations

import datetime
import decimal
import importlib
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType

_KINDS = {ByteType: "smallint", ShortType: "smallint", IntegerType: "integer", LongType: "bigint", BooleanType: "smallint", FloatType: "double precision", DoubleType: "double precision", BinaryType: "blob"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _plain(x):
    """Dates, times and decimals are kept as text, which every database takes; they are read back as what they were."""
    return str(x) if isinstance(x, (datetime.date, datetime.datetime, decimal.Decimal)) else x


class _Database:
    """What tasks and driver need to reach one table; it holds options only, so it travels to tasks."""

    def __init__(self, options: dict[str, str]):
        self.module, self.database, self.table = options.get("module", "sqlite3"), options["database"], options["table"]
        self.batch = int(options.get("batch", 2000))

    def connect(self):
        module = importlib.import_module(self.module)
        return closing(module.connect(self.database, timeout=600) if self.module == "sqlite3" else module.connect(self.database))

    def marks(self, n: int) -> str:
        return ", ".join(["?" if importlib.import_module(self.module).paramstyle == "qmark" else "%s"] * n)

    def create(self, table: str, schema: StructType, more: str = "") -> str:
        columns = ", ".join(f"{_quoted(f.name)} {_KINDS.get(type(f.dataType), 'text')}" for f in schema.fields)
        return f"create table if not exists {_quoted(table)} ({columns}{more})"


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """Each attempt of a task puts its rows, under a name of its own, into a staging table; the commit takes the rows of the
    attempts that Spark reports as done, in one transaction with the batch's name. So killed, repeated and doubled tasks
    leave each row once, readers never see a part of a batch, and a batch that comes again changes nothing."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.db, self.schema, self.overwrite = _Database(options), schema, overwrite
        self.keys = [k.strip() for k in options["keys"].split(",")]
        self.modified, self.epoch = options.get("modified"), options.get("epoch")
        missing = [c for c in (*self.keys, *([self.modified] if self.modified else [])) if c not in schema.fieldNames()]
        if missing:
            raise ValueError(f"no columns {missing} in the rows to write")
        self.stage = f"{self.db.table}__stage_{uuid.uuid4().hex}"
        with self.db.connect() as c:
            keys = ", ".join(map(_quoted, self.keys))
            c.execute(self.db.create(self.db.table, schema, f", primary key ({keys})"))
            c.execute(f"create table if not exists {_quoted(self.db.table + '__epochs')} (epoch text primary key)")
            c.execute(self.db.create(self.stage, schema, ", __attempt text, __pos bigint"))
            c.commit()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        attempt, rows = uuid.uuid4().hex, 0
        insert = f"insert into {_quoted(self.stage)} values ({self.db.marks(len(self.schema.fields) + 2)})"
        with self.db.connect() as c:
            for batch in iterator:
                for start in range(0, batch.num_rows, self.db.batch):
                    columns = [map(_plain, x.to_pylist()) for x in batch.slice(start, self.db.batch).columns]
                    values = [(*row, attempt, rows + i) for i, row in enumerate(zip(*columns))]
                    c.cursor().executemany(insert, values)
                    c.commit()  # short transactions: no task holds the others up
                    rows += len(values)
        return Staged(attempt, rows)

    def commit(self, messages: list[Staged | None]) -> None:
        done = [m.attempt for m in messages if m is not None and m.rows]
        table, stage, names = _quoted(self.db.table), _quoted(self.stage), [f.name for f in self.schema.fields]
        columns, keys = ", ".join(map(_quoted, names)), ", ".join(map(_quoted, self.keys))
        order = (f"{_quoted(self.modified)} desc, " if self.modified else "") + "__attempt desc, __pos desc"
        rest = ", ".join(f"{_quoted(n)} = excluded.{_quoted(n)}" for n in names if n not in self.keys)
        newer = f" where {table}.{_quoted(self.modified)} is null or excluded.{_quoted(self.modified)} >= {table}.{_quoted(self.modified)}" if self.modified else ""
        with self.db.connect() as c:
            cursor = c.cursor()
            if self.epoch:
                cursor.execute(f"select 1 from {_quoted(self.db.table + '__epochs')} where epoch = {self.db.marks(1)}", (self.epoch,))
                if cursor.fetchone():
                    done, self.overwrite = [], False
                else:
                    cursor.execute(f"insert into {_quoted(self.db.table + '__epochs')} values ({self.db.marks(1)})", (self.epoch,))
            if self.overwrite:
                cursor.execute(f"delete from {table}")
            if done:
                cursor.execute("create temporary table __done (attempt text primary key)")
                cursor.executemany(f"insert into __done values ({self.db.marks(1)})", [(a,) for a in done])
                cursor.execute(f"""insert into {table} ({columns}) select {columns} from
                    (select *, row_number() over (partition by {keys} order by {order}) as __rank from {stage} where __attempt in (select attempt from __done)) as s
                    where __rank = 1 on conflict ({keys}) do {'update set ' + rest + newer if rest else 'nothing'}""")
            c.commit()
            cursor.execute(f"drop table if exists {stage}")
            c.commit()

    def abort(self, messages: list[Staged | None]) -> None:
        with self.db.connect() as c:
            c.execute(f"drop table if exists {_quoted(self.stage)}")
            c.commit()


@dataclass
class Part(InputPartition):
    where: str
    values: tuple


class _Reader(DataSourceReader):
    """Ranges of an integer column, one a task, read in Arrow batches; without such a column, one task reads the table."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.db, self.schema = _Database(options), schema
        self.split, self.parts = options.get("split"), int(options.get("parts", 8))

    def partitions(self) -> list[Part]:
        if not self.split:
            return [Part("1 = 1", ())]
        column = _quoted(self.split)
        with self.db.connect() as c:
            cursor = c.cursor()
            cursor.execute(f"select min({column}), max({column}) from {_quoted(self.db.table)}")
            low, high = cursor.fetchone()
        mark, step = self.db.marks(1), 0 if low is None else (high - low) // self.parts + 1
        starts = range(low, high + 1, step) if step else ()
        return [Part(f"{column} is null", ()), *(Part(f"{column} >= {mark} and {column} < {mark}", (s, s + step)) for s in starts)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        columns = ", ".join(_quoted(n) for n in self.schema.fieldNames())
        with self.db.connect() as c:
            cursor = c.cursor()
            cursor.execute(f"select {columns} from {_quoted(self.db.table)} where {partition.where}", partition.values)
            while rows := cursor.fetchmany(self.db.batch):
                yield pa.RecordBatch.from_arrays([self._array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

    @staticmethod
    def _array(values: tuple, kind: pa.DataType) -> pa.Array:
        as_text = pa.types.is_temporal(kind) or pa.types.is_decimal(kind)
        values = [bool(x) if pa.types.is_boolean(kind) and x is not None else str(x) if as_text and x is not None else x for x in values]
        return pa.array(values, pa.string()).cast(kind) if as_text else pa.array(values, kind)


class Relational(DataSource):
    @classmethod
    def name(cls) -> str:
        return "relational"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), schema, overwrite)

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Relational)


def upsert(df: DataFrame, database: str, table: str, keys: list[str], modified: str | None = None, epoch: str | None = None, mode: str = "append", **options: str) -> None:
    """Write rows over a table by key; repeated keys, also of one batch, keep the row modified last."""
    register(df.sparkSession)
    given = {"database": database, "table": table, "keys": ",".join(keys), "modified": modified, "epoch": epoch} | options
    df.write.format("relational").options(**{k: v for k, v in given.items() if v is not None}).mode(mode).save()


def read(spark: SparkSession, database: str, table: str, schema: str | StructType, split: str | None = None, **options: str) -> DataFrame:
    register(spark)
    given = {"database": database, "table": table, "split": split} | options
    return spark.read.format("relational").schema(schema).options(**{k: v for k, v in given.items() if v is not None}).load()
