"""Reading crawls, noisy JSON, captions and page data; writing tables in the supported formats."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsons
from ..functions.text import strip
from ..operators.search import embedded
from ..operators.storage import written
from . import relational

# fixed values: names under which payloads keep their rows
ENVELOPES = ("items", "data", "results", "videos", "list")


def read_crawl(spark: SparkSession, root: str, platform: str, schema: str, kind: str = "contents", limit: int | None = None) -> DataFrame:
    """Rows of search_<kind>_*.jsonl (files, or folders that Spark wrote) of a platform; blank and corrupt lines are left out.

    limit takes the newest files first, and lines in their order: files are counted in growing steps, newest first, until the
    limit is met, so older ones aren't opened. A name sorts by its date.
    """
    places = f"{root}/{platform}/jsonl/search_{kind}_*.jsonl"

    def rows(paths: str | list[str]) -> DataFrame:
        found = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(paths)
        return found.where("_corrupt_record is null")

    if limit is None:
        return rows(places).drop("_corrupt_record")
    name = lambda path: re.findall(r"search_[^/]*\.jsonl", path)[-1]
    # Files' names only, as the planner of any read has them: sorted by name, newest first, parts of a folder in order.
    files = sorted(r.path for r in spark.read.format("binaryFile").load(places).select("path").collect())
    files.sort(key=name, reverse=True)
    chosen, have = [], 0
    while len(chosen) < len(files) and have < limit:
        step = files[len(chosen) : 2 * len(chosen) + 1]
        lines = spark.read.text(step).where("trim(value) != ''").select(F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("v"))
        have += lines.where("v._corrupt_record is null").limit(limit - have).count()
        chosen += step
    if not chosen or limit <= 0:
        return rows(places).drop("_corrupt_record").limit(0)
    # A split numbers its rows in their order; splits are in order by file and start.
    found = rows(chosen)
    columns = [c for c in found.columns if c != "_corrupt_record"]
    path = F.col("_metadata.file_path")
    at = F.struct(path, F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    keyed = found.select(*columns, F.regexp_extract(path, r"(search_[^/]*\.jsonl)", 1).alias("__file"), at.alias("__at"))
    return keyed.orderBy(F.desc("__file"), "__at").limit(limit).select(*columns)


def unwrap(df: DataFrame, column: str = "payload", depth: int = 3) -> DataFrame:
    """One row for each object in a JSON payload: a list, or a list under one of the usual names, nested at most
    depth times; the object is column item (JSON text)."""
    value = F.col(column)
    for _ in range(depth):
        inner = F.coalesce(*(F.get_json_object(value, f"$.{name}") for name in ENVELOPES))
        value = F.when(F.ltrim(value).startswith("["), value).otherwise(inner)
    items = F.from_json(value, "array<string>")
    return df.select("*", F.explode(F.filter(items, lambda x: F.ltrim(x).startswith("{"))).alias("item"))


def first_json(df: DataFrame, column: str = "text") -> DataFrame:
    """df with first_json: the first JSON object or list inside a text, null if there is none."""

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(jsons.first_json)

    return df.withColumn("first_json", found(column))


def json3_captions(df: DataFrame, column: str = "content") -> DataFrame:
    """df's rows with pos, text, start_ms, end_ms for each event of a json3 caption file that has text."""
    events = F.from_json(F.get_json_object(column, "$.events"), "array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>")
    rows = df.select("*", F.posexplode(events).alias("pos", "e")).drop(column)
    text = strip(F.regexp_replace(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), r"\s+", " "))
    out = rows.withColumn("text", text).where("text != ''")
    return out.withColumn("start_ms", F.col("e.tStartMs")).withColumn("end_ms", F.col("e.tStartMs") + F.coalesce("e.dDurationMs", F.lit(0))).drop("e")


def vtt_captions(df: DataFrame, column: str = "content") -> DataFrame:
    """df's rows with pos and text for each text line of a VTT file: no header, timings, cue numbers or blank lines."""
    rows = df.select("*", F.posexplode(F.split(column, r"\r?\n")).alias("pos", "line")).drop(column)
    text = strip(F.regexp_replace("line", "<[^>]+>", ""))
    keep = ~F.col("line").startswith("WEBVTT") & ~F.contains(F.col("line"), F.lit("-->")) & ~F.col("line").rlike(r"^\s*\d+\s*$") & (text != "")
    return rows.where(keep).withColumn("text", text).drop("line")


def pick_track(tracks: DataFrame, languages: list[str]) -> DataFrame:
    """The best caption track of each source (source_id, lang, ext): first language in order, json3 before vtt."""
    rank = F.coalesce(*(F.when(F.col("lang") == x, F.lit(i)) for i, x in enumerate(languages)), F.lit(len(languages))) * 10 + F.when(F.col("ext") == "json3", 0).when(F.col("ext") == "vtt", 1).otherwise(2)
    row = F.struct(*tracks.columns)
    return tracks.groupBy("source_id").agg(F.min_by(row, F.struct(rank, "lang", "ext")).alias("t")).select("t.*")


def page_state(pages: DataFrame, marker: str, column: str = "html") -> DataFrame:
    """pages with state: the JSON that a page assigns after marker inside a script; bare undefined becomes null."""
    return pages.withColumn("state", embedded(column, marker + r"\s*=\s*(\{.*?\})\s*;?\s*</script>", "null"))


def page_script(pages: DataFrame, script_id: str, column: str = "html") -> DataFrame:
    """pages with state: the JSON text of the script with an id."""
    return pages.withColumn("state", F.nullif(F.regexp_extract(column, rf'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1), F.lit("")))


def save_array(df: DataFrame, path: str, order: list[str], tasks: int | None = None) -> None:
    """Write a table as one JSON array in pieces: the files of path, concatenated by name, are the array, in order's order.

    Rows are sorted into ranges, one file each; the array's first and last row, found by one aggregation, carry its
    brackets, the others a comma, so no task holds more than its range. Rows equal in order are in any order; null fields
    are left out; an empty table is [].
    """
    n = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Numbers make the order total; they are written, as another run of the same plan might give others.
    rows = written(df.select(F.to_json(F.struct(*df.columns)).alias("value"), F.struct(*order).alias("at"), F.monotonically_increasing_id().alias("id")))
    at = F.struct("at", "id")
    first, last = rows.agg(F.min_by("id", at), F.max_by("id", at)).first()
    if first is None:
        return df.sparkSession.createDataFrame([("[]",)], "value string").write.text(path)
    line = F.concat(F.when(F.col("id") == first, "[").otherwise(","), "value", F.when(F.col("id") == last, "]").otherwise(""))
    rows.repartitionByRange(n, "at", "id").sortWithinPartitions("at", "id").select(line.alias("value")).write.text(path)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array that save_array() wrote, each line on its own."""
    inner = F.regexp_replace("value", r"^[\[,]|\]$", "")
    lines = spark.read.text(path).where("value != '[]'")
    return lines.select(F.from_json(inner, schema).alias("v")).select("v.*")


def save(df: DataFrame, path: str, kind: str = "jsonl", mode: str = "append", partition_by: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> None:
    """Write a table as jsonl, json, csv (with header), parquet, orc or text; as one JSON array in pieces, by kind 'array';
    over the table path of a database, by kind 'jdbc:...', or by key with 'sqlite:<file>'. Arrays are in keys' order."""
    if kind == "array":
        return save_array(df, path, list(keys))
    if kind.startswith("sqlite:"):
        return relational.upsert(df, kind.removeprefix("sqlite:"), path, list(keys), mode=mode)
    formats = {"jsonl": "json", "json": "json", "csv": "csv", "parquet": "parquet", "orc": "orc", "text": "text"}
    if kind.startswith("jdbc:"):
        df.write.format("jdbc").option("url", kind).option("dbtable", path).mode(mode).save()
        return
    if kind not in formats:
        raise ValueError(f"unknown format {kind}")
    writer = df.write.mode(mode).format(formats[kind])
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def find(df: DataFrame, equal: dict[str, object], limit: int | None = None) -> DataFrame:
    """Rows with the given values."""
    for name, value in equal.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df.limit(limit) if limit else df
