"""Model responses as clean tables, token use, and the prompt packs that responses are asked with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .collect import top_by

# fixed values: kinds of insights and bounds of the cleaned lists
INSIGHT_KINDS = ("answer", "consensus", "disagreement", "risk", "opportunity", "coverage")
MOST = {"takeaways": 6, "insights": 6, "sections": 8, "warnings": 6, "evidence": 80, "dimensions": 8}


def response_text(content: str | Column = "content") -> Column:
    """Text of a response: plain, a list of parts, or an object with text."""
    c = t.c(content)
    parts = F.from_json(c, "array<string>")
    one = lambda p: F.coalesce(F.get_json_object(p, "$.text"), F.get_json_object(p, "$.content"), F.when(~F.ltrim(p).startswith("{"), p), F.lit(""))
    joined = F.array_join(F.transform(parts, one), "")
    return F.when(F.ltrim(c).startswith("[") & parts.isNotNull(), joined).when(F.ltrim(c).startswith("{") & F.get_json_object(c, "$.text").isNotNull(), F.get_json_object(c, "$.text")).otherwise(c)


def response_json(text: str | Column, array_key: str = "items") -> Column:
    """The JSON object in a text, from its first bracket to its last; bare lists become an object with array_key."""
    raw = F.regexp_extract(t.c(text), r"(?s)[\[{].*[\]}]", 0)
    good = F.when(F.try_parse_json(raw).isNotNull(), raw)
    return F.when(good.startswith("["), F.concat(F.lit(f'{{"{array_key}":'), good, F.lit("}"))).otherwise(good)


def json_ids(json_value: Column) -> Column:
    """Ids in a JSON value (a number, a text, an object or a list of them), in order; null for what is none."""
    listed = F.when(F.ltrim(json_value).startswith("["), F.from_json(json_value, "array<string>")).otherwise(F.array(json_value))
    one = lambda x: F.coalesce(F.get_json_object(x, "$.id"), F.get_json_object(x, "$.sourceId"), F.get_json_object(x, "$.source_id"), x).try_cast("bigint")
    return F.transform(listed, one)


def valid_ids(json_value: Column, allowed: Column, limit: int | None = None) -> Column:
    """Ids in a JSON value (a number, a text, an object or a list of them) that are allowed, each once, in order."""
    found = F.array_distinct(F.filter(json_ids(json_value), lambda x: F.coalesce(F.array_contains(allowed, x), F.lit(False))))
    out = F.coalesce(found, F.array().cast("array<bigint>"))
    return F.slice(out, 1, limit) if limit else out


def _items(df: DataFrame, path: str) -> DataFrame:
    """run_id, allowed, pos, item (JSON object) of a list in the payload."""
    rows = df.select("run_id", "allowed", F.posexplode(F.from_json(F.get_json_object("payload", path), "array<string>")).alias("pos", "item"))
    return rows.where(F.ltrim("item").startswith("{"))


def _text(*paths: str, most: int | None = None) -> Column:
    x = t.strip(F.coalesce(*(F.get_json_object("item", p) for p in paths), F.lit("")))
    return F.substring(x, 1, most) if most else x


def _ids(*paths: str, limit: int | None = None) -> Column:
    return valid_ids(F.coalesce(*(F.get_json_object("item", p) for p in paths)), F.col("allowed"), limit)


def _first(df: DataFrame, name: str) -> DataFrame:
    return top_by(df, ["run_id"], [F.col("pos")], MOST[name]).drop("pos")


def takeaways(df: DataFrame) -> DataFrame:
    """run_id, text, citations, rank from responses (run_id, payload: JSON, allowed: array of ids)."""
    rows = _items(df, "$.takeaways").select("run_id", "pos", _text("$.text").alias("text"), _ids("$.citations", "$.sourceIds").alias("citations"))
    return _first(rows.where("text != ''"), "takeaways")


def insights(df: DataFrame) -> DataFrame:
    kind = _text("$.kind")
    rows = _items(df, "$.insights").select(
        "run_id", "pos", F.when(kind.isin(*INSIGHT_KINDS), kind).otherwise("consensus").alias("kind"), _text("$.label").alias("label"), _text("$.summary", most=360).alias("summary"),
        t.clip(F.coalesce(F.get_json_object("item", "$.confidence"), F.lit("3")), 1, 5).alias("confidence"), _ids("$.sourceIds", "$.citations").alias("source_ids"),
    )
    return _first(rows.where("label != ''"), "insights")


def sections(df: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif(_text("$.kind", most=40), F.lit("")), F.lit("narrative"))
    rows = _items(df, "$.sections").select("run_id", "pos", _text("$.title").alias("title"), kind.alias("kind"), t.clip(F.coalesce(F.get_json_object("item", "$.level"), F.lit("1")), 1, 3).alias("level"), _text("$.body").alias("body"), _ids("$.sourceIds", "$.citations").alias("source_ids"), F.get_json_object("item", "$.table").alias("table"))
    return _first(rows.where("title != '' and body != ''"), "sections")


def warnings(df: DataFrame) -> DataFrame:
    rows = df.select("run_id", F.posexplode(F.from_json(F.get_json_object("payload", "$.warnings"), "array<string>")).alias("pos", "text"))
    return _first(rows.where(t.strip("text") != "").withColumn("text", F.substring("text", 1, 240)), "warnings")


def table_rows(df: DataFrame, path: str = "$.table") -> DataFrame:
    """Comparison rows; scores from 1 to 5, older field names too."""
    score = lambda *paths: t.clip(F.coalesce(*(F.get_json_object("item", p) for p in paths), F.lit("3")), 1, 5)
    rows = _items(df, path).select(
        "run_id", "pos", _text("$.name", most=120).alias("name"), _text("$.signal", most=260).alias("signal"), score("$.support", "$.lowLight").alias("support"), score("$.risk").alias("risk"),
        score("$.freshness", "$.battery").alias("freshness"), score("$.confidence", "$.camera").alias("confidence"), _text("$.price", most=80).alias("price"), _ids("$.evidence", "$.sourceIds").alias("evidence"),
    )
    return rows.where("name != ''")


def semantic_evidence(df: DataFrame, path: str = "$.evidence") -> DataFrame:
    """Evidence rows with a known source, a dimension and a conclusion; at most 80 of a run."""
    rows = _items(df, path).select(
        "run_id", "pos", _text("$.candidate", "$.model", "$.name", most=120).alias("candidate"), _text("$.dimension", "$.key", most=80).alias("dimension"), _text("$.conclusion", "$.summary", most=360).alias("conclusion"),
        _text("$.scenario", most=180).alias("scenario"), _text("$.value", "$.metric", most=120).alias("value"), _text("$.quote", "$.excerpt", most=280).alias("quote"),
        F.get(_ids("$.sourceId", "$.source_id", "$.sourceIds", limit=1), F.lit(0)).alias("source_id"), t.clip(F.coalesce(F.get_json_object("item", "$.confidence"), F.lit("3")), 1, 5).alias("confidence"),
    )
    return _first(rows.where("source_id is not null and dimension != '' and conclusion != ''"), "evidence")


def decision_products(df: DataFrame, path: str = "$.products") -> DataFrame:
    """run_id, product, dimension, conclusion, condition, value, source_ids: cells with known sources, at most 8 each."""
    products = F.from_json(F.get_json_object("payload", path), "map<string,string>")
    named = df.select("run_id", "allowed", F.explode(products).alias("product", "dims"))
    cells = named.select("run_id", "allowed", F.substring(t.strip("product"), 1, 120).alias("product"), F.explode(F.from_json("dims", "map<string,string>")).alias("dimension", "values"))
    listed = F.when(F.ltrim("values").startswith("["), F.from_json("values", "array<string>")).otherwise(F.array("values"))
    rows = cells.select("run_id", "allowed", "product", F.substring(t.strip("dimension"), 1, 80).alias("dimension"), F.posexplode(listed).alias("pos", "item"))
    out = rows.select("run_id", "product", "dimension", "pos", _text("$.conclusion", "$.summary", most=360).alias("conclusion"), _text("$.condition", "$.testCondition", "$.scenario", most=180).alias("condition"), _text("$.value", "$.metric", most=140).alias("value"), _ids("$.sourceIds", "$.sources", "$.sourceId").alias("source_ids"))
    good = out.where("product != '' and dimension != '' and conclusion != '' and size(source_ids) > 0")
    return top_by(good, ["run_id", "product", "dimension"], [F.col("pos")], 8).drop("pos")


def contradiction_notes(df: DataFrame, path: str = "$.contradictions") -> DataFrame:
    rows = df.select("run_id", F.explode(F.from_json(F.get_json_object("payload", path), "map<string,string>")).alias("dimension", "item")).where(F.ltrim("item").startswith("{"))
    flag = F.coalesce(F.get_json_object("item", "$.isContradictory"), F.get_json_object("item", "$.contradictory")) == "true"
    return rows.select("run_id", F.substring(t.strip("dimension"), 1, 80).alias("dimension"), F.coalesce(flag, F.lit(False)).alias("contradictory"), _text("$.contradictionDescription", "$.description", most=360).alias("description"), _text("$.possibleReason", "$.reason", most=360).alias("reason")).where("dimension != ''")


def selected_sources(df: DataFrame, sources: DataFrame, limit: int = 24) -> DataFrame:
    """sources (run_id, source_id) that a response selected, with their position in it.

    A response with a long list may come in parts (column part, in order). Only ids that sources have, and that are in
    allowed where df has that column, count. Ids meet both as rows: no run's list is searched for each of its ids.
    """
    value = F.coalesce(F.get_json_object("payload", "$.selectedSourceIds"), F.get_json_object("payload", "$.items"))
    parts = df.select("run_id", F.col("part") if "part" in df.columns else F.lit(0).alias("part"), F.posexplode(json_ids(value)).alias("pos", "source_id"))
    keys = ["run_id", "source_id"]
    at = parts.groupBy(*keys).agg(F.min(F.struct("part", "pos")).alias("at"))
    known = sources.select(*keys).distinct()
    if "allowed" in df.columns:
        known = known.join(df.select("run_id", F.explode("allowed").alias("source_id")), keys, "left_semi")
    chosen = top_by(at.join(known, keys, "left_semi"), ["run_id"], [F.col("at")], limit, "nth")
    return sources.join(chosen.select(*keys, (F.col("nth") - 1).alias("position")), keys)


def token_use(calls: DataFrame, max_calls: int = 10) -> DataFrame:
    """Calls, tokens and calls left of each run (run_id, tokens)."""
    agg = calls.groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.greatest(F.lit(0), F.coalesce("tokens", F.lit(0)))).alias("tokens"))
    return agg.withColumn("calls_left", F.greatest(F.lit(0), F.lit(max_calls) - F.col("calls")))


def compact_metrics(metrics: str | Column = "metrics", most: int = 6) -> Column:
    """The first metrics of a map that aren't empty, by name, their texts cut."""
    kept = F.filter(F.array_sort(F.map_entries(t.c(metrics))), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.map_from_entries(F.transform(F.slice(kept, 1, most), lambda e: F.struct(e["key"], F.substring(e["value"], 1, 120))))


def prompt_packs(sources: DataFrame, evidence: DataFrame | None = None, transcript_chars: int = 4000) -> DataFrame:
    """run_id, source_id, payload: each source as the JSON that a prompt holds, with chunks of its transcript and, if
    given, its evidence rows (run_id, source_id, ...)."""
    rows = sources
    parts = ["platform", F.substring("title", 1, 240).alias("title"), F.substring("creator", 1, 120).alias("creator"), t.excerpt(["summary"], 360).alias("summary"), F.substring(t.squeeze("transcript"), 1, transcript_chars).alias("fullTranscript"), t.chunks(t.squeeze("transcript")).alias("transcriptChunks")]
    if evidence is not None:
        cols = [c for c in evidence.columns if c not in ("run_id", "source_id")]
        grouped = top_by(evidence, ["run_id", "source_id"], [F.col(c) for c in cols[:1]], MOST["evidence"], "nth").groupBy("run_id", "source_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("semanticEvidence"))
        rows = rows.join(grouped, ["run_id", "source_id"], "left")
        parts.append("semanticEvidence")
    return rows.select("run_id", "source_id", F.to_json(F.struct(F.col("source_id").alias("id"), *parts)).alias("payload"))
