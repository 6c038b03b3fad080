"""Drafts of reports: labels, sentences, stages, warnings, claims, layouts and Markdown, as rows of many runs at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as k
from ..functions import text as t
from .collect import blank, first_by, top_by

# fixed values: the platforms' names, roles and abilities
PLATFORM_NAMES = {"bilibili": "Bilibili", "douyin": "Douyin", "youtube": "YouTube", "xiaohongshu": "Xiaohongshu", "zhihu": "Zhihu", "kuaishou": "Kuaishou", "weibo": "Weibo"}
PLATFORM_ROLES = {
    "bilibili": "Long-form testing, creator methodology, detailed comments.",
    "douyin": "Short-form sentiment, fresh reactions, high-volume comment signals.",
    "youtube": "Global reviews, comparison videos, long-term experience.",
    "xiaohongshu": "Lifestyle notes, product experience, image/video posts and comment sentiment.",
    "zhihu": "Long-form answers, zvideo, expert discussions and threaded comments.",
    "kuaishou": "Short-video product experience, regional sentiment and creator feedback.",
    "weibo": "Public conversation, trend diffusion, brand incidents and comment signals.",
}
TRANSCRIPT_PLATFORMS = ("bilibili", "youtube")
CRAWLED = ("bilibili", "douyin", "xiaohongshu", "zhihu", "kuaishou", "weibo")

# fixed values: labels of report kinds and of run stages, in English and Chinese
KIND_LABELS = {
    "consumer": ("consumer buying advice", "消费购物咨询"),
    "business": ("B2B product/category research", "B端产品/品类研究"),
    "comparison": ("comparison", "对比分析"),
    "decision": ("decision support", "决策辅助"),
    "landscape": ("landscape scan", "趋势/格局扫描"),
    "explainer": ("explainer", "解释型研究"),
    "general": ("general research", "通用研究"),
}
STAGE_LABELS = {"plan": ("Plan query", "规划问题"), "search": ("Search sources", "搜索来源"), "evidence": ("Structure evidence", "整理证据"), "synthesis": ("Synthesize report", "生成报告")}
UNTITLED = ("Untitled research", "未命名研究")

# fixed values: warnings of the gates
WARN_BLOCKED = "Coverage gate blocked LLM synthesis after the bounded acquisition retry; conclusions use deterministic evidence-limited reporting."
WARN_COUNTER = "No explicit counterevidence source was found before synthesis."
WARN_CLAIMS = "Claim grounding review: %d insufficient and %d contradictory claim results."

MOST_CLAIMS, TITLE_CHARACTERS, SENTENCE_CHARACTERS = 12, 48, 72


def _lang(pair: tuple[str, str], zh: bool) -> Column:
    return F.lit(pair[1] if zh else pair[0])


def _case(x: Column, values: dict, default: Column) -> Column:
    return reduce(lambda out, item: F.when(x == item[0], item[1]).otherwise(out), reversed(list(values.items())), default)


# ---- dimensions and labels -------------------------------------------------------------------------------------------


def platform_dimension(spark: SparkSession) -> DataFrame:
    """platform, name, role, transcripts (can give them), crawled, position: a row for each platform, in report order."""
    rows = [(p, PLATFORM_NAMES[p], PLATFORM_ROLES[p], p in TRANSCRIPT_PLATFORMS, p in CRAWLED, i) for i, p in enumerate(k.PLATFORMS)]
    return spark.createDataFrame(rows, "platform string, name string, role string, transcripts boolean, crawled boolean, position int")


def platform_name(x: str | Column) -> Column:
    return _case(t.c(x), {p: F.lit(n) for p, n in PLATFORM_NAMES.items()}, t.c(x))


def kind_label(kind: str | Column, zh: bool = False) -> Column:
    """Label of a report kind; unknown kinds are general."""
    return _case(t.c(kind), {name: _lang(pair, zh) for name, pair in KIND_LABELS.items()}, _lang(KIND_LABELS["general"], zh))


def draft_title(query: str | Column, zh: bool = False) -> Column:
    """A question as a title of 48 characters at most."""
    clean = t.strip(F.coalesce(t.c(query), F.lit("")))
    return F.when(clean == "", _lang(UNTITLED, zh)).when(F.length(clean) > TITLE_CHARACTERS, F.concat(F.substring(clean, 1, TITLE_CHARACTERS), F.lit("..."))).otherwise(clean)


def decision_text(preview: Column, comments: Column) -> Column:
    """What decisions are mined from: title, summary, preview, 6,000 characters of the transcript, eight comments; parts
    that are missing leave their blank."""
    parts = F.array(F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce(preview, F.lit("")), F.substring(F.coalesce("transcript", F.lit("")), 1, 6000))
    return F.array_join(F.concat(parts, F.slice(F.coalesce(comments, F.array().cast("array<string>")), 1, 8)), " ")


# ---- sentences -------------------------------------------------------------------------------------------------------


def source_signal(zh: bool = False) -> Column:
    """One line on a source: platform, creator, 110 characters of summary, evidence score and channels."""
    told = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("summary", "transcript", "title")), F.lit(""))
    by = F.coalesce(F.nullif("creator", F.lit("")), F.lit("creator"))
    channels = F.coalesce(F.nullif(F.array_join("channels", "、"), F.lit("")), F.lit("标题" if zh else "title"))
    parts = (F.col("platform"), F.lit(" / "), by, F.lit("：" if zh else ": "), F.substring(told, 1, 110), F.lit("；证据分 " if zh else "; evidence score "), F.col("evidence_score").cast("string"), F.lit("，渠道：" if zh else ", channels: "), channels, F.lit("。" if zh else "."))
    return F.concat(*parts)


# fixed values: the sentences of the four functions below, as reports have them


def platform_sentence(sources: DataFrame) -> DataFrame:
    """run_id, sentence: a run's platforms with their numbers of sources, most first; ties in report order."""
    n = sources.groupBy("run_id", "platform").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(t.words(k.PLATFORMS), F.col("platform"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), place.alias("place"), F.concat(platform_name("platform"), F.lit(" "), F.col("n").cast("string")).alias("text")))), lambda x: x["text"])
    return n.groupBy("run_id").agg(F.concat(F.lit("Platform coverage: "), F.array_join(listed, ", "), F.lit(". ")).alias("sentence"))


def evidence_sentence(sources: DataFrame) -> DataFrame:
    """run_id, sentence: how many sources have comments and how many have transcripts."""
    agg = sources.groupBy("run_id").agg(F.count_if(F.col("n_comments") > 0).alias("c"), F.count_if(~blank("transcript")).alias("s"))
    return agg.select("run_id", F.concat(F.col("c").cast("string"), F.lit(" source(s) include sampled comments and "), F.col("s").cast("string"), F.lit(" include transcript/text snippets. ")).alias("sentence"))


def risk_sentence(runs: DataFrame, risks: DataFrame) -> DataFrame:
    """run_id, sentence: a run's first five risk words (run_id, term, rank), else what to look at instead."""
    words = risks.where("rank <= 5").groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("words"))
    return runs.select("run_id").distinct().join(words, "run_id", "left").select("run_id", F.coalesce("words", F.lit("comment counterexamples, publish date and sample context")).alias("sentence"))


def log_sentence(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """run_id, sentence: provider runs that went well and that failed."""
    agg = logs.groupBy("run_id").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))
    told = F.concat(F.col("good").cast("string"), F.lit(" retrieval run(s) succeeded, "), F.col("bad").cast("string"), F.lit(" failed."))
    return runs.select("run_id").distinct().join(agg, "run_id", "left").select("run_id", F.coalesce(told, F.lit("No live retrieval logs were produced.")).alias("sentence"))


def sentence_chunks(x: str | Column, most: int = SENTENCE_CHARACTERS) -> Column:
    """Pieces of a text that end at sentences and have `most` characters at most, or one longer sentence: one fold over
    the sentences. Nothing is lost: the pieces in a row are the text."""
    text = F.coalesce(t.c(x), F.lit(""))
    parts = F.filter(F.split(text, r"(?<=[。！？.!?;；])"), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    full = lambda acc, s: (F.length(acc["open"]) + F.length(s) > most) & (acc["open"] != "")
    step = lambda acc, s: F.when(full(acc, s), F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), s.alias("open"))).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], s).alias("open")))
    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


# ---- decision texts --------------------------------------------------------------------------------------------------
# fixed values: hints, conclusions and the need's summary in both languages, as reports have them


def scenario_terms(x: str | Column, most: int = 3) -> Column:
    """The first scenario words that a text holds, in their fixed order."""
    low = F.lower(F.coalesce(t.c(x), F.lit("")))
    return F.slice(F.filter(t.words(k.SCENARIO_WORDS), lambda w: F.contains(low, F.lower(w))), 1, most)


def condition_text(x: str | Column, zh: bool = False) -> Column:
    """Scenario words as text; a hint to look them up where there are none."""
    return F.coalesce(F.nullif(F.array_join(scenario_terms(x), "、" if zh else ", "), F.lit("")), F.lit("需打开来源复核场景" if zh else "Verify scenario in source"))


def budget_hint(x: str | Column, zh: bool = False) -> Column:
    """The first number of three to six digits in a text as a budget."""
    found = F.regexp_extract(F.coalesce(t.c(x), F.lit("")), r"(\d{3,6})", 1)
    return F.when(found == "", F.lit("预算未明确" if zh else "budget not explicit")).otherwise(F.concat(F.lit("预算约 " if zh else "budget around "), found))


def dimension_key(x: str | Column) -> Column:
    """A key of letters, digits, underscores and hyphens; for names with CJK characters a sum over places and code points."""
    value = F.coalesce(t.c(x), F.lit(""))
    codes = F.transform(F.filter(F.split(value, ""), lambda s: s != ""), lambda s, i: (i + 1) * F.ascii(s))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda a, b: a + b) % 100_000
    plain = F.substring(F.regexp_replace(F.regexp_replace(F.lower(value), r"[^a-zA-Z0-9_-]+", "-"), "^-+|-+$", ""), 1, 48)
    return F.when(value.rlike(f"[{t.CJK}]"), F.concat(F.lit("dim-"), total.cast("string"))).when(plain == "", F.lit("dimension")).otherwise(plain)


def cell_conclusion(candidate: Column, dimension: Column, snippet: Column, zh: bool = False) -> Column:
    """What a matrix cell says: the evidence found for a candidate's dimension, or that it is thin."""
    cut = F.substring(snippet, 1, 120 if zh else 140)
    if zh:
        return F.when(F.coalesce(snippet, F.lit("")) != "", F.concat(candidate, F.lit(" 在「"), dimension, F.lit("」上的证据："), cut)).otherwise(F.concat(candidate, F.lit(" 的「"), dimension, F.lit("」直接证据不足，先按弱证据处理。")))
    return F.when(F.coalesce(snippet, F.lit("")) != "", F.concat(candidate, F.lit(" evidence on '"), dimension, F.lit("': "), cut)).otherwise(F.concat(F.lit("Direct evidence for "), candidate, F.lit(" on '"), dimension, F.lit("' is thin; treat as weak evidence.")))


def need_summary(need: Column, dimensions: Column, confidence: Column) -> Column:
    """A buyer's need as the report repeats it; dimensions: array, of which five are named."""
    named = F.coalesce(F.nullif(F.array_join(F.slice(dimensions, 1, 5), ", "), F.lit("")), F.lit("repeated product attributes from sources"))
    return F.concat(
        F.lit("I understand your need as: "), budget_hint(need), F.lit(", making a purchase decision for '"), need, F.lit("'. The dimensions to confirm are "), named,
        F.lit(". Please verify budget, use case and unacceptable trade-offs. Current confidence: "), confidence, F.lit("."),
    )


def matrix_cells(sources: DataFrame, mentions: DataFrame, chosen: DataFrame, matrix: DataFrame, most: int = 4) -> DataFrame:
    """run_id, key, term, conclusion, condition, source_ids of each cell of a matrix (run_id, key, term): its candidate's
    sources that hold the dimension, its first source where none does; at most `most` of them by id."""
    own = mentions.join(chosen.select("run_id", "key", F.col("name").alias("candidate")), ["run_id", "key"]).select("run_id", "key", "candidate", "source_id").distinct()
    texts = own.join(sources.select("run_id", "source_id", "text"), ["run_id", "source_id"])
    holds = F.contains(F.lower("text"), F.col("term"))
    rows = matrix.select("run_id", "key", "term").join(texts, ["run_id", "key"]).withColumn("holds", holds)
    cut = top_by(rows, ["run_id", "key", "term"], [F.col("holds").desc(), F.col("source_id")], most, "nth").where(F.col("holds") | (F.col("nth") == 1))
    cut = cut.withColumn("snippet", F.when(F.col("holds"), t.snippet("text", F.col("term"))))
    agg = cut.groupBy("run_id", "key", "term").agg(
        F.max("candidate").alias("candidate"), F.min_by("snippet", "nth").alias("snippet"), F.sort_array(F.collect_list("source_id")).alias("source_ids"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", F.substring("text", 1, 800).alias("text")))), lambda x: x["text"]), " ").alias("all"),
    )
    return agg.select("run_id", "key", "term", cell_conclusion(F.col("candidate"), F.col("term"), F.col("snippet")).alias("conclusion"), condition_text("all").alias("condition"), "source_ids")


def compared_ids(cells: DataFrame) -> DataFrame:
    """run_id, source_ids: all sources that cells name, each once, in order."""
    return cells.groupBy("run_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_ids")))).alias("source_ids"))


# ---- claims, stages, warnings, counts --------------------------------------------------------------------------------


def claims_from_report(takeaways: DataFrame, insights: DataFrame, units: DataFrame, most: int = MOST_CLAIMS) -> tuple[DataFrame, DataFrame]:
    """Claims of reports, and their links to evidence units.

    takeaways: run_id, pos, text, citations; insights: run_id, pos, kind, summary, source_ids; units: run_id, source_id,
    unit_id, pos. Takeaways come first; white space is squeezed; of equal texts the first stays, twelve of a run. A cited
    source stands for its last unit. claims: run_id, claim_no, claim_text, claim_type, source_ids, unit_ids; links:
    run_id, claim_no, unit_id, relation ('insufficient' until verified).
    """
    first = takeaways.select("run_id", F.lit(0).alias("part"), "pos", F.col("text").alias("claim_text"), F.lit("takeaway").alias("claim_type"), F.col("citations").alias("cited"))
    second = insights.select("run_id", F.lit(1).alias("part"), "pos", F.col("summary").alias("claim_text"), F.concat(F.lit("insight:"), "kind").alias("claim_type"), F.col("source_ids").alias("cited"))
    rows = first.unionByName(second).withColumn("claim_text", t.strip(t.squeeze("claim_text"))).where("claim_text != ''")
    order = [F.col("part"), F.col("pos")]
    kept = top_by(first_by(rows, ["run_id", "claim_text"], order), ["run_id"], order, most, "claim_no")
    unit = units.groupBy("run_id", "source_id").agg(F.max_by("unit_id", "pos").alias("unit_id"))
    cited = kept.select("run_id", "claim_no", F.posexplode("cited").alias("at", "source_id")).join(unit, ["run_id", "source_id"])
    listed = F.sort_array(F.collect_list(F.struct("at", "source_id", "unit_id")))
    linked = cited.groupBy("run_id", "claim_no").agg(F.transform(listed, lambda x: x["source_id"]).alias("source_ids"), F.transform(listed, lambda x: x["unit_id"]).alias("unit_ids"))
    none = lambda c: F.coalesce(c, F.array().cast(linked.schema[c].dataType)).alias(c)
    claims = kept.join(linked, ["run_id", "claim_no"], "left").select("run_id", "claim_no", "claim_text", "claim_type", none("source_ids"), none("unit_ids"))
    return claims, cited.select("run_id", "claim_no", "unit_id", F.lit("insufficient").alias("relation"))


def stage_rows(runs: DataFrame) -> DataFrame:
    """run_id, stage, label, status, progress, message: four stages of each run (run_id, status, sources)."""
    done = F.col("status").isin("completed", "partial")
    status = F.when(done, "completed").otherwise(F.col("status"))
    some = F.col("sources") > 0
    values = {
        "plan": (F.lit("completed"), F.lit(100), F.lit("")),
        "search": (status, F.when(some, 100).otherwise(45), F.concat(F.col("sources").cast("string"), F.lit(" sources"))),
        "evidence": (status, F.when(some, 100).otherwise(30), F.lit("")),
        "synthesis": (status, F.when(done, 100).otherwise(30), F.lit("")),
    }
    rows = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(STAGE_LABELS[s][0]).alias("label"), x.alias("status"), p.alias("progress"), m.alias("message")) for s, (x, p, m) in values.items()))
    return runs.select("run_id", F.explode(rows).alias("s")).select("run_id", "s.*")


def source_groups(platforms: DataFrame, sources: DataFrame) -> DataFrame:
    """run_id, platform, n, cited, status from platform_summaries() and sources with citation_count."""
    cited = sources.where("citation_count > 0").groupBy("run_id", "platform").agg(F.count(F.lit(1)).alias("cited"))
    state = F.when(F.col("n") > 0, "completed").when(F.col("status") == "failed", "failed").otherwise("partial")
    return platforms.join(cited, ["run_id", "platform"], "left").select("run_id", "platform", "n", F.coalesce("cited", F.lit(0)).alias("cited"), state.alias("status"))


def manifest_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """run_id and the number of rows that each table has of it; 0 where it has none."""
    rows = [df.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)) for name, df in tables.items()]
    joined = reduce(DataFrame.unionByName, rows)
    return joined.groupBy("run_id").agg(*(F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).alias(name) for name in tables))


def gate_warnings(gate: DataFrame, relations: DataFrame) -> DataFrame:
    """run_id, warnings: what the gates tell the reader, from block_synthesis() and relation_counts()."""
    rows = gate.join(relations, "run_id", "left").fillna(0, ["insufficient", "contradict"])
    poor = (F.col("insufficient") > 0) | (F.col("contradict") > 0)
    texts = F.array(F.when(F.col("blocked"), WARN_BLOCKED), F.when(~F.col("counter_found"), WARN_COUNTER), F.when(poor, F.format_string(WARN_CLAIMS, "insufficient", "contradict")))
    return rows.select("run_id", F.array_compact(texts).alias("warnings"))


def gate_traces(gate: DataFrame, relations: DataFrame) -> DataFrame:
    """run_id, step, status, message: how the coverage gate and the claim verifier ended."""
    cover = gate.select("run_id", F.lit("coverage_gate").alias("step"), F.when(F.col("blocked"), "partial").otherwise("ok").alias("status"), F.when(F.col("blocked"), "LLM synthesis blocked by severe coverage gaps; deterministic reporting remains available.").otherwise("Coverage gate allows report synthesis.").alias("message"))
    n = F.col("support") + F.col("contradict") + F.col("insufficient")
    poor = (F.col("insufficient") > 0) | (F.col("contradict") > 0)
    judged = relations.select("run_id", F.lit("claim_verifier").alias("step"), F.when(poor, "partial").otherwise("ok").alias("status"), F.format_string("Verified %d final report claims with relation-level grounding results.", n).alias("message"))
    return cover.unionByName(judged)


def failed_platforms(warnings: DataFrame, counts: DataFrame) -> DataFrame:
    """run_id, platform, message: platforms without sources that a warning (run_id, pos, text) names, with the last one."""
    named = warnings.select("run_id", "pos", "text", F.explode(t.words(k.PLATFORMS)).alias("platform")).where(F.contains(F.lower("text"), F.col("platform")))
    some = counts.where("n > 0").select("run_id", "platform")
    return named.join(some, ["run_id", "platform"], "left_anti").groupBy("run_id", "platform").agg(F.max_by("text", "pos").alias("message"))


# ---- layouts ---------------------------------------------------------------------------------------------------------

# fixed values: the sections of each layout, in order
LAYOUTS = {
    "business": ("executive_summary", "market_signals", "competitors", "opportunities", "risks"),
    "consumer": ("answer", "top_picks", "good_to_know", "avoid", "next_steps"),
    "decision": ("need", "candidates", "comparison", "recommendation", "contradictions"),
}


def layout_blocks(parts: dict[str, DataFrame], layout: str) -> DataFrame:
    """Blocks of a layout from rows (run_id, pos, text, citations) for its sections; the first section's are bodies, the
    others' bullets. Sections without rows are left out."""
    rows = [parts[s].select("run_id", F.lit(s).alias("section_id"), F.lit("body" if i == 0 else "bullet").alias("block_type"), F.lit(i).alias("section_no"), "pos", "text", "citations") for i, s in enumerate(LAYOUTS[layout]) if s in parts]
    return reduce(DataFrame.unionByName, rows)


def business_blocks(summary: DataFrame, signals: DataFrame, platforms: DataFrame, chances: DataFrame, risks: DataFrame) -> DataFrame:
    """The business layout: sentences, signal rows by support, platforms by sources, positive signals, risk words."""
    told = signals.select("run_id", F.col("nth").alias("pos"), F.concat("term", F.lit(": support "), F.col("support").cast("string"), F.lit("/5, risk "), F.col("risk").cast("string"), F.lit("/5")).alias("text"), F.col("evidence").alias("citations"))
    none = F.array().cast("array<bigint>")
    shown = platforms.select("run_id", F.col("nth").alias("pos"), F.concat(platform_name("platform"), F.lit(": "), F.col("n").cast("string"), F.lit(" sources")).alias("text"), none.alias("citations"))
    open_ = chances.select("run_id", F.col("nth").alias("pos"), F.concat(F.lit("Look into '"), "term", F.lit("'")).alias("text"), F.col("evidence").alias("citations"))
    bad = risks.select("run_id", F.col("rank").alias("pos"), F.concat(F.lit("Check '"), "term", F.lit("'")).alias("text"), "citations")
    return layout_blocks({"executive_summary": summary, "market_signals": told, "competitors": shown, "opportunities": open_, "risks": bad}, "business")


def consumer_blocks(summary: DataFrame, top: DataFrame, risks: DataFrame) -> DataFrame:
    """The consumer layout: an answer, the first sources, what they are known for, risk words, sources to open next."""
    pick = top.where("rank <= 3").select("run_id", F.col("rank").alias("pos"), F.concat(F.col("rank").cast("string"), F.lit(". "), "title").alias("text"), F.array("source_id").alias("citations"))
    known = top.where("rank <= 3").select("run_id", F.col("rank").alias("pos"), "signal", "source_id").select("run_id", "pos", F.col("signal").alias("text"), F.array("source_id").alias("citations"))
    bad = risks.select("run_id", F.col("rank").alias("pos"), F.concat(F.lit("Avoid or check '"), "term", F.lit("'")).alias("text"), "citations")
    after = top.where("rank between 4 and 6").select("run_id", F.col("rank").alias("pos"), F.concat(F.lit("Open "), "url").alias("text"), F.array("source_id").alias("citations"))
    return layout_blocks({"answer": summary, "top_picks": pick, "good_to_know": known, "avoid": bad, "next_steps": after}, "consumer")


def decision_blocks(need: DataFrame, chosen: DataFrame, cells: DataFrame, picks: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The decision layout: the need, the candidates, cells of the matrix, the recommendation, contradictory dimensions."""
    none = F.array().cast("array<bigint>")
    first = need.select("run_id", F.lit(0).alias("pos"), "text", none.alias("citations"))
    named = chosen.select("run_id", F.col("rank").alias("pos"), F.concat("name", F.lit(" ("), F.col("n_sources").cast("string"), F.lit(" sources)")).alias("text"), none.alias("citations"))
    cell = top_by(cells, ["run_id"], [F.col("key"), F.col("term")], 1_000, "pos").select("run_id", "pos", F.col("conclusion").alias("text"), F.col("source_ids").alias("citations"))
    pick = picks.where("pick != ''").select("run_id", F.col("place").alias("pos"), F.concat("pick", F.lit(": "), "key").alias("text"), none.alias("citations"))
    split = top_by(conflicts.where("contradictory"), ["run_id"], [F.col("term")], 1_000, "pos").select("run_id", "pos", F.concat(F.lit("Sources disagree on '"), "term", F.lit("'")).alias("text"), none.alias("citations"))
    return layout_blocks({"need": first, "candidates": named, "comparison": cell, "recommendation": pick, "contradictions": split}, "decision")


# ---- command-line report, records ------------------------------------------------------------------------------------


def conclusion_lines(items: DataFrame, n: int = 8, stop_words: tuple[str, ...] = k.STOP_WORDS) -> DataFrame:
    """run_id, items, platforms ('name n' by number), terms (the n most frequent title words)."""
    from .report import keywords

    total = items.groupBy("run_id").agg(F.count(F.lit(1)).alias("items"))
    counts = items.groupBy("run_id", "platform").agg(F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "platform", "n"))), lambda x: F.concat(x["platform"], F.lit(" "), x["n"].cast("string")))
    spread = counts.groupBy("run_id").agg(F.array_join(listed, ", ").alias("platforms"))
    top = keywords(items.select("run_id", F.col("title").alias("text")), n, stop_words)
    terms = top.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ", ").alias("terms"))
    return total.join(spread, "run_id").join(terms, "run_id", "left").select("run_id", "items", "platforms", F.coalesce("terms", F.lit("")).alias("terms"))


def _cell(x: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")


def markdown_report(runs: DataFrame, items: DataFrame, platforms: DataFrame, logs: DataFrame, most: int = 50) -> DataFrame:
    """run_id, markdown: title (runs: run_id, title), a table of its first items (display_id, platform, title, url), notes
    of its platforms (platform, n, status, note) and its provider runs by platform; bars escaped, line ends blanked."""

    def lines(df: DataFrame, order: list[str], text: Column, name: str) -> DataFrame:
        cut = top_by(df, ["run_id"], [F.col(c) for c in order], most, "nth").withColumn("line", text)
        return cut.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n").alias(name))

    row = lambda *cs: F.concat(F.lit("| "), F.concat_ws(" | ", *(_cell(F.col(c)) for c in cs)), F.lit(" |"))
    table = lines(items, ["display_id"], row("display_id", "platform", "title", "url"), "table")
    notes = lines(platforms, ["platform"], F.concat(F.lit("- "), platform_name("platform"), F.lit(": "), F.col("n").cast("string"), F.lit(", "), F.col("status"), F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" ("), _cell(F.col("note")), F.lit(")"))).otherwise("")), "notes")
    by = logs.groupBy("run_id", "platform").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))
    log = lines(by, ["platform"], row("platform", "good", "bad"), "log")
    parts = runs.join(table, "run_id", "left").join(notes, "run_id", "left").join(log, "run_id", "left")
    head = lambda title, c, top="": F.concat(F.lit(f"\n\n## {title}\n\n{top}"), F.coalesce(c, F.lit("")))
    text = F.concat(F.lit("# "), _cell(F.col("title")), head("Resources", "table", "| # | Platform | Title | Address |\n|-|-|-|-|\n"), head("Platforms", "notes"), head("Run log", "log", "| Platform | Good | Failed |\n|-|-|-|\n"), F.lit("\n"))
    return parts.select("run_id", text.alias("markdown"))


def cover_first(sources: DataFrame, n: int = 4) -> DataFrame:
    """The first n sources of a run, those with a cover before the others, in order of source_id."""
    return top_by(sources, ["run_id"], [F.when(blank("cover"), 1).otherwise(0), F.col("source_id")], n)


def save_records(reports: DataFrame, path: str) -> None:
    """Write reports (run_id and any columns), one folder for each run; a run's earlier record is replaced."""
    reports.withColumn("__run", F.col("run_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__run").parquet(path)


def read_records(spark: SparkSession, path: str, run_id=None) -> DataFrame:
    """Records by run, only that run's folder read; without a run all that can be read, files that can't skipped."""
    df = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    return (df if run_id is None else df.where(F.col("__run") == run_id)).drop("__run")
