"""Report tables: keywords, risks, signals, platform summaries, citations, quality, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import automaton
from ..functions import constants as k
from ..functions import segment
from ..functions import text as t
from .collect import blank, top_by


def keywords(texts: DataFrame, n: int = 12, stop_words: tuple[str, ...] = k.STOP_WORDS, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """by, word, n: the n most frequent tokens of column text in each run, of two or more characters; ties by word."""
    words = texts.select(*by, F.explode(t.tokens("text")).alias("word")).select(*by, F.lower("word").alias("word"))
    kept = words.where((F.length("word") > 1) & ~F.col("word").isin(*stop_words)).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))
    return top_by(kept, list(by), [F.col("n").desc(), F.col("word")], n)


def word_frequency(texts: DataFrame, n: int = 20, stop_words: tuple[str, ...] = k.STOP_WORDS, pattern: str | None = None, tokenizer=None, lexicon: DataFrame | None = None, custom: dict | None = None) -> DataFrame:
    """word, n: the n most frequent words of column text; tokenizer may be a pandas UDF that returns arrays.

    With a lexicon (word, freq), runs of Chinese characters are cut into its words, custom ones (word: frequency, or None
    to keep the word whole) included, and characters alone are words too.
    """
    if lexicon is not None:
        latin = texts.select(F.explode(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z0-9][A-Za-z0-9+\-_.]*"), F.lit(0)), F.lower)).alias("word")).where(F.length("word") > 1)
        cut = segment.segmented(segment.runs(texts), lexicon, custom).select(F.explode("words").alias("word"), "n")
        counts = latin.groupBy("word").agg(F.count(F.lit(1)).alias("n")).unionByName(cut).where(~F.col("word").isin(*stop_words))
        return counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(n)
    found = tokenizer("text") if tokenizer else F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(pattern), F.lit(0)) if pattern else F.transform(t.tokens("text"), F.lower)
    words = texts.select(F.explode(found).alias("word")).where((F.length("word") > 1) & ~F.col("word").isin(*stop_words))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(n)


def risk_terms(texts: DataFrame, terms: tuple[str, ...] = k.RISK_WORDS, n: int = 8) -> DataFrame:
    """run_id, term, n: how often each risk word occurs in column text of a run's sources; the n most frequent."""
    counts = texts.groupBy("run_id").agg(*(F.sum(t.occurrences(F.lower("text"), w.lower())).alias(f"c{i}") for i, w in enumerate(terms)))
    pairs = F.explode(F.array(*(F.struct(F.lit(w).alias("term"), F.col(f"c{i}").cast("long").alias("n")) for i, w in enumerate(terms))))
    rows = counts.select("run_id", pairs.alias("p")).select("run_id", "p.*").where("n > 0")
    return top_by(rows, ["run_id"], [F.col("n").desc(), F.col("term")], n)


def channel_counts(sources: DataFrame) -> DataFrame:
    """run_id, channel, n over column channels."""
    return sources.select("run_id", F.explode("channels").alias("channel")).groupBy("run_id", "channel").agg(F.count(F.lit(1)).alias("n"))


def platform_summaries(sources: DataFrame, logs: DataFrame, runs: DataFrame) -> DataFrame:
    """A row for each run of runs and each platform: n, status (ok, failed, partial) and the logs' notes up to 180."""
    catalog = runs.select("run_id").distinct().select("run_id", F.explode(t.words(k.PLATFORMS)).alias("platform"))
    n = sources.groupBy("run_id", "platform").agg(F.count(F.lit(1)).alias("n"))
    noted = F.filter(F.sort_array(F.collect_list(F.struct("seq", "note"))), lambda x: F.coalesce(x["note"], F.lit("")) != "")
    seen = top_by(logs, ["run_id", "platform"], [F.col("seq")], 60, "nth")  # 180 characters hold no more notes
    notes = seen.groupBy("run_id", "platform").agg(F.substring(F.array_join(F.transform(noted, lambda x: x["note"]), "; "), 1, 180).alias("note"))
    failed = logs.groupBy("run_id", "platform").agg(F.every(~F.col("ok")).alias("all_failed"))
    rows = catalog.join(n, ["run_id", "platform"], "left").join(failed, ["run_id", "platform"], "left").join(notes, ["run_id", "platform"], "left")
    status = F.when(F.coalesce("n", F.lit(0)) > 0, "ok").when(F.coalesce("all_failed", F.lit(False)), "failed").otherwise("partial")
    return rows.select("run_id", "platform", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"), F.coalesce("note", F.lit("")).alias("note"))


def run_warnings(coverage: DataFrame) -> DataFrame:
    """run_id, warnings, status from coverage_summary() with provider runs, for every run that it has."""
    rows = F.array_compact(
        F.array(
            F.when(F.col("sources") == 0, "no_sources"),
            F.when(F.col("runs_failed") > 0, "providers_failed"),
            F.when((F.col("sources") > 0) & (F.col("platforms") == 1), "one_platform"),
            F.when((F.col("sources") > 0) & (F.col("with_comments") == 0) & (F.col("with_transcripts") == 0), "metadata_only"),
        )
    )
    status = F.when(F.col("sources") == 0, "failed").when(F.size("warnings") > 0, "partial").otherwise("completed")
    return coverage.select("run_id", "sources", rows.alias("warnings")).select("run_id", "warnings", status.alias("status"))


def term_sources(sources: DataFrame, terms: DataFrame, text: Column) -> DataFrame:
    """run_id, term and the source's columns for each source of a run whose text holds one of the run's terms, in any case.

    Each text is scanned once, and only its hits meet the run's terms; empty terms are in no text.
    """
    rows = sources.withColumn("__text", F.lower(text))
    wanted = terms.select("run_id", "term", F.lower("term").alias("__hit")).distinct()
    found = automaton.with_counts(rows, automaton.term_blocks(wanted, "__hit"), ["__text"])
    hits = found.select(*sources.columns, F.explode("found.term").alias("__hit"))
    return hits.join(wanted, ["run_id", "__hit"]).drop("__hit")


def signal_rows(sources: DataFrame, terms: DataFrame, positive: tuple[str, ...] = k.POSITIVE_WORDS, risk: tuple[str, ...] = k.RISK_WORDS) -> DataFrame:
    """For each term (run_id, term) that sources mention: counts and 1-5 scores for support, risk and confidence,
    platforms, and the first four sources. text, title, summary, n_comments and transcript are read."""
    hits = term_sources(sources, terms, F.concat_ws(" ", "title", "summary", F.substring("transcript", 1, 420)))
    base = hits.withColumn("p", t.has_any("text", positive)).withColumn("r", t.has_any("text", risk))
    first = top_by(base, ["run_id", "term"], [F.col("source_id")], 4, "nth").groupBy("run_id", "term").agg(F.sort_array(F.collect_list("source_id")).alias("evidence"))
    agg = base.groupBy("run_id", "term").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("p").alias("np"), F.count_if("r").alias("nr"), F.count_if(F.col("n_comments") > 0).alias("comment_sources"),
        F.count_if(~blank("transcript")).alias("transcript_sources"), F.sort_array(F.collect_set("platform")).alias("platforms"),
    )
    five = lambda x: F.least(F.lit(5), x).cast("int")
    return agg.join(first, ["run_id", "term"]).select(
        "run_id", "term", "n", five(2 + F.col("np")).alias("support"), five(2 + F.col("nr")).alias("risk"),
        five(1 + F.size("evidence") + F.when(F.col("comment_sources") > 0, 1).otherwise(0)).alias("confidence"), "comment_sources", "transcript_sources", "platforms", "evidence",
    )


def risk_bullets(sources: DataFrame, risks: DataFrame, most: int = 4, cited: int = 3) -> DataFrame:
    """run_id, term, citations: for a run's first risks up to three sources that hold the word, else its first two."""
    chosen = risks.where(F.col("rank") <= most)
    # Whatever columns go through the scan travel with its hits.
    hits = top_by(term_sources(sources.select("run_id", "source_id", "title", "summary"), chosen, F.concat_ws(" ", "title", "summary")), ["run_id", "term"], [F.col("source_id")], cited, "nth")
    own = hits.groupBy("run_id", "term").agg(F.sort_array(F.collect_list("source_id")).alias("own"))
    first = top_by(sources.select("run_id", "source_id"), ["run_id"], [F.col("source_id")], 2, "nth").groupBy("run_id").agg(F.sort_array(F.collect_list("source_id")).alias("first"))
    return chosen.join(own, ["run_id", "term"], "left").join(first, "run_id", "left").select("run_id", "term", "rank", F.coalesce("own", "first").alias("citations"))


# ---- blocks: (run_id, section_id, block_type, pos, text, citations) ------------------------------------------------

CLAIM_SECTIONS = ("answer", "narrative", "consensus_disagreement")


def citations_of(blocks: DataFrame) -> DataFrame:
    """run_id, source_id: a row for each citation in a block."""
    return blocks.select("run_id", F.explode("citations").alias("source_id"))


def citation_counts(sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """sources with citation_count; cited ones get the status 'cited'."""
    n = citations_of(blocks).groupBy("run_id", "source_id").agg(F.count(F.lit(1)).alias("citation_count"))
    out = sources.drop("citation_count").join(n, ["run_id", "source_id"], "left").fillna(0, ["citation_count"])
    return out.withColumn("status", F.when(F.col("citation_count") > 0, "cited").otherwise(F.col("status")))


def citation_validity(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations of each run, and how many mean one of its sources."""
    cited = citations_of(blocks).join(sources.select("run_id", "source_id", F.lit(1).alias("known")), ["run_id", "source_id"], "left")
    return cited.groupBy("run_id").agg(F.count(F.lit(1)).alias("citations"), F.count("known").alias("valid"))


def uncited_blocks(blocks: DataFrame) -> DataFrame:
    """Takeaways, bullets and claim sections' bodies of each run that have text but no citation; a body is excused
    by citations anywhere in its section."""
    in_section = Window.partitionBy("run_id", "section_id")
    rows = blocks.withColumn("section_cites", F.sum(F.size("citations")).over(in_section))
    bare = (F.coalesce("text", F.lit("")) != "") & F.when(F.col("block_type") == "body", F.col("section_id").isin(*CLAIM_SECTIONS) & (F.col("section_cites") == 0)).otherwise(F.col("block_type").isin("takeaway", "bullet") & (F.size("citations") == 0))
    return rows.groupBy("run_id").agg(F.count_if(bare).alias("uncited"))


def outline(blocks: DataFrame) -> DataFrame:
    """run_id, section_id, label (title without its number), summary (80 characters), source_ids, n."""
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_set("citations"))))
    agg = blocks.groupBy("run_id", "section_id").agg(F.max(F.when(F.col("block_type") == "title", F.col("text"))).alias("title"), F.max(F.when(F.col("block_type") == "body", F.col("text"))).alias("body"), ids.alias("source_ids"))
    summary = F.when(F.length("body") > 80, F.concat(F.substring("body", 1, 80), F.lit("..."))).otherwise(F.col("body"))
    return agg.select("run_id", "section_id", F.regexp_replace("title", r"^\d+\.\s*", "").alias("label"), summary.alias("summary"), "source_ids", F.size("source_ids").alias("n"))


def report_blocks(coverage: DataFrame, words: DataFrame, bullets: DataFrame, top: DataFrame) -> DataFrame:
    """Blocks of the general layout: an answer with the run's first words, coverage figures, risk bullets, sources."""
    cols = ("run_id", "section_id", "block_type", "pos", "text", "citations")
    lead = top.where("rank <= 4").groupBy("run_id").agg(F.sort_array(F.collect_list("source_id")).alias("citations"))
    first = words.where("rank <= 3").groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ", ").alias("text"))
    answer = first.join(lead, "run_id", "left").select("run_id", F.lit("answer").alias("section_id"), F.lit("body").alias("block_type"), F.lit(0).alias("pos"), "text", F.coalesce("citations", F.array().cast("array<bigint>")).alias("citations"))
    figures = F.concat(F.col("sources").cast("string"), F.lit(" sources, "), F.col("platforms").cast("string"), F.lit(" platforms, "), F.col("comments").cast("string"), F.lit(" comments"))
    cover = coverage.select("run_id", F.lit("coverage").alias("section_id"), F.lit("body").alias("block_type"), F.lit(0).alias("pos"), figures.alias("text"), F.array().cast("array<bigint>").alias("citations"))
    risk = bullets.select("run_id", F.lit("risks").alias("section_id"), F.lit("bullet").alias("block_type"), F.col("rank").alias("pos"), F.concat(F.lit("Check '"), "term", F.lit("'")).alias("text"), F.col("citations"))
    shown = top.select("run_id", F.lit("sources").alias("section_id"), F.lit("takeaway").alias("block_type"), F.col("rank").alias("pos"), F.col("title").alias("text"), F.array("source_id").alias("citations"))
    out = answer.unionByName(cover).unionByName(risk).unionByName(shown)
    return out.select(*cols)


def score_label(x: Column) -> Column:
    return F.when(x >= 80, "strong").when(x >= 55, "medium").when(x >= 30, "weak").otherwise("insufficient")


def risk_label(x: Column) -> Column:
    return F.when(x >= 80, "low risk").when(x >= 55, "medium risk").when(x >= 30, "high risk").otherwise("very high risk")


def report_quality(coverage: DataFrame, validity: DataFrame, uncited: DataFrame, strength: DataFrame) -> DataFrame:
    """Four scores of each run from 0 to 100 and their mean.

    coverage: run_confidence() with status; validity, uncited: as above; strength: run_id, evidence (mean evidence
    score of the cited sources, or of all), channels (those with comments plus those with transcripts), n.
    """
    rows = coverage.join(validity, "run_id", "left").join(uncited, "run_id", "left").join(strength, "run_id", "left").fillna(0, ["citations", "valid", "uncited", "evidence", "channels", "n"])
    col = F.col
    cover = F.least(F.lit(100), F.least(F.lit(35), 4 * col("sources")) + F.least(F.lit(25), 8 * col("platforms")) + F.least(F.lit(20), col("comments")) + F.least(F.lit(20), 8 * col("with_transcripts")))
    hundred = lambda x: F.greatest(F.lit(0), F.least(F.lit(100), x)).cast("int")
    share = F.bround(col("valid") / F.greatest(F.lit(1), col("citations")) * 100, 0)
    citation = hundred(share - 8 * col("uncited") - 15 * (col("citations") - col("valid")))
    strong = F.when(col("n") == 0, 0).otherwise(F.least(F.lit(100), F.bround(col("evidence") * 1.6 + col("channels") * 8 + F.least(F.lit(20), 2 * col("n")), 0))).cast("int")
    out = rows.withColumns({"coverage_score": cover.cast("int"), "citation_score": citation, "strength_score": strong})
    base = F.bround(col("strength_score") * 0.35 + col("coverage_score") * 0.25 + col("citation_score") * 0.4, 0)
    less = F.when(col("confidence").isin("low", "insufficient"), 10).otherwise(0) + F.when(col("status").isin("partial", "failed"), 8).otherwise(0)
    out = out.withColumn("safety_score", hundred(base - less))
    overall = F.bround((col("coverage_score") + col("citation_score") + col("strength_score") + col("safety_score")) / 4, 0).cast("int")
    return out.select("run_id", "coverage_score", "citation_score", "strength_score", "safety_score", overall.alias("overall"), score_label(col("strength_score")).alias("strength_label"), risk_label(col("safety_score")).alias("risk_label"))


def quotes(sources: DataFrame) -> DataFrame:
    """source_id, quote: the first comment, else the transcript, else a sentence with the title; 160 characters."""
    return sources.select("source_id", F.coalesce(F.substring(F.nullif(F.get("comments", F.lit(0)), F.lit("")), 1, 160), F.substring(F.nullif("transcript", F.lit("")), 1, 160), F.concat("title", F.lit(" is a top-ranked source in this run; open it to verify context."))).alias("quote"))


def markdown_rows(sources: DataFrame, columns: list[str]) -> DataFrame:
    """run_id, markdown: a table of a run's sources in display order; bars are escaped, line ends blanked."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns)), F.lit(" |"))
    return sources.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("display_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("markdown"))
