from sourcewell.plans import research


def test_decisions_read_past_the_opening(spark, tmp_path):
    filler = "plain words that say nothing of note and go on. " * 40
    rows = [(10 * i, f"{filler} Sony WH-1000XM5 has superb zoomrange.", "en", "s", 0) for i in range(1, 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert 600 < len(filler) < 5900
    assert [(r.key, r.n_sources) for r in research.candidates(spark, str(tmp_path)).collect()] == [("sonywh1000xm5", 3)]
