"""Column functions and operators on small examples, CJK ones included."""

import datetime

import pytest
from pyspark.sql import functions as F

from sourcewell.functions import citations, text, times, urls
from sourcewell.operators import collect, coverage, decision, evidence, grounding, storage


def one(spark, value, x="x"):
    return spark.createDataFrame([(x,)], "x string").select(value.alias("v")).first().v


@pytest.mark.parametrize(
    ("x", "expected"),
    [("Sony WH-1000XM5 降噪", ["Sony", "WH-1000XM5", "降噪"]), ("降噪耳机推荐", ["降噪耳机推荐", "降噪", "噪耳", "耳机", "机推", "推荐"]), ("a 一 b", ["a", "b"]), ("", [])],
)
def test_tokens(spark, x, expected):
    assert one(spark, text.tokens("x"), x) == expected


def test_terms(spark):
    assert one(spark, F.array_sort(text.terms("x")), "Phone A 续航长 好 phone") == sorted(["phone", "a", "续航", "航长", "好"])
    assert one(spark, text.terms("x"), None) == []


def test_text_helpers(spark):
    assert one(spark, text.strip_html("x"), "<p>a <b>b</b>\n c</p>") == "a b c"
    assert one(spark, text.html_text("x"), "<script>x<1</script><p>a</p><style>p{}</style>") == "a"
    assert one(spark, text.first_nonempty("x", F.lit("y")), " 　") == "y"
    assert one(spark, text.excerpt(["x", F.lit(None), F.lit(" b  c ")], 6), " a\n") == "a b c"
    assert one(spark, text.occurrences("x", "aa"), "aaaaa") == 2
    assert one(spark, text.has_negation("x"), "I know") and not one(spark, text.has_negation("x", word_boundary=True), "I know")
    assert one(spark, text.has_negation("x", word_boundary=True), "这个不好")
    assert one(spark, text.sentences("x"), "好。 Bad! ok\nnew") == ["好。", "Bad!", "ok", "new"]
    assert one(spark, F.transform(text.chunks("x", 4, 10, 8), F.length), "一二三四五六七八九十十一") == [4, 4, 2]
    assert [one(spark, text.first_number("x"), v) for v in ("1.2万", "3亿", "12k", "赞 45", "None")] == [12000, 300000000, 12000, 45, None]
    assert one(spark, text.slug("x"), "a b/中 文!") == "a-b-中-文"


@pytest.mark.parametrize(("x", "kind"), [("降噪耳机品类市场机会", "business"), ("2000左右降噪耳机推荐", "decision"), ("A vs B", "comparison"), ("why is the sky blue", "explainer"), ("weather", "general")])
def test_report_kind(spark, x, kind):
    assert one(spark, text.report_kind("x"), x) == kind


def test_addresses(spark):
    key = lambda p, u, compat=False: one(spark, urls.dedupe_key(F.lit(p), "x", F.lit("<b>T</b>"), compat), u)
    assert key("youtube", "https://www.youtube.com/watch?v=AbC&t=1") == "youtube:https://www.youtube.com/watch?v=AbC"
    assert key("youtube", "https://www.youtube.com/watch?v=AbC", True) == "youtube:https://www.youtube.com/watch"
    assert key("weibo", "HTTPS://W.com/a//?q") == "weibo:https://w.com/a" and key("weibo", "") == "weibo:title:t"
    assert one(spark, urls.host("x"), "https://www.a.b/c") == "a.b"
    assert one(spark, urls.video_id("x"), "https://youtu.be/dQw4w9WgXcQ?t=1") == "dQw4w9WgXcQ"
    found = one(spark, urls.object_of(F.lit("zhihu"), "x"), "https://www.zhihu.com/question/1/answer/22")
    assert (found.kind, found.id) == ("answer", "22")


def test_times(spark):
    assert one(spark, F.unix_timestamp(times.from_rfc2822("x")), "Sat Dec 23 17:12:54 +0800 2023") == 1703322774
    assert one(spark, times.clock_to_ms("x"), "13:22") == 802000 and one(spark, times.clock_to_ms("x"), "1:61:00") is None
    assert one(spark, times.ms_to_clock(F.lit(3_725_000))) == "01:02:05"
    assert one(spark, times.published("x"), "2024") == datetime.datetime(2024, 1, 1)
    assert one(spark, times.published("x"), "2024-05-06T07:08:09Z") == datetime.datetime(2024, 5, 6, 7, 8, 9)
    assert one(spark, times.published("x"), "yesterday") is None


def test_citations(spark):
    c = one(spark, citations.parse_citation("x"), "[BILIBILI:BVxxxx@13:22-13:39]")
    assert (c.kind, c.start_ms, c.end_ms, c.object_id) == ("timestamp", 802000, 819000, "BVxxxx")
    assert one(spark, citations.link(citations.parse_citation("x")), "[BILIBILI:BVxxxx@13:22-13:39]").endswith("?t=802")
    assert "comment_id=123456" in one(spark, citations.link(citations.parse_citation("x")), "[DOUYIN:7340000000000000000/comment/123456]")
    assert one(spark, citations.format_citation(F.lit("bilibili"), F.lit("BVxxxx"), F.lit(802000), F.lit(819000))) == "[BILIBILI:BVxxxx@13:22-13:39]"
    assert [one(spark, citations.parse_citation("x"), v).kind for v in ("[X:1]", "[X:1/frame/7/ocr]", "[X:1@9:00-8:00]", "x", None)] == ["source", "frame", "invalid", "invalid", "invalid"]


def test_strong_evidence(spark):
    rows = [("battery lasts full workday office use", "speech", "2026-07-10", True, True, 0.94, True, 0.9, "maker")]
    df = spark.createDataFrame(rows, "title string, modality string, published string, has_hash boolean, has_location boolean, asr_confidence double, verified boolean, independence double, creator string")
    got = evidence.evidence_quality(df, "2026-07-01", "2026-07-17", "battery lasts full workday office use").first()
    assert got.label == "Strong" and len(got.dimensions) == 7 and got.dimensions.freshness == "strong"


def test_claims_support_contradict_insufficient(spark):
    claims = spark.createDataFrame([(1, "Phone A battery life is stable", ["u1"]), (2, "Phone A battery life is stable", ["u2"]), (3, "Laptop B weighs one kilogram", ["u1"])], "claim_id long, claim_text string, unit_ids array<string>")
    units = spark.createDataFrame([("u1", "Phone A battery life is stable in long-term testing."), ("u2", "Phone A battery life is not stable under heavy use.")], "unit_id string, text string")
    links = spark.createDataFrame([], "claim_id long, unit_id string, relation string")
    got = {r.claim_id: r for r in grounding.verify(claims, units, links).collect()}
    assert [got[i].relation for i in (1, 2, 3)] == ["support", "contradict", "insufficient"] and got[3].needs_review
    judged = grounding.verify(claims, units, links, lambda pdf: pdf[["claim_id"]].head(1), "claim_id long")
    assert judged.count() == 3


def test_overlap_prefix_filter_loses_nothing(spark):
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    claims = [(i, " ".join(rng.sample(words, rng.randint(1, 12)))) for i in range(40)]
    units = [(i, " ".join(rng.sample(words, rng.randint(1, 20)))) for i in range(60)]
    got = {(r.claim_id, r.unit_id) for r in grounding.claim_overlap(spark.createDataFrame(claims, "claim_id long, claim_text string"), spark.createDataFrame(units, "unit_id long, text string")).collect()}
    assert got == {(i, j) for i, c in claims for j, u in units if len(set(c.split()) & set(u.split())) / len(set(c.split())) >= 0.3}


def test_gate_and_gaps(spark):
    s = spark.createDataFrame([(1, 1, "bilibili", "Phone A is fine", "", "", "", 0)], "run_id long, source_id long, platform string, title string, summary string, transcript string, url string, n_comments int").withColumn("comment_text", F.lit(""))
    plan = spark.createDataFrame([(1, ["bilibili", "youtube"], ["Phone A"], ["review"])], "run_id long, platforms array<string>, entities array<string>, intents array<string>")
    gate = coverage.block_synthesis(coverage.coverage_gate(s, plan), F.lit(False))
    assert gate.first().blocked and "platform:youtube" in coverage.coverage_gaps(gate).first().gaps


def test_candidates_and_dimensions(spark):
    rows = [
        (1, 1, "youtube", "Sony WH-1000XM5 降噪测评", "Sony WH-1000XM5 降噪很强。佩戴舒适，音质清晰。", 40, "c"),
        (1, 2, "bilibili", "Bose QC45 review", "Bose QC45 降噪稳定，音质一般。佩戴舒适。", 40, "c"),
        (1, 3, "zhihu", "Sony WH-1000XM5 和 Bose QC45", "Sony WH-1000XM5 音质 优秀。佩戴 久了闷。", 20, "c"),
        (1, 4, "weibo", "森海塞尔 Momentum 4 音质", "森海塞尔 Momentum 4 音质好，降噪弱", 20, "c"),
    ]
    s = spark.createDataFrame(rows, "run_id long, source_id long, platform string, title string, body string, evidence_score int, creator string").withColumn("text", F.concat_ws(" ", "title", "body"))
    m = decision.candidate_mentions(s)
    chosen = decision.candidates(s, m)
    assert chosen.count() >= 3
    terms = {r.term for r in decision.dimensions(s, chosen, n=30).collect()}
    assert terms & {"降噪", "音质", "佩戴"} and "拍照" not in terms
    grid = decision.dimension_matrix(s, m, chosen, decision.dimensions(s, chosen), decision.contradictions(s, decision.dimensions(s, chosen)))
    assert grid.where("n < 1").count() == 0 and decision.recommendation(chosen, grid).where("pick = 'primary'").count() == 1


def test_upsert_is_idempotent_and_snapshots_fail_closed(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 10, 10), (2, "b", 20, 20)], "id long, v string, add_ts long, last_modify_ts long")
    assert sorted(map(tuple, storage.upsert_snapshot(base, base, ["id"]).collect())) == sorted(map(tuple, base.collect()))
    storage.write_generation({"source": base}, str(tmp_path))
    storage.write_generation({"source": base.where("id = 1")}, str(tmp_path))
    assert [r.id for r in storage.read_generation(spark, str(tmp_path), "source", "id long, v string, add_ts long, last_modify_ts long").collect()] == [1]
    bad = storage.payload_rows(base, "source").withColumn("payload", F.lit("{}"))
    with pytest.raises(Exception, match="fails its check"):
        storage.check_snapshot(bad, "source").collect()


def test_dedupe_is_idempotent(spark):
    s = spark.createDataFrame([(1, i, "weibo", f"http://a/{i % 3}?x={i}", "t") for i in range(9)], "run_id long, source_id long, platform string, url string, title string")
    once = collect.dedupe_sources(s).drop("dedupe_key")
    assert sorted(r.source_id for r in once.collect()) == [0, 1, 2]
    assert sorted(map(tuple, collect.dedupe_sources(once).drop("dedupe_key").collect())) == sorted(map(tuple, once.collect()))
