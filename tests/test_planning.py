"""Questions to plans, responses to tables, noisy inputs to rows."""

import json

from pyspark.sql import functions as F

from sourcewell.operators import planner, responses
from sourcewell.sources import io


def test_question_analysis(spark):
    q = spark.createDataFrame([(1, "小米 14 和华为 Pura 70 最近3个月评测对比与吐槽")], "question_id long, query string")
    a = planner.analyze(q)
    r = a.first()
    assert r.time_range == "最近3个月" and {"comparison", "complaint"} <= set(r.intents) and len(r.comparisons) == 2
    rows = {x.platform: x for x in planner.targets(a).collect()}
    assert (rows["youtube"].limit, rows["youtube"].detail_limit, rows["zhihu"].limit, rows["zhihu"].detail_limit) == (20, 6, 12, 2)
    assert rows["zhihu"].provider == "crawler" and rows["youtube"].provider == "opencli"
    assert 2 <= len(planner.expand(a).first().queries) <= 6
    assert set(planner.plan_specs(planner.targets(a)).first().platform_queries) == set(rows)


def frame(spark, payload, allowed=tuple(range(1, 21))):
    return spark.createDataFrame([(1, payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False), list(allowed))], "run_id long, payload string, allowed array<bigint>")


def test_selection_keeps_the_returned_order(spark):
    sources = spark.createDataFrame([(1, i) for i in range(1, 21)], "run_id long, source_id long")
    for payload in ({"selectedSourceIds": [18, 3, 12, 99, 3]}, {"items": ["18", {"id": 3}, 12]}):
        got = responses.selected_sources(frame(spark, payload), sources).orderBy("position").collect()
        assert [r.source_id for r in got] == [18, 3, 12]


def test_responses(spark):
    p = {
        "takeaways": [{"text": " a ", "citations": [1, "2", 99]}, {"text": ""}, "x"], "insights": [{"label": "l", "kind": "odd", "confidence": 9}], "sections": [{"title": "t", "body": "b"}, {"title": "t"}], "warnings": ["w" * 300, " "],
        "evidence": [{"sourceId": 3, "dimension": "d", "conclusion": "c", "model": "m"}, {"sourceId": 99, "dimension": "d", "conclusion": "c"}], "products": {"P": {"D": [{"conclusion": "c", "sources": [4]}, {"conclusion": "c"}]}},
        "contradictions": {"D": {"contradictory": True, "reason": "r"}, "E": 3}, "table": [{"name": "n", "lowLight": 5, "camera": "x"}],
    }
    df = frame(spark, p)
    assert [(r.text, r.citations) for r in responses.takeaways(df).collect()] == [("a", [1, 2])]
    assert [(r.kind, r.confidence) for r in responses.insights(df).collect()] == [("consensus", 5)]
    assert responses.sections(df).count() == 1 and len(responses.warnings(df).first().text) == 240
    assert [(r.candidate, r.source_id) for r in responses.semantic_evidence(df).collect()] == [("m", 3)]
    assert [(r.product, r.source_ids) for r in responses.decision_products(df).collect()] == [("P", [4])]
    assert [(r.dimension, r.contradictory, r.reason) for r in responses.contradiction_notes(df).collect()] == [("D", True, "r")]
    assert [(r.support, r.confidence) for r in responses.table_rows(df).collect()] == [(5, 1)]


def test_response_text_and_json(spark):
    rows = [('plain {"a":1} tail',), (json.dumps([{"text": '{"a"'}, ":1}"]),), ('{"text":"[1,2]"}',), ("nothing",)]
    df = spark.createDataFrame(rows, "content string").select(responses.response_json(responses.response_text()).alias("v"))
    assert [r.v for r in df.collect()] == ['{"a":1}', '{"a":1}', '{"items":[1,2]}', None]


def test_token_use_and_prompt_packs(spark):
    calls = spark.createDataFrame([(1, 100), (1, None), (1, -5)], "run_id long, tokens int")
    assert tuple(responses.token_use(calls).first()) == (1, 3, 100, 7)
    s = spark.createDataFrame([(1, 2, "zhihu", "T", "c", "s", "x" * 5000)], "run_id long, source_id long, platform string, title string, creator string, summary string, transcript string")
    pack = json.loads(responses.prompt_packs(s).first().payload)
    assert [len(c) for c in pack["transcriptChunks"]] == [1600, 1600, 1600, 200] and len(pack["fullTranscript"]) == 4000
    m = spark.createDataFrame([({f"k{i}": "v" * 200 for i in range(9)} | {"a": ""},)], "metrics map<string,string>").select(responses.compact_metrics().alias("m")).first().m
    assert len(m) == 6 and max(map(len, m.values())) == 120


def test_noisy_inputs(spark, tmp_path):
    df = spark.createDataFrame([('log [bad {"a": [1]} x',), (None,)], "text string")
    assert [r.first_json for r in io.first_json(df).collect()] == ['{"a": [1]}', None]
    env = spark.createDataFrame([('{"data":{"items":[{"x":1},2,{"x":3}]}}',), ('[{"x":5}]',)], "payload string")
    assert sorted(r.item for r in io.unwrap(env).collect()) == ['{"x":1}', '{"x":3}', '{"x":5}']
    caps = spark.createDataFrame([('{"events":[{"tStartMs":5,"dDurationMs":7,"segs":[{"utf8":"a "},{"utf8":"b"}]},{"tStartMs":9}]}',)], "content string")
    assert [(r.text, r.start_ms, r.end_ms) for r in io.json3_captions(caps).collect()] == [("a b", 5, 12)]
    vtt = spark.createDataFrame([("WEBVTT\n\n1\n00:01 --> 00:02\n<c>hi</c>\n\nyou",)], "content string")
    assert [r.text for r in io.vtt_captions(vtt).collect()] == ["hi", "you"]
    tracks = spark.createDataFrame([(1, "en", "vtt"), (1, "zh", "vtt"), (1, "zh", "json3")], "source_id long, lang string, ext string")
    assert tuple(io.pick_track(tracks, ["zh", "en"]).first()) == (1, "zh", "json3")
    page = spark.createDataFrame([('<script>window.__S__={"a":undefined,"b":1};</script><script id="d" type="x">{"c":2}</script>',)], "html string")
    assert io.page_state(page, "__S__").first().state == '{"a":null,"b":1}' and io.page_script(page, "d").first().state == '{"c":2}'


def test_crawl_files_and_formats(spark, tmp_path):
    d = tmp_path / "weibo" / "jsonl"
    d.mkdir(parents=True)
    (d / "search_contents_2026-01-01.jsonl").write_text('{"id":1}\n\nbroken\n')
    (d / "search_contents_2026-01-02.jsonl").write_text('{"id":2}\n')
    got = io.read_crawl(spark, str(tmp_path), "weibo", "id long")
    assert sorted(r.id for r in got.where("id is not null").collect()) == [1, 2]
    assert [r.id for r in io.read_crawl(spark, str(tmp_path), "weibo", "id long", limit=1).collect()] == [2]
    df = spark.createDataFrame([(1, "a,\"b"), (2, "c")], "id long, v string")
    for kind in ("jsonl", "csv", "parquet", "orc"):
        io.save(df, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).where("v = 'a,\"b'").count() == 1
    assert io.find(df, {"id": 2}).count() == 1


def test_selection_in_parts_without_a_list_of_allowed_ids(spark):
    sources = spark.createDataFrame([(run, i) for run in (1, 2) for i in range(100)], "run_id long, source_id long")
    parts = [(1, 1, '{"selectedSourceIds": [7, 500, 9, 3]}'), (1, 0, '{"items": [50, 3, {"id": 4}]}'), (2, 0, '{"items": 8}'), (2, 1, None)]
    got = responses.selected_sources(spark.createDataFrame(parts, "run_id long, part int, payload string"), sources)
    assert sorted(tuple(r) for r in got.select("run_id", "position", "source_id").collect()) == [(1, 0, 50), (1, 1, 3), (1, 2, 4), (1, 3, 7), (1, 4, 9), (2, 0, 8)]
