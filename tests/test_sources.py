"""Scans and sinks over files written here."""

import json

from versewise.sources import lyrics, records, sinks


def test_lrc(spark, tmp_path):
    (tmp_path / "song.lrc").write_bytes("﻿[ti:Own]\r\n[offset:+125]\r\n[00:10.50][00:20.5]Again\r\n|and again\r\n\r\n[00:12.00]\r\n[00:05]First <00:05>wo<00:05.5>rd<00:06>\r\n[00:20.5]Again\r\n|and again\r\n".encode())
    rows = lyrics.read_lrc(spark, str(tmp_path)).orderBy("entry_idx").collect()
    assert [(r.begin_us, r.text, r.supplied_breaks) for r in rows] == [(5125000, "First word", False), (10625000, "Again\nand again", True), (12125000, "", False), (20625000, "Again\nand again", True)]
    assert [tuple(s) for s in rows[0].segments] == [(0, 2, 5125000, 5625000), (2, 2, 5625000, 6125000)]


def test_ttml(spark, tmp_path):
    body = '<tt xmlns="http://www.w3.org/ns/ttml" xmlns:ttm="http://www.w3.org/ns/ttml#metadata"><body><div><p begin="10s" end="15s" ttm:agent="v2"><span begin="0s" end="1s">one </span><span begin="1s" dur="2s">two</span><span ttm:role="x-bg" begin="3s" end="4s">ooh</span></p><p begin="00:00:20.0" dur="2s">plain</p></div></body></tt>'
    (tmp_path / "song.ttml").write_text(body)
    a, b = lyrics.read_ttml(spark, str(tmp_path)).orderBy("entry_idx").collect()
    assert (a.begin_us, a.end_us, a.text, a.second_voice, a.background.text) == (10000000, 15000000, "one two", True, "ooh")
    assert [(s.begin_us, s.end_us) for s in a.segments] == [(10000000, 11000000), (11000000, 13000000)]
    assert (b.begin_us, b.end_us, b.text, b.background) == (20000000, 22000000, "plain", None)


def test_plain_and_sections(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n\n\nthree\n")
    assert [(r.source_line, r.paragraph, r.text) for r in lyrics.read_plain(spark, str(tmp_path)).orderBy("source_line").collect()] == [(1, 0, "one"), (2, 0, "two"), (5, 2, "three")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.sec").write_text("* 00:10 00:20 a some words\n01:00 01:05 d dropped\n00:30 00:40 b more\n")
    rows = records.read_sections(spark, str(tmp_path / "s")).orderBy("start_us").collect()
    assert [(r.star, r.start_us, r.end_us, r.kind, r.text) for r in rows] == [(True, 10000000, 20000000, "a", "some words"), (False, 30000000, 40000000, "b", "more")]
    assert sinks.section_text(records.read_sections(spark, str(tmp_path / "s"))).first().lyrics == "some words\nmore"


def test_artifacts(spark, tmp_path):
    for name, text in {"good": '{"a": 1}', "twice": '{"a": 1, "a": 2}', "broken": "{"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    good, bad = records.read_artifacts(spark, str(tmp_path), "a int")
    assert [tuple(r) for r in good.collect()] == [("good", 1)]
    assert {(r.recording_id, r.rule_id) for r in bad.collect()} == {("twice", "invalid_json"), ("broken", "invalid_json")}


def test_recognition(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"result": {"language": "en"}, "transcription": [{"text": "hi", "offsets": {"from": 100, "to": 400}, "tokens": [{"text": "h", "offsets": {"from": 100, "to": 200}}, {"text": "i", "offsets": {"from": 300, "to": 200}}]}, {"text": "[noise]", "offsets": {"from": 900, "to": 99000}, "tokens": []}]}))
    windows = spark.createDataFrame([("r", 1_000_000, 5_000_000)], "recording_id string, begin_us long, end_us long")
    segments = records.read_recognition(spark, str(tmp_path))
    a, b = records.word_observations(segments, windows).orderBy("segment").collect()
    assert (a.begin_tick, a.end_tick, a.reason, a.uncertainty) == (110, 140, None, [])
    assert (b.reason, b.uncertainty) == ("out_of_window", ["bracketed"])
    assert records.segment_observations(segments, windows).orderBy("segment").first().timing == {"valid": 1, "invalid": 1}


def test_frozen_thresholds_refuse_other_rows(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.7)], "id int, score double")
    record = sinks.frozen_record(rows, spark.createDataFrame([(0.6,)], "threshold double"), ["id", "score"])
    assert sinks.require_fitted(rows.repartition(3), record, ["id", "score"]).count() == 2
    assert sinks.require_fitted(rows.limit(1), record, ["id", "score"]).count() == 0


def test_daily_upsert(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "day string, observed_at int, count int")
    got = sinks.upsert_daily(rows(("a", 1, 5), ("b", 1, 6)), rows(("a", 2, 7)))
    assert sorted(map(tuple, got.collect())) == [("a", 2, 7), ("b", 1, 6)]
